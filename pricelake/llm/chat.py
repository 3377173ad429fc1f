"""Chat formatting: a finite-state machine over roles and a declarative template.

A template names the strings around each turn, the escape character and the roles whose text counts in the loss.
Every turn becomes three segments: an opening and a closing control segment without loss, and the escaped text between
them with the role's loss flag. Inside texts and role names the escape character is put before itself and before the
first character of any control string, so a control string can't occur in a text and the reading is exact.

Defined cases: null text and null role are empty; turns go by number, null last, ties by role, then text; an
unknown role is formatted too, with ``violation`` naming what the machine refused; an empty table gives none.
A conversation is read in one pass as a stream of rows, so its length is bounded by no task's memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Template:
    open_turn: str = "### "
    open_text: str = ":\n"
    close_turn: str = "</turn>\n"
    escape: str = "\\"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: From the state before a turn (the last role, or the start) to the roles that may follow.
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: tuple[str, ...] = ("assistant",)

    @property
    def special(self) -> str:
        return "".join(dict.fromkeys(self.escape + self.open_turn[0] + self.open_text[0] + self.close_turn[0]))


DEFAULT = Template()
SEGMENTS = "conv_id long, part long, kind string, text string, loss boolean, violation string"


def segments(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """conversations (conv_id, turn, role, text) to rows (conv_id, part, kind, text, loss, violation), three per turn.

    ``violation`` stands on a turn's opening segment if the role may not follow, and on the last closing segment if the
    conversation may not end there.
    """
    turns = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["conv_id", F.col("turn").asc_nulls_last(), "role", "text"]
    return turns.repartition("conv_id").sortWithinPartitions(*order).mapInPandas(lambda batches: _format(batches, template), SEGMENTS)


def _format(batches: Iterator[pd.DataFrame], t: Template) -> Iterator[pd.DataFrame]:
    escaped = re.compile(f"[{re.escape(t.special)}]")
    put = lambda s: escaped.sub(lambda m: t.escape + m[0], s)
    held: list[tuple] = []  # the closing segment of the last turn, until it is known whether another follows
    at, state, part = object(), "", 0
    for batch in batches:
        out: list[tuple] = []
        for conv, role, text in zip(batch["conv_id"].astype("Int64"), batch["role"], batch["text"], strict=True):
            conv = None if conv is pd.NA else int(conv)
            if conv != at:
                out += [(*row[:5], None if state in t.ends else f"ends after {state or 'nothing'}") for row in held]
                held, at, state, part = [], conv, "", 0
            out += held
            wrong = None if role in t.moves.get(state, ()) else f"{role or 'nothing'} after {state or 'the start'}"
            out.append((conv, part, "open", f"{t.open_turn}{put(role)}{t.open_text}", False, wrong))
            out.append((conv, part + 1, "text", put(text), role in t.loss_roles, None))
            held, state, part = [(conv, part + 2, "close", t.close_turn, False, None)], role, part + 3
        yield _frame(out)
    yield _frame([(*row[:5], None if state in t.ends else f"ends after {state or 'nothing'}") for row in held])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["conv_id", "part", "kind", "text", "loss", "violation"])
    return out.astype({"conv_id": "Int64", "part": "int64", "loss": "bool"})


class Reader:
    """Reads formatted text back, piece by piece, into (role, text) turns."""

    def __init__(self, t: Template):
        e = re.escape
        self.t, self.token = t, re.compile(f"{e(t.escape)}(?P<plain>.)|(?P<open>{e(t.open_turn)})|(?P<mid>{e(t.open_text)})|(?P<close>{e(t.close_turn)})", re.DOTALL)

    def unescape(self, s: str) -> str:
        return self.token.sub(lambda m: m["plain"] if m["plain"] is not None else m[0], s)

    def turns(self, formatted: str) -> Iterator[tuple[str, str]]:
        role, held, at = None, [], 0
        for m in self.token.finditer(formatted):
            held.append(formatted[at : m.start()])
            at = m.end()
            if m["plain"] is not None:
                held.append(m["plain"])
            elif m["mid"] is not None and role is None:
                role, held = "".join(held), []
            elif m["close"] is not None:
                yield role or "", "".join(held)
                role, held = None, []
            elif m["open"] is not None:
                role, held = None, []


def read_back(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """One row per conversation, from the segments alone: turns, digests of turns and of loss text, violations."""
    kinds = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_segments long, valid boolean, violation string"
    rows = formatted.select("conv_id", "part", "text", "loss", "violation")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInPandas(lambda batches: _read(batches, template), kinds)


def _read(batches: Iterator[pd.DataFrame], t: Template) -> Iterator[pd.DataFrame]:
    reader, held, at = Reader(t), None, object()
    done: list[tuple] = []

    def end() -> None:
        if held:
            done.append((at, held["n"], held["turns"].hexdigest(), held["chars"], held["loss"].hexdigest(), held["all"], held["parts"], held["wrong"] is None, held["wrong"]))

    for batch in batches:
        for conv, text, loss, wrong in zip(batch["conv_id"].astype("Int64"), batch["text"], batch["loss"], batch["violation"], strict=True):
            conv = None if conv is pd.NA else int(conv)
            if conv != at:
                end()
                at, held = conv, {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "all": 0, "parts": 0, "wrong": None, "open": []}
            held["all"] += len(text)
            held["parts"] += 1
            held["wrong"] = held["wrong"] or (None if pd.isna(wrong) else wrong)
            held["open"].append(text)
            if loss:
                plain = reader.unescape(text)
                held["chars"] += len(plain)
                held["loss"].update(plain.encode())
            if len(held["open"]) == 3:  # a whole turn: read it as one formatted text
                for role, said in reader.turns("".join(held["open"])):
                    held["n"] += 1
                    held["turns"].update(f"{role}\n{said}\n".encode())
                held["open"] = []
        yield _told(done)
        done = []
    end()
    yield _told(done)


def _told(rows: list[tuple]) -> pd.DataFrame:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_segments", "valid", "violation"]
    return pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64", "valid": "bool"} | dict.fromkeys(("n_turns", "loss_chars", "formatted_chars", "n_segments"), "int64"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return read_back(segments(turns)).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid", "violation")


QUERIES = {"op6_chat": op6_chat}

SQL = {
    "op6_chat": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
measured AS (
  SELECT *, length(text) + length(role)
            + length(regexp_replace(text || role, '[^\\#:<]', '', 'g'))
            + 4 + 2 + 8 AS chars FROM turns),
ordered AS (
  SELECT *, row_number() OVER w AS place, coalesce(lag(role) OVER w, '') AS before, lead(role) OVER w IS NULL AS is_last
  FROM measured WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text)),
judged AS (
  SELECT *, CASE WHEN NOT CASE before WHEN '' THEN role IN ('system', 'user') WHEN 'system' THEN role = 'user' WHEN 'user' THEN role = 'assistant' WHEN 'assistant' THEN role = 'user' ELSE false END
                 THEN coalesce(nullif(role, ''), 'nothing') || ' after ' || coalesce(nullif(before, ''), 'the start') END AS wrong,
            CASE WHEN is_last AND role <> 'assistant' THEN 'ends after ' || coalesce(nullif(role, ''), 'nothing') END AS wrong_end
  FROM ordered)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars,
       coalesce(min_by(wrong, place) FILTER (WHERE wrong IS NOT NULL), max(wrong_end)) IS NULL AS valid,
       coalesce(min_by(wrong, place) FILTER (WHERE wrong IS NOT NULL), max(wrong_end)) AS violation
FROM judged GROUP BY conv_id""",
}
