"""Personal data: candidate spans and gradient boosting, with DataFrame operations only.

Generators propose spans that may overlap: the four base patterns, and looser ones (written-out addresses, numbers without
a plus sign, other separators, colon-separated addresses). Base matches that pass their check are always kept. All
candidates get format and context features and a weak label (checks, form, words before them); boosted trees, trained on
these labels, score them; for each kind a threshold that reaches ``PRECISION`` on the loose candidates of documents held
back selects further spans.

The features are small integers, so training needs only the counts of the distinct feature rows (at most the product of
their ranges), which Spark sums over all documents. The trees become one SQL expression.

Defined cases: null text is empty and has no span; repeated rows get equal spans; too few loose
candidates of a kind held back, or labels all alike, add nothing to the base ones; an empty table gives none. Extra columns pass through ``redact``.
Patterns are possessive, or anchored where a match may start, so that long runs cost no more than their length.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, materialize, table

KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
#: (kind, is it a base pattern, what a text must have for the pattern to be tried, pattern)
GENERATORS = (
    (0, True, "@", rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    (1, True, r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    (2, True, r"[0-9][\x20-]?[0-9]", r"[0-9](?:[\x20-]?[0-9])++"),
    (3, True, r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
    (0, False, r"(?i)[\[(\x20]at[\])\x20]", rf"(?<![{LOCAL}])[{LOCAL}]++\x20?[\[(]\x20?(?i:at)\x20?[\])]\x20?[A-Za-z0-9-]++(?:(?:\x20?[\[(]\x20?(?i:dot)\x20?[\])]\x20?|\x20\.\x20|\.)[A-Za-z0-9-]++)++"),
    (1, False, r"[0-9A-Fa-f]:[0-9A-Fa-f]", r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Za-z:])"),
    (2, False, r"[0-9]{4}[._/][0-9]{4}", r"(?<![0-9A-Za-z._/])[0-9]{4}(?:[._/][0-9]{4}){2}[._/][0-9]{1,7}(?![0-9A-Za-z])"),
    (3, False, r"[0-9]{3}[\x20).-]", r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|00[0-9]{1,3}[\x20-]|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{3,4}(?![0-9A-Za-z])"),
)
CONTEXT = 24
HINT = r"(?i)(?:mail|phone|tel|call|fax|mobil|card|visa|credit|kart|ip|addr|host|contact)\b\W*$"
SECRET = r"(?i)(?:token|key|secret|password|hash|version|licen[cs]e|id)\b\W*$"
FEATURES = ("digits", "separators", "length", "before", "after", "hint", "secret", "shape", "sum", "base", "form")
PRECISION = 0.98
LEAST = 30
ROUNDS = 24
RATE = 0.3


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        x = F.substring(back, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, x * 2 - F.when(x > 4, 9).otherwise(0)).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add) % 10 == 0


def _passes(kind: int, m: Column) -> Column:
    digits = _digits(m)
    n = F.length(digits)
    if kind == 1:
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    if kind == 2:
        return F.when(n.between(12, 19), luhn(digits)).otherwise(False)
    return n.between(9, 15) if kind == 3 else F.lit(True)


def _formed(m: Column) -> Column:
    """Whether an address, its written-out signs put back, has a name, hosts and a top-level domain of letters."""
    plain = F.regexp_replace(m, r"(?i)\x20?[\[(]\x20?at\x20?[\])]\x20?", "@")
    plain = F.regexp_replace(plain, r"(?i)\x20?[\[(]\x20?dot\x20?[\])]\x20?|\x20\.\x20", ".")
    return F.rlike(plain, F.lit(r"^[A-Za-z0-9].*@[A-Za-z0-9].*\.[A-Za-z]{2,24}$|^[A-Za-z0-9]@[A-Za-z0-9].*\.[A-Za-z]{2,24}$")) & ~F.rlike(plain, F.lit(r"\.-|-\."))


def _label(kind: int, base: bool, m: Column, before: Column) -> Column:
    """The weak label of a candidate: numbers of a base pattern and all cards by their check, addresses by form, other loose
    numbers by a word before them that says what they are."""
    told, secret = F.rlike(before, F.lit(HINT)), F.rlike(before, F.lit(SECRET))
    if kind == 0:
        return _formed(m) & ~secret
    if base or kind == 2:
        return _passes(kind, m)
    return told & ~secret & (_passes(kind, m) if kind == 3 else F.lit(True))


def _spans(text: Column, kind: int, base: bool, needs: str, pattern: str) -> Column:
    """array<struct<start, end, kind, base, passes, m, before, after, label>> of one generator's matches.

    Starts are the summed lengths (in code points) of what stands between the matches and of the matches before.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    start = F.aggregate(
        F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("g"), F.coalesce(F.length(h), F.lit(0)).alias("h"))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda acc, x: F.struct((acc["at"] + x["g"] + x["h"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"] + x["g"])).alias("starts")),
        lambda acc: acc["starts"],
    )
    before = lambda x: F.substring(text, F.greatest(x["s"] - CONTEXT, F.lit(0)) + 1, F.least(x["s"], F.lit(CONTEXT)))
    spans = F.transform(
        F.filter(F.zip_with(hits, start, lambda h, s: F.struct(h.alias("m"), s.alias("s"))), lambda x: x["m"].isNotNull()),
        lambda x: F.struct(
            x["s"].alias("start"),
            (x["s"] + F.length(x["m"])).alias("end"),
            F.lit(kind).alias("kind"),
            F.lit(base).alias("base"),
            (_passes(kind, x["m"]) if base else F.lit(None).cast("boolean")).alias("passes"),
            x["m"].alias("m"),
            before(x).alias("before"),
            F.substring(text, x["s"] + F.length(x["m"]) + 1, F.lit(1)).alias("after"),
            _label(kind, base, x["m"], before(x)).alias("label"),
        ),
    )
    tried = F.contains(text, F.lit(needs)) if needs == "@" else F.rlike(text, F.lit(needs))
    return F.when(tried, spans).otherwise(F.array().cast("array<struct<start:int,end:int,kind:int,base:boolean,passes:boolean,m:string,before:string,after:string,label:boolean>>"))


def candidates(docs: DataFrame, keys: list[str | Column]) -> DataFrame:
    """``keys`` of docs and ``spans``, all candidates by start and kind. Only texts with a digit, an ``@`` or a written ``at``
    are searched, for every generator asks for one of these."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = F.array_sort(F.concat(*[_spans(text, *g) for g in GENERATORS]))
    none = F.array().cast("array<struct<start:int,end:int,kind:int,base:boolean,passes:boolean,m:string,before:string,after:string,label:boolean>>")
    return docs.select(*keys, F.when(F.rlike(text, F.lit(r"[0-9@]|(?i:[\[(]\x20?at\x20?[\])])|[A-Fa-f]:[A-Fa-f]")), found).otherwise(none).alias("spans"))


def _features(s: Column) -> list[Column]:
    """Small integers in the order of FEATURES."""
    m, digits = s["m"], _digits(s["m"])
    n = F.length(digits)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return [
        F.least(n, F.lit(24)),
        F.least(F.length(F.regexp_replace(m, "[0-9A-Za-z]", "")), F.lit(8)),
        F.least(F.floor(F.length(m) / 4), F.lit(12)).cast("int"),
        flag(F.rlike(s["before"], F.lit(r"[\p{L}0-9_=\"'/]$"))),
        flag(F.rlike(s["after"], F.lit(r"[\p{L}0-9_=\"'/]"))),
        flag(F.rlike(s["before"], F.lit(HINT))),
        flag(F.rlike(s["before"], F.lit(SECRET))),
        F.when(F.rlike(m, F.lit("[A-Za-z]")), 2).otherwise(0) + F.when(F.contains(m, F.lit("@")), 1).otherwise(0),
        flag(F.when(n.between(8, 24), luhn(digits))),
        flag(s["base"]),
        flag((s["kind"] == 0) & _formed(m)),
    ]


def training_counts(found: DataFrame, doc_id: Column) -> list[dict]:
    """Distinct feature rows with how many candidates had them, by weak label, for training and for calibration."""
    s = F.col("s")
    rows = found.select(doc_id.alias("_id"), F.explode("spans").alias("s"))
    named = [f.alias(n) for n, f in zip(FEATURES, _features(s), strict=True)]
    held = (fold(F.col("_id"), 5) == 0).cast("int").alias("held")
    seen = rows.select(s["kind"].alias("kind"), held, s["label"].cast("int").alias("y"), *named)
    return [r.asDict() for r in seen.groupBy("kind", "held", "y", *FEATURES).agg(F.count("*").alias("n")).orderBy("kind", "held", "y", *FEATURES).collect()]


def boost(rows: list[dict], rounds: int = ROUNDS, rate: float = RATE) -> list[tuple]:
    """Trees of two levels by second-order gradient boosting on counted rows: (feature, cut, (feature, cut, low, high) for either side)."""
    names = ("kind", *FEATURES)
    x = np.array([[r[f] for f in names] for r in rows], np.int64)
    n, y = np.array([r["n"] for r in rows], float), np.array([r["y"] for r in rows], float)
    score, trees = np.zeros(len(rows)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = n * (y - p), n * p * (1 - p)

        def leaf(idx: np.ndarray, g=g, h=h) -> float:
            return float(rate * g[idx].sum() / (h[idx].sum() + 1.0))

        def split(idx: np.ndarray, g=g, h=h) -> tuple[int, int]:
            best, total, weight = (0.0, 0, -1), g[idx].sum(), h[idx].sum()
            for f in range(len(names)):
                values, which = np.unique(x[idx, f], return_inverse=True)
                if len(values) > 1:
                    low, under = np.cumsum(np.bincount(which, g[idx]))[:-1], np.cumsum(np.bincount(which, h[idx]))[:-1]
                    gain = low**2 / (under + 1.0) + (total - low) ** 2 / (weight - under + 1.0) - total**2 / (weight + 1.0)
                    k = int(np.argmax(gain))
                    if gain[k] > best[0] + 1e-9:
                        best = (float(gain[k]), f, int(values[k]))
            return best[1:]

        every = np.arange(len(rows))
        f, cut = split(every)
        sides = []
        for side in (every[x[:, f] <= cut], every[x[:, f] > cut]):
            k, at = split(side)
            low, high = side[x[side, k] <= at], side[x[side, k] > at]
            sides.append((names[k], at, leaf(low), leaf(high)))
            score[low] += sides[-1][2]
            score[high] += sides[-1][3]
        trees.append((names[f], cut, *sides))
    return trees


def _value(trees: list[tuple], row: dict) -> float:
    total = 0.0
    for f, cut, low, high in trees:
        g, at, a, b = low if row[f] <= cut else high
        total += a if row[g] <= at else b
    return total


def fit(found: DataFrame, doc_id: Column) -> dict:
    """Trees, and for each kind the least score that reaches PRECISION on loose candidates of the documents held back (None: add nothing)."""
    rows = training_counts(found, doc_id)
    trees = boost([r for r in rows if not r["held"]]) if len({r["y"] for r in rows if not r["held"]}) == 2 else []
    cuts: list[float | None] = []
    for kind in range(len(KINDS)):
        own = sorted(((_value(trees, r), r["y"], r["n"]) for r in rows if r["held"] and r["kind"] == kind and not r["base"]), reverse=True)
        total, good, cut = 0, 0, None
        for k, (value, y, n) in enumerate(own):
            total, good = total + n, good + n * y
            whole = k + 1 == len(own) or own[k + 1][0] < value  # equal scores are taken or left together
            if whole and total >= LEAST and good >= PRECISION * total:
                cut = value - 1e-9  # Spark may add the trees up in another order
        cuts.append(cut if trees else None)
    return {"trees": trees, "cuts": cuts}


def _score(trees: list[tuple], s: Column) -> Column:
    """The trees' sum as an expression. The features are bound once, as fields of a one-row array."""
    names = ("kind", *FEATURES)

    def total(x: Column) -> Column:
        branch = lambda side: F.when(x[side[0]] <= side[1], F.lit(side[2])).otherwise(F.lit(side[3]))
        return reduce(lambda a, b: a + b, [F.when(x[f] <= cut, branch(low)).otherwise(branch(high)) for f, cut, low, high in trees])

    row = F.struct(*[c.alias(n) for n, c in zip(names, [s["kind"], *_features(s)], strict=True)])
    return F.element_at(F.transform(F.array(row), total), 1)


def selected(spans: Column, model: dict) -> Column:
    """Base spans that pass, and those that the model adds: array<struct<start, end, kind, base>>, each span once."""
    cuts = model["cuts"]
    keep = lambda s: s["base"] & s["passes"]
    if model["trees"] and any(c is not None for c in cuts):
        by_kind = lambda s: F.element_at(F.array(*[F.lit(c if c is not None else float("inf")) for c in cuts]), s["kind"] + 1)
        choose = lambda s: F.when(s["base"], s["passes"]).otherwise(_score(model["trees"], s) >= by_kind(s))
    else:
        choose = keep
    short = F.transform(F.filter(spans, choose), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), keep(s).alias("base")))
    return F.array_sort(F.array_distinct(short))


def told(spans: Column) -> Column:
    """kind:start:end, comma-joined; code points, end exclusive."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact_text(text: Column, spans: Column) -> Column:
    """The text with each span (overlapping ones together) replaced by its kind in brackets."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def put(acc: Column, s: Column) -> Column:
        new = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.element_at(names, s["kind"] + 1))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], new).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), put, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(text.isNull() | (F.size(spans) == 0), text).otherwise(whole)


def find(docs: DataFrame) -> DataFrame:
    """doc_id and chosen spans of each document."""
    found = materialize(candidates(docs, ["doc_id"]), "pii-candidates")
    model = fit(found, F.col("doc_id"))
    return found.select("doc_id", selected(F.col("spans"), model).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with personal data in their text replaced."""
    model = fit(candidates(docs, ["doc_id"]), F.col("doc_id"))
    both = candidates(docs, [F.struct(*[docs[c] for c in docs.columns]).alias("d"), F.col("text")])
    text = redact_text(F.col("text"), selected(F.col("spans"), model))
    return both.select(*[text.alias("text") if c == "text" else F.col("d")[c].alias(c) for c in docs.columns])


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


QUERIES = {"op3_pii": op3_pii}
SQL: dict[str, str] = {}
