"""Operators of the subpackage against brute force, on small documents with every odd case."""

from __future__ import annotations

import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelake.llm import chat, decontam, fingerprint, language, lm, mixing, ngram_join, pii, quality, registry, suffix_dedup

from ..conftest import SMALL, cells
from .conftest import ROWS

TEXTS = [(r[0], r[1]) for r in ROWS]


def empty(docs):
    return docs.limit(0)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, duck, name):
    assert cells(registry.queries()[name](spark, SMALL).toPandas()) == cells(duck.execute(registry.oracle_sql()[name]).df())


def test_language(docs):
    model = language.fit(docs, per_lang=40)
    got = {r["doc_id"]: r for r in language.predict(docs, model, ["doc_id"]).collect()}
    assert len(got) == len({r[0] for r in ROWS})
    for r in ROWS:
        if r[1] is None or not any(map(str.isalpha, r[1])):
            assert (got[r[0]]["lang_pred"], got[r[0]]["score"]) == ("und", 0.0)
        else:
            assert got[r[0]]["lang_pred"] in ("en", "fr", "de") and 0 <= got[r[0]]["score"] <= 1
    judged = [r for r in ROWS[:90] if len(r[1].split()) >= 8]
    assert sum(got[r[0]]["lang_pred"] == r[2] for r in judged) >= 0.95 * len(judged)
    assert language.predict(empty(docs), model, ["doc_id"]).count() == 0
    nothing = language.fit(docs.limit(0))
    assert {r["lang_pred"] for r in language.predict(docs, nothing, ["doc_id"]).collect()} == {"und"}


def test_language_with_any_number_of_languages(spark):
    """Blocks of languages give what one block gives, and a thousand spellings are learned."""
    rng = __import__("random").Random(3)
    words = {f"l{k}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(6)] for k in range(1000)}
    rows = [(3 * k + j, " ".join(rng.choice(w) for _ in range(12)), lang) for k, (lang, w) in enumerate(words.items()) for j in range(3)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    some = table.filter("doc_id % 20 = 0")
    whole, parts = (sorted(map(tuple, language.predict(some, language.fit(table, block=n), ["doc_id", "lang"]).collect())) for n in (1000, 300))
    assert [r[:3] for r in whole] == [r[:3] for r in parts]
    assert np.allclose([r[3:5] for r in whole], [r[3:5] for r in parts], atol=1e-6)
    assert np.mean([r[1] == r[2] for r in whole]) > 0.9


def brute_language(text: str, model: dict) -> str:
    counts = np.zeros(language.DIMS)
    codes = [c if c >= 128 or 97 <= c <= 122 else 32 for c in map(ord, f" {text.lower()} ")]
    codes = [c for k, c in enumerate(codes) if c != 32 or k == 0 or codes[k - 1] != 32]
    cut = lambda x: x & 0xFFFFFFFF
    one = [cut(c * 0x9E3779B1) for c in codes]
    two = [cut(cut((a ^ (a >> 15)) * 0x85EBCA6B) + b) for a, b in zip(one, one[1:])]
    three = [cut(cut((a ^ (a >> 13)) * 0xC2B2AE35) + b) for a, b in zip(two, one[2:])]
    for g in one + two + three:
        counts[cut((g ^ (g >> 16)) * 0x9E3779B1) >> 20] += 1
    v = np.log1p(counts) * model["idf"]
    v /= np.linalg.norm(v)
    block = model["blocks"][0].value
    return block["langs"][block["of"][int((block["centroids"] @ v).argmax())]]


def test_language_against_brute_force(docs):
    model = language.fit(docs, per_lang=40)
    for r in language.predict(docs.filter("doc_id < 100"), model, ["doc_id", "text"]).collect():
        if r["lang_pred"] != "und":
            assert r["lang_pred"] == brute_language(r["text"], model)


def test_language_on_given_documents(spark, duck):
    got = registry.queries()["op1_language"](spark, SMALL).toPandas().merge(duck.execute("select doc_id, lang from documents").df())
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95


def test_quality(spark, docs):
    good = [(k, f"a plain line of words number {k} that goes on and on with sense {k * k}", 1) for k in range(200)]
    bad = [(1000 + k, " ".join(f"SPAM{k % 7}!! ###{j}" for j in range(12)), 0) for k in range(200)]
    table = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in good + bad] + [(None, 1), (5, None), (999_999, 0)], "doc_id long, quality int")
    model = quality.fit(table, labels, per_label=150)
    got = {r["doc_id"]: r["score"] for r in quality.score(table, model, ["doc_id"]).collect()}
    assert sum((got[i] >= 0.7) == (q == 1) for i, _, q in good + bad) >= 0.97 * 400
    odd = {r["doc_id"]: r["score"] for r in quality.score(docs, model, ["doc_id"]).collect()}
    assert all(0 <= s <= 1 for s in odd.values())
    blank = [r[0] for r in ROWS if not r[1]]
    assert blank and {odd[i] for i in blank} == {model["prior"]}
    assert set(quality.keep(docs, model).columns) == set(docs.columns)
    assert quality.score(empty(docs), model, ["doc_id"]).count() == 0
    one_sided = quality.fit(table, labels.filter("quality = 1"))
    assert {r["score"] for r in quality.score(docs, one_sided, ["doc_id"]).collect()} == {one_sided["prior"]}


def _luhn(digits: str) -> bool:
    return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text: str) -> str:
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m)) <= 19 and _luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_pii(spark, docs):
    hard = ["a@b.cc_x@d.ee", "1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.004", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "4811 3291 0613 5696-4811329106135696", "é😀 a.b@c.d +12(345)678.901-2", "@@ a@b a@b. .a@b.c-", "4811329106135697"]
    rows = [(k, t) for k, t in TEXTS] + [(10_000 + k, t) for k, t in enumerate(hard)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["s"] for r in pii.find(table).select("doc_id", pii.told(F.filter("spans", lambda s: s["base"])).alias("s")).collect()}
    for k, t in rows:
        if t is None or len(t) < 15_000:
            assert found[k] == base_spans(t or ""), t
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert clean[[k for k, t in TEXTS if t and t.startswith("Mail me")][0]] == "Mail me at [EMAIL] or [PHONE], card [CARD] from [IP]."
    assert all(clean[k] == t for k, t in TEXTS if not base_spans((t or "")[:15_000]) and len(t or "") < 15_000)
    assert pii.redact(docs).columns == docs.columns and pii.find(empty(docs)).count() == 0


def test_written_out_addresses_are_found(spark):
    rows = [(k, f"Please write to name{k} [at] host{k} [dot] com. We answer." if k % 3 else f"We met x{k} (at) room.{k} at noon.") for k in range(450)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["s"] for r in pii.find(table).select("doc_id", pii.told(F.col("spans")).alias("s")).collect()}
    assert found == {k: f"email:16:{t.index(' We') - 1}" if k % 3 else "" for k, t in rows}
    clean = {r["doc_id"]: r["text"] for r in pii.redact(table).collect()}
    assert clean == {k: "Please write to [EMAIL]. We answer." if k % 3 else t for k, t in rows}


def test_boosting_learns_and_adds():
    rows = [{"kind": 2, "held": h, "y": int(d == 16 and s), "n": 50, **dict.fromkeys(pii.FEATURES, 0), "digits": d, "sum": s} for h in (0, 1) for d in (12, 16, 19) for s in (0, 1)]
    trees = pii.boost([r for r in rows if not r["held"]])
    assert all((pii._value(trees, r) > 0) == bool(r["y"]) for r in rows)


def test_language_model(spark, docs):
    table = docs.select("doc_id", "text", (F.col("doc_id") % 7 == 2).alias("held_out"))
    learn = table.filter("not held_out")
    counts = lm.count_words(learn).cache()
    vocab = lm.vocabulary(counts)
    params = lm.train(learn, vocab)
    got = defaultdict(list)
    for r in lm.score(table, counts, vocab, params).collect():
        got[r["doc_id"]].append(r)
    seen = Counter(w for k, t in TEXTS if k % 7 != 2 for w in [*(t or "").encode().lower().split(), b""])
    n, v = sum(seen.values()), len(seen)
    for k, t in TEXTS:
        own = [*(t or "").encode().lower().split(), b""]
        r = got[k][0]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(w in seen for w in own), n)
        assert math.isclose(r["base_score"], sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
        assert r["score"] < 0
    assert len(got[5]) == 2
    scorer = lm.Scorer(params, vocab["own"])
    for before in ([0, 0], [3, 7]):  # after any two words the classes' probabilities add up to 1
        total = sum(10 ** scorer(np.array([*before, c], np.int32), np.array([0]))[2] for c in range(lm.CLASSES))
        assert math.isclose(total, 1, rel_tol=1e-4)
    zero = lm.score(table, counts, None, None).first()
    assert (zero["base_score"], zero["train_tokens"]) == (0.0, 0)
    assert lm.vocabulary(lm.count_words(learn.limit(0))) is None


def test_model_beats_base_on_held_out_documents(spark):
    """By 0.03 of a decimal logarithm a token at least, on documents that it did not learn from."""
    rows = lm.op4_lm(spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert rows["s"] > rows["b"] + 0.03 * rows["n"]


def test_every_position_is_a_training_example(docs, monkeypatch):
    mean, used = lm._mean, []
    monkeypatch.setattr(lm, "_mean", lambda learnt: (got := mean(learnt), used.extend(r["used"] for r in got))[0])
    vocab = lm.vocabulary(lm.count_words(docs).cache())
    lm.train(docs, vocab)
    assert sum(used) == vocab["n"] == sum(len((r[1] or "").encode().split()) + 1 for r in ROWS)


def test_fingerprints(docs):
    rows = sorted(TEXTS, key=lambda r: (-r[0], r[1] or ""))
    got = defaultdict(list)
    for r in fingerprint.with_next(docs, fingerprint.edited, fingerprint.EDITED).collect():
        got[r["doc_id"]].append(r)
    assert sum(map(len, got.values())) == len(rows)
    for k, (doc, text) in enumerate(rows):
        text, follow = text or "", rows[(k + 1) % len(rows)][1] or ""
        changed = text[: len(text) - len(text) // 2] + follow[: len(text) // 2]
        assert hashlib.sha256(changed.encode()).hexdigest() in {r["edited_sha256"] for r in got[doc]}
    prints = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprint(docs).collect()}
    assert all(r["fingerprint"] == prints[d] for d, rs in got.items() for r in rs)
    by_text = defaultdict(set)
    for k, t in TEXTS:
        by_text[t or ""].add(prints[k])
    assert all(len(p) == 1 for p in by_text.values())
    one = docs.filter("doc_id = 7")
    assert fingerprint.with_next(one, fingerprint.edited, fingerprint.EDITED).first()["near_next"] == 1.0
    assert fingerprint.with_next(empty(docs), fingerprint.edited, fingerprint.EDITED).count() == 0


def test_edits_stay_near_and_long_texts_walk_in_chunks(spark):
    rng = np.random.default_rng(3)
    base = "".join(rng.choice(list("abcdefgh ijklmno"), 80_000))
    edited = base[:40_000] + "Z" + base[40_010:]
    a, b, c = fingerprint.fingerprints([base, edited, base[::-1]])
    assert fingerprint.likeness(a, b) > 0.9 and fingerprint.likeness(a, c) < 0.1
    rows = [(1, a.hex()), (2, b.hex()), (3, c.hex()), (4, a.hex())]
    got = {r["doc_id"]: r["class_id"] for r in fingerprint.near_classes(spark.createDataFrame(rows + [(None, c.hex())], "doc_id long, fingerprint string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1, None: 3}


def brute_walk(text: str) -> bytes:
    """The embedding step by step, and the fingerprint sampled from it."""
    stays = fingerprint.STRIDES.reshape(fingerprint.SYMBOLS, fingerprint.PERIOD)
    at, step = [], 0  # the character at each step
    for i, c in enumerate(text):
        symbol = ((ord(c) * 0x9E3779B1) & 0xFFFFFFFF) >> 26
        for _ in range(int(stays[symbol % fingerprint.SYMBOLS, step % fingerprint.PERIOD])):
            at.append(i)
            step += 1
    out = bytearray()
    for records in fingerprint.RECORDS:
        own = [int(r) for r in records if r < 2 * len(text)]
        if not own:
            out.append(0)
            continue
        p = own[-1]
        where = at[p] if p < len(at) else len(text)
        shown = [(ord(text[where + k]) if where + k < len(text) else 0) + 1 for k in range(fingerprint.WIDTH)]
        h = sum(x * int(m) for x, m in zip(shown, fingerprint.MULTIPLIERS, strict=True)) + p * 0xD6E8FEB86659FD93 & (1 << 64) - 1
        h ^= h >> 32
        h = h * 0x9E3779B97F4A7C15 & (1 << 64) - 1
        out.append(h >> 56)
    return bytes(out)


def test_walk_against_brute_force():
    texts = [t for _, t in TEXTS if t and len(t) < 4000][:60] + ["a", "ab", "é😀" * 70, ""]
    assert fingerprint.fingerprints(texts) == [brute_walk(t) for t in texts]


def test_banding_recalls_near_prints(spark):
    """Of the pairs of near prints at least 0.9 are of one class, and no class joins what no chain of near prints joins."""
    rng = np.random.default_rng(8)
    texts = []
    for _ in range(60):
        base = "".join(rng.choice(list("abcdefgh ijklmno"), 1500))
        for k in range(5):
            text = base
            for _ in range(k * 3):
                p = int(rng.integers(len(text)))
                text = text[:p] + "xyz"[: int(rng.integers(0, 4))] + text[p + int(rng.integers(0, 3)) :]
            texts.append(text)
    prints = fingerprint.fingerprints(texts)
    rows = [(k, p.hex()) for k, p in enumerate(prints)]
    got = {r["doc_id"]: r["class_id"] for r in fingerprint.near_classes(spark.createDataFrame(rows, "doc_id long, fingerprint string")).collect()}
    near = [(i, j) for i in range(len(prints)) for j in range(i) if fingerprint.likeness(prints[i], prints[j]) >= fingerprint.NEAR]
    assert len(near) > 100 and sum(got[i] == got[j] for i, j in near) >= 0.9 * len(near)
    root = list(range(len(prints)))
    for i, j in near:
        a, b = root[i], root[j]
        root = [min(a, b) if r in (a, b) else r for r in root]
    assert all(root[k] == root[c] for k, c in got.items())


def test_chat(spark):
    said = r"\### Assistant: </turn> ok"
    rows = [(1, 0, "system", "s"), (1, 1, "user", said), (1, 2, "assistant", said + "\n\\"), (1, 3, "assistant", None), (2, 5, None, "x"), (2, None, "role </turn>\n#", "### "), (3, 0, "user", "q"), (3, 0, "user", "q"), (3, 1, "assistant", "a:\n"), (None, 0, "user", "z")]
    turns = spark.createDataFrame([(*r, 7, "kind") for r in rows], "conv_id long, turn long, role string, text string, part long, kind string")
    segments = chat.segments(turns)
    got = {r["conv_id"]: r for r in chat.read_back(segments).collect()}
    for conv in (1, 2, 3, None):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is None, r[1], r[2] or "", r[3] or ""))
        text = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), hashlib.sha256(text.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert not got[1]["valid"] and "assistant after assistant" in got[1]["violation"]
    assert got[3]["violation"] == "user after user" and got[None]["violation"] == "ends after user"
    parts = [r["text"] for r in segments.filter("conv_id = 1").orderBy("part").collect()]
    assert list(chat.Reader(chat.DEFAULT).turns("".join(parts))) == [("system", "s"), ("user", said), ("assistant", said + "\n\\"), ("assistant", "")]
    assert chat.read_back(chat.segments(turns.limit(0))).count() == 0


def test_decontamination(spark, docs):
    passage = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old barn"
    w = passage.split()
    cases = {"exact": passage, "punctuated": passage.upper().replace(" ", ", "), "reordered": " ".join(w[9:] + w[:9]), "split": " ".join(w[:9]) + " something else stands here " + " ".join(w[9:]), "half": " ".join(w[:8]), "scattered": " so ".join(w)}
    rows = [(10_000 + k, f"{'lead in words ' * 4}{t}{' closing words' * 4}") for k, t in enumerate(cases.values())]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    bench = spark.createDataFrame([(1, passage, "x"), (1, passage, "x"), (2, "tiny item", "x"), (3, None, "x"), (4, "", "x")], "item_id long, text string, text2 string")
    got = {r["doc_id"]: r for r in decontam.find(table, bench).collect()}
    assert set(got) == {10_000, 10_001, 10_002, 10_003} and got[10_002]["coverage"] == 1.0 and got[10_002]["tiles"] == 2
    assert decontam.clean(table, bench).count() == table.count() - 4
    assert decontam.find(table, bench.limit(0)).count() == 0 and decontam.find(table.limit(0), bench).count() == 0
    assert decontam.clean(docs, bench).columns == docs.columns


def brute_tiles(p: list[int], t: list[int], least: int) -> int:
    """Greedy string tiling without hashes: marked words."""
    pf, tf, total = [True] * len(p), [True] * len(t), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                k = 0
                while i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k] and pf[i + k] and tf[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < least:
            return total
        for k in range(best[0]):
            pf[best[1] + k] = tf[best[2] + k] = False
        total += best[0]


def test_tiles_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(60):
        p, t = rng.integers(0, 3, rng.integers(5, 40)), rng.integers(0, 3, rng.integers(5, 60))
        assert sum(decontam.tile(p, t, 3)) == brute_tiles(p.tolist(), t.tolist(), 3)
    p = np.arange(30)
    assert sorted(decontam.tile(p, np.concatenate([p[15:], [99], p[:15]]), 5)) == [15, 15]


def test_found_against_brute_force(spark, monkeypatch):
    """Every item that brute-force tiling covers enough is found, with as many words; none else, however full the bitmap is."""
    rng = np.random.default_rng(6)
    vocabulary = [f"w{k}" for k in range(30)]
    opening = "what is the value of the following"  # many items and texts share it
    items = [(k, (opening + " " if k % 2 else "") + " ".join(rng.choice(vocabulary, int(rng.integers(2, 30))))) for k in range(30)]
    texts = []
    for d in range(14):
        text = opening + " " + " ".join(rng.choice(vocabulary, 40))
        for k in rng.integers(0, 30, 2):
            w = items[k][1].split()
            half = len(w) // 2
            text += " " + " ".join(w[half:]) + " and " + " ".join(w[:half])
        texts.append((d, text))
    texts += [(14, texts[0][1]), (14, texts[0][1]), (None, texts[1][1]), (15, "w1 w2 w3 " * 30), (16, None), (17, "")]
    number = {w: n for n, w in enumerate({w for _, t in items + [x for x in texts if x[1]] for w in t.split()})}
    want = []
    for d, text in texts:
        for k, item in items if text else []:
            p, t = ([number[w] for w in x.split()] for x in (item, text))
            matched = brute_tiles(p, t, min(decontam.MIN_TILE, len(p)))
            if matched >= decontam.COVERAGE * len(p):
                want.append((str(d), k, matched, len(p)))
    assert len(want) > 30
    table = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for bits in (decontam.BITS, 128):
        monkeypatch.setattr(decontam, "BITS", bits)
        got = decontam.find(table, bench).collect()
        assert sorted((str(r["doc_id"]), r["item_id"], r["matched"], r["n_tokens"]) for r in got) == sorted(want)


def test_tiles_of_periodic_texts_take_few_rounds():
    """Words that repeat cost about a sort a length, not a walk over all their places."""
    started = time.monotonic()
    assert sum(decontam.tile(np.arange(60) % 3, np.arange(60_000) % 3, 5)) == 60
    assert sum(decontam.tile(np.arange(6000) % 2, np.arange(60_000) % 7 % 2, 5)) > 0
    assert time.monotonic() - started < 10


def test_suffix_dedup(docs, spark, monkeypatch):
    rows = {k: t for k, t in TEXTS}
    seen: dict[bytes, int] = {}
    want = {}
    for k in sorted(rows):
        raw = (rows[k] or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 49):
            if seen.setdefault(raw[i : i + 50], k) < k:
                gone[i : i + 50] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        want[k] = (len(raw), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    for hot in (suffix_dedup.HOT, 1):  # the second sends many windows through all three routings
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        monkeypatch.setattr(suffix_dedup, "SAMPLE", hot if hot == 1 else 64)
        monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 700)
        got = suffix_dedup.dedup(docs).collect()
        assert len(got) == len(ROWS)
        for r in got:
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]], r["doc_id"]
    assert suffix_dedup.dedup(empty(docs)).count() == 0


def test_suffix_dedup_of_rows_without_an_id(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (None, a), (None, b), (None, b), (None, c + b), (2**40, "short")]
    got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"]) for r in got) == sorted((k or 0, len(t)) for k, t in rows)
    kept = sorted(bytes(r["kept"]).decode() for r in got if r["doc_id"] is None)
    first, second = sorted(["", b, b, c]), sorted(["", "", "", c + b])  # whichever of b and c + b comes first keeps b
    assert kept in (first, second)
    alone = spark.createDataFrame([(None, a), (None, b)], "doc_id long, text string")
    assert {r["n_removed"] for r in suffix_dedup.dedup(alone).collect()} == {0}


def brute_dedup(rows: list[tuple[int, str]]) -> list[tuple[int, int]]:
    """(doc_id, bytes removed) of rows by rising id."""
    seen: dict[bytes, int] = {}
    out = []
    for k, t in rows:
        raw = t.encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 49):
            if seen.setdefault(raw[i : i + 50], k) < k:
                gone[i : i + 50] = True
        out.append((k, int(gone.sum())))
    return out


@pytest.mark.parametrize("hot", [20_000, 2])
def test_suffix_dedup_of_lines_repeated_within_documents(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    line = "All rights are kept by the makers of this very long line of text, all.\n"
    rows = [(1, line * 3000), (2, "x" + line * 3000), (3, "a" * 300), (4, "b" + "a" * 99 + "c"), (5, f"q{line}{'z' * 60}"), (6, f"{'z' * 55}{line[:60]}"), (7, "u" + line[10:65] + "v")]
    got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == brute_dedup(rows)


def test_suffix_dedup_of_one_id_with_two_texts(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    got = suffix_dedup.dedup(spark.createDataFrame([(1, a), (2, a), (2, b), (2, b)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(1, 0), (2, 0), (2, 0), (2, len(a))]


def test_merge_of_transforms_orders_prefixes():
    rng = np.random.default_rng(4)
    texts = sorted({bytes(rng.integers(97, 99, rng.integers(6, 30)).astype(np.uint8)) for _ in range(40)})
    shards = [suffix_dedup.Shard(texts[:13], np.arange(13)), suffix_dedup.Shard(texts[13:], np.arange(13, len(texts)))]
    order, block = suffix_dedup.merge(shards, 6)
    rows = [(t, o) for s in shards for t, o in zip(s.text.tolist(), s.offset.tolist(), strict=True)]
    prefixes = [texts[rows[k][0]][rows[k][1] : rows[k][1] + 6] for k in order.tolist()]
    whole = [(p, b) for p, b in zip(prefixes, block.tolist(), strict=True) if len(p) == 6]
    assert [p for p, _ in whole] == sorted(p for p, _ in whole)
    assert len({b for _, b in whole}) == len({p for p, _ in whole}) and len(set(whole)) == len({b for _, b in whole})


def test_mixing(spark, docs):
    planned = mixing.plan_mix(docs).collect()
    assert len(planned) == len(ROWS)
    again = {(r["doc_id"], r["copies"]) for r in mixing.plan_mix(docs).collect()}
    assert again == {(r["doc_id"], r["copies"]) for r in planned} and all(r["copies"] <= 2 for r in planned)
    sizes = {s: sum(len((x[1] or "").encode().split()) for x in ROWS if x[3] == s) for s in {x[3] for x in ROWS}}
    assert {r["source"]: r["source_size"] for r in planned} == sizes
    total = sum({r["source"]: r["target"] for r in planned}.values())
    assert math.isclose(total, 1.5 * sum(sizes.values()))
    emitted = mixing.mix(docs)
    assert emitted.count() == sum(r["copies"] for r in planned)
    assert mixing.plan_mix(empty(docs)).count() == 0


def test_mixing_counts_words_whatever_size_says(docs):
    want = sorted((r["doc_id"], r["copies"], r["size"]) for r in mixing.plan_mix(docs).collect())
    clash = docs.withColumn("size", F.lit(None).cast("long"))
    assert sorted((r["doc_id"], r["copies"], r["size"]) for r in mixing.plan_mix(clash).collect()) == want
    assert mixing.mix(clash).count() == sum(n for _, n, _ in want) > 0


def test_mixing_of_many_sources_is_salted(docs, monkeypatch):
    want = sorted((r["doc_id"], r["copies"]) for r in mixing.plan_mix(docs).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted((r["doc_id"], r["copies"]) for r in mixing.plan_mix(docs).collect()) == want


def brute_components(rows: list[tuple]) -> dict[int, int]:
    sets = {}
    for k, t in rows:
        w = (t or "").encode().lower().split()
        sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {k: k for k in sets}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}


@pytest.mark.parametrize("small", [False, True])
def test_ngram_join(docs, monkeypatch, small):
    if small:  # many parts and trees of several levels
        for name, value in (("PART", 7), ("FANOUT", 2), ("SMALL", 1), ("FRONTIER", 5), ("LEADS", 1), ("BROADCAST_IDS", 0), ("SAMPLE", 1)):
            monkeypatch.setattr(ngram_join, name, value)
    want = brute_components(TEXTS)
    got = ngram_join.link_components(docs.select("doc_id", "text")).collect()
    assert len(got) == len(ROWS)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(set(want.values()))
    assert ngram_join.link_components(empty(docs)).count() == 0


def test_star_of_copies_keeps_all_links(spark):
    """Copies that are near the original but not near each other."""
    words = [f"w{k}" for k in range(160)]
    rows = [(0, " ".join(words))]
    for k in range(1, 40):
        w = list(words)
        for j in range(4):
            w[(7 * k + 37 * j) % 155] = f"x{k}_{j}"
        rows.append((k, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_repeated_rows_keep_all_links(spark):
    """Every row twice: blocks of one size must not be taken for one another."""
    rng = np.random.default_rng(10)
    rows = []
    for g in range(12):
        words = [f"g{g}w{k}" for k in range(60)]
        for k in range(3):
            near = list(words)
            near[int(rng.integers(60))] = f"x{k}"
            rows.append((10 * g + k, " ".join(near)))
    table = spark.createDataFrame(rows * 2, "doc_id long, text string")
    got = ngram_join.link_components(table).collect()
    assert len(got) == len(table.collect())
    want = brute_components(rows)
    assert 12 < len(set(want.values())) < len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert sorted(r["doc_id"] for r in ngram_join.keep_one(table).collect()) == sorted(set(want.values()))


def test_an_id_of_two_texts_keeps_its_links(spark):
    text = lambda g, k: " ".join([f"g{g}w{j}" for j in range(60)] + [f"x{k}"] * k)
    rows = [(1, text(0, 0)), (5, text(0, 1)), (5, text(1, 0)), (6, text(1, 1)), (2, text(2, 0)), (5, text(2, 0)), (7, text(2, 1))]
    got = {(r["doc_id"], r["component_id"]) for r in ngram_join.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(1, 1), (5, 1), (6, 1), (2, 2), (5, 2), (7, 2)} == got


def test_pipeline_of_odd_tables(spark, docs, tmp_path):
    """Nulls, repeated rows, extra columns with clashing names, and empty tables go through all stages."""
    import corpus_pipeline

    labels = [(r[0], int((r[1] or "").count(" ") > 5), 0) for r in ROWS if r[0] is not None] + [(None, 1, 0), (5, None, None)]
    clash = docs.withColumn("size", F.lit(None).cast("string")).withColumn("rate", F.lit("x")).withColumn("home", F.lit(1))
    clash = clash.unionByName(clash.limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    for name, df in (("documents", clash), ("labels", spark.createDataFrame(labels, "doc_id long, quality int, toxic int")), ("benchmark", spark.createDataFrame([(1, ROWS[80][1]), (2, None)], "item_id long, text string"))):
        df.write.parquet(f"{tmp_path}/full/{name}.parquet")
        df.limit(0).write.parquet(f"{tmp_path}/empty/{name}.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/full").cache()
    assert 0 < out.count() and {"home", "size", "rate"} <= set(out.columns)
    assert ROWS[80][0] not in {r["doc_id"] for r in out.collect()}
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    assert len(corpus_pipeline.STAGES) == 5
    source = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = corpus_pipeline.run(spark, SMALL).cache()
    kept = {r["doc_id"] for r in out.select("doc_id").distinct().collect()}
    texts = {r["doc_id"]: r["text"] for r in source.collect()}
    assert kept <= set(texts) and 0 < len(kept) < len(texts)
    assert not any(base_spans(r["text"]) for r in out.collect())
    comp = brute_components([(k, texts[k]) for k in kept])
    assert all(comp[k] == k for k in kept)


def test_folds_are_crc32(spark):
    from pricelake.llm.common import fold

    got = spark.range(50).select("id", fold(F.col("id"), 4).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 4 for r in got)
