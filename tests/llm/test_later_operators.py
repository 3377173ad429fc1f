"""Source divergence, the dataset manifest and embedding near-duplicates, against plain versions and odd tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pricelake.llm import divergence, embedding_dedup, manifest, registry
from pricelake.llm.language import fit as fit_language
from pricelake.llm.ngram_join import keep_one

from ..conftest import SMALL, cells
from .conftest import prose

NEW = ("op11_divergence", "op12_manifest", "op13_embedding_dedup")


@pytest.mark.parametrize("name", NEW)
def test_sql(spark, duck, name):
    assert cells(registry.queries()[name](spark, SMALL).toPandas()) == cells(duck.execute(registry.oracle_sql()[name]).df())


# -- divergence ---------------------------------------------------------------


def plain_divergence(rows, least, top=10):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    docs = [(lang or "", source or "", Counter(term.findall("".join(c.lower() if c < "\x80" else c for c in text or "")))) for text, lang, source in rows]
    seen, counts, out = Counter(), defaultdict(Counter), []
    for lang, _, c in docs:
        seen.update((lang, t) for t in c)
    groups = sorted({(lang, source) for lang, source, _ in docs})
    for lang, source, c in docs:
        counts[lang, source].update({t: k for t, k in c.items() if seen[lang, t] >= least})
    for lang in {g[0] for g in groups}:
        own = [g for g in groups if g[0] == lang]
        kept = sorted({t for (x, t), k in seen.items() if x == lang and k >= least})
        whole = sum((counts[g] for g in own), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {g: share(counts[g]) for g in own}, share(whole)
        for g in own:
            pairs = [(h[1], sum(f(p[g][t], p[h][t]) for t in kept)) for h in own if h != g]
            terms = [(t, f(p[g][t], q[t])) for t in kept if counts[g][t] and p[g][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(*g, part, item, value, k) for k, (item, value) in enumerate(found, 1) if part == "pair" or k <= top]
    return sorted(out)


def test_divergence_against_plain_sums(spark, monkeypatch):
    rng = random.Random(3)
    # terms that only several chunks of a document, or several documents' chunks, bring over the bound
    rows = [(f"Wort{k % 7}, wort{k % 7}! x-{k % 5}.Y{k % 4} Über und {prose(rng, 'de', 20)}", "de", f"s{k % 4}") for k in range(60)]
    rows += [(prose(rng, "en", 30), None, None), (None, "en", "s1"), ("", None, "s2"), ("12 \x00 34", "de", "empty"), ("naïve\x0bnaïve NAÏVE", "fr", "")] + [("only one", "xx", "a"), ("only one", "xx", "b")]
    rows += [rows[0]] * 3 + [("long " * 50_000, "de", "s1")]
    want = plain_divergence(rows, 5)
    docs = spark.createDataFrame([(*r, 1, 2, "n") for r in rows], "text string, lang string, source string, n long, row long, chunk string").repartition(5)
    for bits, held in ((divergence.BITS, divergence.HELD), (7, 50)):  # 7 bits: places are shared
        monkeypatch.setattr(divergence, "BITS", bits)
        monkeypatch.setattr(divergence, "MASK", (1 << bits) - 1)
        monkeypatch.setattr(divergence, "HELD", held)
        monkeypatch.setattr(divergence, "SENT", 0 if bits == 7 else divergence.SENT)
        got = sorted(tuple(r) for r in divergence.divergence(docs, least=5).select("lang", "source", "part", "item", "value", "rank").collect())
        assert got == want
    assert any(r[2] == "term" for r in want) and any(r[2] == "pair" and r[0] == "xx" and r[4] == 0 for r in want)


def test_divergence_of_no_rows(spark):
    assert divergence.divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_shares_do_not_overflow(spark):
    row = spark.range(1).select(divergence.share(divergence.F.lit(4 * 10**15 + 7), divergence.F.lit(9 * 10**15 + 1)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (4 * 10**15 + 7) // (9 * 10**15 + 1)


# -- manifest -----------------------------------------------------------------


def plain_manifest(rows):
    h = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: h(*map(field, r))

    def tree(leaves):
        paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
        while len(nodes) > 1:
            for k, p in enumerate(at):
                other = p ^ 1
                if other < len(nodes):
                    paths[k].append((nodes[other], "") if p % 2 else ("", nodes[other]))
                else:
                    paths[k].append(("", ""))
            nodes, at = [h(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)], [p // 2 for p in at]
        return (nodes[0] if nodes else None), paths

    langs = defaultdict(list)
    for r in rows:
        langs[r[2]].append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree([leaf(r) for r in langs[x]]) for x in order if not langs[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))}
    root, tops = tree([trees[x][0] for x in order])
    out = []
    for x, top in zip(order, tops, strict=True):
        for r, path in zip(langs[x], trees[x][1], strict=True):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            now = leaf((*r[:3], r[3] + 1 if bad and r[3] is not None else r[3], r[4]))
            for before, after in [*path, *top]:
                now = h(before, now, after)
            out.append((r[0], leaf(r), trees[x][0], root, h(*[a + b for a, b in [*path, *top]]), now, now == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels", [1, 2, 3, 10])
def test_manifest_against_a_plain_tree(spark, monkeypatch, levels):
    monkeypatch.setattr(manifest, "LEVELS", levels)
    rng = random.Random(levels)
    sizes = {"en": 33, "de": 8, "fr": 1, "": 2, None: 5, "é": 16, "es": 17}
    rows, k = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            k += 1
            rows.append((k * 7 % 101, rng.choice([None, "a", "ü"]), lang, rng.choice([None, 5, 77]), rng.choice([None, "", "x" * 100_000, "\U0001f600 text"])))
    rows += [(None, "a", "en", 3, "no id"), (None, "b", "en", 3, "no id")] + [rows[3]] * 3 + [(rows[3][0], "z", rows[3][2], 1, "an id of two texts")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, "t", 1, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, pos long, h string").repartition(3)
    docs.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/manifest-{levels}/documents.parquet")
    got = manifest.op12_manifest(spark, path.removesuffix("/documents.parquet")).collect()
    assert sorted(map(tuple, got), key=str) == plain_manifest(rows)
    assert {r["verified"] for r in got} == {True, False}


def test_manifest_of_no_rows_and_of_one(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    assert manifest.manifest(spark.createDataFrame([], schema)).count() == 0
    row = manifest.manifest(spark.createDataFrame([(1, None, None, None, None)], schema)).first()
    assert row["leaf"] == row["subroot"] == row["root"] and row["steps"] == []


# -- embeddings ---------------------------------------------------------------


def plain_links(rows, cosine=0.93):
    good = [(k, np.array(v, float)) for k, (i, v, label) in enumerate(rows) if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    n, comp = Counter(), list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a, (p, x) in enumerate(good):
        for q, y in good[:a]:
            if rows[p][2] == rows[q][2] and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= cosine:
                n[p] += 1
                n[q] += 1
                comp[max(find(p), find(q))] = min(find(p), find(q))
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[find(k)] = min(least.get(find(k), r[0]), r[0])
    return sorted(((r[0], n[k], None if r[0] is None else least[find(k)], r[0] is not None and least[find(k)] == r[0]) for k, r in enumerate(rows)), key=str)


def vectors():
    rng = np.random.default_rng(4)
    rows = []
    for k in range(40):
        centre = rng.normal(size=16)
        for _ in range(int(rng.choice([1, 1, 3, 9]))):
            rows.append((centre + rng.normal(size=16) * 0.18, int(k % 3)))
    hot = rng.normal(size=16)
    rows += [(hot + rng.normal(size=16) * s, 7) for s in np.linspace(0.0, 0.4, 120)] + [(hot, 7)] * 40 + [(hot * 3.0, 7)] * 5 + [(hot, None), (hot, 8)]
    rows += [(hot[:5], 7), (hot[:5] * 2.0, 7)] + [(rng.normal(size=16), 9) for _ in range(150)]
    at = rng.permutation(len(rows))
    out = [(int(at[k]) * 3, [float(np.float32(x)) for x in v], label) for k, (v, label) in enumerate(rows)]
    bad = [None, [], [0.0] * 16, [1.0, None] + [0.0] * 14, [float("nan")] * 16, [float("inf")] + [1.0] * 15]
    return out + [(5000 + k, v, 7) for k, v in enumerate(bad)] + [(None, out[0][1], out[0][2]), out[5], out[5]]


@pytest.mark.parametrize(("part", "slice_", "probes"), [(2048, 4096, 6), (7, 11, 6), (16, 5, 100)])
def test_embedding_links_against_brute_force(spark, monkeypatch, part, slice_, probes):
    """Every link is found, whatever the tiles; recall is 1."""
    monkeypatch.setattr(embedding_dedup, "PART", part)
    monkeypatch.setattr(embedding_dedup, "SLICE", slice_)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 13)
    monkeypatch.setattr(embedding_dedup.Index.__init__, "__defaults__", (probes,))
    rows = vectors()
    table = spark.createDataFrame([(*r, "g", 1, 2, 3) for r in rows], "vec_id long, embedding array<float>, label int, grp string, cell int, cls long, n long").repartition(4)
    got = embedding_dedup.near_duplicates(table).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=str) == plain_links(rows)


def test_probes_are_sufficient_and_codes_lose_no_pair():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 24))
    x = np.concatenate([base + rng.normal(size=base.shape) * 0.2 for _ in range(10)] + [rng.normal(size=(400, 24))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = embedding_dedup.Index(x[::3], math.sqrt(2 - 2 * 0.93), probes=20)
    own, probed = index.assigned(x)
    codes, error = index.codes(x - index.centres[own])
    near = np.argwhere(np.triu(x @ x.T >= 0.93, 1))
    assert len(index.centres) > 8 and len(near) > 500 and (probed.sum(1) < len(index.centres) - 1).any()
    for p, q in near:
        p, q = (p, q) if own[p] <= own[q] else (q, p)
        assert own[p] == own[q] or probed[p, own[q]]
        assert index.near((x[p] - index.centres[own[q]])[None], codes[q : q + 1], error[q : q + 1]).all()
    far = index.near(x[-100:] - index.centres[0], *index.codes(x[:100] - index.centres[0]))
    assert far.mean() < 0.5


def test_embeddings_without_a_usable_row(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    got = embedding_dedup.near_duplicates(spark.createDataFrame([(1, [1.0, 2.0], None), (2, None, 3)], schema)).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1, True), (2, 0, 2, True)]


# -- what one id of several rows must not do ----------------------------------


def test_a_unique_text_stays_though_its_id_has_a_copy(spark):
    rng = random.Random(9)
    a, b, c = (prose(rng, "en", 60) for _ in range(3))
    docs = spark.createDataFrame([(1, a), (5, a), (5, b), (7, c), (7, b + " x"), (None, a)], "doc_id long, text string")
    assert sorted(map(tuple, keep_one(docs).collect()), key=str) == sorted([(1, a), (5, b), (7, c), (None, a)], key=str)


@pytest.mark.parametrize("ids", [[None] * 100, [3] * 100])
def test_languages_are_learnt_whatever_the_ids(spark, ids):
    rng = random.Random(2)
    rows = [(i, prose(rng, lang, 40), lang) for k, i in enumerate(ids) for lang in ("en", "de")[k % 2 : k % 2 + 1]]
    model = fit_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_lang=10)
    assert sorted(x for b in model["blocks"] for x in b.value["langs"]) == ["de", "en"]
