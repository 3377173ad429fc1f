"""How the sources of a language differ in their words, by chunk factorisation.

Texts are cut at white space into chunks, which repeat far more often than texts do. So chunks are counted in each document, each
distinct chunk of the whole corpus is taken apart into its terms once, and the terms are joined back to the counts.

1. Each document's chunks with their counts; summed by language, source and chunk, with the number of documents.
2. The terms of each distinct chunk, and how often each stands in it.
3. Both joined: occurrences by language, source and term. A term's documents are between those of its most frequent chunk and
   the sum over its chunks. Where the wanted number is between the two, the documents of its chunks are looked up and counted
   without repeats: such chunks are in few documents, so no join has a hot key.
4. Shares of kept terms with two added to every count; differences of shares for pairs of a language's sources, and for a
   source's terms against the language.

Terms that neither source of a pair has are alike, and counted, not listed: a pair's sum is made of one term that neither
has, times all kept terms, of what differs for a term that one has (by distinct shares), and of what differs for one that both have.

Defined cases: null text, language and source are empty ones; a source without terms has the shares of count 0; a language
without kept terms has pairs of value 0; each row is a document, repeated ones too; ties rank by name, bytewise; an empty
table gives no row. Columns beside ``text``, ``lang`` and ``source`` are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, table

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS = 10
TOP = 10
ADDED = 2
SCALE_THOUSANDS = 3
#: Distinct chunks of a task that are summed up before they are handed on.
HELD = 1_000_000
#: Up to so many chunks that are asked for are sent to the tasks themselves (about 20 MB); beyond that 2**BITS bits (4 MB) tell which
#: chunks may be; where two share a bit, a join sorts it out.
SENT = 300_000
BITS = 25
MASK = (1 << BITS) - 1
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def chunk_counts(docs: DataFrame) -> DataFrame:
    """lang, source, chunk, n, docs of docs (text, lang, source; no nulls): each document's chunks are counted, and what a task has
    counted is summed up before it is handed on, HELD chunks at a time."""

    def pack(n: dict[tuple, Counter], docs_: dict[tuple, Counter]) -> pa.RecordBatch:
        ends, keys = [0], list(n)
        for key in keys:
            ends.append(ends[-1] + len(n[key]))
        chunks = pa.array((x for key in keys for x in n[key]), pa.binary()).view(pa.string())
        counts = [pa.array((x for key in keys for x in of[key].values()), pa.int64()) for of in (n, docs_)]  # both have their chunks in one order
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([chunks, *counts], ["chunk", "n", "docs"]))
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), lists], ["lang", "source", "chunks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, docs_, held = defaultdict(Counter), defaultdict(Counter), 0
        for batch in batches:
            for text, lang, source in zip(batch.column("text"), batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True):
                words = text.as_py().split()  # of bytes: the six ASCII spaces
                own, of_docs = n[lang, source], docs_[lang, source]
                held -= len(own)
                own.update(words)
                of_docs.update(dict.fromkeys(words).keys())
                held += len(own)
                if held > HELD:
                    yield pack(n, docs_)
                    n, docs_, held = defaultdict(Counter), defaultdict(Counter), 0
        if n:
            yield pack(n, docs_)

    rows = docs.select("lang", "source", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "lang string, source string, chunks array<struct<chunk:string,n:bigint,docs:bigint>>").select("lang", "source", F.inline("chunks")).repartition("lang", "source", "chunk").groupBy("lang", "source", "chunk").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def places(asked: DataFrame) -> bytes:
    """A bit for the hash of each asked chunk of a language, of 2**BITS bits: what tasks get to leave out most other chunks."""
    place = F.crc32(F.concat("lang", F.lit(" "), "chunk").cast("binary")) % (1 << BITS)
    words = asked.withColumn("place", place).groupBy(F.expr("place div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("bits"))
    out = np.zeros(1 << (BITS - 6), np.int64)
    for r in words.toLocalIterator():
        out[r["word"]] = r["bits"]
    return out.tobytes()


def asked_chunks(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """row, lang, chunk: each document's distinct chunks, at least those of asked (lang, chunk; distinct) and few others. docs has row,
    lang and text."""
    own, marked = defaultdict(set), None
    if asked.count() <= SENT:
        for r in asked.toLocalIterator():
            own[r["lang"]].add(r["chunk"].encode())
    else:
        marked = places(asked)
    sent = docs.sparkSession.sparkContext.broadcast((dict(own), marked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, marked = sent.value
        none: set[bytes] = set()
        for batch in batches:
            rows, langs, chunks = [], [], []
            for row, text, lang in zip(batch.column("row").to_pylist(), batch.column("text"), batch.column("lang").to_pylist(), strict=True):
                words = set(text.as_py().split())
                if marked is None:
                    found = list(words & own.get(lang, none))
                else:
                    start = zlib.crc32(lang.encode() + b" ")
                    found = [w for w in words if marked[(at := zlib.crc32(w, start) & MASK) >> 3] >> (at & 7) & 1]
                rows += [row] * len(found)
                langs += [lang] * len(found)
                chunks += found
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(langs, pa.string()), pa.array(chunks, pa.binary()).view(pa.string())], ["row", "lang", "chunk"])

    return docs.select("row", "lang", F.col("text").cast("binary").alias("text")).mapInArrow(run, "row long, lang string, chunk string")


def chunk_terms(chunks: DataFrame) -> DataFrame:
    """chunk, term, times: each distinct chunk taken apart once."""
    found = F.regexp_extract_all(F.translate("chunk", *LOWER), F.lit(TERM), F.lit(0))
    return chunks.select("chunk").distinct().select("chunk", F.explode(found).alias("term")).groupBy("chunk", "term").agg(F.count("*").alias("times"))


def kept_terms(docs: DataFrame, by_lang: DataFrame, terms: DataFrame, least: int) -> DataFrame:
    """lang, term of the terms in ``least`` documents of their language or more."""
    parts = materialize(by_lang.join(terms.hint("shuffle_hash"), "chunk").select("lang", "term", "chunk", "docs"), "terms-chunks")
    bounds = parts.groupBy("lang", "term").agg(F.max("docs").alias("low"), F.sum("docs").alias("high"))
    bounds = materialize(bounds.filter(F.col("high") >= least), "terms-bounds")
    sure = bounds.filter(F.col("low") >= least).select("lang", "term")
    asked = materialize(parts.join(bounds.filter(F.col("low") < least).hint("shuffle_hash"), ["lang", "term"]).select("lang", "chunk", "term"), "terms-asked")
    chunks = materialize(asked.select("lang", "chunk").distinct(), "chunks-asked")
    rare = asked_chunks(docs.withColumn("row", F.monotonically_increasing_id()), chunks)
    found = rare.join(asked, ["lang", "chunk"]).select("lang", "term", "row").distinct().groupBy("lang", "term").agg(F.count("*").alias("docs"))
    kept = materialize(sure.unionByName(found.filter(F.col("docs") >= least).select("lang", "term")), "terms-kept")
    discard(parts, bounds, asked, chunks)
    return kept


def share(count: Column, total: Column) -> Column:
    """1 + floor(10**9 * count / total) by long division in three digits at a time, so that nothing overflows."""
    whole, rest = F.lit(0).cast("long"), count
    for _ in range(SCALE_THOUSANDS):
        whole, rest = whole * 1000 + F.call_function("div", rest * 1000, total), rest * 1000 % total
    return whole + 1


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def divergence(docs: DataFrame, least: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: for each source of a language all others (part ``pair``) and its ``top`` terms that
    stand out against the language (part ``term``)."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counts = materialize(chunk_counts(docs), "chunks")
    by_lang = materialize(counts.groupBy("lang", "chunk").agg(F.sum("docs").alias("docs")), "chunks-by-lang")
    terms = materialize(chunk_terms(by_lang), "chunk-terms")
    kept = kept_terms(docs, by_lang, terms, least)
    wanted = terms.join(kept.select("term").distinct(), "term", "left_semi")
    occurrences = counts.join(wanted.hint("shuffle_hash"), "chunk").groupBy("lang", "source", "term").agg(F.sum(F.col("n") * F.col("times")).alias("count"))
    found = materialize(occurrences.join(kept, ["lang", "term"]), "terms-counted")
    discard(counts, by_lang, terms)

    of_lang = found.groupBy("lang", "term").agg(F.sum("count").alias("count"))
    langs = of_lang.groupBy("lang").agg(F.sum("count").alias("n"), F.count("*").alias("v"))
    sizes = found.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = docs.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs.select("lang", "v"), "lang", "left")
    total = F.coalesce("n", F.lit(0).cast("long")) + 2 * F.col("v")
    groups = groups.select("lang", "source", "v", total.alias("total"), share(F.lit(ADDED).cast("long"), total).alias("p0"))
    groups = materialize(groups, "sources")
    langs = langs.select("lang", (F.col("n") + 2 * F.col("v")).alias("total"))
    of_lang = of_lang.join(langs, "lang").select("lang", "term", share(F.col("count") + ADDED, F.col("total")).alias("q"))
    shares = found.join(groups, ["lang", "source"]).select("lang", "source", "term", share(F.col("count") + ADDED, F.col("total")).alias("p"), "p0")
    shares = materialize(shares.join(of_lang, ["lang", "term"]), "shares")
    discard(found, kept)

    out = standing_out(shares, top).unionByName(pairs(shares, groups))
    return out.select("lang", "source", "part", "item", "value", "rank")


def ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def standing_out(shares: DataFrame, top: int) -> DataFrame:
    more = shares.filter(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    return ranked(more).filter(F.col("rank") <= top)


def pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """Each two sources of a language, both ways. Kept terms that a source does not have, have its share p0."""
    one, two = (groups.select("lang", F.col("source").alias(s), F.col("p0").alias(f"{s}0"), "v") for s in ("source", "item"))
    every = materialize(one.join(two.drop("v"), "lang").filter("source <> item"), "source-pairs")
    own, other = F.col("source0"), F.col("item0")
    by_share = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("k"))
    single = by_share.join(every, ["lang", "source"]).groupBy("lang", "source", "item").agg(F.sum(F.col("k") * (apart(F.col("p"), other) - apart(own, other))).alias("one"))
    rows = shares.groupBy("lang", "term").agg(F.collect_list("source").alias("source"), F.collect_list("p").alias("p"), F.collect_list("p0").alias("p0"))  # as long as a row of the result's pairs
    both = rows.drop("term").mapInPandas(_in_both, "lang string, source string, item string, both long").groupBy("lang", "source", "item").agg(F.sum("both").alias("both"))
    key = ["lang", "source", "item"]
    back = {"source": "item", "item": "source"}
    parts = single.unionByName(single.withColumnsRenamed({"source": "_s"}).withColumnsRenamed({"item": "source", "_s": "item"})).select(*key, F.col("one").alias("value"))
    mirrored = both.select("lang", *[F.col(v).alias(k) for k, v in back.items()], "both")
    parts = parts.unionByName(both.unionByName(mirrored).select(*key, F.col("both").alias("value")))
    parts = parts.unionByName(every.select(*key, (F.col("v") * apart(own, other)).alias("value")))
    summed = parts.groupBy(*key).agg(F.coalesce(F.sum("value"), F.lit(0)).alias("value"))
    return ranked(summed.withColumn("part", F.lit("pair")))


def _in_both(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """lang, source, item, both of each two sources: what the terms that both have add to the sums of single ones. A source without
    a term stands there with its share p0, which makes its part 0."""
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for batch in batches:
        for lang, rows in batch.groupby("lang", sort=False):
            at = np.repeat(np.arange(len(rows)), rows["source"].map(len))
            names, of = np.unique(np.concatenate([np.asarray(x, object) for x in rows["source"]]).astype(str), return_inverse=True)
            p0 = np.zeros(len(names), np.int64)
            p0[of] = np.concatenate(rows["p0"].to_numpy())
            p = np.repeat(p0[:, None], len(rows), axis=1)
            p[of, at] = np.concatenate(rows["p"].to_numpy())
            for k in range(len(names) - 1):
                own, others = p[k], p[k + 1 :]
                base = p0[k + 1 :, None]
                found = (f(own, others) - f(own, base) - f(p0[k], others) + f(p0[k], base)).sum(axis=1)
                yield pd.DataFrame({"lang": lang, "source": names[k], "item": names[k + 1 :], "both": found})


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


QUERIES = {"op11_divergence": op11_divergence}

SQL = {
    "op11_divergence": r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
found AS MATERIALIZED (SELECT lang, source, row, unnest(terms) AS term FROM docs),
kept AS MATERIALIZED (SELECT lang, term, count(*)::HUGEINT AS n FROM found GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
counted AS MATERIALIZED (SELECT lang, source, term, count(*)::HUGEINT AS n FROM found JOIN kept USING (lang, term) GROUP BY ALL),
langs AS MATERIALIZED (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
sources AS MATERIALIZED (
  SELECT g.lang, g.source, coalesce(c.total, 0) + 2 * l.v AS total
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN langs l USING (lang)
  LEFT JOIN (SELECT lang, source, sum(n)::HUGEINT AS total FROM counted GROUP BY ALL) c USING (lang, source)),
shares AS MATERIALIZED (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, (1 + 1000000000 * (coalesce(c.n, 0) + 2) // s.total)::HUGEINT AS p,
         (1 + 1000000000 * (k.n + 2) // (l.total + 2 * l.v))::HUGEINT AS q
  FROM sources s JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN counted c USING (lang, source, term)),
parts AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM shares WHERE n > 0 AND p > q
  UNION ALL
  SELECT s.lang, s.source, 'pair', t.source, coalesce(v.value, 0)
  FROM sources s JOIN sources t ON s.lang = t.lang AND s.source <> t.source LEFT JOIN (
    SELECT a.lang, a.source, b.source AS other, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term GROUP BY ALL) v ON v.lang = s.lang AND v.source = s.source AND v.other = t.source)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
WHERE part = 'pair' OR rank <= 10""",
}
