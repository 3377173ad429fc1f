"""Mixing sources to target weights, with DataFrame operations only.

Tokens are summed per source, the sums give each source a target and a repetition rate, and each document is
emitted floor(rate) times plus once more with the probability of the fraction, drawn from a hash of seed and id.

Defined cases: a null text has size 0; null is a source of its own, last in order; a source without words has target
and rate 0; repeated rows with one id draw alike; a null id draws as the word ``null``; an empty table gives none.
Columns beside ``doc_id``, ``source`` and ``text`` pass through; those named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, table, unit

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
SEED = "mix-1"
#: Above so many sources their targets are joined by a salted shuffle, not broadcast (about 60 bytes each).
BROADCAST_SOURCES = 100_000
SALTS = 64
OUT = ("source_size", "target", "rate", "copies")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per source: its size and target. Targets are filled up together in proportion to the weights; a source
    whose cap is reached stops there, and what is left goes on to the others.

    The windows without partitions run over one row per source, never over documents.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights) + 1).cast("int"))
    by = by.withColumn("weight", weight).withColumn("full", F.lit(cap) * F.col("source_size"))
    everything = Window.partitionBy()
    filling = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(0, Window.unboundedFollowing)
    by = by.withColumn("full_at", F.col("full") / F.col("weight"))
    wanted = F.lit(share) * F.sum("source_size").over(everything)
    by = by.withColumn("level", (wanted - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    by = by.withColumn("last_level", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "source", "level"))).over(everything)["level"])
    target = F.when(F.col("last_level").isNull() | (F.col("full_at") < F.col("last_level")), F.col("full")).otherwise(F.col("last_level") * F.col("weight"))
    return by.select("source", "source_size", target.alias("target"))


def plan_mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED, counted: bool = False) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``rate`` and ``copies``; docs have doc_id, source and text, or, if
    ``counted``, their words as size in place of text."""
    docs = docs if counted else docs.withColumn("size", n_words(F.col("text")))
    docs = docs.drop(*OUT, "_key", "_salt")
    targets = materialize(source_targets(docs, weights, share, cap), "mix-targets")
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("_key")
    targets = targets.select(key, "source_size", "target")
    if targets.count() <= BROADCAST_SOURCES:
        mixed = docs.withColumn("_key", key).join(F.broadcast(targets), "_key")
    else:
        salted = targets.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        mixed = docs.withColumn("_key", key).withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["_key", "_salt"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor("rate")
    extra = (unit(seed, F.col("doc_id")) < F.col("rate") - whole).cast("long")
    return mixed.withColumn("rate", rate).withColumn("copies", whole + extra).drop("_key", "_salt")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """The mix itself: each document as often as it is taken, with ``copy`` from 1 on."""
    planned = plan_mix(docs, weights, share, cap, seed)
    return planned.filter("copies > 0").withColumn("copy", F.explode(F.expr("sequence(1, cast(copies as int))")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    planned = plan_mix(materialize(docs, "mix-sizes"), counted=True)
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


QUERIES = {"op9_mixing": op9_mixing}

SQL = {
    "op9_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
by_source AS (
  SELECT *, 2.0::DOUBLE * source_size AS full_size, full_size / weight AS full_at FROM (
    SELECT source, sum(size)::BIGINT AS source_size,
           CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight
    FROM sized GROUP BY source)),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - coalesce(sum(full_size) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM by_source),
last_level AS (SELECT min_by(level, full_at) AS level FROM levels WHERE level <= full_at),
targets AS (
  SELECT source, source_size, CASE WHEN l.level IS NULL OR full_at < l.level THEN full_size ELSE l.level * weight END AS target
  FROM levels, last_level l),
rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('mix-1:' || coalesce(s.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated""",
}
