"""Ranks over whole tables that no task holds."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def with_rank(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Adds the row's number from 1 on, by columns that order all rows: a range sort, and each partition's count of rows before it."""
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part, own = F.shiftright("_at", 33), F.col("_at") - F.shiftleft(F.shiftright("_at", 33), 33)
    rows = rows.withColumn("_part", part).withColumn("_own", own)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(counts, "_part").withColumn(name, F.col("_before") + F.col("_own") + 1).drop("_part", "_own", "_at", "_before")


#: Accuracy of the bounds between which percentiles looks for its values.
ACCURACY = 2000


def percentiles(df: DataFrame, columns: tuple[str, ...], shares: tuple[float, ...]) -> dict[str, list[float | None]]:
    """What F.percentile gives for each column and share, exactly, but no task holds a column's values.

    Approximate percentiles bound each value; rows below the bounds are counted, and only the values between them, some
    thousandths of all, are ordered. Bounds that turn out too narrow are widened. The table is read some times: write it first.
    """
    n = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    found = {c: [None] * len(shares) for c in columns}
    open_, half = [(c, k, (n[c] - 1) * p) for c in columns if n[c] for k, p in enumerate(shares)], 2 / ACCURACY
    while open_:
        near = lambda c, at: F.percentile_approx(c, min(1.0, max(0.0, at / max(1, n[c] - 1))), ACCURACY)
        width = lambda c: half * n[c] + 2
        bounds = df.agg(*[x for c, _, at in open_ for x in (near(c, at - width(c)), near(c, at + width(c)))]).first()
        inside = [(F.col(c) >= bounds[2 * k]) & (F.col(c) <= bounds[2 * k + 1]) for k, (c, _, _) in enumerate(open_)]
        below = df.agg(*[F.count_if(F.col(c) < bounds[2 * k]) for k, (c, _, _) in enumerate(open_)]).first()
        each = F.array_compact(F.array(*[F.when(x, F.struct(F.lit(k).alias("k"), F.col(c).cast("double").alias("value"))) for k, (x, (c, _, _)) in enumerate(zip(inside, open_, strict=True))]))
        values = df.select(F.inline(each)).groupBy("k", "value").agg(F.count("*").alias("n"))
        of = lambda numbers: F.element_at(F.array(*[F.lit(int(x)) for x in numbers]), F.col("k") + 1)
        upto = of(below) + F.sum("n").over(Window.partitionBy("k").orderBy("value"))  # over the values between two bounds
        low, high = of(math.floor(at) for _, _, at in open_), of(math.ceil(at) for _, _, at in open_)
        got = values.withColumn("upto", upto).groupBy("k").agg(F.min(F.when(F.col("upto") > low, F.col("value"))).alias("low"), F.min(F.when(F.col("upto") > high, F.col("value"))).alias("high"))
        got, left = {r["k"]: r for r in got.collect()}, []
        for k, (c, share, at) in enumerate(open_):
            r = got.get(k)
            if r is None or r["high"] is None or below[k] > math.floor(at):
                left.append((c, share, at))
            else:
                a, b = math.floor(at), math.ceil(at)
                found[c][share] = r["low"] if a == b or r["low"] == r["high"] else (b - at) * r["low"] + (at - a) * r["high"]
        open_, half = left, half * 8
    return found
