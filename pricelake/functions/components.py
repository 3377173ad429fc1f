"""Connected components of links that no task holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written


def components(links: DataFrame) -> DataFrame:
    """u, component of every node in a link (a, b): the smallest node that links reach.

    A round moves each node to the smallest of itself, its neighbours and what that one moves to, and only the links between such
    nodes go on, each once. So links shrink from round to round, a hub keeps one link to each node that is left, and there are about
    as many rounds as the logarithm of the longest way. The rounds' moves are put together at the end, the last ones first.
    """
    links = written(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    rounds = []
    while not links.isEmpty():
        ends = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        near = ends.groupBy("u").agg(F.least("u", F.min("v")).alias("c"))
        further = near.select(F.col("u").alias("c"), F.col("c").alias("then"))
        moves = written(near.join(further, "c").select("u", F.least("c", "then").alias("c")), "moves")
        to = {x: moves.select(F.col("u").alias(x), F.col("c").alias(f"to_{x}")) for x in "ab"}
        left = links.join(to["a"], "a").join(to["b"], "b").filter("to_a <> to_b")
        links = written(left.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "links")
        rounds.append(moves)
    if not rounds:
        return links.select(F.col("a").alias("u"), F.col("b").alias("component"))
    out = rounds.pop()
    while rounds:
        later = out.select(F.col("u").alias("c"), F.col("c").alias("end"))
        out = written(rounds.pop().join(later, "c", "left").select("u", F.coalesce("end", "c").alias("c")), "moves")
    return out.withColumnRenamed("c", "component")
