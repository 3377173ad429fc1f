"""Merkle manifest of a dataset: a digest of each row, one of each group, one of all, and a proof for each row.

Rows are leaves of their group's tree, in the order of their ids; while a tree has several nodes, every two consecutive ones
(the last one may be alone) are hashed into one. The groups' subroots, in the order of their names, are the leaves of one
more tree, whose top is the root.

1. Leaves are numbered in their groups by a range sort, so that no task holds a group.
2. Windows of 1024 consecutive leaves of a tree, ten levels each: at level k a node's row is that of its first leaf, and its
   sibling's row is 2**k before or behind it. So fixed-offset lag and lead columns, masked by the node's slot in its run and by
   the run's length, hold the siblings, and the first child's row hashes the parent. One exchange and one sort serve all levels.
3. The tops of such windows are the leaves of the next pass, until each tree has one node: a pass for every ten levels.
4. On the way back each node takes over the siblings that the pass above has found for its window's top, by a join on the window.

Defined cases: null, empty and very long texts are leaves like others; a null group is a group of its own, the first; rows
without an id come first in their group; rows of one id are ordered by their digest, and repeated rows are leaves each; an
empty table gives no row. Rows without an id are never tampered with. Only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that a pass climbs, so 1024 leaves a window.
LEVELS = 10
STEP = "struct<before:string,after:string>"


def digest(*values: Column) -> Column:
    """Lower-case hex SHA-256 of the values' texts, one after the other."""
    return F.sha2(F.concat(*values), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(*map(field, values))


def numbered(nodes: DataFrame, *order: str) -> DataFrame:
    """tree, h and the other columns, with a node's place ``pos`` in its tree, from 0 on, and the tree's number of nodes ``n``: a
    range sort, and each partition's count of a tree's nodes before it."""
    rows = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("_at", F.monotonically_increasing_id())
    rows = materialize(rows.withColumn("_part", F.shiftright("_at", 33)), "merkle-sorted")
    # A row for each partition that a tree reaches into.
    counts = rows.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    parts = Window.partitionBy("tree")
    before = parts.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).withColumn("n", F.sum("_rows").over(parts))
    counts = materialize(counts, "merkle-counts")
    return rows.join(counts, ["tree", "_part"]).withColumn("pos", F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_rows", "_before")


def climb(nodes: DataFrame, steps: bool) -> DataFrame:
    """Nodes with ``top`` on each window's first row, its hash after LEVELS levels, or, with ``steps``, on every row what stood
    before and after its own hash on that way."""
    window = Window.partitionBy("tree", "block").orderBy("pos")
    rows = nodes.withColumn("block", F.shiftright("pos", LEVELS)).withColumn("top", F.col("h"))
    last = F.col("n") - 1
    for k in range(LEVELS):
        index, length = F.shiftright("pos", k), 1 << k
        here = (F.col("pos") % length == 0) & (F.shiftright(last, k) > 0)
        slot, whole_run = index % 2, index < F.shiftright(last, k)
        rows = rows.withColumns({"_lag": F.lag("top", length).over(window), "_lead": F.lead("top", length).over(window)})
        rows = rows.withColumn(f"b{k}", F.when(here, F.when(slot == 1, F.col("_lag")).otherwise(F.lit(""))))
        rows = rows.withColumn(f"a{k}", F.when(here, F.when((slot == 0) & whole_run, F.col("_lead")).otherwise(F.lit(""))))
        rows = rows.withColumn("top", F.when(here & (slot == 0), digest(F.col("top"), F.col(f"a{k}"))).when(~here, F.col("top"))).drop("_lag", "_lead")
        rows = rows if steps else rows.drop(f"a{k}", f"b{k}")
    if not steps:
        return rows
    so_far = window.rowsBetween(Window.unboundedPreceding, 0)
    names = [f"{x}{k}" for x in "ba" for k in range(LEVELS)]
    rows = rows.withColumns({x: F.last(x, ignorenulls=True).over(so_far) for x in names})
    taken = [F.when(F.shiftright(last, k) > 0, F.struct(F.col(f"b{k}").alias("before"), F.col(f"a{k}").alias("after"))) for k in range(LEVELS)]
    return rows.withColumn("steps", F.array_compact(F.array(*taken))).drop("top", *names)


def ascend(nodes: DataFrame) -> list[DataFrame]:
    """The written nodes, and those of each pass above them; in the last every tree has one node."""
    levels = [nodes]
    while not levels[-1].filter("n > 1").isEmpty():
        tops = climb(levels[-1], steps=False).filter(F.col("pos") % (1 << LEVELS) == 0)
        n = F.shiftright(F.col("n") - 1, LEVELS) + 1
        levels.append(materialize(tops.select("tree", F.col("block").alias("pos"), n.alias("n"), F.col("top").alias("h")), "merkle-tops"))
    return levels


def descend(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The nodes of levels[0] with all columns of ``above``, which has (tree, pos, steps, ...) for the one node of each tree; the
    steps of each pass go before those of the next."""
    if len(levels) == 1:
        return levels[0].join(above, ["tree", "pos"])
    for nodes in reversed(levels[:-1]):
        further = above.withColumnsRenamed({"pos": "block", "steps": "_further"})
        above = climb(nodes, steps=True).join(further, ["tree", "block"]).withColumn("steps", F.concat("steps", "_further")).drop("_further", "block")
        above = above if nodes is levels[0] else above.drop("n", "h")
    return above


def manifest(rows: DataFrame, group: str = "lang", order: str = "doc_id", fields: Sequence[str] = FIELDS, **also: Column) -> DataFrame:
    """One row for each row: order, group, leaf, subroot, root and steps, from the leaf to the root, of what stands before and
    after the own digest. ``also`` names further columns to compute from the row."""
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # null first
    leaves = rows.select(tree.alias("tree"), F.col(order).alias("id"), F.col(group).alias("name"), leaf(*map(F.col, fields)).alias("h"), *[c.alias(f"also_{x}") for x, c in also.items()])
    levels = ascend(materialize(numbered(materialize(leaves, "merkle-leaves"), "id", "h"), "merkle-nodes"))
    subroots = levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), "h")
    tops = ascend(materialize(numbered(subroots, "of"), "merkle-subroots"))
    root = tops[-1].select("tree", "pos", F.col("h").alias("root"), F.array().cast(f"array<{STEP}>").alias("steps"))
    of_trees = descend(tops, root).select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("pos"), F.col("h").alias("subroot"), "root", "steps")
    found = descend(levels, materialize(of_trees, "merkle-root"))
    return found.select(F.col("id").alias(order), F.col("name").alias(group), F.col("h").alias("leaf"), "subroot", "root", "steps", *[F.col(f"also_{x}").alias(x) for x in also])


def proof_digest(steps: Column) -> Column:
    """The digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s.before, s.after)), ""), 256)


def folded(start: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings make."""
    return F.aggregate(steps, start, lambda h, s: digest(s.before, h, s.after))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampering = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    altered = F.when(tampering, leaf(*[F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]))
    made = manifest(docs, altered=altered)
    made = made.withColumn("folded_root", folded(F.coalesce("altered", "leaf"), F.col("steps")))
    return made.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {"op12_manifest": op12_manifest}

_FIELDS = "concat(" + ", ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in FIELDS) + ")"

SQL = {
    "op12_manifest": f"""
WITH RECURSIVE docs AS MATERIALIZED (
  SELECT *, coalesce('=' || lang, '') AS tree, sha256({_FIELDS}) AS leaf, sha256({_FIELDS.replace("n_chars::", "(n_chars + 1)::")}) AS changed,
         (4294967295 - list_reduce(
            list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
            lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[],
                                     lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::UBIGINT) ELSE y >> 1 END))) % 7 = 0 AS tampered
  FROM documents),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM docs),
nodes AS (
  SELECT tree, 0 AS level, pos, n, leaf AS h FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 2, n),
subroots AS MATERIALIZED (
  SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, pos, n, h FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 2, n),
sides AS MATERIALIZED (  -- the sibling of each node that has a parent
  SELECT a.tree, a.level, a.pos, a.n, b.h AS sibling
  FROM nodes a LEFT JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND b.pos = xor(a.pos, 1) WHERE a.n > 1),
top_sides AS MATERIALIZED (
  SELECT a.level, a.pos, b.h AS sibling FROM tops a LEFT JOIN tops b ON a.level = b.level AND b.pos = xor(a.pos, 1) WHERE a.n > 1),
up AS (
  SELECT p.tree, p.pos AS leaf_pos, 0 AS level, p.pos, coalesce(CASE WHEN p.tampered THEN p.changed END, p.leaf) AS h, '' AS proof FROM placed p
  UNION ALL
  SELECT u.tree, u.leaf_pos, u.level + 1, u.pos // 2,
         sha256(CASE WHEN u.pos % 2 = 1 THEN coalesce(s.sibling, '') ELSE '' END || u.h || CASE WHEN u.pos % 2 = 0 THEN coalesce(s.sibling, '') ELSE '' END),
         u.proof || coalesce(s.sibling, '')
  FROM up u JOIN sides s ON s.tree = u.tree AND s.level = u.level AND s.pos = u.pos),
at_subroot AS MATERIALIZED (
  SELECT u.*, s.h AS subroot, s.pos AS top_pos FROM up u JOIN subroots s ON s.tree = u.tree
  WHERE u.level = (SELECT max(level) FROM nodes x WHERE x.tree = u.tree)),
up_top AS (
  SELECT tree, leaf_pos, subroot, 0 AS level, top_pos AS pos, h, proof FROM at_subroot
  UNION ALL
  SELECT u.tree, u.leaf_pos, u.subroot, u.level + 1, u.pos // 2,
         sha256(CASE WHEN u.pos % 2 = 1 THEN coalesce(s.sibling, '') ELSE '' END || u.h || CASE WHEN u.pos % 2 = 0 THEN coalesce(s.sibling, '') ELSE '' END),
         u.proof || coalesce(s.sibling, '')
  FROM up_top u JOIN top_sides s ON s.level = u.level AND s.pos = u.pos)
SELECT p.doc_id, p.leaf, u.subroot, r.h AS root, sha256(u.proof) AS proof_sha256, u.h AS folded_root, u.h = r.h AS verified
FROM placed p JOIN up_top u ON u.tree = p.tree AND u.leaf_pos = p.pos AND u.level = (SELECT max(level) FROM tops) CROSS JOIN (SELECT h FROM tops WHERE n = 1) r""",
}
