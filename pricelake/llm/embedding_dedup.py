"""Links between embeddings of a label by product quantisation, and what they join.

Two vectors of one label link when their cosine, in double precision, is 0.93 or more: when unit vectors are at most
r = sqrt(2 - 2 * 0.93) apart.

1. Equal vectors of a label are a class; its smallest id stands for it and carries the number of copies.
2. Centroids and residual codebooks are fitted on a bounded sample; the number of centroids is the largest power of two at which the
   sample's vectors need few probes. Every class goes into the inverted list of its nearest centroid, with a code for each
   subspace of its residual and the length of what the code leaves out.
3. Sufficient probes: a partner in list j lies beyond the plane half-way between the own centroid and that of j; if this plane is
   farther than r, no partner is there. Of two lists the lower one's vectors probe the higher one. So no linked pair is missed.
4. Lists are dealt in tiles of bounded numbers of listed vectors and probing vectors. In a tile, table lookups give the distance
   of each probing vector to each code; if it is over r plus the code's own error, the pair can't link. The
   others are ranked anew by their exact cosine.
5. A tile returns a row a vector: how many vectors it links with, and one link that joins what the tile's links join.
   Components over these links.

The result is exact for any sample: centroids and codes only decide how much is compared.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, those without a label and those
without an id link with nothing; without an id they have no component and are not kept. Vectors of different lengths never link.
Rows of one id are vectors each, and count as linked if they are near. Ties need no order. An empty table gives no row.
Columns beside ``vec_id``, ``embedding`` and ``label`` are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, table, unit
from .ngram_join import components

COSINE = 0.93
#: Vectors that centroids and codebooks are fitted on, about; nothing else is sampled.
SAMPLE = 20_000
#: Probes a vector, on average over the sample, that the number of centroids may lead to, and the most centroids.
PROBES = 6
MOST_LISTS = 1024
SUBSPACES, CODES, ROUNDS = 8, 256, 8
#: Vectors of a list in a tile, and vectors that probe them there.
PART, SLICE = 2048, 4096
#: Probing vectors whose tables are held at once.
BLOCK = 128
#: For the rounding of sums that only rule pairs out.
SLACK = 1e-4
TILE = ["grp", "cell", "part", "slice"]


def k_means(points: np.ndarray, k: int) -> np.ndarray:
    """k centres at most, from evenly spaced points on; centres that lose all points stay where they are."""
    centres = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        at = nearest(points, centres)
        order = np.argsort(at, kind="stable")
        own, first = np.unique(at[order], return_index=True)
        centres[own] = np.add.reduceat(points[order], first, axis=0) / np.diff(np.append(first, len(points)))[:, None]
    return centres


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances."""
    return np.maximum((points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1), 0)


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    step = max(1, 4_000_000 // len(centres))
    return np.concatenate([distances(points[k : k + step], centres).argmin(1) for k in range(0, len(points), step)] or [np.zeros(0, int)])


class Index:
    """Centroids, and codebooks for the subspaces of residuals."""

    def __init__(self, sample: np.ndarray, reach: float, probes: float = PROBES):
        self.reach = reach
        lists, self.centres = 1, sample.mean(axis=0, keepdims=True)
        while lists * 2 <= min(MOST_LISTS, len(sample) // 16):
            lists *= 2
            before, self.centres = self.centres, np.unique(k_means(sample, lists), axis=0)
            if self.assigned(sample)[1].sum() > probes * len(sample):
                self.centres = before
                break
        residual = sample - self.centres[nearest(sample, self.centres)]
        self.spans = [s for s in np.array_split(np.arange(sample.shape[1]), SUBSPACES) if len(s)]
        self.books = [k_means(residual[:, s], min(CODES, len(residual))) for s in self.spans]

    def assigned(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each point's list, and which lists it has to probe for partners: those above its own that reach can lead into."""
        d = distances(points, self.centres)
        own = d.argmin(1)
        apart = np.sqrt(distances(self.centres, self.centres))[own]
        beyond = d - d[np.arange(len(d)), own][:, None] <= 2 * apart * self.reach + SLACK
        return own, beyond & (np.arange(len(self.centres)) > own[:, None])

    def codes(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes by subspace, and how far each residual is from what its codes stand for."""
        codes = np.stack([nearest(residual[:, s], b) for s, b in zip(self.spans, self.books, strict=True)], axis=1)
        left = sum(((residual[:, s] - b[codes[:, m]]) ** 2).sum(1) for m, (s, b) in enumerate(zip(self.spans, self.books, strict=True)))
        return codes.astype(np.uint8), np.sqrt(left)

    def near(self, residual: np.ndarray, codes: np.ndarray, error: np.ndarray) -> np.ndarray:
        """Which of the coded vectors (columns) may be within reach of these residuals (rows): asymmetric distances, a table for
        each residual and subspace, looked up by code."""
        total = np.zeros((len(residual), len(codes)), np.float32)
        for m, (s, b) in enumerate(zip(self.spans, self.books, strict=True)):
            total += distances(residual[:, s], b).astype(np.float32)[:, codes[:, m]]
        return total <= ((self.reach + error + SLACK) ** 2).astype(np.float32)


def units(vectors: pd.Series) -> np.ndarray:
    """Unit vectors from the bytes of doubles."""
    x = np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def can_link() -> Column:
    v = F.col("embedding").cast("array<double>")
    good = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & good, F.lit(False))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, grp (label and length) and the vector's doubles as bytes, of rows that can link."""
    v = F.col("embedding").cast("array<double>")
    grp = F.concat_ws(":", F.size(v).cast("string"), F.col("label").cast("string"))
    rows = vectors.filter(can_link()).select("vec_id", grp.alias("grp"), v.alias("v"))

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"vec_id": batch["vec_id"], "grp": batch["grp"], "v": [(np.asarray(x, np.float64) + 0.0).tobytes() for x in batch["v"]]})

    return rows.mapInPandas(run, "vec_id long, grp string, v binary")


def fit(classes: DataFrame, reach: float) -> dict[int, Index]:
    """An index for each length of vectors, on a sample drawn by a hash of the vectors."""
    lengths = {r["d"]: r["n"] for r in classes.groupBy((F.octet_length("v") / 8).cast("int").alias("d")).agg(F.count("*").alias("n")).collect()}
    found = {}
    for d, n in sorted(lengths.items()):
        drawn = classes.filter((F.octet_length("v") == 8 * d) & (unit("embedding", F.sha2("v", 256)) < SAMPLE / n)).select("v", F.sha2("v", 256).alias("h")).toPandas()
        if not len(drawn):
            drawn = classes.filter(F.octet_length("v") == 8 * d).select("v", F.sha2("v", 256).alias("h")).limit(1).toPandas()
        found[d] = Index(units(drawn.sort_values("h")["v"]), reach)
    return found


def listed(classes: DataFrame, indexes) -> DataFrame:
    """The classes in their lists, with codes and their error, and the lists that they probe."""

    def run(batches):
        for batch in batches:
            size = batch["v"].map(len)
            for length in size.unique():
                rows, index = batch[size == length], indexes.value[length // 8]
                for k in range(0, len(rows), 1024):
                    some = rows.iloc[k : k + 1024]
                    x = units(some["v"])
                    cell, probed = index.assigned(x)
                    codes, error = index.codes(x - index.centres[cell])
                    yield some.assign(cell=cell.astype(np.int32), codes=[c.tobytes() for c in codes], error=error, probes=[np.flatnonzero(p).astype(np.int32) for p in probed])

    return classes.mapInPandas(run, "cls long, grp string, v binary, copies long, cell int, codes binary, error double, probes array<int>")


def tiles(lists: DataFrame) -> DataFrame:
    """The listed vectors in each tile of their list (``role`` 0), and those that probe them there (1)."""
    guests = lists.select("grp", F.explode("probes").alias("cell"))
    sizes = lists.groupBy("grp", "cell").agg(F.count("*").alias("own")).join(guests.groupBy("grp", "cell").agg(F.count("*").alias("guests")), ["grp", "cell"], "left")
    parts = F.ceil(F.col("own") / PART)
    coming = F.coalesce("guests", F.lit(0)) + F.when(parts > 1, F.col("own")).otherwise(0)
    sizes = materialize(sizes.select("grp", "cell", parts.cast("int").alias("parts"), F.greatest(F.ceil(coming / SLICE), F.lit(1)).cast("int").alias("slices")), "pq-sizes")
    draw = F.xxhash64("cls")
    part, slice_ = F.pmod(draw, F.col("parts")).cast("int"), F.pmod(F.shiftright(draw, 20), F.col("slices")).cast("int")
    known = ["grp", "cell", "part", "slice", "role", "cls", "copies", "v", "codes", "error"]
    own = lists.join(sizes, ["grp", "cell"]).withColumn("home", part)
    residents = own.withColumn("role", F.lit(0)).withColumn("part", F.col("home")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    above = own.filter(F.col("home") < F.col("parts") - 1).withColumn("role", F.lit(1)).withColumn("part", F.explode(F.sequence(F.col("home") + 1, F.col("parts") - 1))).withColumn("slice", slice_)
    visitors = lists.withColumn("cell", F.explode("probes")).join(sizes, ["grp", "cell"]).withColumn("role", F.lit(1)).withColumn("slice", slice_)
    visitors = visitors.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return residents.select(known).unionByName(above.select(known)).unionByName(visitors.select(known))


def compared(tile: pd.DataFrame, index: Index, cosine: float) -> pd.DataFrame:
    """cls, n, link: how many vectors each of the tile links with here, and one of the smallest number that joins the same ones."""
    tile = tile.sort_values(["role", "cls"], kind="stable")
    x, ids, copies = units(tile["v"]), tile["cls"].to_numpy(), tile["copies"].to_numpy()
    m = int((tile["role"] == 0).sum())
    codes, error = np.stack([np.frombuffer(c, np.uint8) for c in tile["codes"][:m]]), tile["error"].to_numpy()[:m]
    residual = x - index.centres[tile["cell"].iloc[0]]
    n, root = np.zeros(len(x), np.int64), np.arange(len(x))
    starts = [*(range(0, m, BLOCK) if tile["slice"].iloc[0] == 0 else ()), *range(m, len(x), BLOCK)]  # the list's own pairs are compared in one slice
    for k in starts:
        rows = np.arange(k, min(k + BLOCK, m if k < m else len(x)))
        at, to = np.nonzero(index.near(residual[rows], codes, error))
        at = rows[at]
        at, to = at[at > to], to[at > to]
        for j in range(0, len(at), 65_536):
            p, q = at[j : j + 65_536], to[j : j + 65_536]
            good = (x[p] * x[q]).sum(axis=1) >= cosine
            p, q = p[good], q[good]
            np.add.at(n, p, copies[q])
            np.add.at(n, q, copies[p])
            root = merged(root, p, q)
    least = np.full(len(x), np.iinfo(np.int64).max)
    np.minimum.at(least, root, ids)
    some = np.flatnonzero(n)
    return pd.DataFrame({"cls": ids[some], "n": n[some], "link": least[root[some]]})


def merged(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Each row's component, named by its first row, after these links too."""
    while True:
        a, b = root[p], root[q]
        apart = a != b
        if not apart.any():
            return root
        p, q, a, b = p[apart], q[apart], a[apart], b[apart]
        low = np.minimum(a, b)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while (root[root] != root).any():
            root = root[root]


def link_classes(classes: DataFrame, cosine: float) -> DataFrame:
    """cls, n, link: of each class that links with another, how many vectors it links with, a row for each tile."""
    spark = classes.sparkSession
    indexes = spark.sparkContext.broadcast(fit(classes, math.sqrt(2 - 2 * cosine)))
    lists = materialize(listed(classes, indexes), "pq-lists")

    def run(tile: pd.DataFrame) -> pd.DataFrame:
        return compared(tile, indexes.value[len(tile["v"].iloc[0]) // 8], cosine)

    out = materialize(tiles(lists).groupBy(*TILE).applyInPandas(run, "cls long, n long, link long"), "pq-links")
    discard(lists)
    return out


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding, label)."""
    rows = materialize(usable(vectors), "pq-vectors")
    classes = rows.groupBy("grp", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = materialize(classes.withColumn("cls", F.monotonically_increasing_id()), "pq-classes")
    found = link_classes(classes.select("cls", "grp", "v", "copies"), cosine)
    counts = found.groupBy("cls").agg(F.sum("n").alias("n"))
    labels = components(found.filter("link < cls").select(F.col("link").alias("a"), F.col("cls").alias("b")))
    named = classes.join(counts, "cls", "left").join(labels.select(F.col("doc_id").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    named = materialize(named.select("grp", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "least", "component"), "pq-named")
    least = materialize(named.groupBy("component").agg(F.min("least").alias("component_id")), "pq-components")
    named = materialize(named.join(least, "component").select("grp", "v", "n_links", "component_id"), "pq-results")
    linked = rows.join(named, ["grp", "v"]).select("vec_id", "n_links", "component_id")
    discard(classes, found)
    alone = vectors.filter(~can_link()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_embedding_dedup": op13_embedding_dedup}

SQL = {
    "op13_embedding_dedup": """
WITH RECURSIVE usable AS MATERIALIZED (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, CASE WHEN len(a.v) = len(b.v) THEN b.v ELSE a.v END) >= 0.93),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings WHERE vec_id IS NOT NULL
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, l.component_id, coalesce(e.vec_id = l.component_id, false) AS kept
FROM embeddings e LEFT JOIN least l ON l.a = e.vec_id LEFT JOIN degree d ON d.a = e.vec_id""",
}
