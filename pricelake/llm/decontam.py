"""Benchmark decontamination by greedy string tiling.

Words (lower-cased, ASCII punctuation apart) of documents and benchmark items are joined on shared seeds: runs of
``MIN_TILE`` words, by a Karp-Rabin hash. Where an item shares enough seeds with a document, running Karp-Rabin greedy
string tiling marks the longest matches that don't overlap, again and again, down to ``MIN_TILE`` words. A document is
contaminated if the tiles cover ``COVERAGE`` of an item's words, in whatever order its parts stand.

Both sides are rows: the seeds of items, and those seeds of documents that a bitmap of at most ``BITS`` bits over the items' seeds
lets through (a full bitmap lets more through and changes no result). Tiles that cover an item hold at least
``COVERAGE * words / seed length`` of its seeds, so the seeds an item can spare, those that most texts have, propose no
pairs: they are looked up for the pairs that the others proposed. Equal texts are tiled once. Words and runs are compared
by hashes of 64 bits.

Defined cases: null and wordless texts match nothing; an item of fewer than MIN_TILE words must occur whole; repeated
items count once, repeated documents each; an empty benchmark finds nothing. Extra columns pass through ``clean``.
"""

from __future__ import annotations

import string
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, table

MIN_TILE = 5
COVERAGE = 0.6
#: Bits of the bitmap for each seed, and in all, at most.
BITS_A_SEED = 64
BITS = 2**26
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
MIX = np.uint64(0xD6E8FEB86659FD93)
SPLIT = bytes(32 if chr(c) in string.punctuation else c for c in range(256))
SEEDS = "item_key string, n int, n_tokens int, hash long, m int"
HITS = "doc_id long, text_key string, hashes array<long>, places array<array<int>>"
TILED = "text_key string, item_id long, matched int, n_tokens int, coverage double, tiles int"
FOUND = ("doc_id", "item_id", "matched", "n_tokens", "coverage", "tiles")


def words(text: str | None) -> list[bytes]:
    return [] if text is None else text.lower().encode("utf-8", "surrogatepass").translate(SPLIT).split()


def numbers(text: str | None) -> np.ndarray:
    """The text's words as hashes of 64 bits."""
    own = words(text)
    return np.fromiter(map(xxhash.xxh64_intdigest, own), np.uint64, len(own))


class Runs:
    """Karp-Rabin hashes, modulo 2**64, of the runs of any length of one sequence, from one pass of prefix sums."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        power = lambda base: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))
        self.back = power(INVERSE)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * MIX * power(BASE)[:n], dtype=np.uint64)])

    def of(self, n: int) -> np.ndarray:
        most = max(len(self.sums) - n, 0)
        return ((self.sums[n:] - self.sums[:most]) * self.back[:most] + np.uint64(n)) * MIX


def clear(free: np.ndarray, n: int) -> np.ndarray:
    """Where runs of n free words start."""
    total = np.concatenate([[0], np.cumsum(free)])
    return np.flatnonzero(total[n:] - total[: max(len(total) - n, 0)] == n)


def tile(pattern: np.ndarray, text: np.ndarray, least: int) -> list[int]:
    """Lengths of the tiles of greedy string tiling, longest first; among equally long ones the first of the pattern, then of the text.

    Text words of -1 are in no tile. Each round finds the longest free match by halving, then marks all of that length:
    as many rounds as there are lengths of tiles, each of about a sort of both sides, however often words repeat.
    """
    p_runs, t_runs = Runs(pattern), Runs(text)
    p_free, t_free = np.ones(len(pattern), bool), text >= 0
    tiles: list[int] = []
    most = min(len(pattern), len(text))
    while True:
        low, high = least - 1, most
        while low < high:
            n = (low + high + 1) // 2
            if np.isin(p_runs.of(n)[clear(p_free, n)], t_runs.of(n)[clear(t_free, n)]).any():
                low = n
            else:
                high = n - 1
        if low < least:
            return tiles
        places = defaultdict(list)
        at = clear(t_free, low)[::-1]
        for t, h in zip(at.tolist(), t_runs.of(low)[at].tolist(), strict=True):
            places[h].append(t)
        at = clear(p_free, low)
        for p, h in zip(at.tolist(), p_runs.of(low)[at].tolist(), strict=True):
            if not (p_free[p] and p_free[p + low - 1]):
                continue
            queue = places.get(h, [])
            while queue:
                t = queue.pop()
                if t_free[t] and t_free[t + low - 1]:
                    p_free[p : p + low] = t_free[t : t + low] = False
                    tiles.append(low)
                    break
        most = low - 1


def regions(ids: np.ndarray, pattern: np.ndarray, hashes: list[int], places: list[list[int]], n: int) -> np.ndarray:
    """What the seeds of one item (hashes of its words, their numbers) cover of a document, as the same numbers; -1 parts the pieces.
    A tile is a run of seeds, so none is missed."""
    first: dict[int, int] = {}
    for p, h in enumerate(Runs(ids).of(n).view(np.int64).tolist()):
        first.setdefault(h, p)
    at = np.concatenate([np.asarray(x, np.int64) for x in places])
    source = np.repeat([first[h] for h in hashes], [len(x) for x in places])
    cover = np.unique(at[:, None] + np.arange(n))
    place = np.arange(len(cover)) + np.concatenate([[0], np.cumsum(np.diff(cover) > 1)])
    text = np.full(place[-1] + 1, -1, np.int64)
    for k in range(n):
        text[place[np.searchsorted(cover, at + k)]] = pattern[source + k]
    return text


def key_of(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_key, item_id, text: distinct items."""
    items = benchmark.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    return items.select(F.md5(F.concat_ws(":", F.coalesce(F.col("item_id").cast("string"), F.lit("null")), "text").cast("binary")).alias("item_key"), "item_id", "text")


def seeds_of(items: DataFrame) -> DataFrame:
    """One row per item and distinct seed, m times in it; seeds are as long as the item where it is shorter than MIN_TILE."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, text in zip(batch["item_key"], batch["text"], strict=True):
                ids = numbers(text)
                if len(ids):
                    n = min(MIN_TILE, len(ids))
                    hashes, m = np.unique(Runs(ids).of(n), return_counts=True)
                    yield pd.DataFrame({"item_key": key, "n": n, "n_tokens": len(ids), "hash": hashes.view(np.int64), "m": m})

    return items.select("item_key", "text").mapInPandas(run, SEEDS)


def bitmap(seeds: DataFrame) -> np.ndarray:
    """A bit for the first bits of each seed's hash: BITS bits at most, whatever the number of seeds."""
    size = min(BITS, max(128, 1 << (BITS_A_SEED * seeds.count()).bit_length()))
    shift = 65 - size.bit_length()
    rows = seeds.groupBy(F.shiftrightunsigned("hash", shift + 6).alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned(hash, {shift}) & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def hits_of(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """One row per document that has seeds which the bitmap lets through: the distinct ones and their places."""
    lengths = sorted(r["n"] for r in seeds.select("n").distinct().collect())  # MIN_TILE of them at most
    bits = bitmap(seeds)
    shift = np.uint64(59 - len(bits).bit_length())
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = sent.value
        for batch in batches:
            rows = []
            for doc, key, text in zip(batch["doc_id"].astype("Int64"), batch["text_key"], batch["text"], strict=True):
                ids = numbers(text)
                if not len(ids) or not lengths:
                    continue
                runs, hashes, places = Runs(ids), [], []
                for n in lengths:
                    own = runs.of(n)
                    start = own >> shift
                    at = np.flatnonzero((bits[start >> np.uint64(6)] >> (start & np.uint64(63))) & np.uint64(1))
                    hashes.append(own[at])
                    places.append(at.astype(np.int32))
                found, at = np.concatenate(hashes), np.concatenate(places)
                if len(found):
                    order = np.argsort(found, kind="stable")
                    found, first = np.unique(found[order], return_index=True)
                    rows.append((doc, key, found.view(np.int64), np.split(at[order], first[1:])))
            yield pd.DataFrame(rows, columns=["doc_id", "text_key", "hashes", "places"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), key_of(F.col("text")).alias("text_key"), "text").mapInPandas(run, HITS)


def tiled(items: DataFrame, seeds: DataFrame, hits: DataFrame) -> DataFrame:
    """One row per distinct text and item that it covers enough of."""
    texts = hits.groupBy("text_key").agg(F.first(F.arrays_zip("hashes", "places")).alias("own"))
    own = texts.select("text_key", F.explode("own").alias("seed")).select("text_key", F.col("seed.hashes").alias("hash"), F.col("seed.places").alias("places"))
    own = materialize(own.join(seeds.select("hash").distinct(), "hash", "left_semi"), "decontam-seeds")
    counted = seeds.join(own.groupBy("hash").agg(F.count("*").alias("in_texts")), "hash")
    spare = F.greatest(F.lit(1), F.ceil(F.lit(COVERAGE) * F.col("n_tokens") / F.col("n") - 1e-9)) - 1
    by_frequency = Window.partitionBy("item_key").orderBy(F.desc("in_texts"), "hash").rowsBetween(Window.unboundedPreceding, 0)
    counted = counted.withColumn("spared", F.sum("m").over(by_frequency) <= spare).select("item_key", "hash", "m", "spared")
    near = own.join(counted.filter(~F.col("spared")), "hash").select("text_key", "item_key", "hash", "m", "places")
    asked = near.select("text_key", "item_key").distinct().join(counted.filter("spared"), "item_key")
    rest = asked.join(own, ["text_key", "hash"]).select(near.columns)
    pairs = near.unionByName(rest).groupBy("text_key", "item_key").agg(F.sum("m").alias("in_item"), F.sum(F.size("places")).alias("in_text"), F.collect_list("hash").alias("hashes"), F.collect_list("places").alias("places"))
    size = seeds.select("item_key", "n", "n_tokens").distinct()
    enough = (F.col("in_item") > spare) & (F.col("in_text") * F.col("n") >= F.lit(COVERAGE) * F.col("n_tokens"))
    asked_tiles = pairs.join(size, "item_key").filter(enough).join(items, "item_key").select("text_key", "item_id", "text", "n", "hashes", "places")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, item, text, n, hashes, places in zip(batch["text_key"], batch["item_id"].astype("Int64"), batch["text"], batch["n"], batch["hashes"], batch["places"], strict=True):
                ids = numbers(text)
                pattern = np.unique(ids, return_inverse=True)[1]
                tiles = tile(pattern, regions(ids, pattern, hashes, places, int(n)), int(n))
                if sum(tiles) >= COVERAGE * len(ids):
                    rows.append((key, item, sum(tiles), len(ids), sum(tiles) / len(ids), len(tiles)))
            yield pd.DataFrame(rows, columns=["text_key", *FOUND[1:]]).astype({"item_id": "Int64"})

    return asked_tiles.mapInPandas(run, TILED)


def sides(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items, their seeds, and the documents with such seeds."""
    items = items_of(benchmark)
    seeds = materialize(seeds_of(items), "decontam-items")
    return items, seeds, materialize(hits_of(docs, seeds), "decontam-hits")


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item that it covers: doc_id, item_id, matched, n_tokens, coverage, tiles."""
    items, seeds, hits = sides(docs, benchmark)
    return hits.select("doc_id", "text_key").join(tiled(items, seeds, hits), "text_key").select(*FOUND)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, that cover no item enough."""
    items, seeds, hits = sides(docs, benchmark)
    bad = materialize(tiled(items, seeds, hits).select("text_key").distinct(), "decontam-texts")
    discard(seeds, hits)
    return docs.join(bad, key_of(docs["text"]) == bad["text_key"], "left_anti")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op7_decontamination": op7_decontamination}
SQL: dict[str, str] = {}
