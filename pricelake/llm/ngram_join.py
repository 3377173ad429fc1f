"""Similarity join of documents on word shingles with signature trees.

A document's set are its distinct runs of five words (lower-cased A-Z, split at ASCII white space), as 64-bit hashes. Two
documents link when 100 * intersection >= 75 * union.

1. Documents of one set are a class; its smallest id stands for it.
2. In any fixed order of shingles, linked sets share one that is among the first n // 4 + 1 of the larger and among the
   first n // 7 + 1 of the smaller. The order puts shingles last that a sample of documents found often, so that common
   lines join few documents. Sets that share such a shingle, of sizes that can link, form a block.
3. Blocks of one smallest member meet in one group, so that a set is sent once for the many shingles it shares with its near
   copies. Large groups are split into parts, and pairs of parts are looked at.
4. In a group, signature trees: leaves are sets with a bitmap of their shingles, nodes the OR of their bitmaps with the
   ranges of sizes. Two trees are walked together, and a pair of nodes goes no further if the largest overlap that
   bitmaps and sizes allow is too small. Members that are left with no partner leave the group; no pair is sent.
5. The others meet again with their whole sets. Trees over bitmaps with a bit for each shingle that two of them have count
   exactly; a group returns at most one link a member, to the smallest id that its links reach.
6. Components over these links, contracted round by round.

Defined cases: null, empty and blank texts have no shingle, link with nothing and are their own component; fewer words than
five make one shingle of them all; repeated rows are copies; rows of one id with other texts each link, and of such an id all
texts count where one of them is a candidate; a null doc_id links with nothing and has a null component; an
empty table gives none. Extra columns are ignored. Hashes of 64 bits stand for shingles and 128 bits for sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, table, tokens

WORDS = 5
#: 7 * intersection >= 3 * (sum of sizes) is 100 * intersection >= 75 * union.
SHARE, OF_BOTH = 7, 3
SAMPLE = 64
OFTEN = 3
#: At most so many common shingles go to the tasks; which they are changes the work, never the result.
COMMON = 100_000
#: Sides of joins with at most so many ids are broadcast (8 bytes each), others shuffled.
BROADCAST_IDS = 1_000_000
#: Members and shingles of a part of a group, at most about.
PART = 2048
PART_SHINGLES = 1_000_000
#: Sizes of one class differ by less than this factor; it is over 4 / 3, so that linked sets are of one class or of neighbours.
CLASS = 1.34
FANOUT = 8
#: Node pairs that are looked at together, and members up to which a block is walked without a tree.
FRONTIER = 4096
SMALL = 12
#: Keys packed together before they are sent.
FLUSH = 2_000_000
#: Sets of a group that are compared with all others before the trees are walked: what they link is skipped there.
LEADS = 8
PLACE = "_ngram_place"
CHUNK_WORDS = 1_000_000
CACHE = 200_000
_RNG = np.random.default_rng(10)
MULTIPLIERS = _RNG.integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Shingles:
    """Sorted distinct shingle hashes of texts."""

    def __init__(self):
        self.words: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        seen, out = self.words, []
        if len(seen) > CACHE:
            seen.clear()
        for w in tokens(text):
            h = seen.get(w)
            if h is None:
                h = seen[w] = xxhash.xxh64_intdigest(w)
            out.append(h)
        ids = np.array(out, np.uint64)
        if not len(ids):
            return ids
        if len(ids) < WORDS:
            h = np.array([xxhash.xxh64_intdigest(ids.tobytes(), 1)], np.uint64)
        else:
            h = np.zeros(len(ids) - WORDS + 1, np.uint64)
            for k in range(WORDS):
                h += ids[k : len(ids) - WORDS + 1 + k] * MULTIPLIERS[k]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return np.unique(h)


def bitmap(shingles: np.ndarray) -> bytes:
    """Two bits a shingle at least (four for small sets), a power of two; the low bits of a hash choose its bit, so halves fold
    onto each other."""
    size = max(64, 1 << int((4 if len(shingles) <= 256 else 2) * len(shingles) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(shingles & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample of the documents (one in SAMPLE by a hash) has often, sorted, with their counts. A hint for the order only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = Shingles()
        for batch in batches:
            sets = [of(t) for t in batch["text"]]
            if sets:
                h, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pd.DataFrame({"h": h.view(np.int64), "n": n})

    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("text")
    counts = sample.mapInPandas(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= OFTEN)
    rows = counts.orderBy(F.desc("n"), "h").limit(COMMON).collect()
    h, n = np.array([r["h"] for r in rows], np.int64).view(np.uint64), np.array([r["n"] for r in rows], np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def shingled(docs: DataFrame) -> DataFrame:
    """doc_id, n, set_id, bits, first: size, digest, bitmap and first shingles of each document's set."""
    sent = docs.sparkSession.sparkContext.broadcast(common_shingles(docs))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, (common, often) = Shingles(), sent.value
        for batch in batches:
            out = []
            for text in batch["text"]:
                s = of(text)
                first = s
                if len(s) and len(common):
                    k = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    first = s[np.lexsort((s, np.where(common[k] == s, often[k], 0)))]
                first = first[: len(s) // 4 + 1]
                out.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None, bitmap(s) if len(s) else None, first.view(np.int64)))
            n, ids, bits, first = zip(*out, strict=True) if out else ((), (), (), ())
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n": n, "set_id": ids, "bits": bits, "first": first})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n long, set_id binary, bits binary, first array<long>")


def _among(df: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """Semi or anti join; the ids are broadcast if they are few enough."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, how)


def shared_keys(sets: DataFrame) -> DataFrame:
    """key: the leading bits of first shingles that more than one set has, one of them among its first n // 7 + 1. They travel
    packed: a bucket of leading bits, as many as keep buckets small, and arrays of the next 31 bits and that mark, each at most
    twice a batch. Shingles that only look alike cost work, not results."""
    bits = max(4, min(16, (max(1, sets.count() // 4000)).bit_length()))

    def pack(keys: list) -> pd.DataFrame:
        k, n = np.unique(np.concatenate(keys), return_counts=True)
        k = np.repeat(k, np.minimum(n, 2))
        bucket = (k >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        low = k.astype(np.uint32)
        return pd.DataFrame({"bucket": bucket[cuts], "keys": [low[x:y].tobytes() for x, y in zip(cuts, np.append(cuts[1:], len(k)), strict=True)]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, held = [], 0
        for batch in batches:
            for n, first in zip(batch["n"].tolist(), batch["first"], strict=True):
                k = (np.asarray(first, np.int64).view(np.uint64) >> np.uint64(33 - bits)) << np.uint64(1)
                k[: n // 7 + 1] |= np.uint64(1)
                keys.append(k)
                held += len(k)
            if held > FLUSH:
                yield pack(keys)
                keys, held = [], 0
        if keys:
            yield pack(keys)

    def often(pdf: pd.DataFrame) -> pd.DataFrame:
        k = np.sort(np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["keys"]]))
        first = np.flatnonzero(np.concatenate([[True], k[1:] >> np.uint32(1) != k[:-1] >> np.uint32(1)]))
        last = np.append(first[1:], len(k)) - 1
        shared = (last > first) & (k[last] & np.uint32(1) == 1)
        return pd.DataFrame({"key": (np.int64(pdf["bucket"].iloc[0]) << 31) | (k[first[shared]] >> np.uint32(1)).astype(np.int64)})

    packed = sets.select("n", "first").mapInPandas(run, "bucket long, keys binary")
    found = packed.groupBy("bucket").applyInPandas(often, "key long")
    return found.withColumn("bits", F.lit(bits))


def groups(sets: DataFrame) -> DataFrame:
    """home, cls, high, doc_id: members of the blocks whose smallest member is home and whose larger sets are of class cls. high
    marks sets of that class; those of the class below only meet these."""
    keys = materialize(shared_keys(sets), "ngram-keys")
    bits = keys.select("bits").first()
    if bits is None:
        return materialize(sets.limit(0).select(F.col("doc_id").alias("home"), F.lit(0).alias("cls"), F.lit(True).alias("high"), "doc_id"), "ngram-groups")
    first = sets.select(F.posexplode("first").alias("at", "h"), "doc_id", "n")
    first = first.withColumn("key", F.shiftrightunsigned("h", 33 - bits["bits"]))
    own = F.floor(F.log("n") / math.log(CLASS)).cast("int")
    held = first.join(keys.select("key"), "key").select("h", "doc_id", (F.col("at") <= F.floor(F.col("n") / 7)).alias("index"), own.alias("own"))
    held = materialize(held, "ngram-shared")
    meets = held.withColumn("cls", F.explode(F.array(F.col("own"), F.col("own") + 1))).withColumn("high", F.col("own") == F.col("cls"))
    blocks = meets.groupBy("h", "cls").agg(F.count("*").alias("members"), F.max("high").alias("some"), F.max("index").alias("index"), F.min("doc_id").alias("home"))
    # Written first, so that the join's rows of one shingle can be split among tasks.
    blocks = materialize(blocks.filter((F.col("members") > 1) & F.col("some") & F.col("index")).select("h", "cls", "home"), "ngram-blocks")
    out = materialize(meets.select("h", "cls", "high", "doc_id").join(blocks, ["h", "cls"]).select("home", "cls", "high", "doc_id").distinct(), "ngram-groups")
    discard(keys, held, blocks)
    return out


GROUP = ["home", "cls", "i", "j"]


def dealt(members: DataFrame, about: DataFrame) -> DataFrame:
    """members, once for each pair (i, j) of parts of their group that they take part in."""
    sized = members.join(about.select("doc_id", "n"), "doc_id").groupBy("home", "cls").agg(F.count("*").alias("m"), F.sum("n").alias("t"))
    parts = F.greatest(F.ceil(F.col("m") / PART), F.ceil(F.col("t") / PART_SHINGLES)).cast("int")
    large = materialize(sized.select("home", "cls", parts.alias("parts")).filter("parts > 1"), "ngram-large")
    out = members.join(F.broadcast(large) if large.count() <= BROADCAST_IDS else large, ["home", "cls"], "left")
    parts = F.coalesce("parts", F.lit(1))
    own = F.pmod(F.xxhash64("doc_id", "home"), parts).cast("int")
    others = F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.struct(F.least(k, own).alias("i"), F.greatest(k, own).alias("j")))
    return out.select("home", "cls", "high", "doc_id", own.alias("own"), F.explode(others).alias("to")).select("home", "cls", "to.i", "to.j", "own", "high", "doc_id")


class Tree:
    """A signature tree over sets whose bitmaps have one length. levels[0] are the leaves: bits, least and largest size, the
    largest number of shingles that share a bit with another, least and largest component. In an exact tree bitmaps
    have a bit for each shingle that another set of the group has too."""

    def __init__(self, rows: np.ndarray, n: np.ndarray, bits: np.ndarray, component: np.ndarray, exact: bool = False):
        order = np.lexsort((*bits.T[:2], n, component))
        self.rows, n, bits, own, self.exact = rows[order], n[order], bits[order], component[order], exact
        excess = n - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        self.levels = [(bits, n, n, excess, own, own)]
        while len(self.levels[-1][1]) > FANOUT:
            b, low, high, more, least, most = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(b, at), *(f.reduceat(x, at) for f, x in ((np.minimum, low), (np.maximum, high), (np.maximum, more), (np.minimum, least), (np.maximum, most)))))

    def children(self, level: int, node: np.ndarray) -> np.ndarray:
        return np.minimum(node[:, None] * FANOUT + np.arange(FANOUT), len(self.levels[level - 1][1]))


def fold_to(bits: np.ndarray, words: int) -> np.ndarray:
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


def walk(s: Tree, t: Tree) -> np.ndarray:
    """Row pairs of leaves whose largest possible overlap is enough. s and t may be the same tree. Node pairs wait on a
    stack in portions, so that memory follows the depth, not the number of pairs."""
    words = min(s.levels[0][0].shape[1], t.levels[0][0].shape[1])
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(s.levels[-1][1])), np.arange(len(t.levels[-1][1])), indexing="ij"))
    stack, out = [(len(s.levels) - 1, len(t.levels) - 1, i, j)], [np.zeros((0, 2), np.int64)]
    while stack:
        a_level, b_level, i, j = stack.pop()
        if len(i) > FRONTIER:
            stack.append((a_level, b_level, i[FRONTIER:], j[FRONTIER:]))
            i, j = i[:FRONTIER], j[:FRONTIER]
        if s is t:
            i, j = i[i <= j], j[i <= j]
        i, j = _near(s.levels[a_level], t.levels[b_level], i, j, words, a_level == b_level == 0, s.exact)
        if a_level == b_level == 0:
            own = s.rows[i] != t.rows[j]
            out.append(np.stack([s.rows[i][own], t.rows[j][own]], axis=1))
        elif len(i):
            down_a, down_b = a_level >= b_level and a_level > 0, b_level >= a_level and b_level > 0
            a = s.children(a_level, i) if down_a else i[:, None]
            b = t.children(b_level, j) if down_b else j[:, None]
            a_level, b_level = a_level - down_a, b_level - down_b
            i, j = np.repeat(a, b.shape[1], axis=1).ravel(), np.tile(b, (1, a.shape[1])).ravel()
            real = (i < len(s.levels[a_level][1])) & (j < len(t.levels[b_level][1]))
            stack.append((a_level, b_level, i[real], j[real]))
    return np.concatenate(out)


def _near(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray, words: int, leaves: bool, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of nodes of two levels that can hold a linked pair of two components; of exact leaves, those that link."""
    (ab, al, ah, ae, a0, a1), (bb, bl, bh, be, b0, b1) = a, b
    near = (4 * ah[i] >= 3 * bl[j]) & (4 * bh[j] >= 3 * al[i]) & ((a0[i] != b0[j]) | (a1[i] != b1[j]) | (a0[i] != a1[i]))
    i, j = i[near], j[near]
    keep = np.zeros(len(i), bool)
    step = max(1, CHUNK_WORDS // max(ab.shape[1], bb.shape[1]))
    for k in range(0, len(i), step):
        p, q = i[k : k + step], j[k : k + step]
        x, y = fold_to(ab[p], words), fold_to(bb[q], words)
        both = np.bitwise_count(x & y).sum(axis=1).astype(np.int64)
        if exact:
            most = np.minimum(np.minimum(ah[p], bh[q]), both)
        elif leaves:  # what only one has shows as bits that the other lacks
            most = np.minimum(al[p] - np.bitwise_count(x).sum(axis=1) + both, bl[q] - np.bitwise_count(y).sum(axis=1) + both)
        else:
            fa, fb = (ah[p] if ab.shape[1] > words else ae[p]), (bh[q] if bb.shape[1] > words else be[q])
            most = np.minimum(np.minimum(ah[p], bh[q]), np.minimum(fa, fb) + both)
        keep[k : k + step] = SHARE * most >= OF_BOTH * (al[p] + bl[q])
    return i[keep], j[keep]


def _meet(own: list[int], high: list[bool], i: int, j: int, n: list[int]) -> Iterator[tuple[int, int]]:
    """The pairs of rows that a group's pair of parts asks for and whose sizes can link."""
    for p in range(len(n)):
        for q in range(p + 1, len(n)):
            if (high[p] or high[q]) and (i == j or own[p] != own[q]) and 4 * n[p] >= 3 * n[q] and 4 * n[q] >= 3 * n[p]:
                yield p, q


def _few(n: list[int], bits: list[bytes], pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """walk() for a handful of sets: their leaves, pair by pair."""
    whole = [int.from_bytes(b, "little") for b in bits]
    out = []
    for p, q in pairs:
        x, y, a, b = whole[p], whole[q], len(bits[p]), len(bits[q])
        while a > b:
            a //= 2
            x = (x & ((1 << 8 * a) - 1)) | (x >> 8 * a)
        while b > a:
            b //= 2
            y = (y & ((1 << 8 * b) - 1)) | (y >> 8 * b)
        both = (x & y).bit_count()
        if SHARE * min(n[p] - x.bit_count() + both, n[q] - y.bit_count() + both) >= OF_BOTH * (n[p] + n[q]):
            out.append((p, q))
    return out


def _walks(trees: dict[tuple, Tree], i: int, j: int) -> np.ndarray:
    """Row pairs that the walks of a group's trees, by (part, high, ...), leave."""
    found, own = [np.zeros((0, 2), np.int64)], list(trees.items())
    for x, (a, s) in enumerate(own):
        for b, t in own[x:]:
            if {a[0], b[0]} == {i, j} and (a[1] or b[1]) and (i == j or a[0] != b[0]):
                width = s.levels[0][0].shape[1], t.levels[0][0].shape[1]
                if max(width) <= 4 * min(width):
                    found.append(walk(s, t))
    return np.concatenate(found)


def partners(n: np.ndarray, bits: list[bytes], own: np.ndarray, high: np.ndarray, i: int, j: int) -> np.ndarray:
    """Rows of a group's two parts that may link with another by their signatures."""
    if len(n) <= SMALL:
        sizes = n.tolist()
        pairs = np.array(_few(sizes, bits, _meet(own.tolist(), high.tolist(), i, j, sizes)), np.int64)
    else:
        widths = np.array([len(b) for b in bits])
        trees: dict[tuple, Tree] = {}
        for key in sorted(set(zip(own.tolist(), high.tolist(), widths.tolist(), strict=True))):
            rows = np.flatnonzero((own == key[0]) & (high == key[1]) & (widths == key[2]))
            trees[key] = Tree(rows, n[rows], np.stack([np.frombuffer(bits[r], np.uint64) for r in rows]), rows)
        pairs = _walks(trees, i, j)
    return np.unique(pairs)


def linked(s: np.ndarray, t: np.ndarray) -> bool:
    k = np.minimum(np.searchsorted(t, s), len(t) - 1)
    return SHARE * int((t[k] == s).sum()) >= OF_BOTH * (len(s) + len(t))


def shared_bits(sets: list[np.ndarray]) -> np.ndarray:
    """A bit for each shingle that two of the sets have, most frequent ones first, as rows of 64-bit words."""
    shingles, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = int((n > 1).sum())
    place = np.empty(len(n), np.int64)
    place[np.argsort(-n, kind="stable")] = np.arange(len(n))
    width, start, rows = max(1, -(-shared // 64)), 0, []
    for s in sets:
        own = place[at[start : start + len(s)]]
        start += len(s)
        bits = np.zeros(64 * width, np.uint8)
        bits[own[own < shared]] = 1
        rows.append(np.packbits(bits, bitorder="little").view(np.uint64))
    return np.stack(rows)


def joined(component: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The components, each named by its smallest row, after these links too."""
    a, b = pairs[:, 0], pairs[:, 1]
    while True:
        x, y = component[a], component[b]
        if (x == y).all():
            return component
        new, least = component.copy(), np.minimum(x, y)
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        while (new[new] != new).any():
            new = new[new]
        component = new[component]


def links_of(sets: list[np.ndarray], own: np.ndarray, high: np.ndarray, i: int, j: int) -> np.ndarray:
    """The components of a group's links between its two parts, counted exactly: for each row the smallest row of its own."""
    n = np.array([len(s) for s in sets])
    component = np.arange(len(n))
    if len(n) <= SMALL:
        pairs = [(p, q) for p, q in _meet(own.tolist(), high.tolist(), i, j, n.tolist()) if linked(sets[p], sets[q])]
        return joined(component, np.array(pairs, np.int64).reshape(-1, 2))
    bits = shared_bits(sets)
    for lead in np.argsort(-np.bitwise_count(bits[:, : max(1, bits.shape[1] // 8)]).sum(axis=1).astype(np.int64), kind="stable")[:LEADS]:
        both = np.bitwise_count(bits & bits[lead]).sum(axis=1).astype(np.int64)
        near = np.flatnonzero(SHARE * both >= OF_BOTH * (n + n[lead]))
        component = joined(component, np.stack([np.full(len(near), lead), near], axis=1))
    trees: dict[tuple, Tree] = {}
    for key in sorted(set(zip(own.tolist(), high.tolist(), strict=True))):
        rows = np.flatnonzero((own == key[0]) & (high == key[1]))
        trees[key] = Tree(rows, n[rows], bits[rows], component[rows], exact=True)
    return joined(component, _walks(trees, i, j))


def whole_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows that come sorted by GROUP, the rows of a group together."""
    held: list[pd.DataFrame] = []
    key = None
    for batch in batches:
        if not len(batch):
            continue
        keys = batch[GROUP].to_numpy()
        last = int(np.argmax((keys == keys[-1]).all(axis=1)))
        if held and (last or (key != keys[-1]).any()):
            yield pd.concat([*held, batch.iloc[:last]], ignore_index=True)
            held = []
        elif last:
            yield batch.iloc[:last].reset_index(drop=True)
        held.append(batch.iloc[last:])
        key = keys[-1]
    if held:
        yield pd.concat(held, ignore_index=True)


def cuts(rows: pd.DataFrame) -> Iterator[tuple[int, int, int, int]]:
    """(first row, end, i, j) of each group."""
    keys = rows[GROUP].to_numpy()
    at = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])) if len(keys) else np.zeros(0, int)
    return zip(at.tolist(), [*at[1:].tolist(), len(keys)], keys[at, 2].tolist(), keys[at, 3].tolist(), strict=True)


def with_partners(members: DataFrame, about: DataFrame) -> DataFrame:
    """The members (dealt) whose signature some other of their group can link with."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_groups(batches):
            n, own, high, bits, keep = rows["n"].to_numpy(np.int64), rows["own"].to_numpy(), rows["high"].to_numpy(bool), rows["bits"].tolist(), []
            for p, q, i, j in cuts(rows):
                if q - p > 1:
                    keep.append(p + partners(n[p:q], bits[p:q], own[p:q], high[p:q], i, j))
            keep = np.concatenate([np.zeros(0, np.int64), *keep]).astype(np.int64)
            yield rows.drop(columns=["n", "bits"]).iloc[keep]

    rows = dealt(members, about).join(about, "doc_id").select(*GROUP, "own", "high", "doc_id", "n", "bits")
    return rows.repartition(*GROUP).sortWithinPartitions(*GROUP, "doc_id").mapInPandas(run, "home long, cls int, i int, j int, own int, high boolean, doc_id long")


def links(members: DataFrame, docs: DataFrame) -> DataFrame:
    """a, b (a < b): links that join what the groups' exact links join."""
    ids = materialize(members.select("doc_id").distinct(), "ngram-asked")

    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = Shingles()
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "s": [of(t).tobytes() for t in batch["text"]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_groups(batches):
            ids, own, high = rows["doc_id"].to_numpy(np.int64), rows["own"].to_numpy(), rows["high"].to_numpy(bool)
            out = [np.zeros((0, 2), np.int64)]
            for p, q, i, j in cuts(rows):
                root = links_of([np.frombuffer(s, np.uint64) for s in rows["s"].iloc[p:q]], own[p:q], high[p:q], i, j)
                out.append(np.stack([ids[p:q][root], ids[p:q]], axis=1))  # rows come by id, so the smallest row has the smallest id
            found = np.concatenate(out)
            yield pd.DataFrame(found[found[:, 0] < found[:, 1]], columns=["a", "b"])

    sets = materialize(_among(docs.select("doc_id", "text"), ids, "doc_id", "left_semi").mapInPandas(sets_of, "doc_id long, s binary").filter("octet_length(s) > 0"), "ngram-asked-sets")
    rows = members.join(sets, "doc_id").select(*GROUP, "own", "high", "doc_id", "s")
    out = materialize(rows.repartition(*GROUP).sortWithinPartitions(*GROUP, "doc_id").mapInPandas(run, "a long, b long"), "ngram-links")
    discard(ids, sets)
    return out


def spanning(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of the links (a, b) that a task reads, those that join what the ones before have not joined yet."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    for batch in batches:
        keep = []
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
            keep.append(x != y)
        yield batch[np.array(keep, bool)]


def components(links: DataFrame) -> DataFrame:
    """doc_id, component of every document in a link: the smallest id that links reach. Each round moves every node to the
    smallest of itself, its neighbours and what that one moves to, and goes on with the links between such nodes only; a node's
    own moves are put together at the end."""
    links = materialize(links.select("a", "b").mapInPandas(spanning, "a long, b long").distinct(), "ngram-round")
    moves = []
    while not links.isEmpty():
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        near = both.groupBy("u").agg(F.least("u", F.min("v")).alias("c"))
        then = near.select(F.col("u").alias("c"), F.col("c").alias("then"))
        moves.append(materialize(near.join(then, "c").select("u", F.least("c", "then").alias("c")), "ngram-moves"))
        a, b = (moves[-1].select(F.col("u").alias(x), F.col("c").alias(f"c{x}")) for x in "ab")
        left = links.join(a, "a").join(b, "b").filter("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
        done, links = links, materialize(left, "ngram-round")
        discard(done)
    if not moves:
        return links.select(F.col("a").alias("doc_id"), F.col("b").alias("component"))
    out = moves[-1].select("u", "c")
    for earlier in reversed(moves[:-1]):
        later = out.select(F.col("u").alias("c"), F.col("c").alias("to"))
        moved = earlier.join(later, "c", "left").select("u", F.coalesce("to", "c").alias("c"))
        out = materialize(moved, "ngram-moves")
    return out.select(F.col("u").alias("doc_id"), F.col("c").alias("component"))


def link_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text)."""
    all_sets = materialize(shingled(docs).withColumn("row", F.monotonically_increasing_id()), "ngram-sets")
    known = all_sets.filter("n > 0 and doc_id is not null")
    # One row stands for a class: repeated rows of its smallest id are copies too.
    first = known.groupBy("set_id").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    classes = materialize(first.select("set_id", F.col("first.doc_id").alias("rep"), F.col("first.row").alias("rep_row")), "ngram-classes")
    copies = known.select("row", "set_id").join(classes, "set_id").filter("row <> rep_row").select("row")
    sets = _among(known, materialize(copies, "ngram-copies"), "row", "left_anti")
    about = materialize(sets.select("doc_id", "n", "bits"), "ngram-about")
    members = groups(sets)
    narrow = materialize(all_sets.select("doc_id", "n", "set_id"), "ngram-sizes")
    discard(all_sets)
    asked = materialize(with_partners(members, about), "ngram-partners")
    discard(members, about)
    found = links(asked, docs)
    labels = components(found)
    named = classes.join(labels.withColumnRenamed("doc_id", "rep"), "rep", "left")
    named = materialize(named.select("set_id", F.coalesce("component", "rep").alias("component")), "ngram-components")
    discard(asked, found, classes)
    out = narrow.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("set_id")).alias("set_id"))
    alone = out.filter("set_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    joined = out.filter("set_id is not null").join(named, "set_id").select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return joined.unionByName(alone)


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents, all columns, one of each component of links: the first by id. Rows of one id are documents each, so that
    one of them can go and another stay; rows without an id all stay.

    Where ids repeat, the documents are written once in the order of their ids, and their places stand for the ids."""
    ids = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"))
    if ids.filter("n > 1").isEmpty():
        return _without_copies(docs, "doc_id")
    sorted_ = docs.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    place = F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())
    return _without_copies(materialize(sorted_.withColumn(PLACE, place), "ngram-places"), PLACE).drop(PLACE)


def _without_copies(docs: DataFrame, key: str) -> DataFrame:
    found = link_components(docs.select(F.col(key).alias("doc_id"), "text")).filter("component_id < doc_id")
    return _among(docs, materialize(found.select(F.col("doc_id").alias(key)), "ngram-dropped"), key, "left_anti")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op10_ngram_join": op10_ngram_join}
SQL: dict[str, str] = {}
