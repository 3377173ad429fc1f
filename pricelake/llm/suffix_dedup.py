"""Exact removal of repeated byte strings by merged Burrows-Wheeler transforms.

Every byte covered by a string of ``LENGTH`` bytes that also starts in a document of a smaller id is removed.

1. Documents of one text are a class; its smallest id stands for it. Of the copies all is removed (if long enough).
2. Each window of LENGTH bytes is routed by its minimiser: the smallest hash of the 20-byte strings in it, which depends on
   the window alone. A run of windows with one minimiser is a segment. Minimisers of a single document can't be of a
   repeated window; the segments of all others go on, as (route, hash, id, place).
3. Equal segments of a route are summed up to the smallest id. All others of them are repeated whole. Where a route has more
   than one segment, the bytes of each are fetched from the document of that smallest id.
4. Segments of one bucket of routes meet in a task as shards, but for those that share no string around the minimiser. Each
   shard's suffixes are sorted once; the shards'
   transforms are then merged without sorting again: an interleave of their rows is refined by stable counting on the
   transforms' symbols, two at a time, until LENGTH, and blocks of equal prefixes split along with it. After that, a block of more
   than one row is a repeated interval; the smallest id in it decides which windows go.
5. Routes of more than ``HOT`` segments are split: their windows are routed anew by minimisers of longer strings (``GRAMS``),
   from step 3 on. Minimisers of LENGTH bytes are the windows themselves, so the last step leaves nothing to merge.
6. Windows become spans, spans are merged, and the bytes between them are kept.

Defined cases: null text is empty; texts under LENGTH bytes lose nothing; repeated rows count as one document; rows of one
id with different texts count as documents that follow each other by the texts' digests, and so do, after all others,
rows without an id; an empty table gives none. Extra columns are ignored. 64 bits stand for a segment within its route, 128 for a text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, table

LENGTH = 50
#: Bytes of the strings whose hashes route windows, one after the other for routes that are still hot.
GRAMS = (20, 35, LENGTH)
CHUNK = 60_000
#: Bytes of text for each bucket of minimisers, segments for each bucket of segments, and bytes of a shard.
BUCKET_BYTES = 2_000_000
BUCKET_SEGMENTS = 10_000
SHARD_BYTES = 128_000
#: Segments of a route that meet in one task, at most about.
HOT = 20_000
FLUSH = 2_000_000
BROADCAST_ROWS = 1_000_000
#: Minimisers that a sample of the documents (one in SAMPLE) has OFTEN times are known as shared to the tasks, at most so many;
#: which they are changes the work, never the result.
SAMPLE = 64
OFTEN = 3
COMMON = 100_000
LAST = 2**63 - 1
_RNG = np.random.default_rng(8)
SYMBOL = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(CHUNK + LENGTH, BASE)]), dtype=np.uint64)
INVERSE = np.cumprod(np.concatenate([[np.uint64(1)], np.full(CHUNK + LENGTH, np.uint64(pow(int(BASE), -1, 2**64)))]), dtype=np.uint64)


def sums_of(codes: np.ndarray) -> np.ndarray:
    part = SYMBOL[codes]
    return np.concatenate([[np.uint64(0)], np.cumsum(part * POWERS[: len(part)], dtype=np.uint64)])


def hashes(sums: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all strings of ``size`` bytes, from the sums of at most CHUNK + LENGTH codes."""
    h = (sums[size:] - sums[:-size]) * INVERSE[: len(sums) - size]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def runs(raw: bytes, gram: int = GRAMS[0]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first window, number of windows, minimiser) of the runs of windows with one minimiser, chunk by chunk; of each window
    where the minimiser is the window."""
    codes, span = np.frombuffer(raw, np.uint8), LENGTH - gram + 1
    for at in range(0, len(codes) - LENGTH + 1, CHUNK):
        h = hashes(sums_of(codes[at : at + CHUNK + LENGTH - 1]), gram)
        width = 1
        while 2 * width <= span:
            h = np.minimum(h[:-width], h[width:])
            width *= 2
        if width < span:
            h = np.minimum(h[: len(h) - (span - width)], h[span - width :])
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if gram < LENGTH else np.arange(len(h))
        yield at + first, np.diff(np.append(first, len(h))), h[first]


def _raw(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def _own_keys(text: str | None, bits: int) -> np.ndarray:
    """The distinct leading bits of a text's minimisers: ``bits`` for its bucket and 32 more."""
    own = [m for _, _, m in runs(_raw(text))]
    return np.unique(np.concatenate(own) >> np.uint64(32 - bits)) if own else np.zeros(0, np.uint64)


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of the keys are in the sorted array ``known``."""
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def often_keys(docs: DataFrame, bits: int) -> np.ndarray:
    """Minimisers that several documents of a sample have, sorted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [_own_keys(t, bits) for t in batch["text"]]
            if own:
                k, n = np.unique(np.concatenate(own), return_counts=True)
                yield pd.DataFrame({"key": k.view(np.int64), "n": n})

    sample = docs.filter(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).dropDuplicates(["id"]).select("text")
    counts = sample.mapInPandas(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= OFTEN)
    return np.sort(np.array([r["key"] for r in counts.orderBy(F.desc("n"), "key").limit(COMMON).collect()], np.int64).view(np.uint64))


def minimisers(docs: DataFrame, bits: int, often: np.ndarray) -> DataFrame:
    """bucket, keys, docs: packed arrays of 32-bit keys and ids, without those that are often. The bucket is the first ``bits``
    bits, the key the next 32."""
    sent = docs.sparkSession.sparkContext.broadcast(often)

    def pack(keys: list, ids: list) -> pd.DataFrame:
        k, d = np.concatenate(keys), np.concatenate(ids)
        order = np.argsort(k, kind="stable")
        k, d = k[order], d[order]
        bucket = (k >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        ends = np.append(cuts[1:], len(k))
        low = k.astype(np.uint32)
        return pd.DataFrame({"bucket": bucket[cuts], "keys": [low[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], "docs": [d[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, ids, held = [], [], 0
        for batch in batches:
            for doc, text in zip(batch["id"], batch["text"], strict=True):
                own = _own_keys(text, bits)
                own = own[~_among(own, sent.value)]
                if len(own):
                    keys.append(own)
                    ids.append(np.full(len(own), doc, np.int64))
                    held += len(own)
                if held > FLUSH:
                    yield pack(keys, ids)
                    keys, ids, held = [], [], 0
        if keys:
            yield pack(keys, ids)

    return docs.select("id", "text").mapInPandas(run, "bucket long, keys binary, docs binary")


def shared(packed: DataFrame) -> DataFrame:
    """id, key: the keys that more than one document has, for each document."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["keys"]])
        d = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["docs"]])
        order = np.argsort(k, kind="stable")
        k, d = k[order], d[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        two = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
        keep = np.repeat(two, np.diff(np.append(first, len(k))))
        return pd.DataFrame({"id": d[keep], "key": (np.int64(pdf["bucket"].iloc[0]) << 32) | k[keep].astype(np.int64)})

    return packed.groupBy("bucket").applyInPandas(run, "id long, key long")


def segments(docs: DataFrame, keys: DataFrame, bits: int, often: np.ndarray) -> DataFrame:
    """route, h, id, at, n: the segments of shared minimisers, their hashes, places and numbers of windows."""
    packed = keys.groupBy("id").agg(F.collect_list("key").alias("keys"))
    sent = docs.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[np.ndarray] = []
            for doc, text, keys in zip(batch["id"], batch["text"], batch["keys"], strict=True):
                raw, keys = _raw(text), np.sort(np.asarray([] if keys is None else keys, np.int64).view(np.uint64))
                for first, n, m in runs(raw):
                    key = m >> np.uint64(32 - bits)
                    own = np.flatnonzero(_among(key, keys) | _among(key, sent.value))
                    first, n = first[own], n[own]
                    h = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(first.tolist(), (first + n + (LENGTH - 1)).tolist(), strict=True)]
                    out.append(np.stack([key[own].view(np.int64), np.array(h, np.uint64).view(np.int64), np.full(len(own), doc, np.int64), first, n]))
            yield pd.DataFrame(np.concatenate([np.zeros((5, 0), np.int64), *out], axis=1).T, columns=["route", "h", "id", "at", "n"])

    return docs.join(packed, "id", "left").select("id", "text", "keys").mapInPandas(run, "route long, h long, id long, at int, n int")


class Shard:
    """The transform of sorted texts, each with an end of its own (symbol 0, ordered like the texts). ``last`` is the symbol
    before each row's suffix, ``back`` the row of the suffix that starts with it."""

    def __init__(self, texts: list[bytes], number: np.ndarray):
        sizes = np.array([len(t) + 1 for t in texts])
        raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8) + np.uint8(1)  # UTF-8 has no byte 255
        ends = np.cumsum(sizes) - 1
        raw[ends] = 0
        starts = ends - sizes + 1
        text = np.repeat(np.arange(len(texts)), sizes)
        n = len(raw)
        place = np.arange(n)
        left = ends[text] - place  # to the end of the own text
        key, step = np.zeros(n, np.int64), 7  # the first seven symbols, then prefix doubling inside this one shard
        for k in range(step):
            key = key * 256 + np.where(k <= left, raw[np.minimum(place + k, n - 1)], 0)
        longest = int(sizes.max())
        while True:
            order = np.argsort(key)
            new = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))
            rank = np.empty(n, np.int64)
            rank[order] = new
            if step >= longest or new[-1] == n - 1:
                break
            follow = np.where(step <= left, rank[np.minimum(place + step, n - 1)] + 1, 0)
            key = rank * (n + 1) + follow
            step *= 2
        rows = np.argsort(rank * n + place)  # equal suffixes stay in the order of their texts
        at = np.empty(n, np.int64)
        at[rows] = np.arange(n)
        before = np.where(place == starts[text], ends[text], place - 1)[rows]
        self.last, self.back = raw[before], at[before]
        self.text, self.offset = number[text[rows]], (place - starts[text])[rows]
        self.size = sizes[text[rows]] - 1


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of the shards' rows (numbered one shard after the other) ordered by their first ``depth`` symbols, an even
    number, and each row's block of equal ones. A round moves every row's two preceding symbols in front of it; rows are
    only counted into place by these, never compared."""
    last = np.concatenate([s.last for s in shards])
    firsts = np.cumsum([0, *(len(s.last) for s in shards[:-1])])
    back = np.concatenate([s.back + f for s, f in zip(shards, firsts, strict=True)])
    pair = last[back].astype(np.uint16) * np.uint16(256) + last
    ended = (last == 0) | (last[back] == 0)
    twice = back[back]
    rows, block = np.arange(len(last)), np.zeros(len(last), np.int32)
    for _ in range(depth // 2):
        symbols = pair[rows]
        order = np.argsort(symbols, kind="stable")
        came, of, was = block[order], symbols[order], rows[order]
        new = (of[1:] != of[:-1]) | (came[1:] != came[:-1]) | ended[was[1:]]  # ends differ from one another
        rows = twice[was]
        block = np.concatenate([[0], np.cumsum(new)]).astype(np.int32)
    return rows, block


def with_company(segs: list[bytes], routes: np.ndarray, gram: int) -> np.ndarray:
    """Which of the segments may share a window with another of their route. A shared window holds the minimiser of ``gram``
    bytes and, before it or after it, half of the window's other bytes; a segment that has its minimiser twice is not judged."""
    side = (LENGTH - gram) // 2
    left, right, unsure = (np.zeros(len(segs), t) for t in (np.uint64, np.uint64, bool))
    ends, at = np.cumsum([len(s) for s in segs]), 0
    while at < len(segs):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
        size = np.diff(ends[at:to], prepend=ends[at - 1] if at else 0)
        start = np.cumsum(size) - size
        sums = sums_of(np.frombuffer(b"".join(segs[at:to]), np.uint8)) if size.sum() <= CHUNK + LENGTH else None
        if sums is None:  # one long segment: it repeats its minimiser
            unsure[at:to] = True
        else:
            h = hashes(sums, gram)
            h = np.append(h, np.full(int(size.sum()) - len(h), ~np.uint64(0)))
            inside = np.arange(len(h)) - np.repeat(start, size) <= np.repeat(size, size) - gram
            h[~inside] = ~np.uint64(0)
            is_least = h == np.repeat(np.minimum.reduceat(h, start), size)
            unsure[at:to] = np.add.reduceat(is_least.astype(np.int64), start) > 1
            p = np.minimum.reduceat(np.where(is_least, np.arange(len(h)), len(h)), start)
            sides = hashes(sums, gram + side)
            for out, q, fits in ((left, p - side, p - side >= start), (right, p, p + gram + side <= start + size)):
                out[at:to] = np.where(fits, sides[np.clip(q, 0, len(sides) - 1)], 0)
        at = to
    keep = unsure
    for own in (left, right):
        _, which, n = np.unique(own + routes.view(np.uint64) * BASE, return_inverse=True, return_counts=True)
        keep = keep | ((n[which] > 1) & (own != 0))
    _, which, n = np.unique(routes, return_inverse=True, return_counts=True)
    any_unsure = np.bincount(which, weights=unsure) > 0
    return (keep | any_unsure[which]) & (n[which] > 1)


def repeated_windows(segs: list[bytes], least: np.ndarray, routes: np.ndarray, gram: int) -> dict[int, list[tuple[int, int]]]:
    """For distinct segments, each with its route and the smallest id that has it: the spans of windows that some other segment
    of a still smaller id has. Only segments of one route share windows."""
    kept = np.flatnonzero(with_company(segs, routes, gram)) if len(segs) else []
    if not len(kept):
        return {}
    own = _windows([segs[k] for k in kept.tolist()], least[kept])
    return {int(kept[k]): spans for k, spans in own.items()}


def _windows(segs: list[bytes], least: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    shards, at = [], 0
    ends = np.cumsum([len(s) + 1 for s in segs])
    while at < len(segs):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SHARD_BYTES)))
        shards.append(Shard(segs[at:to], np.arange(at, to)))
        at = to
    rows, block = merge(shards, LENGTH)
    text, offset, size = (np.concatenate([getattr(s, k) for s in shards])[rows] for k in ("text", "offset", "size"))
    window = offset + LENGTH <= size
    text, offset, block = text[window], offset[window], block[window]
    first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    smallest = np.repeat(np.minimum.reduceat(least[text], first), np.diff(np.append(first, len(block))))
    gone = smallest < least[text]
    order = np.lexsort((offset[gone], text[gone]))
    t, o = text[gone][order], offset[gone][order]
    if not len(t):
        return {}
    cut = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (o[1:] != o[:-1] + 1)]))
    own: dict[int, list[tuple[int, int]]] = {}
    for a, b in zip(cut.tolist(), np.append(cut[1:], len(t)).tolist(), strict=True):
        own.setdefault(int(t[a]), []).append((int(o[a]), int(o[b - 1]) + LENGTH))
    return own


SPANS = "id long, start long, end long"
ROUTED = "route long, h long, id long, at int, n int, seg binary"


def repeated(pdf: pd.DataFrame, gram: int) -> pd.DataFrame:
    """id, start, end of the windows of a bucket's segments that a smaller id has too. Equal segments are all of one id."""
    keys, first, inverse = np.unique(pdf[["route", "h"]].to_numpy(np.int64), axis=0, return_index=True, return_inverse=True)
    ids, places, segs = pdf["id"].to_numpy(np.int64), pdf["at"].to_numpy(np.int64), pdf["seg"].tolist()
    own = repeated_windows([segs[k] for k in first.tolist()], ids[first], np.ascontiguousarray(keys[:, 0]), gram)
    out = [(ids[k], places[k] + a, places[k] + b) for k, d in enumerate(inverse.ravel().tolist()) for a, b in own.get(d, ())]
    return pd.DataFrame(np.array(out, np.int64).reshape(-1, 3), columns=["id", "start", "end"])


def summed_up(segs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Of segments (route, h, id, at, n, ...): spans of those that a smaller id has too, and those of the smallest id whose route
    has others."""
    distinct = materialize(segs.groupBy("route", "h").agg(F.min("id").alias("least")), f"{name}-distinct")
    several = distinct.groupBy("route").agg(F.min("h").alias("low"), F.max("h").alias("high")).filter("low <> high").select("route", F.lit(True).alias("several"))
    several = materialize(several, f"{name}-several")
    known = distinct.join(several, "route", "left").withColumnRenamed("route", "r").withColumnRenamed("h", "k")
    joined = segs.join(known, (F.col("route") == F.col("r")) & (F.col("h") == F.col("k"))).filter((F.col("id") > F.col("least")) | F.col("several"))
    joined = materialize(joined.select(*segs.columns, "least"), f"{name}-known")
    discard(distinct, several)
    whole = joined.filter("id > least").select("id", F.col("at").cast("long").alias("start"), (F.col("at") + F.col("n") + (LENGTH - 1)).cast("long").alias("end"))
    return whole, joined.filter("id = least").drop("least")


def fetched(docs: DataFrame, segs: DataFrame) -> DataFrame:
    """segs with their bytes, from their documents."""
    asked = segs.groupBy("id").agg(F.collect_list(F.struct("route", "h", "at", "n")).alias("asked"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text, asked in zip(batch["id"], batch["text"], batch["asked"], strict=True):
                raw = _raw(text)
                out += [(r["route"], r["h"], doc, r["at"], r["n"], raw[r["at"] : r["at"] + r["n"] + LENGTH - 1]) for r in asked]
            yield pd.DataFrame(out, columns=["route", "h", "id", "at", "n", "seg"])

    return docs.join(asked, "id").select("id", "text", "asked").mapInPandas(run, ROUTED)


def rerouted(segs: DataFrame, gram: int) -> DataFrame:
    """The windows of the segments, as segments of the minimisers of ``gram`` bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, at, seg in zip(batch["id"].tolist(), batch["at"].tolist(), batch["seg"], strict=True):
                raw = bytes(seg)
                for first, n, m in runs(raw, gram):
                    for a, c, r in zip(first.tolist(), n.tolist(), m.view(np.int64).tolist(), strict=True):
                        own = raw[a : a + c + LENGTH - 1]
                        out.append((r, xxhash.xxh3_64_intdigest(own) - (1 << 63), doc, at + a, c, own))
            yield pd.DataFrame(out, columns=["route", "h", "id", "at", "n", "seg"])

    return segs.mapInPandas(run, ROUTED)


def gone_in(segs: DataFrame, level: int = 0) -> DataFrame:
    """Spans of the windows of segments (ROUTED, each of the smallest id that has it) that others of a smaller id have."""
    sizes = segs.groupBy("route").agg(F.count("*").alias("m"))
    hot = materialize(sizes.filter(F.col("m") > HOT).select("route"), "suffix-hot")
    n, cold = segs.count(), segs
    out = segs.limit(0).select("id", F.col("at").cast("long").alias("start"), F.col("at").cast("long").alias("end"))
    if not hot.isEmpty():
        side = F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot
        cold = segs.join(side, "route", "left_anti")
        again = materialize(rerouted(segs.join(side, "route", "left_semi").select(*segs.columns), GRAMS[level + 1]), "suffix-again")
        out, rest = summed_up(again, "suffix-again")
        if level + 2 < len(GRAMS):
            out = out.unionByName(gone_in(rest, level + 1))
    bucket = F.pmod(F.xxhash64("route"), F.lit(max(1, -(-n // BUCKET_SEGMENTS))))
    return out.unionByName(cold.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(lambda pdf: repeated(pdf, GRAMS[level]), SPANS))


def spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """id and the sorted (start, end) byte spans to be removed."""
    whole, rest = summed_up(found, "suffix")
    gone = whole
    if not rest.isEmpty():
        gone = whole.unionByName(gone_in(materialize(fetched(docs, rest), "suffix-fetched")))
    return gone.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut(raw: bytes, gone: list) -> tuple[int, int, bytes]:
    """Bytes removed, maximal removed runs, and the bytes that stay."""
    parts, at, removed, n = [], 0, 0, 0
    for start, end in gone:
        if start > at or not n:
            parts.append(raw[at:start])
            n, removed, at = n + 1, removed + end - start, end
        elif end > at:
            removed, at = removed + end - at, end
    return removed, n, b"".join(parts) + raw[at:]


def _digest() -> Column:
    return F.unhex(F.md5(F.col("text").cast("binary")))


def with_ids(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with id: doc_id, or, where ids are missing or have several texts, numbers of the distinct (id, digest) in their order."""
    texts = materialize(docs.select("doc_id", _digest().alias("digest")).distinct(), "suffix-texts")
    plain = texts.groupBy("doc_id").agg(F.count("*").alias("n")).filter("doc_id is null or n > 1").isEmpty()
    if plain:
        return docs.withColumn("id", F.col("doc_id"))
    numbered = materialize(texts.orderBy(F.col("doc_id").asc_nulls_last(), "digest").withColumn("id", F.monotonically_increasing_id()), "suffix-numbered")
    numbered = numbered.select(F.col("doc_id").alias("own"), F.col("digest").alias("same"), "id")
    return docs.withColumn("digest", _digest()).join(numbered, F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("digest") == F.col("same"))).select("doc_id", "text", "id")


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (what is left, as bytes) of each row of docs."""
    docs = with_ids(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    ids = materialize(docs.select("id", _digest().alias("digest"), F.octet_length("text").cast("long").alias("n")), "suffix-ids")
    # Written first, so that the join's rows of one text can be split among tasks; so are the tables joined below.
    first = ids.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("k")).filter("k > 1").select("digest", "first")
    first = materialize(first, "suffix-first")
    copies = materialize(ids.join(first, "digest").filter(F.col("id") > F.col("first")).filter(F.col("n") >= LENGTH).select("id").distinct(), "suffix-copies")
    few = copies.count() <= BROADCAST_ROWS
    one = docs.join(F.broadcast(copies) if few else copies, "id", "left_anti")
    total = ids.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = max(6, min(24, (max(1, total // BUCKET_BYTES) - 1).bit_length()))
    often = often_keys(one, bits)
    keys = materialize(shared(minimisers(one, bits, often)), "suffix-keys")
    found = materialize(segments(one, keys, bits, often), "suffix-segments")
    discard(keys)
    gone = materialize(spans(one, found), "suffix-spans")
    discard(found)
    gone = gone.unionByName(copies.select("id", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(LAST).alias("end"))).alias("spans")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, spans in zip(batch["text"], batch["spans"], strict=True):
                raw = _raw(text)
                spans = [] if spans is None else [(s["start"], min(s["end"], len(raw))) for s in spans]
                removed, n, kept = _cut(raw, spans)
                out.append((len(raw), removed, n, hashlib.sha256(kept).hexdigest(), kept))
            n_bytes, removed, n, sha, kept = zip(*out, strict=True) if out else ((), (), (), (), ())
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_bytes": n_bytes, "n_removed": removed, "n_spans": n, "kept_sha256": sha, "kept": kept})

    return docs.join(gone, "id", "left").select("doc_id", "text", "spans").mapInPandas(run, KEPT)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {"op8_suffix_dedup": op8_suffix_dedup}
SQL: dict[str, str] = {}
