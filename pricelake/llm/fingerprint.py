"""Document fingerprints by randomised edit embedding.

A walk reads a text one character after the other. At each step a random bit, shared by all texts and chosen by the
step and the character, says whether the walk goes on to the next character or repeats this one. Texts a few edits apart
soon walk in step again, so that their embeddings differ at few steps. The fingerprint samples the embedding at ``SLOTS`` steps:
each slot has its own random order of steps and takes the last record of that order within twice the text's length, so
texts of like length are sampled at like steps. A slot is 8 bits of a hash of the step and of the characters there.
Likeness is one less the share of differing slots.

``near_classes`` bands the fingerprints by sampled slots, verifies members of a band against its leaders, and closes over the links.

Defined cases: null text is empty; empty texts have one fingerprint, of likeness 1; a single document is its own next;
rows with one id follow each other by text; a null id comes last; an empty table gives none. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, sized_batches, table
from .ngram_join import components

SLOTS = 128
SYMBOLS = 64
PERIOD = 2048
WIDTH = 5
CHUNK = 32_768
BATCH_CHARS = 3_000_000
BANDS = 16
BAND_SLOTS = 5
#: Classes that a task holds of a band.
CROWD = 20_000
NEAR = 0.75
SEED = 5
MULTIPLIERS = np.random.default_rng(SEED).integers(1, 2**63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _strides() -> np.ndarray:
    """For each symbol and step (in its period), how many steps the walk stays: until the next bit that is set."""
    bits = np.random.default_rng(SEED + 1).random((SYMBOLS, PERIOD)) < 0.5
    out = np.zeros((SYMBOLS, PERIOD), np.int32)
    far = np.zeros(SYMBOLS, np.int32)
    for step in range(2 * PERIOD - 1, -1, -1):
        far = np.where(bits[:, step % PERIOD], 1, far + 1)
        out[:, step % PERIOD] = far
    return out.ravel()


def _records() -> np.ndarray:
    """For each slot the steps that set a record in its order: after step p the next is past p / u, u uniform."""
    rng, out = np.random.default_rng(SEED + 2), []
    for _ in range(SLOTS):
        row = [0]
        while row[-1] < 2**45:
            row.append(int((row[-1] + 1) / rng.random()) + 1)
        out.append(row)
    most = max(map(len, out))
    return np.array([r + [2**62] * (most - len(r)) for r in out])


STRIDES, RECORDS = _strides(), _records()


def fingerprints(texts: list[str]) -> list[bytes]:
    """SLOTS bytes for each text."""
    out: list[bytes] = [b""] * len(texts)
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    for part in sized_batches(((i, len(texts[i]) + 64) for i in order), BATCH_CHARS):
        for i, f in zip(part, _walk([np.frombuffer(texts[i].encode("utf-32-le", "surrogatepass"), np.uint32) for i in part]), strict=True):
            out[i] = f
    return out


def _walk(codes: list[np.ndarray]) -> list[bytes]:
    """Texts by falling length, walked together, CHUNK characters at a time."""
    sizes = np.array([len(c) for c in codes])
    steps = [RECORDS[np.arange(SLOTS), (RECORDS < 2 * n).sum(axis=1) - 1] if n else None for n in sizes]
    at = [np.full(SLOTS, n, np.int64) for n in sizes]  # the character at each sampled step; past the end: none
    j = np.zeros(len(codes), np.int64)
    for first in range(0, int(sizes.max(initial=0)), CHUNK):
        live = int((sizes > first).sum())
        length = min(CHUNK, int(sizes[0]) - first)
        symbols = np.zeros((length, live), np.int32)
        for k in range(live):
            part = codes[k][first : first + CHUNK]
            symbols[: len(part), k] = (((part * np.uint32(0x9E3779B1)) >> np.uint32(26)) % np.uint32(SYMBOLS)).astype(np.int32) * PERIOD
        seen = np.zeros((length, live), np.int64)
        still = (np.minimum(sizes[:live], first + length)[None, :] > np.arange(first, first + length)[:, None]).sum(axis=1)
        now = j[:live]
        for i, n in enumerate(still.tolist()):
            x = now[:n]
            seen[i, :n] = x
            x += STRIDES[symbols[i, :n] + (x & (PERIOD - 1))]
        for k in range(live):
            n = min(length, int(sizes[k]) - first)
            own = np.ascontiguousarray(seen[:n, k])
            inside = (steps[k] >= own[0]) & (steps[k] < now[k])
            at[k][inside] = first + np.searchsorted(own, steps[k][inside], "right") - 1
    out = []
    for c, n, step, where in zip(codes, sizes, steps, at, strict=True):
        if not n:
            out.append(bytes(SLOTS))
            continue
        padded = np.concatenate([c, np.zeros(WIDTH, np.uint32)]).astype(np.uint64) if n < 4096 else None
        idx = where[:, None] + np.arange(WIDTH)
        shown = padded[idx] if padded is not None else np.where(idx < n, c[np.minimum(idx, n - 1)], 0).astype(np.uint64)
        h = (shown + np.uint64(1)) @ MULTIPLIERS + step.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        out.append((h >> np.uint64(56)).astype(np.uint8).tobytes())
    return out


def likeness(a: bytes, b: bytes) -> float:
    return float((np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).mean())


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint of each row of docs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_chars": [len(t) for t in texts], "fingerprint": [f.hex() for f in fingerprints(texts)]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_chars long, fingerprint string")


def band_keys(prints: list[bytes]) -> np.ndarray:
    """A row of BANDS keys for each print: hashes of BAND_SLOTS slots that each band samples."""
    rng = np.random.default_rng(SEED + 3)
    slots = np.stack([rng.permutation(SLOTS)[:BAND_SLOTS] for _ in range(BANDS)])
    raw = np.frombuffer(b"".join(prints), np.uint8).reshape(-1, SLOTS)[:, slots].astype(np.uint64) + np.uint64(1)
    weights = np.random.default_rng(SEED + 4).integers(1, 2**63, slots.shape, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    h = (raw * weights).sum(axis=2, dtype=np.uint64)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def banded(classes: DataFrame) -> DataFrame:
    """band, rep: the bands of each class (rep, print) that another class is in too."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = band_keys([bytes(p) for p in batch["print"]]) if len(batch) else np.zeros((0, BANDS), np.int64)
            yield pd.DataFrame({"band": keys.ravel(), "rep": np.repeat(batch["rep"].to_numpy(np.int64), BANDS)})

    rows = classes.mapInPandas(run, "band long, rep long")
    full = materialize(rows.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"), "bands-full")
    return rows.join(full, "band").select("band", "rep", "n")


def _led(batches: Iterator[pd.DataFrame], near: float) -> Iterator[pd.DataFrame]:
    """band, leader (a), rep (b) for members (band, rep, print) that come sorted: each goes to all leaders of its band that it is near, or
    leads itself (a = b)."""
    band, leaders, ids = None, np.zeros((0, SLOTS), np.uint8), []
    for batch in batches:
        out = []
        for own, rep, raw in zip(batch["band"].tolist(), batch["rep"].tolist(), batch["print"], strict=True):
            if own != band:
                band, ids, leaders = own, [], np.zeros((16, SLOTS), np.uint8)
            p = np.frombuffer(raw, np.uint8)
            hit = np.flatnonzero((leaders[: len(ids)] == p).sum(axis=1) >= near * SLOTS)
            out += [(band, ids[k], rep) for k in hit.tolist()]
            if not len(hit):
                out.append((band, rep, rep))
                if len(ids) == len(leaders):
                    leaders = np.concatenate([leaders, np.zeros_like(leaders)])
                leaders[len(ids)] = p
                ids.append(rep)
        yield pd.DataFrame(out, columns=["band", "a", "b"]).astype("int64")


def _met(batches: Iterator[pd.DataFrame], near: float) -> Iterator[pd.DataFrame]:
    """a, b: each member (tile, leads false, rep, print) with all leaders of its tile that it is near; leaders come first."""
    tile, leaders, ids, waiting = None, None, [], []
    for batch in batches:
        out = []
        for own, leads, rep, raw in zip(batch["tile"].tolist(), batch["leads"].tolist(), batch["rep"].tolist(), batch["print"], strict=True):
            if own != tile:
                tile, ids, waiting, leaders = own, [], [], None
            p = np.frombuffer(raw, np.uint8)
            if leads:
                ids.append(rep)
                waiting.append(p)
                continue
            if leaders is None:
                leaders, waiting = np.array(waiting, np.uint8).reshape(-1, SLOTS), []
            out += [(ids[k], rep) for k in np.flatnonzero((leaders == p).sum(axis=1) >= near * SLOTS).tolist()]
        yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _lead(members: DataFrame, near: float) -> DataFrame:
    asked = members.repartition("band").sortWithinPartitions("band", "rep")
    return asked.mapInPandas(lambda batches: _led(batches, near), "band long, a long, b long")


def crowded_links(members: DataFrame, near: float) -> DataFrame:
    """a, b: links within bands (band, rep, print, n) of more than CROWD classes. A band is cut into parts of about CROWD, each with its own leaders, and
    each part's members also meet the leaders of every other part, a task a pair of parts: nobody is compared with fewer leaders."""
    parts = F.ceil(F.col("n") / CROWD).cast("int")
    cut = members.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).withColumn("key", F.xxhash64("band", "part"))
    cut = materialize(cut, "bands-cut")
    own = materialize(_lead(cut.select(F.col("key").alias("band"), "rep", "print"), near), "bands-led")
    leaders = cut.join(own.filter("a = b").select(F.col("band").alias("key"), F.col("a").alias("rep")), ["key", "rep"], "left_semi")
    others = lambda df: df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).filter("other <> part")
    tiles = others(leaders).select(F.xxhash64("band", "part", "other").alias("tile"), F.lit(True).alias("leads"), "rep", "print")
    tiles = tiles.unionByName(others(cut).select(F.xxhash64("band", "other", "part").alias("tile"), F.lit(False).alias("leads"), "rep", "print"))
    tiles = tiles.repartition("tile").sortWithinPartitions("tile", F.desc("leads"), "rep")
    return own.select("a", "b").unionByName(tiles.mapInPandas(lambda batches: _met(batches, near), "a long, b long"))


def near_classes(prints: DataFrame, near: float = NEAR) -> DataFrame:
    """doc_id and class_id: the smallest id that links between near prints reach; null for a null id without an equal print.

    Equal prints are a class. Bands take BAND_SLOTS slots sampled at random; within a band each class is verified against the band's
    leaders, and links to all that it is near. Bands of more than CROWD classes are cut into parts whose members meet all leaders. The
    index loses a link where no band holds both, or where two members of a band are near each other but have no leader in common.
    """
    prints = prints.select("doc_id", F.unhex("fingerprint").alias("print"))
    classes = prints.groupBy("print").agg(F.min("doc_id").alias("rep"))
    classes = materialize(classes.filter("rep is not null"), "prints")
    members = materialize(banded(classes), "bands")
    asked = members.join(classes, "rep").select("band", "rep", "print", "n")
    links = _lead(asked.filter(F.col("n") <= CROWD).select("band", "rep", "print"), near).select("a", "b")
    if not members.filter(F.col("n") > CROWD).isEmpty():
        links = links.unionByName(crowded_links(asked.filter(F.col("n") > CROWD), near))
    links = materialize(links.filter("a <> b").distinct(), "bands-links")
    labels = components(links)
    named = classes.join(labels.withColumnRenamed("doc_id", "rep"), "rep", "left").select("print", F.coalesce("component", "rep").alias("class_id"))
    return prints.join(named, "print", "left").select("doc_id", "class_id")


def _cut(key: Column, bounds: list[int], first: int = 0) -> Column:
    """The number of the range that a key falls in, as nested comparisons; ranges by falling key."""
    if not bounds:
        return F.lit(first)
    mid = len(bounds) // 2
    return F.when(key >= bounds[mid], _cut(key, bounds[:mid], first)).otherwise(_cut(key, bounds[mid + 1 :], first + mid + 1))


def with_next(docs: DataFrame, use, schema: str) -> DataFrame:
    """``use`` over batches of (doc_id, text, next text) triples, the next by falling doc_id, after the last the first.

    One shuffle: ids are cut into ranges, and the first row of each range goes also to the range before it.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(2**63))).alias("_key"))
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = rows.agg(F.percentile_approx("_key", [k / parts for k in range(1, parts)], 100 * parts)).first()[0] or []
    part = _cut(F.col("_key"), sorted(set(bounds), reverse=True))
    heads = sorted((r["part"], r["head"]) for r in rows.select("_key", part.alias("part")).groupBy("part").agg(F.max("_key").alias("head")).collect())
    before = [(head, heads[k - 1][0]) for k, (_, head) in enumerate(heads)]
    sent = spark.createDataFrame(before, "_key long, also int")  # a row for each range
    twice = F.explode(F.when(F.col("also").isNull(), F.array(F.struct(part.alias("part"), F.lit(0).alias("ahead")))).otherwise(F.array(F.struct(part.alias("part"), F.lit(0).alias("ahead")), F.struct(F.col("also").alias("part"), F.lit(1).alias("ahead")))))
    dealt = rows.join(F.broadcast(sent), "_key", "left").select("doc_id", "text", "_key", twice.alias("to")).select("doc_id", "text", "_key", "to.part", "to.ahead")
    ordered = dealt.repartition(parts, "part").sortWithinPartitions("part", "ahead", F.desc("_key"), F.col("text").asc_nulls_first())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the row whose next is to come: (part, id, text)
        for batch in batches:
            triples = []
            for part, ahead, doc, text in zip(batch["part"], batch["ahead"], batch["doc_id"].astype("Int64"), batch["text"], strict=True):
                if held is not None and held[0] == part:
                    triples.append((held[1], held[2], text or ""))
                held = None if ahead else (part, doc, text or "")
            yield from use(triples)

    return ordered.mapInPandas(run, schema)


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(triples: list[tuple]) -> Iterator[pd.DataFrame]:
    for part in sized_batches((((d, t, n), 2 * len(t) + len(n)) for d, t, n in triples), 4 * BATCH_CHARS):
        changed = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for _, t, n in part]
        own: list[str] = [part[0][1]]
        place = []
        for _, t, n in part:  # a row's next is mostly the row that follows
            if own[-1] is not t and own[-1] != t:
                own.append(t)
            place.append(len(own) - 1)
            own.append(n)
        prints = fingerprints(own + changed)
        a = [prints[k] for k in place]
        b = [prints[k + 1] for k in place]
        c = prints[len(own) :]
        yield pd.DataFrame({
            "doc_id": pd.array([d for d, _, _ in part], "Int64"), "n_chars": [len(t) for _, t, _ in part],
            "edited_sha256": [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in changed],
            "fingerprint": [x.hex() for x in a], "edited_fingerprint": [x.hex() for x in c],
            "near_edited": [likeness(x, y) for x, y in zip(a, c, strict=True)], "near_next": [likeness(x, y) for x, y in zip(a, b, strict=True)],
        })


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the contract asks for, and class_id: the smallest id of the documents near this one, directly or not."""
    made = with_next(table(spark, sf_dir, "documents"), edited, EDITED)
    packed = {c: F.unhex(c) for c in ("fingerprint", "edited_fingerprint")}
    found = materialize(made.withColumns(packed), "fingerprints").withColumns({c: F.lower(F.hex(c)) for c in packed})
    classes = near_classes(found.select("doc_id", "fingerprint")).filter("doc_id is not null").groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    return found.join(classes, "doc_id", "left")


QUERIES = {"op5_fingerprint": op5_fingerprint}
SQL: dict[str, str] = {}
