"""Quality classifier by compression.

One zstandard dictionary is built from good labelled texts and one from bad. A text is cut into pieces of ``PIECE``
bytes (all of them), each piece is compressed with either dictionary, and the difference of the summed sizes over their
sum, with the two rates to the plain size, is calibrated by a logistic curve to the probability of label 1.

Training reads a bounded sample of labelled rows: about ``PER_LABEL`` of each label, chosen by a hash of the id, two
thirds for the dictionaries and the rest for the calibration, so that the curve sees only texts that are in no dictionary.

Defined cases: a null text is empty; an empty text has sizes 0 and gets the share of label 1 as its score; several labels
of one id count once each; null labels are left out; if a label has no rows all texts get the share of label 1;
an empty table gives none. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, table, unit

PER_LABEL = 3000
#: Bytes of sample text that a dictionary is trained on, at most, spread over the sample's pieces by a hash.
TRAIN_BYTES = 24_000_000
DICT_BYTES = 96_000
PIECE = 2048
LEVEL = 3
SEED = "quality-1"
PASS = 0.7
#: Bytes of an empty piece when compressed, and of the prior that the difference is shrunk by.
HEADER = 9
SHRINK = 128


def pieces(text: str | None) -> list[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]


class Sizes:
    """Compressed sizes under the good and the bad dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        held = [zstandard.ZstdCompressionDict(d) if d else None for d in (good, bad)]
        for d in held:
            if d:
                d.precompute_compress(level=LEVEL)
        self.with_ = [zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False) for d in held]

    def __call__(self, text: str | None) -> np.ndarray:
        parts = pieces(text)
        return np.array([sum(map(len, parts)), *(sum(len(c.compress(p)) for p in parts) for c in self.with_)], float)


def features(sizes: np.ndarray) -> np.ndarray:
    """Rows (plain, good, bad) to what the calibration sees: the normalised difference, the rate to the plain size, the
    length, and their products. Frame headers don't count; SHRINK bytes of no difference steady short texts."""
    plain = sizes[:, 0]
    headers = HEADER * np.ceil(plain / PIECE)
    good, bad = np.maximum(sizes[:, 1] - headers, 1), np.maximum(sizes[:, 2] - headers, 1)
    d = (good - bad) / (np.maximum(good, bad) + SHRINK)
    rate = np.minimum(good, bad) / (np.maximum(plain, 1) + SHRINK)
    size = np.log(np.maximum(plain, 1))
    return np.stack([d, rate, d * rate, rate**2, d**2, size, size**2, d * size, rate * size], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> dict:
    """Weighted logistic regression by Newton steps, with a small ridge."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], axis=1)
    b, ridge = np.zeros(z.shape[1]), np.diag([1e-2] * (z.shape[1] - 1) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (w * (y - p)) - ridge @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return {"mean": mean, "scale": scale, "b": b}


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, seed: str = SEED) -> dict:
    """Model from documents (doc_id, text) and labels (doc_id, quality).

    The labels are sampled before texts are read, so that only about 2 * per_label of them go to the tasks. The driver
    gets the counts, two dictionaries and the sizes of the sample's compressed texts.
    """
    labels = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    counts = {r["quality"]: r["n"] for r in labels.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    prior = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    if len(counts) < 2:
        return {"prior": prior, "curve": None}
    rate = F.when(F.col("quality") == 1, per_label / counts[1]).otherwise(per_label / counts[0])
    chosen = labels.filter(unit(seed, F.col("doc_id")) < rate).withColumn("for_dict", unit(f"{seed}-use", F.col("doc_id")) < 2 / 3)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").repartition("doc_id").persist()
    try:
        of_dict = sample.filter("for_dict")
        every = {r["quality"]: -(-r["n"] // TRAIN_BYTES) for r in of_dict.groupBy("quality").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n")).collect()}
        thinned = of_dict.mapInPandas(lambda batches: _chosen(batches, every), "quality int, doc_id long, at int, piece binary")
        built = {r["quality"]: bytes(r["content"]) for r in thinned.groupBy("quality").applyInPandas(_dictionary, "quality int, content binary").collect()}
        good, bad = built.get(1, b""), built.get(0, b"")

        def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sizes = Sizes(good, bad)
            for batch in batches:
                got = [sizes(t) for t in batch["text"]]
                yield pd.DataFrame({"quality": batch["quality"], "plain": [s[0] for s in got], "good": [s[1] for s in got], "bad": [s[2] for s in got]})

        rows = sample.filter("not for_dict").repartition(8, "doc_id").mapInPandas(measure, "quality int, plain double, good double, bad double").collect()
    finally:
        sample.unpersist()
    y = np.array([r["quality"] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return {"prior": prior, "curve": None}
    w = np.where(y == 1, counts[1] / max(1, y.sum()), counts[0] / max(1, (1 - y).sum()))  # as frequent as among all labels
    order = np.lexsort([[r[k] for r in rows] for k in ("plain", "good", "bad", "quality")])  # the same sums on each run
    x = features(np.array([[r["plain"], r["good"], r["bad"]] for r in rows]))
    return {"prior": prior, "good": good, "bad": bad, "curve": _logistic(x[order], y[order], (w / w.mean())[order])}


def _chosen(batches: Iterator[pd.DataFrame], every: dict[int, int]) -> Iterator[pd.DataFrame]:
    """The pieces of each label's texts, thinned by a hash to about TRAIN_BYTES before they meet."""
    for batch in batches:
        rows = [(q, d, k, p) for q, d, t in zip(batch["quality"], batch["doc_id"], batch["text"], strict=True) for k, p in enumerate(pieces(t)) if zlib.crc32(b"%d:%d" % (d, k)) % max(1, every[q]) == 0]
        yield pd.DataFrame(rows, columns=["quality", "doc_id", "at", "piece"])


def _dictionary(pdf: pd.DataFrame) -> pd.DataFrame:
    parts = [bytes(p) for p in pdf.sort_values(["doc_id", "at"])["piece"]]
    try:
        content = zstandard.train_dictionary(min(DICT_BYTES, max(1024, sum(map(len, parts)) // 10)), parts).as_bytes()
    except zstandard.ZstdError:  # too little text to choose from: the text itself is the dictionary
        content = b"".join(parts)[:DICT_BYTES]
    return pd.DataFrame({"quality": [int(pdf["quality"].iloc[0])], "content": [content]})


def scores(texts: list[str | None], model: dict, sizes: Sizes | None) -> pd.DataFrame:
    if sizes is None:
        return pd.DataFrame({"score": [model["prior"]] * len(texts), "difference": [0.0] * len(texts)})
    got = np.array([sizes(t) for t in texts]).reshape(-1, 3)
    c, x = model["curve"], features(got)
    p = 1 / (1 + np.exp(-np.clip(((x - c["mean"]) / c["scale"]) @ c["b"][:-1] + c["b"][-1], -30, 30)))
    return pd.DataFrame({"score": np.where(got[:, 0] > 0, p, model["prior"]), "difference": x[:, 0]})


def score(docs: DataFrame, model: dict, keys: list[str | Column]) -> DataFrame:
    """``keys`` of docs with score and difference."""
    rows = docs.select(*keys, F.col("text").alias("_text"))
    kept = [f for f in rows.schema.fields if f.name != "_text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", score double, difference double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes = Sizes(model["good"], model["bad"]) if model["curve"] else None
        for batch in batches:
            yield pd.concat([batch.drop(columns="_text"), scores(list(batch["_text"]), model, sizes)], axis=1)

    return rows.mapInPandas(run, schema)


def keep(docs: DataFrame, model: dict, least: float = PASS) -> DataFrame:
    """The documents, all columns, whose score is ``least`` or more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes = Sizes(model["good"], model["bad"]) if model["curve"] else None
        for batch in batches:
            yield batch[scores(list(batch["text"]), model, sizes)["score"].to_numpy() >= least]

    return docs.mapInPandas(run, docs.schema)


def learn(docs: DataFrame, labels: DataFrame) -> dict:
    """Learns from the labels outside the held-out fold."""
    return fit(docs, labels.filter(fold(F.col("doc_id"), 4) != 2))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    held_out = (fold(F.col("doc_id"), 4) == 2).alias("held_out")
    scored = score(docs, model, ["doc_id", held_out])
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= PASS).cast("int").alias("predicted"), "difference")


QUERIES = {"op2_quality": op2_quality}
SQL: dict[str, str] = {}
