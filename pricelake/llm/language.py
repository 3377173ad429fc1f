"""Language identification by nearest centroid.

Character 1- to 3-grams of the lower-cased text are hashed to a fixed number of dimensions; damped counts times inverse
document frequency, normalised, are compared by cosine with several clustered centroids per language. A text farther
from its nearest centroid than that cluster's training distances allow is marked rejected.

Training reads a bounded sample: about ``PER_LANG`` labelled documents of each language, chosen by a hash of the id; they
meet as count vectors of a fixed size. Any number of languages is learned: their centroids go to the tasks in blocks of
``BLOCK`` languages, each a pass that carries on the nearest so far. Prediction reads whole texts and nothing but texts.

Defined cases: a null text, or one without a letter (``str.isalpha``), is ``und`` with score 0; equal cosines go to the
language first by code point, then to the lower cluster; repeated rows get equal results; without any training row all
texts are ``und``; an empty table gives none. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, fold, materialize, sized_batches, table, unit

DIMS = 4096
CLUSTERS = 4
PER_LANG = 400
#: Languages whose centroids are sent to the tasks at a time (DIMS * CLUSTERS * 4 bytes each).
BLOCK = 200
#: Up to so many languages their counts are broadcast, beyond it joined by a shuffle.
BROADCAST_LANGS = 100_000
SEED = "language-1"
TEMPERATURE = 0.05
UNKNOWN = "und"
BATCH_BYTES = 4_000_000
STEP = np.uint32(0x9E3779B1)


#: ASCII code points that are no lower-case letter stand for a space, so that punctuation and digits tell nothing.
PLAIN = np.array([c if 97 <= c <= 122 else 32 for c in range(128)], dtype=np.uint32)


def ngram_counts(text: str, dims: int = DIMS) -> np.ndarray:
    """Hashed counts of the 1-, 2- and 3-grams of the text's words, a single space put between and around them."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = np.where(codes < 128, PLAIN[np.minimum(codes, 127)], codes)
    space = codes == 32
    codes = codes[~(space & np.concatenate([[False], space[:-1]]))]
    one = codes * STEP
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + one[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE35) + one[2:]
    grams = np.concatenate([one, two, three])
    grams ^= grams >> np.uint32(16)
    return np.bincount((grams * STEP) >> np.uint32(32 - int(np.log2(dims))), minlength=dims).astype(np.float32)


def weighted(grams: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of counts to normalised TF-IDF vectors."""
    x = np.log1p(grams) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def fit(train: DataFrame, per_lang: int = PER_LANG, clusters: int = CLUSTERS, seed: str = SEED, block: int = BLOCK) -> dict:
    """Model from rows (doc_id, text, lang). Bound: ``per_lang`` documents a language in expectation.

    Document frequencies and then the clusters of each language are computed in tasks; the driver gets the model, block by block.
    """
    spark = train.sparkSession
    train = train.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull())
    counts = materialize(train.groupBy("lang").agg(F.count("*").alias("n")), "language-counts")
    many = counts.count() > BROADCAST_LANGS
    rate = F.lit(float(per_lang)) / F.col("n")
    sample = train.filter(F.col("text").isNotNull()).join(counts if many else F.broadcast(counts), "lang").filter(unit(seed, F.col("doc_id"), F.xxhash64("text")) < rate)
    counted = materialize(sample.select("doc_id", "lang", "text").mapInPandas(_counted, "doc_id long, lang string, grams binary"), "language-sample")
    seen = counted.repartition(16, "doc_id").mapInPandas(_frequencies, "n long, df binary").collect()
    n, df = sum(r["n"] for r in seen), sum((np.frombuffer(r["df"], np.int64) for r in seen), np.zeros(DIMS, np.int64))
    idf = np.log((1.0 + n) / (1.0 + df)).astype(np.float32) + 1
    told = counted.groupBy("lang").applyInPandas(lambda pdf: _cluster(pdf, idf, clusters), "lang string, cluster int, radius double, centroid binary")
    told = materialize(told, "language-centroids")
    langs = [r["lang"] for r in told.select("lang").distinct().orderBy("lang").collect()]
    blocks = []
    for k in range(0, len(langs), block):
        own = langs[k : k + block]
        rows = told.filter((F.col("lang") >= own[0]) & (F.col("lang") <= own[-1])).orderBy("lang", "cluster").collect()
        blocks.append(spark.sparkContext.broadcast({"langs": own, "centroids": np.stack([np.frombuffer(r["centroid"], np.float32) for r in rows]), "radius": np.array([r["radius"] for r in rows]), "of": np.array([own.index(r["lang"]) for r in rows])}))
    discard(counts, counted, told)
    return {"idf": idf, "blocks": blocks}


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        batch = batch[[has_letter(t) for t in batch["text"]]]
        yield batch[["doc_id", "lang"]].assign(grams=[ngram_counts(t).tobytes() for t in batch["text"]])


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    n, df = 0, np.zeros(DIMS, np.int64)
    for batch in batches:
        for grams in batch["grams"]:
            df += np.frombuffer(grams, np.float32) > 0
            n += 1
    yield pd.DataFrame({"n": [n], "df": [df.tobytes()]})


def _cluster(pdf: pd.DataFrame, idf: np.ndarray, clusters: int) -> pd.DataFrame:
    """Spherical k-means of one language's sample; the radius is the distance within which nearly all of it lies."""
    grams = sorted(zip(pdf["doc_id"].tolist(), pdf["grams"].tolist(), strict=True), key=lambda r: (pd.isna(r[0]), 0 if pd.isna(r[0]) else r[0], r[1]))
    x = weighted(np.stack([np.frombuffer(g, np.float32) for _, g in grams]), idf)
    centres = [x.mean(axis=0)]
    while len(centres) < min(clusters, len(x)):  # next the sample farthest from those chosen
        centres.append(x[np.argmin((x @ np.stack(centres).T).max(axis=1))])
    c = np.stack(centres)
    for _ in range(12):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        own = (x @ c.T).argmax(axis=1)
        c = np.stack([x[own == k].mean(axis=0) if (own == k).any() else c[k] for k in range(len(c))])
    c = (c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    far = 1 - (x @ c.T).max(axis=1)
    own = (x @ c.T).argmax(axis=1)
    radius = [float(np.quantile(far[own == k], 0.99)) * 1.25 + 0.05 if (own == k).any() else 0.5 for k in range(len(c))]
    return pd.DataFrame({"lang": pdf["lang"].iloc[0], "cluster": range(len(c)), "radius": radius, "centroid": [v.tobytes() for v in c]})


STATE = {"lang_pred": UNKNOWN, "best": -1.0, "odds": 0.0, "rejected": True}


def nearer(batch: pd.DataFrame, idf: np.ndarray, block: dict) -> pd.DataFrame:
    """``batch`` (_text and the columns of STATE) after the centroids of one block: the nearest language so far, its cosine, and the
    sum of exp((cosine - best) / TEMPERATURE) over the languages so far."""
    texts = batch["_text"].tolist()
    lang, best, odds, rejected = (batch[c].to_numpy(copy=True) for c in STATE)
    rows = [i for i, t in enumerate(texts) if has_letter(t)]
    for part in sized_batches(((i, len(texts[i]) + 4 * DIMS) for i in rows), BATCH_BYTES):
        near = weighted(np.stack([ngram_counts(texts[i], len(idf)) for i in part]), idf) @ block["centroids"].T
        of_lang = np.stack([near[:, block["of"] == k].max(axis=1) for k in range(len(block["langs"]))], axis=1).astype(float)
        k, at = of_lang.argmax(axis=1), near.argmax(axis=1)
        top, was = of_lang.max(axis=1), best[part].astype(float)
        new = np.maximum(top, was)
        odds[part] = odds[part] * np.exp((was - new) / TEMPERATURE) + np.exp((of_lang - new[:, None]) / TEMPERATURE).sum(axis=1)
        won = top > was
        best[part] = new
        for i, wins, j, out in zip(part, won.tolist(), k.tolist(), (1 - near.max(axis=1) > block["radius"][at]).tolist(), strict=True):
            if wins:
                lang[i], rejected[i] = block["langs"][j], out
    return batch.assign(lang_pred=lang, best=best, odds=odds, rejected=rejected)


def predict(docs: DataFrame, model: dict, keys: list[str | Column]) -> DataFrame:
    """``keys`` of docs with lang_pred, score, distance and rejected."""
    idf = model["idf"]
    start = {"lang_pred": F.lit(UNKNOWN), "best": F.lit(-1.0), "odds": F.lit(0.0), "rejected": F.lit(True)}
    rows = docs.select(*keys, F.col("text").alias("_text"), *[v.alias(c) for c, v in start.items()])
    kept = [f.name for f in rows.schema.fields if f.name not in ("_text", *STATE)]
    for block in model["blocks"]:

        def run(batches: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield nearer(batch, idf, block.value)

        rows = rows.mapInPandas(run, rows.schema)
    known = F.col("odds") > 0
    score = F.when(known, F.least(F.lit(1.0), 1 / F.col("odds"))).otherwise(0.0)
    distance = F.when(known, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("best")))).otherwise(1.0)
    return rows.select(*kept, "lang_pred", score.alias("score"), distance.alias("distance"), "rejected")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = fit(docs.filter(~held_out))
    return predict(docs, model, ["doc_id", held_out.alias("held_out")]).select("doc_id", "held_out", "lang_pred", "score", "distance", "rejected")


QUERIES = {"op1_language": op1_language}
SQL: dict[str, str] = {}
