"""Language-model scoring with a log-bilinear model.

Words are counted over all training documents. The ``OWN`` most frequent words are classes of their own; all other words
share ``SHARED`` classes by a hash of their ending. A log-bilinear model predicts the class of the next word from the two
before: position matrices times context vectors, a dot product with each class's vector, and a bias. It is trained in
numpy by noise-contrastive estimation: each task takes steps on its own documents, parameters are averaged over the
tasks' words, and every position of every training document is an example once. A word's probability is its class's normalised probability (batched
matrix products over the distinct contexts) times its add-one share within the class.

Words of the ``FREQUENT`` commonest are looked up in the tasks; of the others each document's counts are joined with the table of
counts. Neither the vocabulary nor the join has a limit.

Defined cases: null text is empty (one end token); repeated rows are scored each; a null doc_id counts as the word ``null``
in the folds; without any training document each token has probability 1; an empty table gives none. Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, materialize, sized_batches, table, tokens

END = b""
OWN = 512
SHARED = 64
CLASSES = OWN + SHARED
ENDING = 3
DIMS = 24
#: At most so many words (with their counts) go to the tasks: about 100 bytes each.
FREQUENT = 200_000
ROUNDS = 3
NOISE = 64
BATCH = 256
RATE = 0.5
SEED = 11
FLUSH = 400_000
BATCH_CHARS = 4_000_000
PARAMS = ("R", "Q", "C", "b")


def ending(token: bytes) -> int:
    return OWN + zlib.crc32(token[-ENDING:]) % SHARED


def count_words(docs: DataFrame) -> DataFrame:
    """(token binary, c long) over whole texts, ends included."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch["text"]:
                seen.update(tokens(text))
                seen[END] += 1
                if len(seen) > FLUSH:
                    yield pd.DataFrame({"token": list(seen), "c": list(seen.values())})
                    seen.clear()
        yield pd.DataFrame({"token": list(seen), "c": list(seen.values())})

    return docs.select("text").mapInPandas(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame) -> dict | None:
    """What tasks need of the counts: totals, the frequent words, and the shared classes' sizes. Bounded by FREQUENT."""
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    if not total["v"]:
        return None
    step = F.floor(F.log2("c") * 8).alias("step")
    left, least = FREQUENT, None
    for r in counts.groupBy(step).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():
        if (left := left - r["n"]) < 0:
            break
        least = r["step"]
    rows = counts.filter(F.floor(F.log2("c") * 8) >= least).collect() if least is not None else []
    frequent = {bytes(r["token"]): r["c"] for r in rows}
    own = sorted(frequent, key=lambda w: (-frequent[w], w))[: OWN - 1]
    own = [END, *[w for w in own if w != END]][:OWN]
    ends = F.crc32(F.expr(f"substring(token, greatest(octet_length(token) - {ENDING - 1}, 1), {ENDING})"))
    shared = np.zeros((SHARED, 2), np.int64)
    for r in counts.groupBy((ends % SHARED).alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        shared[r["k"]] = r["n"], r["v"]
    for w in own:
        if w in frequent:
            shared[ending(w) - OWN] -= frequent[w], 1
    classes = {w: k for k, w in enumerate(own)}
    mass = np.concatenate([[frequent.get(w, 0) for w in own], np.zeros(OWN - len(own), int), shared[:, 0]]) + 0.5
    return {"n": total["n"], "v": total["v"], "words": [list(frequent), np.array([classes.get(w, ending(w)) for w in frequent], np.int32), np.log10(np.array(list(frequent.values())) + 1.0)], "own": len(own), "within": np.log10(shared.sum(axis=1) + 1.0), "mass": mass / mass.sum()}


def start(mass: np.ndarray, seed: int = SEED) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    return {"R": draw(CLASSES, DIMS), "Q": draw(CLASSES, DIMS), "C": np.stack([np.eye(DIMS, dtype=np.float32)] * 2) * 0.7, "b": np.log(mass).astype(np.float32)}


class Trainer:
    """Noise-contrastive estimation with Adagrad steps; the noise samples of a batch are shared by its positions."""

    def __init__(self, params: dict[str, np.ndarray], mass: np.ndarray, seed: int):
        self.p = {k: v.copy() for k, v in params.items()}
        self.seen = {k: np.full_like(v, 0.1) for k, v in params.items()}
        self.log_noise, self.cut = np.log(NOISE * mass).astype(np.float32), np.cumsum(mass)
        self.rng = np.random.default_rng(seed)

    def step(self, c2: np.ndarray, c1: np.ndarray, w: np.ndarray) -> None:
        p, n = self.p, np.minimum(np.searchsorted(self.cut, self.rng.random(NOISE)), CLASSES - 1)
        r1, r2 = p["R"][c1], p["R"][c2]
        h = r1 @ p["C"][0] + r2 @ p["C"][1]
        qw, qn = p["Q"][w], p["Q"][n]
        true = 1 - _sigmoid((h * qw).sum(axis=1) + p["b"][w] - self.log_noise[w])
        false = -_sigmoid(h @ qn.T + p["b"][n] - self.log_noise[n])
        gh = true[:, None] * qw + false @ qn
        seen = np.concatenate([w, n])
        grad = {"R": np.zeros_like(p["R"]), "Q": np.zeros_like(p["Q"]), "C": np.stack([r1.T @ gh, r2.T @ gh]), "b": np.bincount(seen, np.concatenate([true, false.sum(axis=0)]), CLASSES).astype(np.float32)}
        _add(grad["Q"], seen, np.concatenate([true[:, None] * h, false.T @ h]))
        _add(grad["R"], np.concatenate([c1, c2]), np.concatenate([gh @ p["C"][0].T, gh @ p["C"][1].T]))
        for k, g in grad.items():
            g /= len(w)
            self.seen[k] += g * g
            p[k] += RATE * g / np.sqrt(self.seen[k])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):  # the limit is right
        return 1 / (1 + np.exp(-x))


class Words(dict):
    """Numbers of the frequent words; -1 for all others."""

    def __init__(self, words: list[bytes], classes: np.ndarray, logs: np.ndarray):
        super().__init__(zip(words, range(len(words)), strict=True))
        self.classes, self.logs = np.append(classes, 0).astype(np.int32), np.append(logs, 0.0)

    def __missing__(self, word: bytes) -> int:
        return -1

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Class ids of the words and the end, log10(count + 1) where it is known here, and the words that aren't frequent."""
        own = [*tokens(text), END]
        at = np.fromiter(map(self.__getitem__, own), np.int32, len(own))
        ids, rare = self.classes[at], np.flatnonzero(at < 0)
        rest = [own[k] for k in rare.tolist()]
        ids[rare] = [ending(w) for w in rest]
        return ids, self.logs[at], rest


def _add(total: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """total[at] += rows, for indices that repeat."""
    order = np.argsort(at, kind="stable")
    own = at[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    total[own[first]] += np.add.reduceat(rows[order], first, axis=0)


def train(docs: DataFrame, vocab: dict) -> dict[str, np.ndarray]:
    """Parameters from all documents, in ROUNDS parts by a hash of the id; each part starts from the mean of the last."""
    spark = docs.sparkSession
    words = spark.sparkContext.broadcast((vocab["words"], vocab["mass"]))
    params = start(vocab["mass"])
    for k in range(ROUNDS):
        part = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)) == k).select("text")

        def run(batches: Iterator[pd.DataFrame], params=params, k=k) -> Iterator[pd.DataFrame]:
            known, mass = Words(*words.value[0]), words.value[1]
            trainer, held, waiting, used = Trainer(params, mass, SEED + k), [], 0, 0
            for batch in batches:
                for text in batch["text"]:
                    ids = np.concatenate([[0, 0], known(text)[0]])
                    held.append(np.stack([ids[:-2], ids[1:-1], ids[2:]]))
                    used += len(ids) - 2
                    waiting += len(ids) - 2
                    if waiting >= BATCH * 64:
                        rows = np.concatenate(held, axis=1)
                        rows = rows[:, trainer.rng.permutation(rows.shape[1])]
                        for i in range(0, rows.shape[1] - BATCH + 1, BATCH):
                            trainer.step(*rows[:, i : i + BATCH])
                        held = [rows[:, rows.shape[1] // BATCH * BATCH :]]
                        waiting = held[0].shape[1]
            rows = np.concatenate([*held, np.zeros((3, 0), np.int32)], axis=1)
            for i in range(0, rows.shape[1], BATCH):
                trainer.step(*rows[:, i : i + BATCH])
            flat = np.concatenate([trainer.p[n].ravel() for n in PARAMS])
            if used:
                yield pd.DataFrame({"used": [float(used)], "flat": [flat.astype(np.float32).tobytes()]})

        got = _mean(part.mapInPandas(run, "used double, flat binary"))
        total = sum(r["used"] for r in got)
        if total:
            flat = sum(r["used"] / total * np.frombuffer(r["flat"], np.float32) for r in got)
            at = 0
            for n in PARAMS:
                size = params[n].size
                params[n] = flat[at : at + size].reshape(params[n].shape).astype(np.float32)
                at += size
    return params


def _mean(learnt: DataFrame, width: int = 32) -> list:
    """Weighted means within at most ``width`` groups, taken in the tasks one parameter set at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used, total = 0.0, None
        for batch in batches:
            for n, flat in zip(batch["used"], batch["flat"], strict=True):
                part = n * np.frombuffer(flat, np.float32).astype(np.float64)
                used, total = used + n, part if total is None else total + part
        if used:
            yield pd.DataFrame({"used": [used], "flat": [(total / used).astype(np.float32).tobytes()]})

    return learnt.repartition(width).mapInPandas(run, learnt.schema).collect()


class Scorer:
    """Normalised class log-probabilities (base 10). The log of a context's sum is computed once per task."""

    def __init__(self, params: dict[str, np.ndarray], own: int):
        self.p = params
        self.bias = params["b"].copy()
        self.bias[own:OWN] = -np.inf  # classes without a word
        self.log_z = np.full(CLASSES * CLASSES, np.nan, np.float32)
        self.h1, self.h2 = params["R"] @ params["C"][0], params["R"] @ params["C"][1]

    def __call__(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """ids: documents one after the other, each ending with 0, so the end is what stands before a document too.
        starts: where each begins."""
        c1 = np.concatenate([[0], ids[:-1]])
        c2 = np.concatenate([[0, 0], ids[:-2]])[: len(ids)]
        c2[starts] = 0
        follow = starts + 1
        follow = follow[follow < len(ids)]
        c2[follow[~np.isin(follow, starts)]] = 0
        at = c2.astype(np.int64) * CLASSES + c1
        new = np.unique(at[np.isnan(self.log_z[at])])
        for i in range(0, len(new), 8192):
            k = new[i : i + 8192]
            s = (self.h1[k % CLASSES] + self.h2[k // CLASSES]) @ self.p["Q"].T + self.bias
            top = s.max(axis=1)
            self.log_z[k] = top + np.log(np.exp(s - top[:, None]).sum(axis=1))
        out = np.empty(len(ids), np.float64)
        for i in range(0, len(ids), 1 << 18):
            k = slice(i, i + (1 << 18))
            out[k] = np.einsum("ij,ij->i", self.h1[c1[k]] + self.h2[c2[k]], self.p["Q"][ids[k]]) + self.bias[ids[k]] - self.log_z[at[k]]
        return out / math.log(10)


PARTS = "row long, doc_id long, held_out boolean, token binary, n long, n_tokens long, n_known long, log_c double, lm double"


def score(docs: DataFrame, counts: DataFrame, vocab: dict | None, params: dict | None) -> DataFrame:
    """docs (doc_id, held_out, text) to doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    if vocab is None:
        n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long") + 1
        zero = F.lit(0.0)
        return docs.select("doc_id", "held_out", n.alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), F.lit(0).cast("long").alias("train_tokens"), zero.alias("base_score"), zero.alias("score"))
    sent = spark.sparkContext.broadcast((vocab["words"], vocab["within"], vocab["own"], params))
    names = ["row", "doc_id", "held_out", "token", "n", "n_tokens", "n_known", "log_c", "lm"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, within, own, params = sent.value
        known, scorer = Words(*words), Scorer(params, own)
        for batch in batches:
            rows = zip(batch["row"], batch["doc_id"].astype("Int64"), batch["held_out"], batch["text"], strict=True)
            for part in sized_batches(((r, len(r[3] or "")) for r in rows), BATCH_CHARS):
                ids, logs, rests = zip(*[known(text) for *_, text in part], strict=True)
                sizes = np.array([len(x) for x in ids])
                starts = np.cumsum(sizes) - sizes
                every, log_c = np.concatenate(ids), np.concatenate(logs)
                logp = scorer(every, starts)
                shared = every >= OWN
                logp[shared] += log_c[shared] - within[every[shared] - OWN]
                n_rest = [len(r) for r in rests]
                yield pd.DataFrame({
                    "row": [r[0] for r in part], "doc_id": pd.array([r[1] for r in part], "Int64"), "held_out": [r[2] for r in part],
                    "token": [b" %d" % r[0] for r in part], "n": 0, "n_tokens": sizes, "n_known": sizes - n_rest,
                    "log_c": np.add.reduceat(log_c, starts), "lm": np.add.reduceat(logp, starts),
                })
                rare = [(r[0], w, n) for r, rest in zip(part, rests, strict=True) for w, n in Counter(rest).items()]
                if rare:
                    out = pd.DataFrame(rare, columns=["row", "token", "n"])
                    yield out.assign(doc_id=pd.array([None] * len(out), "Int64"), held_out=None, n_tokens=0, n_known=0, log_c=0.0, lm=0.0)[names]

    # A document's own row has a token with a space, which no word has: it finds no count and lands anywhere.
    parts = docs.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "held_out", "text").mapInPandas(run, PARTS)
    joined = parts.join(counts.hint("merge"), "token", "left")
    rare = F.coalesce(F.col("n") * F.log10(F.col("c") + 1), F.lit(0.0))
    known = F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)
    sums = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("n_known") + known).alias("n_known"),
        F.sum(F.col("log_c") + rare).alias("log_c"), F.sum(F.col("lm") + rare).alias("lm"),
    )
    whole = math.log10(vocab["n"] + vocab["v"] + 1)
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(vocab["n"]).cast("long").alias("train_tokens"), (F.col("log_c") - F.col("n_tokens") * whole).alias("base_score"), F.col("lm").alias("score"))


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (fold(F.col("doc_id"), 7) == 2).alias("held_out"), "text")
    learn = docs.filter(~F.col("held_out"))
    counts = materialize(count_words(learn), "lm-counts")
    vocab = vocabulary(counts)
    return score(docs, counts, vocab, train(learn, vocab) if vocab else None)


QUERIES = {"op4_lm": op4_lm}
SQL: dict[str, str] = {}
