"""Language identification by a byte convolutional network.

Bytes are embedded; filters of several widths slide over windows of WINDOW bytes; each
filter's largest response goes to a softmax layer. The network is trained in numpy, by Adam
on cross-entropy, on all windows of at most SAMPLE labelled texts (the smallest hashes of their
text and id), whole, in at least LEAST_STEPS steps. Prediction covers every byte of a text: its windows' log-probabilities, weighted by
their lengths, are averaged.

A null text or one without a letter is `und` with score 0. Without any labelled text the
model has no language and every text is `und`. Labels that are null are not learned from. Of languages
of equal odds the first by name is taken; an empty table gives no rows; very long texts are read whole.
Repeated rows and extra columns change nothing; columns named lang_pred and score are replaced."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbatch as T

WINDOW = 256
SAMPLE = 3000
EMBED, FILTERS, WIDTHS, EPOCHS, LEAST_STEPS, BATCH, RATE, SEED = 6, 8, (2, 3, 4), 1, 1000, 64, 0.01, 7
CHUNK = 1024
SPAN = max(WIDTHS)


@dataclass
class Model:
    """Response tables of byte pairs (first and second pair of the widest filter), and the output layer."""

    languages: list[str]
    first: np.ndarray
    second: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        """windows: rows of WINDOW + SPAN - 1 bytes, padded by zeros."""
        pair = windows[:, :-1].astype(np.int32) * 256 + windows[:, 1:]
        pooled = np.empty((len(windows), len(self.bias)), np.float32)
        for i in range(0, len(windows), 64):  # a part that stays in the cache
            p = pair[i : i + 64]
            x = self.first[p[:, :WINDOW]]
            x += self.second[p[:, 2 : 2 + WINDOW]]
            pooled[i : i + 64] = x.max(axis=1)
        z = np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias
        z = z - z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of each text: bytes, owner and length. Windows follow one another; each also sees the SPAN - 1 bytes after it."""
    length = np.diff(offsets)
    count = -(-length // WINDOW)
    owner = np.repeat(np.arange(len(length)), count)
    start = offsets[:-1][owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
    ends = offsets[1:][owner]
    at = start[:, None] + np.arange(WINDOW + SPAN - 1)
    inside = at < ends[:, None]
    return np.where(inside, data[np.minimum(at, max(len(data) - 1, 0))], 0).astype(np.uint8), owner, np.minimum(ends - start, WINDOW)


def train(texts: list[str], labels: list[str]) -> Model | None:
    """Fits the network; deterministic for equal rows in equal order."""
    languages = sorted(set(labels))
    if not languages:
        return None
    rng = np.random.Generator(np.random.PCG64(SEED))
    data, offsets = T.utf8(pa.array(texts, pa.large_string()))
    answer = np.array([languages.index(l) for l in labels])
    parts = [(i, *cut(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[:2]) for i, j in T.slices(offsets)]
    x = np.concatenate([p[1] for p in parts])
    y = answer[np.concatenate([p[0] + p[2] for p in parts])]
    m = FILTERS * len(WIDTHS)
    mask = np.zeros((SPAN, EMBED, m), np.float32)
    for k, w in enumerate(WIDTHS):
        mask[:w, :, k * FILTERS : (k + 1) * FILTERS] = 1
    p = {"e": rng.normal(0, 0.5, (256, EMBED)), "w": rng.normal(0, 0.3, (SPAN, EMBED, m)) * mask, "b": np.zeros(m), "o": rng.normal(0, 0.3, (m, len(languages))), "c": np.zeros(len(languages))}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    p["e"][0] = 0
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // max(len(x), 1)))):
        turn = rng.permutation(len(x))
        for i in range(0, len(turn), BATCH):
            xb, yb = x[turn[i : i + BATCH]], y[turn[i : i + BATCH]]
            n, rows = len(xb), np.arange(len(xb))
            e = p["e"][xb]
            cols = np.concatenate([e[:, k : k + WINDOW] for k in range(SPAN)], axis=2)
            a = cols.reshape(n * WINDOW, -1) @ p["w"].reshape(SPAN * EMBED, m)
            a = a.reshape(n, WINDOW, m)
            top = a.argmax(axis=1)
            pool = np.take_along_axis(a, top[:, None, :], axis=1)[:, 0] + p["b"]
            act = np.maximum(pool, 0)
            z = act @ p["o"] + p["c"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            g = z / z.sum(axis=1, keepdims=True)
            g[rows, yb] -= 1
            g /= n
            d = {"o": act.T @ g, "c": g.sum(axis=0)}
            back = (g @ p["o"].T) * (pool > 0)
            d["b"] = back.sum(axis=0)
            seen = cols[rows[:, None], top]  # what each filter saw where it responded most
            d["w"] = np.einsum("nm,nmk->km", back, seen).reshape(SPAN, EMBED, m) * mask
            into = np.einsum("nm,km->nmk", back, p["w"].reshape(-1, m)).reshape(n, m, SPAN, EMBED)
            d["e"] = np.zeros_like(p["e"])
            np.add.at(d["e"], xb[rows[:, None, None], top[:, :, None] + np.arange(SPAN)], into)
            d["e"][0] = 0
            step += 1
            for k in p:
                first[k] = 0.9 * first[k] + 0.1 * d[k]
                second[k] = 0.999 * second[k] + 0.001 * d[k] ** 2
                p[k] = (p[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    part = [p["e"] @ p["w"][k] for k in range(SPAN)]
    table = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, m)
    return Model(languages, table(part[0], part[1]), table(part[2], part[3]), p["b"], p["o"], p["c"])


def fit(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE) -> Model | None:
    """Trains on at most `sample` of the rows where `learn` holds and text and language are not null."""
    labelled = docs.where(learn & F.col(text).isNotNull() & F.col(lang).isNotNull())
    # a hashed share of the rows of about four samples, so that tasks send few rows, and of these the smallest hashes
    share = min(1.0, 4 * sample / max(labelled.count(), 1))
    key = F.xxhash64(F.col(doc_id).cast("string"), text)
    labelled = labelled.where((F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(share * (1 << 30))) & F.col(text).rlike(r"\p{L}"))
    # their hashes first, so that the driver is sent the texts of the sample and no others
    keys = [r.k for r in labelled.select(key.alias("k")).orderBy("k").limit(sample).collect()]
    few = labelled.where(key <= (keys[-1] if keys else 0)).select(key.alias("k"), F.col(text).cast("string").alias("t"), F.col(lang).alias("l")).orderBy("k", "t", "l").limit(sample)
    rows = sorted((r.k, r.t, r.l) for r in few.collect())
    model = train([r[1] for r in rows], [r[2] for r in rows])
    del rows
    T.release()  # the driver's Python lives on
    return model


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows with lang_pred and score; columns of those names are replaced."""
    docs = docs.drop("lang_pred", "score")
    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return docs.withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # a fixed size: two tables of 65,536 rows

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        net = shared.value
        for column in batches:
            data, offsets = T.utf8(column)
            total = np.zeros((len(column), len(net.languages)))
            weight = np.zeros(len(column))
            for i, j in T.slices(offsets):
                x, owner, length = cut(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for k in range(0, len(x), CHUNK):
                    o = owner[k : k + CHUNK] + i
                    np.add.at(total, o, net.log_probabilities(x[k : k + CHUNK]) * length[k : k + CHUNK, None])
                    np.add.at(weight, o, length[k : k + CHUNK])
            mean = total / np.maximum(weight, 1)[:, None]
            best = mean.argmax(axis=1)
            odds = np.exp(mean - mean.max(axis=1, keepdims=True))
            score = 1 / odds.sum(axis=1)
            yield pa.StructArray.from_arrays([pa.array(np.array(net.languages, dtype=object)[best], pa.string()), pa.array(np.where(weight > 0, score, 0.0), pa.float64())], names=["lang_pred", "score"])
        T.release()

    judge = F.arrow_udf(run, "struct<lang_pred:string,score:double>")
    # the caller's columns are one column, so that none clashes
    out = docs.select(F.struct(*docs.columns).alias("row"), letter.alias("letter"), judge(F.when(letter, F.col(text))).alias("judged"))
    return out.select("row.*", F.when(F.col("letter"), F.col("judged.lang_pred")).otherwise("und").alias("lang_pred"), F.when(F.col("letter"), F.col("judged.score")).otherwise(0.0).alias("score"))
