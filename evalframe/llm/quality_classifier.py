"""Quality classifier: hashed word n-gram logistic regression with FTRL-proximal updates (operator 7).

Tokens are runs of letters and digits and runs of other marks; features are hashed
token uni- and bigrams with their share of the text as value. A bounded, hash-chosen sample
of the labelled rows is dealt to shards of about SHARD_ROWS; each runs follow-the-regularised-
leader over its rows in a Spark task, and the shards' weights are averaged. A score is a
sparse dot product with the averaged weights, whose size the parameters fix.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch, texts_of

DIMENSIONS = 1 << 18
#: About so many labelled rows are learned from (all, if there are fewer).
TRAIN_ROWS = 24_000
SHARD_ROWS = 3_000
EPOCHS = 2
THRESHOLD = 0.3
SCALE = 32.0
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.05, 1.0
_TOKEN = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[^\x00-\x20A-Za-z0-9\x80-\xff]+")
_SAME = 0x51ED270B


def feature_indices(text: str, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Hashed uni- and bigrams of a text, repeats included; all bigrams of one token with itself are one feature."""
    tokens = _TOKEN.findall(text.encode("utf-8", "surrogatepass"))
    h = np.fromiter(map(zlib.crc32, tokens), np.uint64, len(tokens))
    if not len(h):
        return np.zeros(0, np.int64)
    a, b = h[:-1], h[1:]
    two = np.where(a == b, np.uint64(_SAME), a * np.uint64(0x9E3779B97F4A7C15) ^ b * np.uint64(0xC2B2AE3D27D4EB4F))
    all_ = np.concatenate([h, two]) * np.uint64(0xD6E8FEB86659FD93)
    return (all_ >> np.uint64(40)).astype(np.int64) % dimensions


def sparse(text: str, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    at = feature_indices(text, dimensions)
    index, count = np.unique(at, return_counts=True)
    return index, count * (SCALE / max(1, len(at)))


class FTRL:
    """Per-coordinate FTRL-proximal for logistic loss; index ``dimensions`` is the bias."""

    def __init__(self, dimensions: int = DIMENSIONS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(dimensions + 1), np.zeros(dimensions + 1)
        self.alpha, self.beta, self.l1, self.l2, self.dimensions = alpha, beta, l1, l2, dimensions

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def update(self, index: np.ndarray, value: np.ndarray, y: int) -> None:
        index, value = np.append(index, self.dimensions), np.append(value, 1.0)
        w = self.weights(index)
        g = (sigmoid(w @ value) - y) * value
        n = self.n[index]
        self.z[index] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[index] = n + g * g


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def train(docs: DataFrame, labels: DataFrame, training: Column, rows: int = TRAIN_ROWS, shard_rows: int = SHARD_ROWS, epochs: int = EPOCHS) -> np.ndarray:
    """Averaged weights (bias last) from about ``rows`` labelled rows of those where ``training`` holds.

    The sample is chosen by a hash of doc_id, on both tables before they are joined, so only its texts
    are shuffled. Labels repeated for an id are averaged; null ids and null labels are left out.
    """
    part = 1 << 20
    pick = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(part))
    labelled = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & training).select("doc_id", "quality")
    n = labelled.count()
    share = min(part, int(part * rows / max(1, n)) + 1)
    shards = max(1, math.ceil(min(n, rows) / shard_rows))
    known = labelled.filter(pick < share).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    sample = docs.filter(training & (pick < share)).select("doc_id", "text").join(known, "doc_id")
    dims = DIMENSIONS

    def learn(g: pd.DataFrame) -> pd.DataFrame:
        model = FTRL(dims)
        data = [(*sparse(t or "", dims), int(y)) for t, y in zip(g.text, g.y, strict=True)]
        for e in range(epochs):
            for i in np.random.default_rng(e).permutation(len(data)):
                model.update(*data[i])
        return pd.DataFrame({"n": [len(g)], "w": [model.weights().astype("<f4").tobytes()]})

    got = sample.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(shards))).groupBy("shard").applyInPandas(learn, "n long, w binary").collect()
    if not got:
        return np.zeros(dims + 1, np.float32)
    n = np.array([r.n for r in got], float)
    return (np.stack([np.frombuffer(r.w, "<f4") for r in got]) * (n / n.sum())[:, None]).sum(0).astype(np.float32)


def score_texts(texts: list[str], w: np.ndarray) -> np.ndarray:
    dims = len(w) - 1
    out = np.empty(len(texts))
    for i, t in enumerate(texts):
        at = feature_indices(t, dims)
        out[i] = w[-1] + (float(w[at].sum(dtype=np.float64)) * SCALE / len(at) if len(at) else 0.0)
    return sigmoid(out)


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``; held-out rows' labels are not learned.

    Null and empty texts score by the bias alone; without labelled rows every score is 0.5. Null ids
    are kept; repeated rows score alike; an empty table gives no rows; other columns are not read.
    """
    w = train(docs, labels, ~held_out)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def make():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            p = score_texts(texts_of(b), w)
            return batch(schema, b.column(0), b.column(1), p, (p >= threshold).astype(np.int32))
        return step
    return arrow_map(docs.select("doc_id", held_out.alias("held_out"), "text"), make, "doc_id long, held_out boolean, score double, predicted int")


def keep_documents(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = THRESHOLD, learn_from: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` predicted as good, with all their columns; learned from ``learn_from`` (doc_id, text) or from ``docs``."""
    w = train(docs if learn_from is None else learn_from, labels, ~held_out)

    def make():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            return b.filter(pa.array(score_texts(texts_of(b), w) >= threshold))
        return step
    return arrow_map(docs, make, docs.schema)
