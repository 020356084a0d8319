"""Language identification: multinomial naive Bayes over hashed character n-grams (operator 9).

Training counts every n-gram of every training text, per task and language in a fixed
number of buckets, and Spark adds the tasks' counts up. The smoothed log-probability
matrix (buckets x languages) has a size that the parameters and the number of languages
fix; it goes to every task, where a text's log-likelihoods are sums of the matrix rows
of its n-grams, in numpy over many texts at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch, bounded, texts_of

SIZES = (1, 2, 3)
BUCKETS = 1 << 16
CHUNK = 1 << 18
UNKNOWN = "und"
_GAP = 0x110000  # beyond every code point: no n-gram reaches over it
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5))


def buckets_of(texts: list[str], sizes=SIZES, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (texts' numbers, starts in the block, bucket of each n-gram; ``buckets`` where none starts).

    A block holds about CHUNK characters: several texts, or a part of one with the overlap its n-grams need.
    """
    over = max(sizes) - 1

    def block(parts: list[tuple[int, np.ndarray, int]]):
        # part: (text, code points, how many n-grams may start there)
        starts = np.cumsum([0] + [len(c) + 1 for _, c, _ in parts])
        codes = np.full(starts[-1] + over, _GAP, np.uint64)
        may = np.zeros(starts[-1], bool)
        for (_, c, n), s in zip(parts, starts, strict=False):
            codes[s:s + len(c)] = c
            may[s:s + n] = True
        for k in sizes:
            h, ok = np.zeros(starts[-1], np.uint64), may.copy()
            for j in range(k):
                c = codes[j:j + starts[-1]]
                h = (h ^ c) * _MIX[j % 4]
                h ^= h >> np.uint64(31)
                ok &= c != _GAP
            yield np.array([i for i, _, _ in parts]), starts[:-1], np.where(ok, (h * _MIX[k % 4] >> np.uint64(40)) % np.uint64(buckets), np.uint64(buckets)).astype(np.int64)

    held, size = [], 0
    for i, t in enumerate(texts):
        c = np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        for s in range(0, max(1, len(c)), CHUNK):
            part = c[s:s + CHUNK + over]
            held.append((i, part, min(CHUNK, len(part))))
            size += len(part)
            if size >= CHUNK:
                yield from block(held)
                held, size = [], 0
    if held:
        yield from block(held)


class Model:
    def __init__(self, langs: list[str], logp: np.ndarray, prior: np.ndarray, sizes=SIZES):
        self.langs, self.prior, self.sizes, self.buckets = langs, prior, sizes, len(logp)
        self.logp = np.vstack([logp, np.zeros((1, logp.shape[1]))])  # last row: no n-gram

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language of each text and its posterior probability; UNKNOWN with 0 where there is no letter or no model."""
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        total = np.tile(self.prior, (len(texts), 1))
        for ids, starts, at in buckets_of(texts, self.sizes, self.buckets):
            np.add.at(total, ids, np.add.reduceat(self.logp[at], starts, axis=0))
        best = total.argmax(1)
        p = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        known = np.array([any(map(str.isalpha, t)) for t in texts], bool)
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, p, 0.0)


def train(docs: DataFrame, training: Column, sizes=SIZES, buckets: int = BUCKETS, alpha: float = 0.5) -> Model:
    """Counts over all rows where ``training`` holds and lang is set; only text and lang are learned from."""
    def count(batches):
        got: dict[str, np.ndarray] = {}
        texts_seen: dict[str, int] = {}
        for b in batches:
            for part in bounded(b):
                langs, texts = part.column(1).to_pylist(), texts_of(part)
                for lang in dict.fromkeys(langs):
                    own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                    texts_seen[lang] = texts_seen.get(lang, 0) + len(own)
                    total = got.setdefault(lang, np.zeros(buckets + 1, np.int64))
                    for _, _, at in buckets_of(own, sizes, buckets):
                        total += np.bincount(at, minlength=buckets + 1)
        for lang, total in got.items():
            at = np.flatnonzero(total[:buckets])
            # bucket -1: the number of texts
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1), pa.int32()),
                                              pa.array(np.append(total[at], texts_seen[lang]), pa.int64())], ["lang", "bucket", "n"])

    rows = docs.filter(training & F.col("lang").isNotNull()).select("text", "lang")
    counts = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts.lang.unique().tolist())
    c = np.zeros((buckets, len(langs)))
    texts = np.zeros(len(langs))
    col = counts.lang.map({x: i for i, x in enumerate(langs)}).to_numpy("int64") if len(langs) else np.zeros(0, int)
    bucket, n = counts.bucket.to_numpy("int64"), counts.n.to_numpy("float64")
    c[bucket[bucket >= 0], col[bucket >= 0]] = n[bucket >= 0]
    texts[col[bucket < 0]] = n[bucket < 0]
    logp = np.log(c + alpha) - np.log(c.sum(0) + alpha * buckets)
    return Model(langs, logp, np.log(texts / texts.sum()) if len(langs) else texts, sizes)


def identify(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; rows where ``held_out`` holds are not learned from.

    ``und`` with score 0 for null texts and texts without a letter, and for all where no row can be
    learned from. Null ids are kept; repeated rows give repeated results; an empty table gives none.
    """
    model = train(docs, ~held_out)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def make():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            return batch(schema, b.column(0), b.column(1), *model.predict(texts_of(b)))
        return step
    return arrow_map(docs.select("doc_id", held_out.alias("held_out"), "text"), make, "doc_id long, held_out boolean, lang_pred string, score double")
