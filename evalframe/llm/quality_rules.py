"""Quality rules with an isolation forest on rule statistics (operator 6).

One pass over the texts computes the rule statistics of each document. Trees split a
random statistic at a random point between the extremes of a small sample until its
rows stand alone; a document that a few random splits isolate is unlike the rest. The
anomaly score is ``2 ** (-mean path length / expected path length)``. Every labelled row's
score enters a histogram by label, from which the threshold is taken: the lowest one
that keeps the asked share of the rows labelled as good.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, batch, bounded, stored, texts_of

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = b"#*$%&|<>"
TREES = 160
SAMPLE_PER_TREE = 128
KEEP_GOOD = 0.999
BINS = 4096

#: Statistics the trees split on, each a share or a mean, so that documents of any length compare. Repeats
#: and short texts are left to the base rule: as splits they isolate good documents of rare kinds.
FEATURES = ("symbol_share", "letterless_share", "distinct_share", "word_length")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_BARE = b".,;:!?'\"()#*$%&|<>-"
_MULT = np.array([random.Random(5).getrandbits(64) | 1 for _ in range(WINDOW)], np.uint64)


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of eight words that are found twice or more in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    w = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        w += (h[j:j + n] ^ (h[j:j + n] >> np.uint64(29))) * _MULT[j]
    s = np.sort(w)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    # Equal hashes are only candidates: the words decide.
    at = np.flatnonzero(np.isin(w, twice))
    seen: dict[tuple, int] = {}
    keys = [tuple(words[i:i + WINDOW]) for i in at.tolist()]
    for k in keys:
        seen[k] = seen.get(k, 0) + 1
    step = np.zeros(len(words) + 1, np.int64)
    for i, k in zip(at.tolist(), keys, strict=True):
        if seen[k] > 1:
            step[i] += 1
            step[i + WINDOW] -= 1
    return int((np.cumsum(step) > 0).sum())


def statistics(text: str) -> tuple:
    """COUNTS, then FEATURES, of one text."""
    b = text.encode("utf-8", "surrogatepass")
    words = b.split()
    n = len(words)
    chars = len(text) - (len(b) - len(b.translate(None, b" \t\n\r\x0b\x0c")))
    symbols = len(b) - len(b.translate(None, SYMBOLS))
    seen, dup = set(), 0
    for line in b.split(b"\n"):
        if line and not line.isspace():
            dup += line in seen
            seen.add(line)
    repeat = repeated_words(words)
    bare = sum(1 for w in words if not w.isalpha() and not w.translate(None, _BARE))
    return (n, chars, symbols, dup, repeat,
            symbols / max(1, n), bare / max(1, n), math.log(max(1, len(set(words)))) / math.log(max(2, n)) if n else 1.0, math.log(max(1.0, chars / max(1, n))))


STATS_DDL = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{c} double" for c in FEATURES)
STATS = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), *((c, pa.float64()) for c in FEATURES)])


def rule_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, COUNTS and FEATURES of every row; null text counts as a text without words."""
    def make():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            return batch(STATS, b.column(0), *zip(*map(statistics, texts_of(b)), strict=True))
        return step
    return arrow_map(docs.select("doc_id", "text"), make, STATS_DDL)


def base_failed(n_words, n_repeat_words):
    """The base rule, of numbers, arrays or columns alike."""
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


class IsolationForest:
    """Trees as flat arrays: feature (-1 at a leaf), split, left child (right is next to it), path length at the leaf."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, sample: int = SAMPLE_PER_TREE, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.sample = max(2, min(sample, len(rows)))
        self.height = math.ceil(math.log2(self.sample))
        feature, split, child, path, roots = [], [], [], [], []

        def node() -> int:
            for a, x in ((feature, -1), (split, 0.0), (child, 0), (path, 0.0)):
                a.append(x)
            return len(feature) - 1

        for _ in range(trees if len(rows) else 0):
            roots.append(node())
            # Rows come in random order: where there are enough of them, each tree has its own.
            tree = len(roots) - 1
            drawn = slice(tree * self.sample, (tree + 1) * self.sample) if len(rows) >= trees * self.sample else rng.choice(len(rows), min(self.sample, len(rows)), replace=False)
            todo = [(roots[-1], rows[drawn], 0)]
            while todo:
                at, own, depth = todo.pop()
                low, high = own.min(0), own.max(0)
                open_ = np.flatnonzero(high > low)
                if depth >= self.height or len(own) < 2 or not len(open_):
                    path[at] = depth + self.expected(len(own))
                    continue
                f = int(rng.choice(open_))
                x = float(rng.uniform(low[f], high[f]))
                left = own[:, f] <= x
                a, b = node(), node()
                feature[at], split[at], child[at] = f, x, a
                todo += [(a, own[left], depth + 1), (b, own[~left], depth + 1)]
        self.feature, self.split = np.array(feature, np.int16), np.array(split)
        self.child, self.path, self.roots = np.array(child, np.int32), np.array(path), np.array(roots, np.int32)

    @staticmethod
    def expected(n: int) -> float:
        """Mean path length of an unsuccessful search in a binary tree of n rows."""
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1) of each row; 0.5 for all where nothing was fitted."""
        if not len(self.roots) or not len(rows):
            return np.full(len(rows), 0.5)
        out = np.empty(len(rows))
        for i in range(0, len(rows), 2048):
            x = rows[i:i + 2048]
            at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
            r = np.arange(len(x))[:, None]
            for _ in range(self.height):
                f = self.feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                at = np.where(inner, self.child[at] + (x[r, np.maximum(f, 0)] > self.split[at]), at)
            out[i:i + 2048] = self.path[at].mean(1)
        return np.exp2(-out / max(1e-9, self.expected(self.sample)))


def fit(stats: DataFrame, labels: DataFrame, keep_good: float = KEEP_GOOD) -> tuple[IsolationForest, float]:
    """Forest and threshold from the statistics of all documents and the labelled rows (doc_id, quality).

    The forest's draws, SAMPLE_PER_TREE rows for each of TREES trees, come from the distinct statistics
    of all rows, by their hash; copies count once. The threshold comes from all labelled rows that pass
    the base rule; without any, nothing is rejected.
    """
    features = [F.col(c) for c in FEATURES]
    ok = stats.filter(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    distinct, draws, part = ok.select(*features).distinct(), TREES * SAMPLE_PER_TREE, 1 << 30
    # About twice as many rows as are drawn are sorted, whatever their number.
    share = min(part, int(2 * part * draws / max(1, distinct.count())) + 1000)
    rows = distinct.filter(F.pmod(F.xxhash64(*features, F.lit(5)), F.lit(part)) < share).orderBy(F.xxhash64(*features), *features).limit(draws).toPandas()
    forest = IsolationForest(rows.to_numpy("float64"))
    labelled = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("good"))
    scored = ok.select("doc_id", *features).join(labelled, "doc_id").select("good", *features)

    def bins(batches):
        got = np.zeros((2, BINS), np.int64)
        for b in batches:
            for part in bounded(b):
                x = np.column_stack([part.column(i + 1).to_numpy() for i in range(len(FEATURES))])
                at = np.minimum((forest.score(x) * BINS).astype(int), BINS - 1)
                np.add.at(got, (np.array(part.column(0).to_pylist(), int), at), 1)
        good, at = np.nonzero(got)
        yield pa.RecordBatch.from_arrays([pa.array(good == 1), pa.array(at, pa.int32()), pa.array(got[good, at])], ["good", "bin", "n"])

    counts = scored.mapInArrow(bins, "good boolean, bin int, n long").groupBy("good", "bin").agg(F.sum("n").alias("n")).toPandas()
    good = counts[counts.good].sort_values("bin")
    if not len(good):
        return forest, math.inf
    # The lowest bin edge with the asked share of good rows below it.
    cum = good.n.cumsum().to_numpy() / good.n.sum()
    return forest, float(good.bin.to_numpy()[np.searchsorted(cum, min(keep_good, cum[-1]))] + 1) / BINS


def judge(docs: DataFrame, labels: DataFrame, keep_good: float = KEEP_GOOD) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept and score of every row of ``docs``.

    Null and empty texts have no words and so fail the base rule. Null ids are kept and judged but
    never labelled; repeated rows are judged alike; labels repeated for an id are averaged; an empty
    table gives no rows. Other columns of either table are not read.
    """
    stats = stored(rule_statistics(docs), "rule-statistics")
    forest, threshold = fit(stats, labels, keep_good)
    schema = pa.schema([*list(STATS)[:1 + len(COUNTS)], ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("score", pa.float64())])

    def make():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            failed, score = verdict(b, forest)
            return batch(schema, *b.columns[:1 + len(COUNTS)], failed, ~failed & (score < threshold), score)
        return step
    return arrow_map(stats, make, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, score double")


def verdict(b: pa.RecordBatch, forest: IsolationForest) -> tuple[np.ndarray, np.ndarray]:
    """Base verdict and anomaly score of a batch of statistics."""
    col = lambda c: b.column(b.schema.names.index(c)).to_numpy()
    return base_failed(col("n_words"), col("n_repeat_words")), forest.score(np.column_stack([col(c) for c in FEATURES]))


def keep_documents(docs: DataFrame, labels: DataFrame, keep_good: float = KEEP_GOOD) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns.

    The documents are stored once with their statistics, so each text is read once; the verdict takes the
    statistics alone to Python.
    """
    named = {c: f"__{c}" for c in (*COUNTS, *FEATURES)}
    while set(named.values()) & set(docs.columns):
        named = {c: f"_{n}" for c, n in named.items()}

    def make():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            own = zip(*map(statistics, texts_of(b)), strict=True)
            columns = [*b.columns, *(pa.array(x, f.type) for x, f in zip(own, list(STATS)[1:], strict=True))]
            return pa.RecordBatch.from_arrays(columns, [*b.schema.names, *named.values()])
        return step
    fields = [T.StructField(named[f.name], T.LongType() if f.name in COUNTS else T.DoubleType()) for f in list(STATS)[1:]]
    both = stored(arrow_map(docs, make, T.StructType([*docs.schema.fields, *fields])), "rule-documents")
    forest, threshold = fit(both.select("doc_id", *(F.col(n).alias(c) for c, n in named.items())), labels, keep_good)

    @F.pandas_udf("boolean")
    def passes(n_words: pd.Series, n_repeat: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        x = np.column_stack([v.to_numpy("float64") for v in (a, b, c, d)])
        return pd.Series(~base_failed(n_words.to_numpy(), n_repeat.to_numpy()) & (forest.score(x) < threshold))
    return both.filter(passes(*(F.col(named[c]) for c in ("n_words", "n_repeat_words", *FEATURES)))).select(*docs.columns)
