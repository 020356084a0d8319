"""Learned operators against plain versions: tree walks and draws of the isolation forest, FTRL and dot products, PMI ratios."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("tokenizers")
from pyspark.sql import functions as F  # noqa: E402

from evalframe.llm import pii, quality_classifier, quality_rules  # noqa: E402


def walk(forest, root, x):
    """Path length of one row in one tree, node by node."""
    at, depth = root, 0
    while forest.feature[at] >= 0:
        at = forest.child[at] + (1 if x[forest.feature[at]] > forest.split[at] else 0)
        depth += 1
    return depth, forest.path[at]


def test_forest_scores_are_mean_path_lengths():
    rng = np.random.default_rng(4)
    rows = np.unique(rng.normal(size=(700, 3)).round(1), axis=0)
    rng.shuffle(rows)
    forest = quality_rules.IsolationForest(rows, trees=20, sample=32)
    def harmonic(n):
        return math.log(n) + 0.5772156649015329

    def expected(n):
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * harmonic(n - 1) - 2 * (n - 1) / n
    for x, got in zip(rows[:50], forest.score(rows[:50]), strict=True):
        paths = []
        for i, root in enumerate(forest.roots):
            depth, path = walk(forest, root, x)
            own = rows[i * 32:(i + 1) * 32]  # a tree's own rows: those that end in the same leaf
            leaf = [r for r in own if all(a == b for a, b in zip(trail(forest, root, r), trail(forest, root, x), strict=False)) and len(trail(forest, root, r)) == len(trail(forest, root, x))]
            assert abs(path - (depth + expected(len(leaf)))) < 1e-9
            paths.append(path)
        assert abs(got - 2 ** (-(sum(paths) / len(paths)) / expected(32))) < 1e-9


def trail(forest, root, x):
    at, out = root, []
    while forest.feature[at] >= 0:
        right = bool(x[forest.feature[at]] > forest.split[at])
        out.append(right)
        at = forest.child[at] + right
    return out


def test_threshold_keeps_the_asked_share_of_good_rows(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(rng.randrange(25, 200)))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id long, quality int")
    for share in (0.5, 0.9, 1.0):
        got = {r.doc_id: r for r in quality_rules.judge(docs, labels, share).collect()}
        good = [got[i] for i in range(300) if i % 3 and not got[i].base_failed]
        assert share <= sum(r.kept for r in good) / len(good) <= share + 0.05
        kept = {r.doc_id for r in quality_rules.keep_documents(docs.withColumn("__n_words", F.lit("clash")), labels, share).collect()}
        assert kept == {i for i, r in got.items() if r.kept}


def plain_ftrl(data, epochs, alpha, beta, l1, l2):
    z, n = defaultdict(float), defaultdict(float)

    def weight(k):
        return 0.0 if abs(z[k]) <= l1 else -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)
    for e in range(epochs):
        for i in np.random.default_rng(e).permutation(len(data)):
            x, y = data[i]
            x = {**x, "bias": 1.0}
            w = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items())))
            for k, v in x.items():
                g = (p - y) * v
                sigma = (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / alpha
                z[k] += g - sigma * w[k]
                n[k] += g * g
    return {k: weight(k) for k in z}


def test_ftrl_and_scores_equal_plain_versions():
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["good", "bad", "x", "y,", "é", "z z"]) for _ in range(rng.randrange(0, 12))) for _ in range(60)]
    y = [int("good" in t) for t in texts]
    model = quality_classifier.FTRL(512)
    data = [quality_classifier.sparse(t, 512) for t in texts]
    for e in range(2):
        for i in np.random.default_rng(e).permutation(len(data)):
            model.update(*data[i], y[i])
    want = plain_ftrl([(dict(zip(ix.tolist(), v.tolist(), strict=True)), t) for (ix, v), t in zip(data, y, strict=True)], 2, quality_classifier.ALPHA, quality_classifier.BETA, quality_classifier.L1, quality_classifier.L2)
    w = model.weights()
    assert abs(w[512] - want["bias"]) < 1e-9 and all(abs(w[k] - want.get(k, 0.0)) < 1e-9 for k in range(512))
    got = quality_classifier.score_texts(texts, w)
    for t, s in zip(texts, got, strict=True):
        at = quality_classifier.feature_indices(t, 512)
        share = Counter(at.tolist())
        dot = sum(want.get(k, 0.0) * c * quality_classifier.SCALE / len(at) for k, c in share.items()) + want["bias"]
        assert abs(s - 1 / (1 + math.exp(-dot))) < 1e-9


def test_ratios_equal_plain_counts(spark):
    """PMI(e; t) / IC(e) and the chance bound of every pair of an entity and a term, by sets."""
    rng = random.Random(6)
    rows = []
    for i in range(300):
        words = [f"w{rng.randrange(30)}q" for _ in range(12)]
        if i < 24:
            words += [f"m{i % 4}@mail.example", f"Code{i % 4}"]
        rows.append((i, " ".join(words)))
    rows += rows[:5]  # copies
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.detect(docs).cache()
    got = {r.h: r.ratio for r in pii.disclosing_terms(docs, found).collect()}
    total, names = len(rows), {}
    df, dt = Counter(), Counter()
    for text, n in Counter(t for _, t in rows).items():
        for w in set(text.lower().replace("@", " ").replace(".", " ").split()):
            df[w] += n
            dt[w] += 1
    near, de, et = Counter(), Counter(), Counter()
    bt = Counter()
    for text, n in Counter(t for _, t in rows).items():
        e = next((w for w in text.split() if "@" in w), None)
        if e:
            de[e] += n
            et[e] += 1
            for w in {w.lower() for w in text.split() if "@" not in w}:
                near[e, w] += n
                bt[e, w] += 1
    hashes = {r.w: r.h for r in spark.createDataFrame([(w,) for w in df], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    for (e, w), both in near.items():
        ratio = math.log2(both * total / (de[e] * df[w])) / math.log2(total / de[e])
        names.setdefault(w, []).append(ratio)
    assert {w for w in hashes if hashes[w] in got} == {f"code{i}" for i in range(4)}
    for i in range(4):
        assert abs(got[hashes[f"code{i}"]] - max(names[f"code{i}"])) < 1e-9
