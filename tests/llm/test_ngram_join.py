"""N-gram Jaccard join against all pairs by brute force: chains, bridges, thresholds, short and long texts, split shards, bounds of the trees."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evalframe.llm import ngram_join as nj

SCHEMA = "doc_id long, text string, lang string, sid long, label long, n long, digest binary"


def shingles(text, size=4):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1)))


def plain(rows, need=85):
    """doc_id, set size and component by all pairs."""
    sets = [shingles(t) for _, t in rows]
    part = list(range(len(rows)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= need * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                part[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def corpus(seed=3, families=14):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    shared = " ".join(rng.choice(vocab) for _ in range(60))
    rows = []
    for f in range(families):
        base = [rng.choice(vocab) for _ in range(rng.choice([6, 9, 30, 60, 120, 300, 700]))]
        for _ in range(rng.choice([1, 2, 5, 9])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, len(w) // 80, len(w) // 40])):
                at = rng.randrange(len(w))
                w[at:at + 1] = rng.choice([[], ["new" + str(rng.randrange(10**6))], [w[at], "more"]])
            rows.append(" ".join(w) + (" " + shared if f % 3 == 0 else ""))
    # A chain: each links with the next, the ends do not.
    chain = [f"c{i}" for i in range(140)]
    rows += [" ".join(chain[i:i + 100]) for i in range(0, 41, 5)]
    rows += ["One two", "one TWO", "one two three", "a b c d", "a b c d e", "", None, " \n\t ", "", "x", "X", "É é", "é é", "w1 w2 w3 w4 " * 500, rows[0], rows[0].upper()]
    return list(enumerate(rows)) + [(None, rows[1]), (None, "null alone here now"), (None, None), (3, rows[3]), (3, rows[3])]


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def make(spark, rows):
    return spark.createDataFrame([(d, t, "en", 1, 2, 3, b"z") for d, t in rows], SCHEMA)


@pytest.mark.parametrize(("tree_rows", "rounds"), [(nj.TREE_ROWS, nj.ROUNDS), (3, ()), (2, ((1, 4, 1),))])
def test_equals_all_pairs(spark, tree_rows, rounds):
    rows = corpus()
    assert result(nj.join(make(spark, rows).repartition(3), tree_rows=tree_rows, rounds=rounds)) == plain(rows)


def test_a_large_family_is_one_component(spark):
    """Near copies that do not all link with each other, in shards that are split; and others that share most of their shingles."""
    rng = random.Random(8)
    base = [f"v{rng.randrange(500)}" for _ in range(90)]
    rows = []
    for i in range(150):
        w = list(base)
        for at in rng.sample(range(90), 2):
            w[at] = f"edit{i}x{at}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(base[:60] + [f"own{i}y{k}" for k in range(30)])) for i in range(20)]
    assert result(nj.join(make(spark, rows), tree_rows=16, rounds=((1, 8, 1),))) == plain(rows)


def test_empty_table(spark):
    df = nj.join(make(spark, [(1, "x")]).limit(0))
    assert df.count() == 0
    assert df.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint")]


def test_threshold_is_exact(spark):
    """17 of 20 shingles link, 33 of 39 do not."""
    words = [f"t{i}" for i in range(60)]
    a, b = words[:23], words[:20]  # 20 and 17 shingles, 17 in common: 17/20
    c, d = words[30:60], words[30:55]  # 27 and 22 shingles, 22 in common: 22/27 < 0.85
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c)), (4, " ".join(d))]
    assert result(nj.join(make(spark, rows))) == [(1, 20, 1), (2, 17, 1), (3, 27, 3), (4, 22, 4)]


@settings(max_examples=120, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2), st.lists(st.integers(0, 6), min_size=4, max_size=4)), max_size=60), st.integers(2, 5))
def test_trees_leave_every_pair_within_the_bound(rows, leaf):
    shard = np.array(sorted(r[0] for r in rows), np.int64)
    rows = sorted(rows, key=lambda r: r[0])
    label = np.array([r[1] if r[1] else 100 + i for i, r in enumerate(rows)], np.int64)
    point = np.array([r[2] for r in rows], np.uint8).reshape(-1, 4)
    n = point.sum(1, dtype=np.int64)
    forest = nj.RForest(shard, label, n, point, leaf)
    got = sorted(tuple(sorted((int(forest.order[i]), int(forest.order[j])))) for x, y, _ in forest.survivors(front=20) for i, j in zip(x, y, strict=True))
    want = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if shard[i] == shard[j] and label[i] != label[j]
            and 100 * max(n[i], n[j]) * 85 <= 100 * 100 * min(n[i], n[j])
            and 185 * int(np.minimum(point[i], point[j]).sum()) >= 85 * int(n[i] + n[j])]
    assert got == sorted(want)


def test_bound_holds_for_sets():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 62, 80).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 62, 8).astype(np.uint64)]))
        for dims in (4, 32, 256):
            assert len(np.intersect1d(a, b)) <= np.minimum(nj.counts_of(a, dims), nj.counts_of(b, dims)).sum()
        assert (nj.counts_of(a, 256).reshape(-1, 32).sum(0) == nj.counts_of(a, 32)).all()


def test_linking_sizes_have_a_band_in_common():
    for n in range(1, 3000):
        for m in {n, n + 1, n * 20 // 17, max(n, n * 100 // 85)}:
            if 100 * n >= 85 * m:
                assert set(nj.bands_of(n)) & set(nj.bands_of(m)), (n, m)


def test_linking_sets_share_a_first_shingle(spark):
    """The order may be any: with a level for each counter at random, no link between shards is lost."""
    rows = corpus(11)
    level = np.random.default_rng(1).integers(0, 90, nj.SKETCH).astype(np.uint8)
    point = nj.points(make(spark, rows), level)
    met = {r.sid: set() for r in point.collect()}
    for r in nj.shards(point).collect():
        met[r.sid].add(r.shard)
    sets = {r.sid: shingles(t) for r in point.collect() for _, t in rows if t and nj.xxhash.xxh3_128_digest(nj.shingle_set(t, nj._WordHash()).tobytes()) == bytes(r.digest)}
    sids = sorted(sets)
    linked = [(a, b) for a in sids for b in sids if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    # Shards of the same documents are searched once, so linked sets still have a shard in common.
    assert linked and all(met[a] & met[b] for a, b in linked)


def test_sets_are_made_where_their_texts_meet(spark, monkeypatch):
    # Texts are dealt, once from each task; the larger sets are not, and each wanted set comes once.
    rows = [(i, ["a b c d e", "a b c d e", "A b c d e", "x y", None, "", "q r s t u v"][i % 7]) for i in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    point = nj.points(docs, nj.scan(docs)[1])
    wanted = point.filter("n <> 1").select("sid", "digest", "text_hash")
    seen = []
    stored = nj.stored
    monkeypatch.setattr(nj, "stored", lambda df, name, *by: seen.append(df) or stored(df, name, *by))
    got = {r.sid: np.array(r.own, np.int64) for r in nj.sets_of(docs, wanted).collect()}
    assert len(got) == nj.sets_of(docs, wanted).count() == wanted.count() == 2
    want = {tuple(nj.shingle_set(t, nj._WordHash()).view(np.int64)) for t in ("a b c d e", "q r s t u v")}
    assert {tuple(x) for x in got.values()} == want
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[:plan.index("MapInArrow")] and "Exchange" in plan


def test_tasks_hold_one_python_worker_and_narrow_sums(spark, monkeypatch):
    frame, plans = type(spark.range(0)), {}
    below, deal = [], ("Repartition", "Sort", "Aggregate", "Join", "Relation")
    mapped, stored = frame.mapInArrow, nj.stored

    def plan(df):
        return df._jdf.queryExecution().analyzed().toString()

    def recorded(self, *a, **b):
        below.append(plan(self))
        return mapped(self, *a, **b)

    def kept(df, name, *by):
        plans.setdefault(name, []).append(plan(df))
        return stored(df, name, *by)
    monkeypatch.setattr(frame, "mapInArrow", recorded)
    monkeypatch.setattr(nj, "stored", kept)
    base = " ".join(f"w{i}" for i in range(200))
    docs = spark.createDataFrame([(1, base), (2, base + " more"), (3, "alone in here now")], "doc_id long, text string")
    assert sorted(map(tuple, nj.join(docs).collect())) == [(1, 197, 1), (2, 198, 1), (3, 1, 3)]
    assert below
    for p in below:  # nothing but a shuffle or a stored table between two Python steps
        lines = p.splitlines()
        first = next((i for i, x in enumerate(lines) if any(d in x for d in deal)), len(lines))
        assert not any("MapInArrow" in x for x in lines[:first])
    assert "decimal" not in "".join(plans["ngram-shards"])
    # `docs` itself has rows from Python, the empty labels do not.
    assert not any("LogicalRDD" in x for name in ("ngram-labels", "ngram-ids") for x in plans[name])
