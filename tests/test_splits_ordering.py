"""Properties of splits and of the skew-aware ordering helpers (against brute force)."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from evalframe.operators import ordering, splits


def test_global_row_number_matches_sort(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, id int").repartition(7)
    got = {(r.k, r.id): r.rn for r in ordering.global_row_number(df, ["k", "id"]).collect()}
    want = {key: i + 1 for i, key in enumerate(sorted(rows))}
    assert got == want


def test_split_fraction_exact_disjoint(spark):
    df = spark.range(0, 1003).withColumnRenamed("id", "claim_id")
    s = splits.split_fraction(df, "claim_id", 0.8, seed=1)
    counts = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert counts == {"train": int(1003 * 0.8), "val": 1003 - int(1003 * 0.8)}
    assert s.select("claim_id").distinct().count() == 1003
    # invariant under input partitioning
    s2 = splits.split_fraction(df.repartition(3), "claim_id", 0.8, seed=1)
    a = {(r.claim_id, r.split) for r in s.collect()}
    b = {(r.claim_id, r.split) for r in s2.collect()}
    assert a == b


def test_split_fixed_sizes(spark):
    df = spark.range(0, 130).withColumnRenamed("id", "task")
    s = splits.split_fixed(df, "task", (50, 50), seed=5)
    counts = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert counts == {"train": 50, "val": 50, "test": 30}


def test_sample_is_the_head_of_the_shuffle(spark):
    import hashlib
    df = spark.range(0, 500).withColumnRenamed("id", "x")
    order = sorted(range(500), key=lambda i: hashlib.md5(f"9|{i}".encode()).hexdigest())
    for n in (0, 40, 500, 600):
        got = sorted((r.sample_rank, r.x) for r in splits.sample_n(df, "x", n, seed=9).collect())
        assert got == [(k + 1, i) for k, i in enumerate(order[:n])]
    with_null = spark.createDataFrame([(1,), (None,), (2,)], "x long")
    assert splits.split_fraction(with_null, "x", 0.5).count() == 3


def test_head_pct_with_other_columns(spark):
    df = spark.range(1, 201).select((F.col("id") * 3).alias("k"), (F.col("id") % 7).alias("v"))
    got = splits.head_pct(df, "k", 10).orderBy("k").collect()
    assert [(r.k, r.v, r.position) for r in got] == [(3 * i, i % 7, i) for i in range(1, 21)]


def test_head_pct_and_batches(spark):
    df = spark.range(1, 11).withColumnRenamed("id", "k")
    assert [r.k for r in splits.head_pct(df, "k", 25).orderBy("k").collect()] == [1, 2]
    assert splits.head_pct(df, "k", 1).count() == 1
    b = splits.batch_ranges(df, 4).orderBy("batch").collect()
    assert [(r.start, r.end, r.n) for r in b] == [(1, 4, 4), (5, 8, 4), (9, 10, 2)]


def test_minibatches_cover_epochs(spark):
    df = spark.range(0, 12).withColumnRenamed("id", "i")
    mb = splits.minibatches(df, "i", size=5, iters=7, seed=3).collect()
    per_iter = {}
    for r in mb:
        per_iter.setdefault(r.iteration, []).append(r.i)
    assert sorted(per_iter) == list(range(7))
    # 3 batches per epoch (5, 5, 2); the epoch's batches partition the rows
    assert sorted(len(v) for k, v in per_iter.items() if k < 3) == [2, 5, 5]
    assert sorted(sum((per_iter[k] for k in range(3)), [])) == list(range(12))


def test_holdout_and_remaining(spark):
    all_rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], "id int, input string")
    train = spark.createDataFrame([(1, "a")], "id int, input string")
    assert sorted(r.id for r in splits.holdout(all_rows, train).collect()) == [2, 4]
    done = spark.createDataFrame([(2, "b")], "id int, input string")
    assert sorted(r.id for r in splits.remaining(all_rows, done, ["id"]).collect()) == [1, 3, 4]


def _events(n_hot=400, n_cold=60):
    rnd = random.Random(7)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n_hot + n_cold):
        run = "hot" if i < n_hot else f"r{i % 3}"
        ts = base + dt.timedelta(minutes=rnd.randint(0, 60 * 24 * 3))
        rows.append((i, run, ts, rnd.random() < 0.3))
    return rows


def test_running_count_and_lag_brute_force(spark):
    rows = _events()
    df = spark.createDataFrame(rows, "event_id long, run string, ts timestamp_ntz, flag boolean")
    rc = {r.event_id: r.running for r in ordering.running_count(df, "run", "ts", "event_id", F.col("flag")).collect()}
    lg = {r.event_id: r.prev for r in ordering.keyed_lag(df, "run", "ts", "event_id", "ts", "prev").collect()}
    by_run = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        by_run.setdefault(r[1], []).append(r)
    for run, rs in by_run.items():
        c, prev = 0, None
        for r in rs:
            c += int(r[3])
            assert rc[r[0]] == c
            assert lg[r[0]] == prev
            prev = r[2]


def test_hashed_rows_matches_sort(spark):
    df = spark.range(0, 5000).select(F.col("id"), F.md5(F.concat(F.lit("s|"), F.col("id").cast("string"))).alias("k"))
    got, n = ordering.hashed_rows(df.repartition(7), "k", "id", buckets=13)
    want = {r.id: i + 1 for i, r in enumerate(sorted(df.collect(), key=lambda r: (r.k, r.id)))}
    assert n == 5000 and {r.id: r.rn for r in got.collect()} == want


def test_running_count_null_run_key(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(1, None, base), (2, None, base + dt.timedelta(hours=2)), (3, "r", base), (4, None, base + dt.timedelta(hours=5))]
    df = spark.createDataFrame(rows, "event_id long, run string, ts timestamp_ntz")
    rc = {r.event_id: r.running for r in ordering.running_count(df, "run", "ts", "event_id").collect()}
    lg = {r.event_id: r.prev for r in ordering.keyed_lag(df, "run", "ts", "event_id", "event_id", "prev").collect()}
    assert rc == {1: 1, 2: 2, 4: 3, 3: 1}
    assert lg == {1: None, 2: 1, 4: 2, 3: None}


def test_minibatches_keep_null_ids(spark):
    df = spark.createDataFrame([(1,), (2,), (None,), (None,), (5,)], "id long")
    rows = splits.minibatches(df, "id", 2, 6).collect()
    assert len(rows) == 10 and sum(r.id is None for r in rows) == 4
    assert sorted((r.iteration, r.slot) for r in rows) == [(i, s) for i in range(6) for s in ((1, 2) if i % 3 < 2 else (1,))]


@pytest.mark.parametrize("cell_rows", [4, 50])
def test_crowded_times_are_cut_into_ranges(spark, cell_rows):
    """One run holds nearly all rows, all in one second and many at one time."""
    rng = random.Random(6)
    rows = [(i, "hot" if i % 10 else f"r{i % 3}", dt.datetime(2026, 1, 1, 5, 0, 0, rng.choice([0, 0, 0, 7, 9])), bool(rng.randrange(2))) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id long, run string, ts timestamp_ntz, flag boolean").repartition(5)
    cut = ordering.segments(df, "run", "ts", "event_id", cell_rows=cell_rows)
    sizes = cut.groupBy("run", "_ef_b").count().filter("run = 'hot'").select("count").collect()
    assert len(sizes) >= 6 and max(r[0] for r in sizes) <= 120  # spread over the partitions' ranges
    rc = {r.event_id: r.running for r in ordering.running_count(df, "run", "ts", "event_id", F.col("flag"), cell_rows=cell_rows).collect()}
    lg = {r.event_id: r.prev for r in ordering.keyed_lag(df, "run", "ts", "event_id", "event_id", "prev", cell_rows=cell_rows).collect()}
    seen, last = {}, {}
    for i, run, _, flag in sorted(rows, key=lambda r: (r[2], r[0])):
        seen[run] = seen.get(run, 0) + flag
        assert rc[i] == seen[run] and lg[i] == last.get(run)
        last[run] = i


def test_first_hashed_keeps_the_smallest(spark):
    df = spark.range(3000).withColumn("h", F.md5(F.col("id").cast("string")))
    want = sorted(r.h for r in df.collect())
    for n, most in ((1, 1), (10, 1), (500, 40), (3000, 10), (5000, 10)):
        got = sorted(r.h for r in ordering.first_hashed(df, "h", n, most).collect())
        assert got[:n] == want[:n] and len(got) <= min(3000, n + max(most, 3))
    same = df.withColumn("h", F.md5(F.lit("x")))
    assert ordering.first_hashed(same, "h", 10, 5).count() == 3000  # equal digests are not told apart here


def test_head_pct_numbers_few_keys(spark, monkeypatch):
    from evalframe.operators import splits
    seen = []
    number = splits.number_rows
    monkeypatch.setattr(splits, "number_rows", lambda keys, *a, **k: seen.append(keys.count()) or number(keys, *a, **k))
    df = spark.range(2000).selectExpr("(id * 7919) % 100003 as k", "id as v")
    want = [r.k for r in df.orderBy("k").collect()]
    got = splits.head_pct(df, "k", 5).orderBy("position").collect()
    assert [(r.position, r.k) for r in got] == list(enumerate(want[:100], 1)) and seen[0] <= 110
    text = df.selectExpr("cast(k as string) as k", "v")
    assert [r.k for r in splits.head_pct(text, "k", 1).orderBy("position").collect()] == sorted(map(str, want))[:20]
