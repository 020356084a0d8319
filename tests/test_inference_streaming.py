"""Batched prediction / scoring and the streaming jobs (stream = batch, restart safe)."""

import os

import pytest

from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalframe.operators import inference, joins, metrics
from evalframe.streaming import live


def test_predict_keyed_and_partition_independent(spark):
    df = spark.range(0, 200).select(F.col("id").alias("k"), F.concat(F.lit("q"), F.col("id").cast("string")).alias("text"))

    def fn(batch):
        return ["SUPPORTED" if int(k) % 3 == 0 else "no" for k in batch["k"]]

    a = {r.k: r.response for r in inference.predict(df, fn, ["k"], ["text"], batch_size=7).collect()}
    b = {r.k: r.response for r in inference.predict(df.repartition(5), fn, ["k"], ["text"], parallelism=3).collect()}
    assert a == b and len(a) == 200 and a[3] == "SUPPORTED"


def test_predict_row_failures(spark):
    df = spark.range(0, 10).select(F.col("id").alias("k"))

    def fn(batch):
        if (batch["k"] == 4).any():
            raise RuntimeError("rate limited")
        return ["ok"] * len(batch)

    r = {x.k: (x.response, x.failed) for x in inference.predict(df, fn, ["k"], ["k"], batch_size=5).collect()}
    assert r[4] == ("", True) and r[0] == ("ok", False) and sum(f for _, f in r.values()) == 1
    e = {x.k: x.error for x in inference.predict(df, fn, ["k"], ["k"], batch_size=5).collect()}
    assert e[4] == "RuntimeError: rate limited" and e[0] is None
    whole = inference.predict(df.coalesce(1), fn, ["k"], ["k"], batch_size=5, whole_call=True).collect()
    assert sorted(x.k for x in whole if x.failed) == [0, 1, 2, 3, 4]


def test_with_retries():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise IOError("x")
        return "done"

    waits = []
    assert inference.with_retries(flaky, retries=3, sleep=waits.append)() == "done"
    assert waits == [1, 2]


def test_score_with(spark):
    df = spark.createDataFrame([(1, "def f(): pass"), (2, "oops(")], "k long, code string")
    schema = T.StructType([T.StructField("passed", T.BooleanType()), T.StructField("error_type", T.StringType())])

    def scorer(batch):
        import pandas as pd
        ok = [c.endswith("pass") for c in batch["code"]]
        return pd.DataFrame({"passed": ok, "error_type": [None if o else "SyntaxError" for o in ok]})

    r = {x.k: (x.passed, x.error_type) for x in inference.score_with(df, scorer, ["k"], ["code"], schema).collect()}
    assert r == {1: (True, None), 2: (False, "SyntaxError")}

    def short(batch):
        import pandas as pd
        if (batch["code"] == "oops(").any():
            return pd.DataFrame({"passed": [], "error_type": []})
        return pd.DataFrame({"passed": [True] * len(batch), "error_type": None})

    on_error = lambda e: {"passed": False, "error_type": "UnknownError"}
    r = {x.k: (x.passed, x.error_type) for x in inference.score_with(df.coalesce(1), short, ["k"], ["code"], schema, on_error=on_error).collect()}
    assert r == {1: (True, None), 2: (False, "UnknownError")}
    with pytest.raises(Exception):
        inference.score_with(df.coalesce(1), short, ["k"], ["code"], schema).collect()


def test_stream_accuracy_equals_batch(spark, tmp):
    src = os.path.join(tmp, "src")
    rows = [(i, c, "SUPPORTED" if (i + c) % 2 else "refuted") for i in range(20) for c in range(2)]
    spark.createDataFrame(rows, "claim_id long, candidate_id int, response string").write.parquet(src)
    gold = spark.createDataFrame([(i, "SUPPORTED") for i in range(20)], "claim_id long, answer string")
    schema = "claim_id long, candidate_id int, response string"
    stream = spark.readStream.schema(schema).parquet(src)
    got = {r.candidate_id: (r.correct, r.total) for r in live.run_complete(live.live_accuracy(stream, gold, unique=True), "t_acc").collect()}
    batch = spark.read.parquet(src)
    want = {r.candidate_id: (r.correct, r.total) for r in metrics.accuracy(joins.parse_and_score(batch, gold)).collect()}
    assert got == want
    with pytest.raises(ValueError):
        live.live_accuracy(stream, gold)


def test_stream_score_restart_idempotent(spark, tmp):
    src, sink, ck = (os.path.join(tmp, x) for x in ("in", "out", "ck"))
    schema = "k long, v string"
    spark.createDataFrame([(1, "a"), (2, "b")], schema).write.parquet(os.path.join(src, "p1"))
    stream = spark.readStream.schema(schema).parquet(os.path.join(src, "*"))
    live.stream_score(stream, sink, ck).awaitTermination()
    spark.createDataFrame([(3, "c")], schema).write.parquet(os.path.join(src, "p2"))
    live.stream_score(spark.readStream.schema(schema).parquet(os.path.join(src, "*")), sink, ck).awaitTermination()
    # a restart with nothing new adds nothing
    live.stream_score(spark.readStream.schema(schema).parquet(os.path.join(src, "*")), sink, ck).awaitTermination()
    out = live.read_committed(spark, sink, schema)
    assert sorted(r.k for r in out.collect()) == [1, 2, 3]


def test_token_windows_session(spark, tmp):
    import datetime as dt
    src = os.path.join(tmp, "ev")
    t0 = dt.datetime(2024, 1, 1, 0, 0)
    rows = [(1, t0, "r", 5), (2, t0 + dt.timedelta(minutes=10), "r", 5), (3, t0 + dt.timedelta(minutes=50), "r", 1)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, run_name string, total_tokens long").write.parquet(src)
    s = spark.readStream.schema("event_id long, ts timestamp_ntz, run_name string, total_tokens long").parquet(src)
    res = live.run_complete(live.token_windows(s, "session", gap="30 minutes"), "t_sess").orderBy("window_start_us").collect()
    assert [(r.n_events, r.tokens) for r in res] == [(2, 10), (1, 1)]


def test_append_mode_windows_finalised_by_watermark(spark, tmp):
    import datetime as dt
    src = os.path.join(tmp, "ev2")
    t0 = dt.datetime(2024, 1, 1, 0, 0)
    rows = [(i, t0 + dt.timedelta(minutes=20 * i), "r", 1) for i in range(12)]  # 4 hours of events
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, run_name string, total_tokens long").write.parquet(src)
    s = spark.readStream.schema("event_id long, ts timestamp_ntz, run_name string, total_tokens long").parquet(src)
    res = live.run_stream(live.token_windows(s, "tumbling", size="1 hour", delay="0 seconds"), "t_app", mode="append")
    # append mode emits a window only once the watermark has passed its end, and only once
    last_us = int((t0 + dt.timedelta(minutes=20 * 11) - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    hour, zero = 3_600_000_000, int((t0 - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    assert sorted((r.window_start_us, r.n_events) for r in res.collect()) == [(zero + k * hour, 3) for k in range(4) if zero + (k + 1) * hour <= last_us]
    assert last_us > zero + 3 * hour


def test_append_mode_drops_late_rows(spark, tmp):
    import datetime as dt
    src = os.path.join(tmp, "late")
    t0 = dt.datetime(2024, 1, 1, 0, 0)
    schema = "event_id long, ts timestamp_ntz, run_name string, total_tokens long"
    spark.createDataFrame([(i, t0 + dt.timedelta(minutes=30 * i), "r", 1) for i in range(8)], schema).coalesce(1).write.parquet(os.path.join(src, "a"))
    s = lambda: live.token_windows(spark.readStream.schema(schema).parquet(os.path.join(src, "*")), "tumbling", size="1 hour", delay="0 seconds")
    ck = os.path.join(tmp, "ck")
    first = live.run_stream(s(), "t_late", checkpoint=ck).collect()
    assert sorted(r.n_events for r in first) == [2, 2, 2]
    # half an hour after the first hour was closed and given out: one row too late, one in time
    spark.createDataFrame([(100, t0, "r", 1), (101, t0 + dt.timedelta(minutes=200), "r", 1), (102, t0 + dt.timedelta(hours=9), "r", 1)], schema).coalesce(1).write.parquet(os.path.join(src, "b"))
    second = live.run_stream(s(), "t_late2", checkpoint=ck).collect()
    assert [r.n_events for r in second] == [3]
    # nothing new: an empty result with the stream's columns
    third = live.run_stream(s(), "t_late3", checkpoint=ck)
    assert third.columns == s().columns and third.count() == 0


def test_live_accuracy_with_watermark(spark, tmp):
    import datetime as dt
    src = os.path.join(tmp, "resp")
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, 0, "supported", t0), (1, 0, "supported", t0), (2, 0, "refuted", t0)]
    spark.createDataFrame(rows, "claim_id long, candidate_id int, response string, et timestamp").write.parquet(src)
    gold = spark.createDataFrame([(1, "SUPPORTED"), (2, "SUPPORTED")], "claim_id long, answer string")
    s = spark.readStream.schema("claim_id long, candidate_id int, response string, et timestamp").parquet(src)
    r = live.run_complete(live.live_accuracy(s, gold, event_time_col="et"), "t_wm").collect()[0]
    assert (r.correct, r.total) == (1, 2)


def test_live_batch_audit_equals_the_batch_one(spark, tmp):
    """Events in several files out of order; a last event long after closes every run, so the state ends empty."""
    import datetime as dt
    import random

    from evalframe.operators.events import batch_audit
    rng = random.Random(2)
    t0 = dt.datetime(2024, 1, 1)
    schema = "event_id long, ts timestamp_ntz, run_name string, event_type string"
    rows = [(i, t0 + dt.timedelta(seconds=rng.randrange(6000)), rng.choice(["a", "b", "c", None]), rng.choice(["batch_start", "batch_complete"] + ["reflector_invocation"] * 3)) for i in range(300)]
    want = sorted((tuple(r) for r in batch_audit(spark.createDataFrame(rows, schema)).select("run_name", "batch_seq", "n_invocations", "n_completes", "complete", "duration_us").collect()), key=repr)
    src, ck = os.path.join(tmp, "in"), os.path.join(tmp, "ck")
    out = []
    for part in (rows[0::3], rows[1::3], rows[2::3], [(1000, t0 + dt.timedelta(days=3), "z", "batch_start")], [(1001, t0 + dt.timedelta(days=6), "y", "batch_start")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        got = live.run_stream(live.live_batch_audit(stream, delay="2 hours"), "audit", checkpoint=ck)
        out += [tuple(r) for r in got.select("run_name", "batch_seq", "n_invocations", "n_completes", "complete", "duration_us").collect()]
    assert sorted((r for r in out if r[0] != "z"), key=repr) == want
    assert [r for r in out if r[0] == "z"] == [("z", 1, 0, 0, False, None)]
