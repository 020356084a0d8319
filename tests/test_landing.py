"""Replies that survive: killed workers, repeated requests, changed contents, failed calls, null keys, moved reflections."""

import os
from collections import Counter

import pytest

from evalframe.operators import landing
from evalframe.plans import evaluate


def requests(spark, n=60):
    return spark.createDataFrame([(i, f"text {i % 50}") for i in range(n)] + [(None, "no key"), (None, None)], "id long, request string")


def reader(path):
    return Counter(open(path).read().split("\n")[:-1]) if os.path.exists(path) else Counter()


def counted(path, die_at=None):
    """A model that writes down each request and ends its process at one of them."""
    def model(batch):
        if die_at is not None and (batch["id"] == die_at).any():
            os._exit(1)
        with open(path, "a") as f:
            f.write("".join(f"{k} {r}\n" for k, r in zip(batch["id"], batch["request"])))
        return [f"re: {r}" for r in batch["request"]]
    return model


def test_a_killed_worker_loses_no_landed_reply(spark, tmp):
    df = requests(spark).coalesce(1)
    first, again = f"{tmp}/first", f"{tmp}/again"
    with pytest.raises(Exception):
        landing.predict_landed(df, counted(first, die_at=30), ["id"], ["request"], f"{tmp}/o", batch_size=1, land_rows=1)
    before = reader(first)
    assert 0 < len(before) < 62
    out = landing.predict_landed(df, counted(again), ["id"], ["request"], f"{tmp}/o", batch_size=4)
    assert out.count() == 62 and out.filter("failed").count() == 0
    assert set(reader(again)) & set(before) == set() and max((reader(again) + before).values()) == 1
    # computed again: from the log alone
    third = f"{tmp}/third"
    assert landing.predict_landed(df, counted(third), ["id"], ["request"], f"{tmp}/o").count() == 62
    assert not reader(third)


def test_a_retried_task_asks_only_for_the_rest(spark, tmp):
    """A call that ends the task, not the process: what was answered before it is in the log."""
    class Stop(BaseException):
        pass

    def model(batch):
        if (batch["id"] == 41).any():
            raise Stop("stop")
        return ["x"] * len(batch)

    with pytest.raises(Exception):
        landing.predict_landed(requests(spark).coalesce(1), model, ["id"], ["request"], f"{tmp}/o", batch_size=1, land_rows=10_000)
    assert landing.call_log(spark, f"{tmp}/o").count() > 0


def test_equal_requests_are_answered_by_one_call(spark, tmp):
    df = requests(spark)
    both = df.unionByName(df)
    out = landing.predict_landed(both, counted(f"{tmp}/calls"), ["id"], ["request"], f"{tmp}/o", output="reply")
    assert out.count() == 124 and max(reader(f"{tmp}/calls").values()) == 1
    assert {(r.id, r.reply) for r in out.collect()} == {(r.id, f"re: {r.request}") for r in df.collect()}


def test_contents_are_part_of_a_request(spark, tmp):
    df = requests(spark)
    landing.predict_landed(df, counted(f"{tmp}/a"), ["id"], ["request"], f"{tmp}/o")
    from pyspark.sql import functions as F
    other = df.withColumn("request", F.when(F.col("id") < 10, F.lit("new")).otherwise(F.col("request")))
    out = landing.predict_landed(other, counted(f"{tmp}/b"), ["id"], ["request"], f"{tmp}/o")
    assert sum(reader(f"{tmp}/b").values()) == 10
    assert out.filter("response = 're: new'").count() == 10 and out.count() == 62


def test_failed_calls_are_tried_again(spark, tmp):
    def down(batch):
        if (batch["id"] % 4 == 1).any():
            raise RuntimeError("down")
        return ["ok"] * len(batch)

    df = requests(spark)
    first = landing.predict_landed(df, down, ["id"], ["request"], f"{tmp}/o", batch_size=8)
    assert first.filter("failed").count() == 15 and {r.error for r in first.filter("failed").collect()} == {"RuntimeError: down"}
    then = landing.predict_landed(df, counted(f"{tmp}/c"), ["id"], ["request"], f"{tmp}/o", batch_size=8)
    assert then.filter("failed").count() == 0 and sum(reader(f"{tmp}/c").values()) == 15
    log = landing.call_log(spark, f"{tmp}/o")
    assert log.count() == 62 + 15 and log.filter("failed").count() == 15


def test_a_reader_never_sees_a_half_file(spark, tmp):
    store, at = landing.file_system(f"file:{tmp}/x")
    with pytest.raises(ZeroDivisionError):
        landing.write_whole(store, f"{at}/part", lambda f: (f.write(b"half"), 1 / 0))
    assert not [f for f in os.listdir(f"{tmp}/x") if not f.startswith(".")]
    landing.write_whole(store, f"{at}/part", lambda f: f.write(b"whole"))
    assert open(f"{tmp}/x/part", "rb").read() == b"whole"


def test_empty_input(spark, tmp):
    out = landing.predict_landed(requests(spark).limit(0), counted(f"{tmp}/c"), ["id"], ["request"], f"{tmp}/o")
    assert out.count() == 0 and landing.call_log(spark, f"{tmp}/none").count() == 0


def test_new_failures_leave_old_reflections_with_their_tasks(spark, tmp):
    def failures(ids):
        return spark.createDataFrame([(i, "f", False, "E", f"m{i}", "") for i in ids], "task_id long, entry_point string, passed boolean, error_type string, error_message string, traceback string")

    def reflector(batch):
        return [f"SUGGESTED_PROMPT_CHANGE: {r.split('Error Message: ')[1].split(chr(10))[0]}" for r in batch["request"]]

    evaluate.reflection_log(failures([5, 7]), reflector, ["task_id"], run_name="a", out_dir=f"{tmp}/o")
    r = evaluate.reflection_log(failures([3, 5, 7]), reflector, ["task_id"], run_name="b", out_dir=f"{tmp}/o")
    assert {(x.task_id, x.change) for x in r["reflections"].collect()} == {(i, f"m{i}") for i in (3, 5, 7)}
    assert landing.call_log(spark, f"{tmp}/o/reflections").count() == 3


def test_other_code_for_a_key_is_run_again(spark, tmp):
    import pandas as pd
    tasks = spark.createDataFrame([(1, "p", "s", "t")], "task_id long, prompt string, entry_point string, test string")
    cands = lambda p: spark.createDataFrame([(0, p)], "candidate_id int, system_prompt string")
    scorer = lambda b: pd.DataFrame({"passed": ["return 1" in c for c in b["code"]], "error_type": None, "error_message": None, "traceback": None})
    model = lambda b: [f"def s(): return {int(s == 'good')}" for s in b["system_content"]]
    got = [evaluate.evaluate_code(tasks, cands(p), model, scorer, ks=(1,), out_dir=f"{tmp}/o")["pass_at_k"].first().pass_at_1 for p in ("bad", "good", "bad")]
    assert got == [0.0, 1.0, 0.0]


def test_many_slots_share_partitions_evenly(spark):
    from pyspark.sql import functions as F
    at = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for slots, most in ((at, 1), (at * 16, landing.TASK_SLOTS)):
        out = landing.dealt(spark.range(4000).select("id"), ["id"], slots)
        where = out.select(landing.SLOT, F.spark_partition_id().alias("p")).distinct().collect()
        assert len(where) == len({r[landing.SLOT] for r in where})  # a slot lies in one partition
        assert max(Counter(r.p for r in where).values()) <= most
        assert out.rdd.getNumPartitions() == -(-slots // most)


def test_repeated_and_null_requests_are_called_once_in_order(spark, tmp):
    df = spark.createDataFrame([(i, f"t{i % 3}") for i in (0, 0, 1, 2, 2, 2)] + [(None, None)] * 2, "id long, request string")
    out = landing.predict_landed(df, counted(f"{tmp}/c"), ["id"], ["request"], f"{tmp}/o", batch_size=2)
    assert Counter((r.id, r.response, r.failed, r.error) for r in out.collect()) == Counter(
        {(0, "re: t0", False, None): 2, (1, "re: t1", False, None): 1, (2, "re: t2", False, None): 3, (None, "re: None", False, None): 2})
    assert sum(reader(f"{tmp}/c").values()) == 4


def test_failures_and_generations_are_written_once(spark, tmp):
    from evalframe.plans import catalog
    d = spark.createDataFrame([(i, False, "E", "m", "tb") for i in range(20)], "task_id long, passed boolean, error_type string, error_message string, traceback string")
    r = evaluate.reflection_log(d, catalog.stub_reflector_plain, ["task_id"], run_name="r")
    assert r["failures"].inputFiles() and all("/failures-" in f for f in r["failures"].inputFiles())
    t = spark.createDataFrame([(i, f"def f{i}(x):", f"f{i}", "assert 1") for i in range(8)], "task_id long, prompt string, entry_point string, test string")
    c = spark.createDataFrame([(0, "a"), (1, "b")], "candidate_id int, system_prompt string")
    g = evaluate.evaluate_code(t, c, catalog.stub_coder, catalog.stub_runner, ks=(1, 2))["generations"]
    assert any("/code_generations-" in f for f in g.inputFiles()) and not any("/code_outputs-" in f for f in g.inputFiles())
    assert g.count() == 32


def test_event_log_is_written_by_several_tasks(spark, tmp):
    import glob

    from evalframe.plans import catalog
    from evalframe.session import ensure_checkpoint_dir
    spark.sql("SELECT id AS event_id, timestamp_ntz'2025-01-01 00:00:00' AS ts, 7L AS user_id, 'click' AS event_type, 2.5D AS value, '' AS props FROM range(400)") \
        .coalesce(1).write.parquet(f"{tmp}/events.parquet")
    before = set(glob.glob(f"{ensure_checkpoint_dir(spark).removeprefix('file:')}/event-log-*"))
    r = {x.level: (x.n_calls, x.sum_tokens) for x in catalog.QUERIES["event_log_roundtrip"](spark, tmp).collect()}
    assert r == {0: (400, 800), 1: (400, 800), 3: (400, 800)}
    new = set(glob.glob(f"{ensure_checkpoint_dir(spark).removeprefix('file:')}/event-log-*")) - before
    assert len(glob.glob(f"{new.pop()}/run=*/part-*")) > 1
