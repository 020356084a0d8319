"""File sources and sinks on small written fixtures."""

import json
import os

import pytest
from pyspark.sql import functions as F

from evalframe.sources import files


def test_split_csv_roundtrip_and_freeze(spark, tmp):
    rows = [("1", "f", 'def f():\n    """a "quoted" doc"""', "", "assert f() == 1\n"),
            ("2", "g", "x, y\r\nz", " ", "")]
    df = spark.createDataFrame(rows, "task_id string, entry_point string, input string, answer string, test string")
    p = os.path.join(tmp, "split")
    files.write_split(df, p)
    back = {r.task_id: (r.input, r.answer, r.test, r.additional_context["test"]) for r in files.read_split(spark, p).collect()}
    assert back == {"1": (rows[0][2], "", rows[0][4], rows[0][4]), "2": (rows[1][2], " ", "", "")}
    # frozen: a second write is ignored
    files.write_split(df.limit(1), p)
    assert files.read_split(spark, p).count() == 2


def test_fewshot_csv(spark, tmp):
    rows = [(1, "in", "SUPPORTED", '{"id": "1"}', '[{"input": "a", "label": "SUPPORTED"}]'),
            (2, "in2", None, "{bad", '{"raw": "ERROR: x"}'),
            (3, "in3", None, "{}", "plain text")]
    df = spark.createDataFrame(rows, "id long, input string, answer string, additional_context string, few_shot string")
    p = os.path.join(tmp, "fs")
    files.write_fewshot(df, p)
    r = {x.id: (x.context, x.items, x.few_shot_raw) for x in files.read_fewshot(spark, p).collect()}
    assert r[1][0] == {"id": "1"} and r[1][1][0]["label"] == "SUPPORTED" and r[1][2] is None
    assert r[2] == ({}, None, "ERROR: x")
    assert r[3] == ({}, None, "plain text")


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_runs_prompts_and_best_outputs(spark, tmp):
    _write(f"{tmp}/runs/r1/experiment_config.json", json.dumps({
        "experiment_info": {"timestamp": "2025-01-01T00:00:00"}, "results": {"best_prompt_index": 2, "best_prompt_score": 0.8,
        "seed_prompt_score": 0.6, "pareto_front_score": 1.0, "num_candidates_evaluated": 4},
        "all_candidate_scores": {"candidate_0": 0.6, "candidate_1": 0.7}, "seed_prompt": {"system_prompt": "seed text"}}, indent=2))
    _write(f"{tmp}/runs/r2/experiment_config.json", json.dumps({
        "timestamp": "2025-02-01", "results": {"best_idx": 1, "best_score": 1.0, "num_candidates": 6}}, indent=2))
    runs = files.read_runs(spark, f"{tmp}/runs/*/experiment_config.json")
    got = {r.run_dir: (r.best_idx, r.best_score, r.num_candidates) for r in runs.collect()}
    assert got == {"r1": (2, 0.8, 4), "r2": (1, 1.0, 6)}
    cs = {(r.run_dir, r.candidate_id): r.score for r in files.candidate_scores_of_runs(runs).collect()}
    assert cs == {("r1", 0): 0.6, ("r1", 1): 0.7}

    _write(f"{tmp}/runs/r1/optimized_prompt.txt", "  better prompt \n")
    with pytest.raises(Exception):  # run r2 has a config and no prompt file
        files.read_prompts(spark, f"{tmp}/runs/*/*_prompt.txt", runs).collect()
    runs = runs.filter("run_dir = 'r1'")
    pr = files.read_prompts(spark, f"{tmp}/runs/*/*_prompt.txt", runs).collect()
    assert [(r.run_dir, r.seed_prompt, r.optimized_prompt) for r in pr] == [("r1", "seed text", "better prompt")]
    _write(f"{tmp}/runs2/r3/seed_prompt.txt", "only seed")
    with pytest.raises(Exception):
        files.read_prompts(spark, f"{tmp}/runs2/*/*_prompt.txt").collect()

    for t, v in [(0, "1.0"), (1, "0.0"), (2, "1.0")]:
        _write(f"{tmp}/best/task_{t}/iter_0_prog_0.json", v)
    bo = files.read_best_outputs(spark, f"{tmp}/best/task_*/*.json")
    assert bo.agg(F.avg("score")).collect()[0][0] == pytest.approx(2 / 3)


def test_read_claims_picks_train(spark, tmp):
    for split, claim in [("test", "t"), ("train", "tr")]:
        _write(f"{tmp}/claims/{split}/part.json", json.dumps({"id": "1", "claim": claim, "evidence": "a. b", "label": 0}))
    assert files.read_claims(spark, f"{tmp}/claims").collect()[0].claim == "tr"
    assert files.read_claims(spark, f"{tmp}/claims", split="test").collect()[0].claim == "t"
    # a folder without split folders is read as it is
    _write(f"{tmp}/flat/part.json", json.dumps({"id": "1", "claim": "f", "evidence": "a", "label": 0}))
    assert files.read_claims(spark, f"{tmp}/flat").collect()[0].claim == "f"


def test_event_log_as_written(spark, tmp):
    """Log lines of one reflection batch: the invocations do not name their run."""
    from evalframe.operators.events import batch_audit, call_latency, progress
    from evalframe.operators.events import token_rollup as rollup
    times = ["08.545700", "12.670618", "17.174334", "19.720770", "24.360398", "28.650826", "28.652565"]
    tokens = [240, 288, 251, 321, 261]
    rows = [{"event_type": "batch_start", "data": {"run_name": "a_run", "num_failures": 5}}]
    rows += [{"event_type": "reflector_invocation", "data": {"task_id": f"Bench/{i}", "entry_point": "f", "error_type": "MissingFunction", "error_message": "m",
              "reflector_output": "o", "model_used": "m", "usage": {"prompt_tokens": 1, "completion_tokens": n - 1, "total_tokens": n}}} for i, n in enumerate(tokens)]
    rows += [{"event_type": "batch_complete", "data": {"run_name": "a_run", "num_processed": 5}}]
    text = "".join(json.dumps({"timestamp": f"2026-04-07T22:49:{t}", **r}) + "\n" for t, r in zip(times, rows, strict=True))
    _write(f"{tmp}/log/a_run_20260407_224908.jsonl", text)
    log = files.read_events(spark, f"{tmp}/log")
    assert dict(log.dtypes)["ts"] == "timestamp_ntz" and log.select("event_id").distinct().count() == 7
    a = [(r.run_name, r.batch_seq, r.n_invocations, r.declared, r.processed, r.complete, r.duration_us) for r in batch_audit(log).collect()]
    assert a == [("a_run", 1, 5, 5, 5, True, 20_106_865)]
    assert [r.sum_tokens for r in rollup(log).filter("level = 1").collect()] == [1361]
    p = progress(log).orderBy("processed").collect()
    assert [(r.processed, r.total, r.pct) for r in p] == [(i, 5, 20 * i) for i in range(1, 6)]
    assert [r.gap_us for r in call_latency(log).orderBy("ts").collect()][:2] == [None, 4_124_918]
    # rows whose run is not known are kept
    lost = log.withColumn("run_name", F.lit(None).cast("string"))
    assert progress(lost).count() == 5


def test_detailed_results_shapes(spark):
    docs = [json.dumps({"seed_results": [{"task_id": "1", "passed": False}], "optimized_results": [{"task_id": "1", "passed": True}],
                        "summary": {"x": 1}, "note": "n"}),
            json.dumps([{"task_id": "2", "passed": True}]),
            json.dumps({"full": {"task_id": "3"}})]
    df = spark.createDataFrame([(d,) for d in docs], "doc string")
    r = sorted((x.prompt_type or "", x.task_id, x.passed) for x in files.flatten_detailed(df).collect())
    assert r == [("", "2", True), ("optimized_results", "1", True), ("seed_results", "1", False)]


def test_events_and_metrics_append(spark, tmp):
    ev = spark.createDataFrame([("2026-04-07T22:49:08", "batch_start", ("run", 5, None, None, None, None, None, None, None, None)),
                                ("2026-04-07T22:49:12", "reflector_invocation",
                                 ("run", None, None, "Bench/29", "f", "MissingFunction", "m", "out", "m1", (10, 20, 30)))],
                               files.EVENT_SCHEMA)
    p = os.path.join(tmp, "events")
    files.append_events(ev, p)
    files.append_events(ev.limit(1), p)
    e = files.read_events(spark, p)
    assert e.count() == 3
    assert e.filter(F.col("task_id") == "Bench/29").select("total_tokens").collect()[0][0] == 30
    m = spark.createDataFrame([("2025-01-01T00:00:00", "acc", 0.5, 1)], "timestamp string, name string, value double, step long")
    files.append_metrics(m, os.path.join(tmp, "m"))
    assert files.read_metrics(spark, os.path.join(tmp, "m")).count() == 1


def test_write_report_partitioned(spark, tmp):
    c = spark.createDataFrame([("r1", "1", 0.5, 5, 10, 0.0, 0.0, 0), ("r1", "2", 0.6, 6, 10, 0.1, 20.0, 1)],
                              "run_id string, variant string, accuracy double, correct long, total long, delta_absolute double, "
                              "delta_percent double, additional_correct long")
    files.write_report(files.comparison_documents(c, {"baseline": "1", "optimized": "2"}, fewshot_file="f.csv", fewshot_k=3), os.path.join(tmp, "rep"))
    doc = json.loads(next(open(os.path.join(tmp, "rep", "run_id=r1", f)).readline() for f in os.listdir(os.path.join(tmp, "rep", "run_id=r1")) if f.endswith(".json")))
    assert doc["test_size"] == 10 and doc["few_shot"] == {"injected": False, "file": "f.csv", "k": 3}
    assert doc["baseline"] == {"accuracy": 0.5, "correct": 5, "total": 10}
    assert doc["optimized"]["additional_correct"] == 1 and doc["optimized"]["delta_percent"] == 20.0
    assert os.path.isdir(os.path.join(tmp, "rep", "run_id=r1"))


def test_synthetic_claims_shape(spark):
    s = files.synthetic_claims(spark.range(0, 50), "id", seed=1).collect()
    for r in s:
        claim = r.input.split("\n")[0][len("Claim: "):]
        assert claim[0].isupper() and claim.endswith(".")
        assert 6 <= len(claim[:-1].split(" ")) <= 14
        assert r.answer in ("SUPPORTED", "NOT_SUPPORTED")


def test_batch_audit_on_read_log(spark, tmp):
    from evalframe.operators.events import batch_audit, token_rollup
    ev = spark.createDataFrame([
        ("2026-04-07T22:49:08", "batch_start", ("run", 2, None, None, None, None, None, None, None, None)),
        ("2026-04-07T22:49:12", "reflector_invocation", ("run", None, None, "29", "f", "MissingFunction", "m", "o", "g", (1, 2, 3))),
        ("2026-04-07T22:49:16", "reflector_invocation", ("run", None, None, "15", "g", "SyntaxError", "m", "o", "g", (1, 3, 4))),
        ("2026-04-07T22:49:28", "batch_complete", ("run", None, 2, None, None, None, None, None, None, None))],
        files.EVENT_SCHEMA)
    p = os.path.join(tmp, "ev")
    files.append_events(ev, p)
    log = files.read_events(spark, p)
    a = batch_audit(log).filter("batch_seq = 1").collect()[0]
    assert (a.declared, a.processed, a.n_invocations, a.complete, a.duration_us) == (2, 2, 2, True, 20_000_000)
    t = {(r.run_name, r.error_type, r.level): r.sum_tokens for r in token_rollup(log).collect()}
    assert t[(None, None, 3)] == 7


def test_comparisons_two_shapes(spark, tmp):
    _write(f"{tmp}/cmp/r1/comparison.json", json.dumps({
        "timestamp": "t1", "test_size": 500, "few_shot": {"injected": True, "file": "f.csv", "k": 3},
        "baseline": {"accuracy": 0.628, "correct": 314, "total": 500},
        "optimized": {"accuracy": 0.654, "correct": 327, "total": 500, "delta_absolute": 0.026, "delta_percent": 4.14},
        "fewshot_optimized": {"accuracy": 0.622, "correct": 311, "total": 500}}, indent=2))
    _write(f"{tmp}/cmp/r2/comparison.json", json.dumps({
        "timestamp": "t2", "test_size": 64,
        "baseline": {"pass_at_1": 0.0, "passed": 0, "total": 64},
        "optimized": {"pass_at_1": 1.0, "passed": 64, "total": 64, "delta_percent": 0}}, indent=2))
    r = {(x.run_dir, x.variant): (x.score, x.pass_at_3, x.correct, x.few_shot_injected)
         for x in files.read_comparisons(spark, f"{tmp}/cmp/*/comparison.json").collect()}
    assert r[("r1", "fewshot_optimized")] == (0.622, None, 311, True)
    assert r[("r2", "optimized")] == (1.0, None, 64, None)
    assert ("r2", "fewshot_optimized") not in r and len(r) == 5


def test_detailed_task_id_int_or_string(spark):
    docs = [json.dumps({"seed_results": [{"task_id": 29, "passed": False}]}),
            json.dumps({"seed_results": [{"task_id": "Bench/15", "passed": False}]})]
    df = spark.createDataFrame([(d,) for d in docs], "doc string")
    assert sorted(r.task_id for r in files.flatten_detailed(df).collect()) == ["29", "Bench/15"]


def test_frozen_split_reloads(spark, tmp):
    a = spark.createDataFrame([("1", "f", "p", "", "t")], "task_id string, entry_point string, input string, answer string, test string")
    b = spark.createDataFrame([("2", "g", "q", "", "u")], "task_id string, entry_point string, input string, answer string, test string")
    p = os.path.join(tmp, "frozen")
    assert [r.task_id for r in files.frozen_split(spark, a, p).collect()] == ["1"]
    assert [r.task_id for r in files.frozen_split(spark, b, p).collect()] == ["1"]


def test_whole_files_are_listed_and_read_by_tasks(spark, tmp):
    for i in range(300):
        _write(f"{tmp}/runs/g{i % 7}/run {i}/optimized_prompt.txt", f" best {i}\n")
        _write(f"{tmp}/runs/g{i % 7}/run {i}/seed_prompt.txt", f"seed é{i}")
    _write(f"{tmp}/runs/g0/run 0/_prompt.txt", "hidden")
    _write(f"{tmp}/runs/g0/run 0/part_prompt.txt/part-0.txt", "in a folder")
    glob = f"{tmp}/runs/*/*/*_prompt.txt"
    whole = files.read_whole(spark, glob)
    # one task reads many files: their number does not follow the number of files
    assert whole.rdd.getNumPartitions() <= 8
    old = spark.read.text(glob, wholetext=True).select("value", F.col("_metadata.file_path").alias("file_path"))
    cut = F.regexp_replace("file_path", "^file:/*", "/").alias("file_path")
    want = {tuple(r) for r in old.select("value", cut).collect()}
    got = [tuple(r) for r in whole.select("value", cut).collect()]
    assert len(got) == 601 and set(got) == want
    assert files.read_prompts(spark, f"{tmp}/runs/g*/*/?????????_prompt.txt").count() == 300
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_best_outputs(spark, f"{tmp}/runs/*/none_*.json").collect()


def test_rows_to_write_are_dealt_out(spark, tmp):
    df = spark.range(64).coalesce(1).selectExpr("concat('d', id % 4, '/f', id) AS path", "'x' AS text")
    assert files._spread(df, "path").select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert files.write_files(df, tmp) == 64


def test_best_outputs_rank_code_tasks_alone_and_drop_what_they_were_shuffled_by(spark, tmp, monkeypatch):
    from evalframe import session
    from evalframe.plans.catalog import QUERIES
    lines = [(1, 5, 3, 1, "N", "O"), (1, 6, 3, 2, "N", "O"), (2, 5, 3, 1, "A", "O"), (2, 5, 3, 2, "N", "F"), (2, 5, 3, 2, "N", "F"), (3, 1, 1, 1, "R", "F"),
             (4, 1, 1, 1, None, None), (None, 1, 1, 1, "N", "O"), (70, 1, 1, 1, "N", "O"), (71, 1, 1, 1, "N", "O")]
    spark.createDataFrame([(o, p, s, n, 1.0, 2.0, 0.0, 0.0, r, t, None) for o, p, s, n, r, t in lines],
                          "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
                          " l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{tmp}/lineitem.parquet")
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, None), (4, "d"), (5, "e"), (None, "f")], "p_partkey long, p_name string").write.parquet(f"{tmp}/part.parquet")
    plans = {}

    def kept(module, name):
        real = getattr(module, name)

        def call(df, *args):
            plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
            return real(df, *args)
        monkeypatch.setattr(module, name, call)
    kept(files, "write_files")
    kept(session, "written_once")
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    got = sorted(tuple(r) for r in QUERIES["best_outputs_roundtrip"](spark, tmp).collect())
    assert got == [(1, 1, 0, 1.0), (2, 1, 1, 1.0), (3, 1, 1, 0.0), (4, 1, 1, 0.0)]
    assert plans["written_once"].index("Window") < plans["written_once"].index("LeftSemi")  # the join is below
    assert "Window" not in plans["write_files"] and "Aggregate" not in plans["write_files"]
    assert spark.conf.get(key, "false") == before
