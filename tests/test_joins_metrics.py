"""Joins, aggregates, candidates and comparisons on hand-written rows."""

import pytest
from pyspark.sql import functions as F

from evalframe.operators import (candidates, compare, feedback, joins,
                                 metrics)


def test_evaluation_grid_and_bound(spark):
    ex = spark.createDataFrame([(1,), (2,)], "claim_id long")
    k = spark.createDataFrame([(0, "seed"), (1, "opt")], "candidate_id int, prompt_type string")
    g = joins.evaluation_grid(ex, k).collect()
    assert sorted((r.claim_id, r.candidate_id, r.prompt_type) for r in g) == [
        (1, 0, "seed"), (1, 1, "opt"), (2, 0, "seed"), (2, 1, "opt")]
    # nulls are left out, repeated ids give one row, with and without attributes, broadcast or not
    odd = spark.createDataFrame([(0, "seed"), (0, "again"), (None, "x")], "candidate_id int, prompt_type string")
    for limit in (1 << 20, 0):
        assert [(r.claim_id, r.prompt_type) for r in joins.evaluation_grid(ex, odd, broadcast_bytes=limit).orderBy("claim_id").collect()] == [(1, "again"), (2, "again")]
        assert joins.evaluation_grid(ex, odd.select("candidate_id"), broadcast_bytes=limit).count() == 2
        many = spark.range(0, 10_500).select(F.col("id").cast("int").alias("candidate_id"))
        g = joins.evaluation_grid(ex, many, broadcast_bytes=limit)
        assert g.count() == 21_000 and g.select("candidate_id").distinct().count() == 10_500
    none = joins.evaluation_grid(ex, k.limit(0))
    assert none.count() == 0 and none.columns == ["claim_id", "candidate_id", "prompt_type"]


def test_score_left_join_counts_missing_gold(spark):
    out = spark.createDataFrame([(1, 0, "yes SUPPORTED"), (2, 0, "refutes"), (3, 0, "supported")],
                                "claim_id long, candidate_id int, response string")
    gold = spark.createDataFrame([(1, "SUPPORTED"), (2, "NOT_SUPPORTED")], "claim_id long, answer string")
    s = joins.parse_and_score(out, gold)
    acc = metrics.accuracy(s).collect()[0]
    assert (acc.correct, acc.total) == (2, 3)


def test_attach_fewshot_last_wins(spark):
    ex = spark.createDataFrame([(1, "t1"), (2, "t2"), (3, "zz")], "claim_id long, input string")
    fs = spark.createDataFrame([(10, "t1", "A"), (11, "t1", "B"), (5, "t2", "C")], "id long, input string, few_shot string")
    a = {r.claim_id: (r.few_shot, r.attached) for r in joins.attach_fewshot(ex, fs).collect()}
    assert a == {1: ("B", True), 2: ("C", True), 3: (None, False)}
    st = joins.attach_stats(joins.attach_fewshot(ex, fs)).collect()[0]
    assert (st.attached, st.total) == (2, 3)


def test_merge_training_gated_on_match(spark):
    csv = spark.createDataFrame([(1, "a", "X", "fs1"), (2, "zz", "Y", "fs2")], "id long, input string, answer string, few_shot string")
    canon = spark.createDataFrame([(7, "a", None, 70), (3, "a", "P", 30)], "id long, input string, answer string, context_id long")
    m = {r.id: (r.answer, r.context_id, r.matched, r.few_shot) for r in joins.merge_training(csv, canon).collect()}
    # canonical id 7 wins; its null answer is taken (gated on the match, not on the value)
    assert m == {1: (None, 70, True, "fs1"), 2: ("Y", None, False, "fs2")}


def test_fill_failures(spark):
    grid = spark.createDataFrame([(1, 0), (1, 1)], "claim_id long, candidate_id int")
    out = spark.createDataFrame([(1, 0, "supported")], "claim_id long, candidate_id int, response string")
    gold = spark.createDataFrame([(1, "NOT_SUPPORTED")], "claim_id long, answer string")
    f = {r.candidate_id: (r.failed, r.predicted_label, r.score)
         for r in joins.fill_claim_failures(grid, out, gold, failure_score=-1.0).collect()}
    assert f == {0: (False, "SUPPORTED", 0.0), 1: (True, "NOT_SUPPORTED", -1.0)}


def test_pass_at_k_monotone_and_golden(spark):
    rows = [(1, 0, 1, False, "SyntaxError"), (1, 0, 2, False, None), (1, 0, 3, True, None),
            (2, 0, 1, True, None), (3, 0, 4, True, None)]
    g = spark.createDataFrame(rows, "task_id long, candidate_id int, sample_idx long, passed boolean, error_type string")
    r = metrics.pass_at_k(g).collect()[0]
    assert (r.solved_at_1, r.solved_at_3, r.solved_at_5) == (1, 2, 3)
    assert r.pass_at_1 <= r.pass_at_3 <= r.pass_at_5
    p1 = metrics.pass_at_1(g).collect()[0]
    errs = metrics.error_distribution(g, first_sample=True).collect()
    assert sum(e.n for e in metrics.error_distribution(g).collect()) == 2
    assert p1.passed + sum(e.n for e in errs) == p1.total
    rep = {x.task_id: x.sample_text for x in metrics.sample_report(g, k=5).collect()}
    assert rep[1] == "1:F(SyntaxError),2:F,3:P"


def test_label_distribution_keeps_zero(spark):
    s = spark.createDataFrame([(0, "SUPPORTED"), (0, "SUPPORTED")], "candidate_id int, predicted_label string")
    ex = spark.createDataFrame([("SUPPORTED",), ("NOT_SUPPORTED",), ("NOT_SUPPORTED",)], "answer string")
    d = {r.label: (r.predicted, r.actual) for r in metrics.label_distribution(s, ex).collect()}
    assert d == {"SUPPORTED": (2, 1), "NOT_SUPPORTED": (0, 2)}


def test_frontier_best_and_gate(spark):
    rows = [(1, 0, 1.0), (1, 1, 1.0), (2, 0, 0.0), (2, 1, 0.0), (3, 0, 0.0), (3, 1, 1.0)]
    s = spark.createDataFrame(rows, "claim_id long, candidate_id int, score double")
    f = {r.claim_id: r.frontier for r in candidates.instance_frontier(s).collect()}
    assert f == {1: [0, 1], 2: [0, 1], 3: [1]}
    fs = candidates.frontier_score(candidates.instance_frontier(s)).collect()[0]
    assert fs.frontier_score == 1.0 and abs(fs.solved_by_any - 2 / 3) < 1e-12
    sc = candidates.candidate_scores(s)
    b = candidates.best_candidate(sc).collect()[0]
    assert b.best_candidate_id == 1
    tie = spark.createDataFrame([(3, 0.5), (1, 0.5), (2, 0.1)], "candidate_id int, val_score double")
    assert candidates.best_candidate(tie).collect()[0].best_candidate_id == 1
    mb = spark.createDataFrame([(0, 1), (0, 3)], "iteration long, claim_id long")
    pairs = spark.createDataFrame([(0, 1, 0)], "iteration long, candidate_id int, parent_id int")
    gate = candidates.minibatch_gate(s, mb, pairs).collect()[0]
    assert (gate.new_score, gate.parent_score, gate.promote) == (2.0, 1.0, True)


def test_compare_zero_baseline_and_verdict(spark):
    m = spark.createDataFrame([("r", "1", 0, 10), ("r", "2", 1, 10)], "run_id string, variant string, correct long, total long")
    c = {r.variant: r.delta_percent for r in compare.compare(m, "1", None).collect()}
    assert c == {"1": None, "2": None}
    z = {r.variant: r.delta_percent for r in compare.compare(m, "1", 0.0).collect()}
    assert z == {"1": 0.0, "2": 0.0}
    v = {r.variant: r.verdict for r in compare.verdict(compare.compare(m, "1")).collect()}
    assert v == {"1": "NO_CHANGE", "2": "IMPROVED"}


def test_parse_reflections_and_failures(spark):
    out = "MUTATION_ANALYSIS: x\n\nSUGGESTED_PROMPT_CHANGE: a\nSUGGESTED_PROMPT_CHANGE: name it\n\nPRIORITY_LEVEL: HIGH"
    df = spark.createDataFrame([(1, out), (2, "nothing")], "event_id long, reflector_output string")
    p = {r.event_id: (r.change_raw, r.change, r.analysis, r.priority) for r in feedback.parse_reflections(df).collect()}
    assert p[1] == ("name it\n\nPRIORITY_LEVEL: HIGH", "name it", "x", "HIGH")
    assert p[2] == ("See log", "See log", None, None)
    d = spark.createDataFrame([(1, False, "E"), (2, None, "E"), (3, True, None)], "task_id long, passed boolean, error_type string")
    f = feedback.extract_failures(d, ["task_id"]).collect()
    assert [(r.task_id, r.entry_point, r.error_message) for r in f] == [(1, "unknown", "No error message")]
    claims_rows = spark.createDataFrame([(1, "full_response", "SUPPORTED")], "i long, full_response string, predicted_label string")
    assert feedback.extract_failures(claims_rows, ["i"]).count() == 0


def test_feedback_empty_raises(spark):
    s = spark.createDataFrame([], "claim_id long, input string, response string, predicted_label string, answer string, score double")
    with pytest.raises(ValueError):
        feedback.claims_feedback(s, check_nonempty=True)


def test_code_feedback_traceback_only_when_present(spark):
    rows = [(1, "f", "def f", "code", "failed", "AssertionError", "boom", "", 0.0),
            (2, "g", "def g", "code", "failed", "AssertionError", "boom", "tb", 0.0),
            (3, "h", "def h", "code", "passed", None, None, None, 1.0)]
    df = spark.createDataFrame(rows, "task_id long, entry_point string, prompt string, code string, exec_status string, "
                                     "error_type string, error_message string, traceback string, score double")
    fb = {r.task_id: r.feedback for r in feedback.code_feedback(df).collect()}
    assert "Traceback" not in fb[1] and "\nTraceback:\ntb" in fb[2]
    assert fb[1].endswith("- Edge cases may not be handled properly")
    assert fb[3].startswith("PASSED: Task 3")


def test_candidate_analytics_per_run(spark):
    rows = [("a", 1, 0, 1.0), ("a", 1, 1, 0.0), ("a", 2, 0, 0.0), ("a", 2, 1, 1.0),
            ("b", 1, 0, 0.0), ("b", 1, 1, 1.0), ("b", 2, 0, 0.0), ("b", 2, 1, 1.0)]
    s = spark.createDataFrame(rows, "run string, claim_id long, candidate_id int, score double")
    sc = candidates.candidate_scores(s, by=["run"])
    best = {r.run: (r.best_candidate_id, r.best_score) for r in candidates.best_candidate(sc, by=["run"]).collect()}
    assert best == {"a": (0, 0.5), "b": (1, 1.0)}
    fr = candidates.instance_frontier(s, by=["run"])
    summ = {r.run: (r.best_candidate_id, r.frontier_score, r.num_candidates)
            for r in compare.run_summary(sc, candidates.frontier_score(fr, by=["run"]), by=["run"]).collect()}
    assert summ == {"a": (0, 1.0, 2), "b": (1, 1.0, 2)}
    prog = {(r.run, r.candidate_id): r.prev_score for r in candidates.score_progression(sc, by=["run"]).collect()}
    assert prog[("b", 1)] == 0.0 and prog[("a", 0)] is None


def test_summarize_run_equals_composed(spark):
    import random
    rnd = random.Random(5)
    rows = [(e, c, float(rnd.random() < 0.4 + 0.1 * c)) for e in range(300) for c in range(4)]
    s = spark.createDataFrame(rows, "claim_id long, candidate_id int, score double")
    one = compare.summarize_run(s).collect()[0].asDict()
    composed = compare.run_summary(candidates.candidate_scores(s),
                                   candidates.frontier_score(candidates.instance_frontier(s))).collect()[0].asDict()
    assert one.keys() == composed.keys()
    for k in one:
        assert one[k] == pytest.approx(composed[k]), k


def test_extract_failures_limit(spark):
    rows = [(i, i % 3 == 0, "E") for i in range(100)]
    d = spark.createDataFrame(rows, "task_id long, passed boolean, error_type string")
    first = [(r.failure_idx, r.task_id) for r in feedback.extract_failures(d, ["task_id"], limit=5).orderBy("failure_idx").collect()]
    assert first == [(1, 1), (2, 2), (3, 4), (4, 5), (5, 7)]
    assert feedback.extract_failures(d, ["task_id"]).count() == 66


def test_empty_inputs_and_missing_baseline(spark):
    none = spark.createDataFrame([], "claim_id long, candidate_id int, score double")
    f = candidates.instance_frontier(none)
    assert f.collect() == []
    assert [(r.n_examples, r.frontier_score, r.solved_by_any) for r in candidates.frontier_score(f).collect()] == [(0, 0.0, 0.0)]
    s = compare.summarize_run(none).collect()[0]
    assert (s.num_candidates, s.n_examples, s.frontier_score, s.best_candidate_id, s.improvement_pct) == (0, 0, 0.0, None, 0.0)
    m = spark.createDataFrame([("r", "2", 5, 10)], "run_id string, variant string, correct long, total long")
    assert [r.verdict for r in compare.verdict(compare.compare(m, baseline="1")).collect()] == [None]


def test_frontier_of_many_candidates(spark):
    s = spark.range(0, 10_500).select(F.lit(1).alias("claim_id"), F.col("id").cast("int").alias("candidate_id"), (F.col("id") % 7 == 0).cast("double").alias("score"))
    r = candidates.instance_frontier(s).collect()[0]
    assert r.best_score == 1.0 and r.frontier == list(range(0, 10_500, 7))
    assert compare.summarize_run(s).collect()[0].num_candidates == 10_500


def test_latest_required(spark):
    df = spark.createDataFrame([("a", "run_1", 1.0), ("a", "run_2", 2.0)], "exp string, run string, score double")
    assert compare.latest(df, "exp", "run").collect()[0].score == 2.0
    with pytest.raises(ValueError):
        compare.latest(df.limit(0), "exp", "run", required=True)


def test_leaderboard_ranks_alike_by_window_and_by_ranges(spark, monkeypatch):
    from evalframe.operators import compare
    rows = [(f"r{i}", str(v), None if i == 7 else ((i * 7 + v) % 13) / 13) for i in range(40) for v in (1, 2, 3)]
    df = spark.createDataFrame(rows, "run_id string, variant string, accuracy double")
    want = sorted(map(tuple, compare.leaderboard(df).collect()), key=repr)
    monkeypatch.setattr(compare, "FEW", 3)
    assert sorted(map(tuple, compare.leaderboard(df).collect()), key=repr) == want
    best = {r[0]: max((a for q, _, a in rows if q == r[0] and a is not None), default=None) for r in rows}
    order = sorted({b for b in best.values() if b is not None}, reverse=True)
    got = {r.run_id: r["rank"] for r in compare.leaderboard(df).collect()}
    assert all(got[q] == order.index(b) + 1 for q, b in best.items() if b is not None)
