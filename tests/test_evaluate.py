"""End-to-end flows with stub model / scorer functions."""

import pandas as pd
from pyspark.sql import functions as F

from evalframe.plans import evaluate


def test_evaluate_claims_flow(spark, tmp):
    ex = spark.createDataFrame([(1, "Claim: a", "SUPPORTED"), (2, "Claim: b", "NOT_SUPPORTED"), (3, "Claim: c", "SUPPORTED")],
                               "claim_id long, input string, answer string")
    cands = spark.createDataFrame([(0, "seed prompt"), (1, "better prompt")], "candidate_id int, system_prompt string")

    def model(batch):
        if (batch["user_content"] == "Claim: c").any() and (batch["system_content"] == "seed prompt").any():
            raise RuntimeError("whole call failed")
        return ["SUPPORTED" if "better" in s or u.endswith(": a") else "refuted"
                for s, u in zip(batch["system_content"], batch["user_content"])]

    r = evaluate.evaluate_claims(ex, cands, model, out_dir=tmp, batch_size=8)
    acc = {x.candidate_id: (x.correct, x.total) for x in r["accuracy"].collect()}
    # seed: claim 1 right, claim 2 right, claim 3 failed (failure score); better: 1 and 3 right
    assert acc == {0: (2, 3), 1: (2, 3)}
    failed = {(x.claim_id, x.candidate_id) for x in r["scored"].filter("failed").collect()}
    assert failed == {(3, 0)}
    v = {x.candidate_id: x.verdict for x in r["comparison"].collect()}
    assert v == {0: "NO_CHANGE", 1: "NO_CHANGE"}


def test_evaluate_code_flow(spark, tmp):
    tasks = spark.createDataFrame([(1, "def f1():", "f1", "assert f1() == 1"), (2, "def f2():", "f2", "")],
                                  "task_id long, prompt string, entry_point string, test string")
    cands = spark.createDataFrame([(0, "seed"), (1, "opt")], "candidate_id int, system_prompt string")

    def model(batch):
        out = []
        for s, i in zip(batch["system_content"], batch["sample_idx"]):
            body = "def f1(): return 1" if (s == "opt" or i >= 3) else "def g(): pass"
            out.append(f"```python\n{body}\n```")
        return out

    def scorer(batch):
        ok = [("return 1" in c) for c in batch["code"]]
        return pd.DataFrame({"passed": ok, "error_type": [None if o else "AssertionError" for o in ok],
                             "error_message": None, "traceback": None})

    r = evaluate.evaluate_code(tasks, cands, model, scorer, ks=(1, 3, 5), out_dir=tmp)
    pk = {x.candidate_id: (x.solved_at_1, x.solved_at_3, x.n_tasks) for x in r["pass_at_k"].collect()}
    # task 2 has no test -> never solved; seed solves task 1 from sample 3 on
    assert pk == {0: (0, 1, 2), 1: (1, 1, 2)}
    errs = {(x.candidate_id, x.error_type): x.n for x in r["errors"].collect()}
    assert errs == {(0, "MissingFunction"): 1, (0, "NoTestCode"): 1, (1, "NoTestCode"): 1}
    c = r["comparison"].collect()[0]
    assert c.verdict == "IMPROVED" and c.additional_problems_solved == 1


def test_reflection_log_flow(spark):
    d = spark.createDataFrame([(29, "f", False, "MissingFunction", "not found", ""), (15, "g", None, "SyntaxError", "bad", ""),
                               (3, "h", False, "IndexError", "idx", "tb")],
                              "task_id long, entry_point string, passed boolean, error_type string, error_message string, traceback string")

    def reflector(batch):
        return [f"MUTATION_ANALYSIS: a\nSUGGESTED_PROMPT_CHANGE: fix {len(r)}\nPRIORITY_LEVEL: LOW" for r in batch["request"]]

    r = evaluate.reflection_log(d, reflector, ["task_id"], run_name="run1", limit=5)
    s = r["summary"].collect()[0]
    assert (s.failures_found, s.reflections_generated, s.suggestions) == (2, 2, 2)
    assert {x.data.task_id for x in r["events"].filter("event_type = 'reflector_invocation'").collect()} == {"3", "29"}
    assert r["reflections"].filter(F.col("change").startswith("fix")).count() == 2


def test_resumed_flow_calls_each_key_once(spark, tmp):
    ex = spark.createDataFrame([(i, f"Claim: {i}", "SUPPORTED") for i in range(20)], "claim_id long, input string, answer string")
    cands = spark.createDataFrame([(0, "seed"), (1, "opt")], "candidate_id int, system_prompt string")
    calls = f"{tmp}/calls"

    def model(batch):
        with open(calls, "a") as f:
            f.write("".join(f"{c} {k}\n" for c, k in zip(batch["claim_id"], batch["candidate_id"])))
        return ["SUPPORTED" if c else "refuted" for c in batch["candidate_id"]]

    evaluate.evaluate_claims(ex.filter("claim_id < 7"), cands, model, out_dir=f"{tmp}/o")
    r = evaluate.evaluate_claims(ex, cands, model, out_dir=f"{tmp}/o")
    full = evaluate.evaluate_claims(ex, cands, lambda b: ["SUPPORTED" if c else "refuted" for c in b["candidate_id"]], out_dir=f"{tmp}/p")
    key = lambda d: sorted((x.candidate_id, x.correct, x.total) for x in d["accuracy"].collect())
    assert key(r) == key(full) == [(0, 0, 20), (1, 20, 20)]
    lines = open(calls).read().split("\n")[:-1]
    assert len(lines) == len(set(lines)) == 40


def test_repeated_entry_points_keep_their_own_test(spark, tmp):
    tasks = spark.createDataFrame([(1, "p", "s", "good"), (2, "p", "s", "bad")], "task_id long, prompt string, entry_point string, test string")
    cands = spark.createDataFrame([(0, "seed"), (1, "opt")], "candidate_id int, system_prompt string")

    def scorer(batch):
        if (batch["test"] == "bad").any() and len(batch) > 1:
            raise RuntimeError("runner broke")
        return pd.DataFrame({"passed": batch["test"] == "good", "error_type": None, "error_message": "m", "traceback": "t"})

    r = evaluate.evaluate_code(tasks, cands, lambda b: ["def s(): pass"] * len(b), scorer, ks=(1,), out_dir=tmp, failure_score=-1.0)
    assert r["generations"].count() == 4
    assert {x.candidate_id: x.pass_at_1 for x in r["pass_at_k"].collect()} == {0: 0.5, 1: 0.5}
    bad = r["generations"].filter("task_id = 2").collect()
    assert {(x.error_message, x.traceback, x.score) for x in bad} == {("m", "t", 0.0)}
    f = evaluate.code_feedback_of(r["generations"], only_failed=True).collect()
    assert len(f) == 2 and all("Error Message: m" in x.feedback and "Traceback" in x.feedback for x in f)


def test_failed_calls_and_messages_of_the_code_flow(spark, tmp):
    tasks = spark.createDataFrame([(1, "p", "s", "t"), (2, "p", "s", ""), (3, "p", "q", "t")], "task_id long, prompt string, entry_point string, test string")
    cands = spark.createDataFrame([(0, "seed")], "candidate_id int, system_prompt string")

    def model(batch):
        if (batch["task_id"] == 1).any():
            raise RuntimeError("down")
        return ["def s(): pass"] * len(batch)

    r = evaluate.evaluate_code(tasks, cands, model, lambda b: pd.DataFrame({"passed": [True] * len(b)}), ks=(1,), out_dir=tmp, failure_score=-1.0)
    got = {x.task_id: (x.error_type, x.error_message, x.status, x.score) for x in r["generations"].collect()}
    assert got == {1: ("LLMError", "RuntimeError: down", "llm_error", -1.0), 2: ("NoTestCode", "No test code provided for this problem", "failed", 0.0),
                   3: ("MissingFunction", "Function 'q' not found in generated code", "failed", 0.0)}


def test_reflector_is_called_once_and_logged(spark, tmp):
    from evalframe.operators.events import batch_audit
    from evalframe.sources.files import read_events
    d = spark.createDataFrame([(i, "f", False, "E", "m", "") for i in range(5)], "task_id long, entry_point string, passed boolean, error_type string, error_message string, traceback string")
    calls = f"{tmp}/calls"

    def reflector(batch):
        with open(calls, "a") as f:
            f.write("x\n" * len(batch))
        return ["SUGGESTED_PROMPT_CHANGE: x"] * len(batch)

    r = evaluate.reflection_log(d, reflector, ["task_id"], run_name="run1", log_path=f"{tmp}/log", model="m1")
    assert r["reflections"].count() == 5 and r["summary"].collect()[0].suggestions == 5
    assert len(open(calls).read().split()) == 5
    a = batch_audit(read_events(spark, f"{tmp}/log/run1")).collect()
    assert [(x.run_name, x.n_invocations, x.declared, x.processed, x.complete) for x in a] == [("run1", 5, 5, 5, True)]
