"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame over the whole tables.

Output columns are named exactly like the oracle SQL's (see ``oracle.py``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.functions.code import extract_code, status_of
from evalframe.functions.verdicts import normalize_gold, parse_verdict
from evalframe.operators import (candidates, compare, events, feedback,
                                 joins, metrics, shaping, splits)
from evalframe.plans.views import Fixture

SYSTEM_PROMPT = "Decide whether the context supports the claim. Answer SUPPORTED or NOT_SUPPORTED."
SPLIT_SEED = 42
SAMPLE_SEED = 7

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn=None, *, name: str | None = None):
    """Register a query under its function name (or ``name``)."""
    def register(f):
        QUERIES[name or f.__name__] = f
        return f
    return register(fn) if fn is not None else register


# ---------------------------------------------------------------- shared steps
def claims(fx: Fixture) -> DataFrame:
    return shaping.format_claims(fx.view("v_claims"))


def scored_claims(fx: Fixture) -> DataFrame:
    return joins.parse_and_score(fx.view("v_responses"), claims(fx).select("claim_id", "answer"))


def candidate_val_scores(fx: Fixture) -> DataFrame:
    return candidates.candidate_scores(scored_claims(fx))


def frontier(fx: Fixture) -> DataFrame:
    return candidates.instance_frontier(scored_claims(fx))


def claims_grid(fx: Fixture) -> DataFrame:
    return joins.evaluation_grid(fx.view("v_claims").select("claim_id"), fx.view("v_candidates"))


def train_ids(fx: Fixture) -> DataFrame:
    s = splits.split_fraction(fx.view("v_claims").select("claim_id"), "claim_id", 0.8, SPLIT_SEED)
    return s.filter(F.col("split") == "train").select("claim_id")


def exec_status(df: DataFrame) -> DataFrame:
    return df.withColumn("status", status_of(F.col("passed"), F.col("error_type")))


# ---------------------------------------------------------------- B: shaping
@query
def claims_format(spark, sf_dir):
    return claims(Fixture(spark, sf_dir))


@query
def gold_labels(spark, sf_dir):
    fx = Fixture(spark, sf_dir)
    return fx.view("v_claims").select("claim_id", "label_raw", normalize_gold(F.col("label_raw")).alias("answer"))


@query
def code_tasks_format(spark, sf_dir):
    fx = Fixture(spark, sf_dir)
    f = shaping.format_code_tasks(fx.view("v_code_tasks"))
    ctx = F.col("additional_context")
    return f.select("task_id", "input", "answer", ctx["task_id"].alias("ctx_task_id"),
                    ctx["entry_point"].alias("ctx_entry_point"), ctx["test"].alias("ctx_test"))


@query
def task_signatures(spark, sf_dir):
    fx = Fixture(spark, sf_dir)
    return shaping.describe_tasks(fx.view("v_code_tasks")).select("task_id", "signature", "docstring")


@query
def fewshot_requests(spark, sf_dir):
    return shaping.fewshot_requests(claims(Fixture(spark, sf_dir))).select("claim_id", "request")


@query
def fewshot_validate(spark, sf_dir):
    fx = Fixture(spark, sf_dir)
    p = shaping.parse_fewshot(fx.view("v_fewshot"))
    return p.select("id", "valid", "n_items",
                    F.array_join(F.transform("items", lambda x: x["label"]), ",").alias("labels"))


def _claims_requests(fx: Fixture) -> DataFrame:
    ex = claims(fx).join(fx.view("v_claims").select("claim_id", "evidence"), "claim_id")
    fs = fx.view("v_fewshot_gaps").withColumnRenamed("reply", "few_shot")
    att = joins.attach_fewshot(ex, fs, example_key="evidence", fewshot_key="input", value_col="few_shot")
    val = shaping.parse_fewshot(att, reply="few_shot")
    return shaping.build_requests(val, style="claims", items="items", system_prompt=SYSTEM_PROMPT)


@query
def requests_claims(spark, sf_dir):
    return _claims_requests(Fixture(spark, sf_dir)).select("claim_id", "system_content", "user_content")


@query
def requests_code(spark, sf_dir):
    fx = Fixture(spark, sf_dir)
    t = fx.view("v_code_tasks")
    neighbour = t.select((F.col("task_id") - 1).alias("task_id"),
                         F.struct(F.col("prompt").alias("input"), F.col("test").alias("solution")).alias("_item"))
    j = t.join(neighbour, "task_id", "left").withColumn("items", F.when(F.col("_item").isNotNull(), F.array("_item")))
    r = shaping.build_requests(j, style="code", input_col="prompt", items="items", system_prompt=SYSTEM_PROMPT)
    return r.select("task_id", "user_content")


@query
def flatten_messages(spark, sf_dir):
    return shaping.flatten_messages(Fixture(spark, sf_dir).table("conversations"))


# ---------------------------------------------------------------- C: splits
@query
def split_fraction(spark, sf_dir):
    fx = Fixture(spark, sf_dir)
    return splits.split_fraction(fx.view("v_claims").select("claim_id"), "claim_id", 0.8, SPLIT_SEED)


@query
def split_fixed(spark, sf_dir):
    fx = Fixture(spark, sf_dir)
    return splits.split_fixed(fx.view("v_claims").select("claim_id"), "claim_id", (50, 50), SPLIT_SEED)


@query
def sample_n(spark, sf_dir):
    fx = Fixture(spark, sf_dir)
    return splits.sample_n(fx.view("v_claims").select("claim_id"), "claim_id", 100, SAMPLE_SEED)


@query
def head_pct(spark, sf_dir):
    fx = Fixture(spark, sf_dir)
    return splits.head_pct(fx.view("v_claims").select("claim_id"), "claim_id", 25)


@query
def holdout(spark, sf_dir):
    fx = Fixture(spark, sf_dir)
    c = claims(fx).select("claim_id", "input")
    train = c.join(train_ids(fx), "claim_id")
    return splits.holdout(c, train, "input").select("claim_id")


@query
def batch_ranges(spark, sf_dir):
    fx = Fixture(spark, sf_dir)
    return splits.batch_ranges(fx.view("v_claims").select("claim_id"), 50)


@query
def remaining_work(spark, sf_dir):
    fx = Fixture(spark, sf_dir)
    done = fx.view("v_responses").filter(F.col("response") != "")
    return splits.remaining(claims_grid(fx).select("claim_id", "candidate_id"), done, ["claim_id", "candidate_id"])


@query
def minibatches(spark, sf_dir):
    fx = Fixture(spark, sf_dir)
    return splits.minibatches(fx.view("v_claims").select("claim_id"), "claim_id", size=5, iters=20, seed=SPLIT_SEED)


# ---------------------------------------------------------------- D: joins
@query
def evaluation_grid(spark, sf_dir):
    return claims_grid(Fixture(spark, sf_dir))


@query
def score_claims(spark, sf_dir):
    return scored_claims(Fixture(spark, sf_dir)).select("claim_id", "candidate_id", "predicted_label", "answer",
                                                        "correct", "score")


@query
def attach_fewshot(spark, sf_dir):
    fx = Fixture(spark, sf_dir)
    a = joins.attach_fewshot(fx.view("v_claims").select("claim_id", "evidence"),
                             fx.view("v_fewshot_gaps").withColumnRenamed("reply", "few_shot"),
                             example_key="evidence", fewshot_key="input", value_col="few_shot")
    return a.select("claim_id", "fewshot_id", "few_shot", "attached")


@query
def merge_training(spark, sf_dir):
    fx = Fixture(spark, sf_dir)
    c = fx.view("v_claims")
    canon = (c.join(train_ids(fx), "claim_id")
              .select(F.col("claim_id").alias("id"), F.col("evidence").alias("input"),
                      normalize_gold(F.col("label_raw")).alias("answer"), F.col("claim_id").alias("context_id")))
    csv = fx.view("v_fewshot_gaps").select("id", "input", F.col("reply").alias("few_shot"),
                                           F.lit(None).cast("string").alias("answer"))
    m = joins.merge_training(csv, canon, key="input", canonical_id="id", take=("answer", "context_id"))
    return m.select("id", "answer", "context_id", "matched", "few_shot")


@query
def fill_failures(spark, sf_dir):
    fx = Fixture(spark, sf_dir)
    landed = fx.view("v_responses").filter(F.col("response") != "")
    f = joins.fill_claim_failures(claims_grid(fx).select("claim_id", "candidate_id"), landed,
                                  claims(fx).select("claim_id", "answer"), failure_score=0.0)
    return f.select("claim_id", "candidate_id", "response", "failed", "predicted_label", "score")


@query
def error_guidance(spark, sf_dir):
    fx = Fixture(spark, sf_dir)
    g = exec_status(fx.view("v_generations")).filter(~F.col("passed"))
    return feedback.attach_guidance(g).select("task_id", "candidate_id", "sample_idx", "status", "error_type",
                                              "guidance_key", "guidance")


@query
def error_guidance_table(spark, sf_dir):
    """Guidance by rules that are rows: the fixed ones, and one per error type of the tables that names it in full."""
    g = exec_status(Fixture(spark, sf_dir).view("v_generations")).filter(~F.col("passed"))
    own = g.filter(F.col("error_type").isNotNull()).select("error_type").distinct().select(
        F.lit(1000).alias("priority"), F.upper("error_type").alias("rule"), F.concat(F.lit("see "), "error_type").alias("guidance"))
    rules = feedback.guidance_rules(spark).unionByName(own)
    return feedback.attach_guidance_table(g, rules).select("task_id", "candidate_id", "sample_idx", "status", "error_type", "guidance_key", "guidance")


# ---------------------------------------------------------------- E: parsing
@query
def parse_verdicts(spark, sf_dir):
    fx = Fixture(spark, sf_dir)
    return fx.view("v_responses").withColumn("predicted_label", parse_verdict(F.col("response")))


@query(name="extract_code")
def extract_code_query(spark, sf_dir):
    fx = Fixture(spark, sf_dir)
    return fx.view("v_code_replies").select("reply_id", "entry_point", extract_code(F.col("reply")).alias("code"))


def classified(fx: Fixture) -> DataFrame:
    from evalframe.operators.scoring import classify_generations as classify
    gens = fx.view("v_code_replies").select("reply_id", "task_id", extract_code(F.col("reply")).alias("code"))
    out = classify(gens, fx.view("v_code_tasks"), fx.view("v_exec_results"))
    return out.select("reply_id", "task_id", "entry_point", "passed", "error_type", "error_message", "status")


@query
def classify_generations(spark, sf_dir):
    return classified(Fixture(spark, sf_dir))


@query
def status_taxonomy(spark, sf_dir):
    fx = Fixture(spark, sf_dir)
    return exec_status(fx.view("v_generations")).select("task_id", "candidate_id", "sample_idx", "error_type", "status")


# ---------------------------------------------------------------- F: aggregates
@query
def accuracy(spark, sf_dir):
    return metrics.accuracy(scored_claims(Fixture(spark, sf_dir)))


@query
def label_distribution(spark, sf_dir):
    fx = Fixture(spark, sf_dir)
    return metrics.label_distribution(scored_claims(fx), claims(fx))


@query
def pass_at_1(spark, sf_dir):
    return metrics.pass_at_1(Fixture(spark, sf_dir).view("v_generations"))


@query
def error_distribution(spark, sf_dir):
    return metrics.error_distribution(Fixture(spark, sf_dir).view("v_generations"), first_sample=False)


@query
def error_distribution_first(spark, sf_dir):
    return metrics.error_distribution(Fixture(spark, sf_dir).view("v_generations"), first_sample=True)


@query
def pass_at_k(spark, sf_dir):
    return metrics.pass_at_k(Fixture(spark, sf_dir).view("v_generations"), ks=(1, 3, 5))


@query
def sample_report(spark, sf_dir):
    r = metrics.sample_report(Fixture(spark, sf_dir).view("v_generations"), k=5)
    return r.select("candidate_id", "task_id", "samples_passed", "samples", "solved", "sample_text")


@query
def candidate_scores(spark, sf_dir):
    return candidate_val_scores(Fixture(spark, sf_dir))


@query
def best_candidate(spark, sf_dir):
    return candidates.best_candidate(candidate_val_scores(Fixture(spark, sf_dir)))


@query
def instance_frontier(spark, sf_dir):
    f = frontier(Fixture(spark, sf_dir))
    return f.select("claim_id", "best_score", F.array_join(F.col("frontier").cast("array<string>"), ",").alias("frontier"),
                    "frontier_size")


@query
def frontier_score(spark, sf_dir):
    return candidates.frontier_score(frontier(Fixture(spark, sf_dir)))


@query
def frontier_coverage(spark, sf_dir):
    fx = Fixture(spark, sf_dir)
    return candidates.frontier_coverage(frontier(fx), fx.view("v_candidates"))


def gate_pairs(fx: Fixture) -> DataFrame:
    # candidate c > 0 is proposed at iteration c - 1 with parent c - 1
    k = fx.view("v_candidates").filter(F.col("candidate_id") > 0)
    return k.select((F.col("candidate_id") - 1).cast("long").alias("iteration"), "candidate_id",
                    (F.col("candidate_id") - 1).alias("parent_id"))


@query
def frontier_bitmaps(spark, sf_dir):
    """How many examples each candidate is on the frontier of, by bitmaps of wins."""
    fx = Fixture(spark, sf_dir)
    return candidates.coverage_of(candidates.win_bitmaps(scored_claims(fx)), fx.view("v_candidates"))


@query
def undominated_candidates(spark, sf_dir):
    """Candidates whose wins no other candidate has all of, with wins and mean score."""
    scored = scored_claims(Fixture(spark, sf_dir))
    return candidates.undominated(candidates.win_bitmaps(scored), candidates.candidate_scores(scored))


@query
def select_parents(spark, sf_dir):
    """Two parents for each of 50 rounds, drawn from the undominated candidates by their wins."""
    scored = scored_claims(Fixture(spark, sf_dir))
    front = candidates.undominated(candidates.win_bitmaps(scored), candidates.candidate_scores(scored))
    rounds = front.withColumn("iteration", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(50).cast("long"))))
    return candidates.select_parents(rounds, 2, by=["iteration"], round_=F.col("iteration")).select("iteration", "draw", "candidate_id", "n_wins")


@query
def minibatch_gate(spark, sf_dir):
    fx = Fixture(spark, sf_dir)
    mb = splits.minibatches(fx.view("v_claims").select("claim_id"), "claim_id", size=5, iters=20, seed=SPLIT_SEED)
    return candidates.minibatch_gate(scored_claims(fx), mb, gate_pairs(fx))


@query
def score_progression(spark, sf_dir):
    return candidates.score_progression(candidate_val_scores(Fixture(spark, sf_dir)))


# ---------------------------------------------------------------- G: comparison and feedback
def run_metrics(fx: Fixture) -> DataFrame:
    return fx.view("v_run_metrics")


@query
def compare_variants(spark, sf_dir):
    c = compare.compare(run_metrics(Fixture(spark, sf_dir)), baseline="1", zero_baseline=None)
    return c.select("run_id", "variant", "correct", "total", "accuracy", "delta_absolute", "delta_percent",
                    "additional_correct")


@query
def verdict(spark, sf_dir):
    c = compare.verdict(compare.compare(run_metrics(Fixture(spark, sf_dir)), baseline="1"))
    return c.select("run_id", "variant", "verdict", "accuracy_pct", "baseline_pct", "improvement_pct")


@query
def comparison_wide(spark, sf_dir):
    c = compare.compare(run_metrics(Fixture(spark, sf_dir)), baseline="1")
    return compare.comparison_doc(c, ["1", "2", "3", "4", "5"])


@query
def run_summary(spark, sf_dir):
    # one pass over the scored grid (compare.run_summary composes the same from separate tables)
    return compare.summarize_run(scored_claims(Fixture(spark, sf_dir)))


@query
def latest_run(spark, sf_dir):
    c = compare.compare(run_metrics(Fixture(spark, sf_dir)), baseline="1")
    return compare.latest(c.select("variant", "run_id", "accuracy"), by="variant", order="run_id") \
        .withColumnRenamed("run_id", "latest_run_id")


@query
def leaderboard(spark, sf_dir):
    c = compare.compare(run_metrics(Fixture(spark, sf_dir)), baseline="1")
    return compare.leaderboard(c)


@query
def candidate_comparison(spark, sf_dir):
    """Flagship: every candidate vs the seed prompt on all claims (accuracy, deltas, verdict)."""
    fx = Fixture(spark, sf_dir)
    acc = metrics.accuracy(scored_claims(fx)).withColumn("run_id", F.lit("claims")) \
        .withColumnRenamed("candidate_id", "variant")
    v = compare.verdict(compare.compare(acc, baseline=0, run="run_id", variant="variant"))
    return v.select(F.col("variant").alias("candidate_id"), "correct", "total", "accuracy", "delta_absolute",
                    "delta_percent", "additional_correct", "verdict", "accuracy_pct", "improvement_pct")


@query
def claims_feedback(spark, sf_dir):
    fx = Fixture(spark, sf_dir)
    s = scored_claims(fx).join(claims(fx).select("claim_id", "input"), "claim_id")
    return feedback.claims_feedback(s).select("claim_id", "candidate_id", "status", "predicted_label", "answer",
                                              "feedback", "score", "component")


@query
def code_feedback(spark, sf_dir):
    fx = Fixture(spark, sf_dir)
    g = fx.view("v_code_generations").withColumn("exec_status", status_of(F.col("passed"), F.col("error_type"))) \
        .withColumn("score", F.when(F.col("passed"), F.lit(1.0)).otherwise(F.lit(0.0)))
    return feedback.code_feedback(g)


@query
def failure_digest(spark, sf_dir):
    fx = Fixture(spark, sf_dir)
    d = feedback.failure_digest(exec_status(fx.view("v_exec_details")))
    return d.select("task_id", "candidate_id", "sample_idx", "digest")


def failures(fx: Fixture) -> DataFrame:
    d = fx.view("v_exec_details").select("task_id", "candidate_id", "sample_idx", "passed", "error_type",
                                         "error_message", "traceback")
    return feedback.extract_failures(d, ["task_id", "candidate_id", "sample_idx"])


@query
def extract_failures(spark, sf_dir):
    return failures(Fixture(spark, sf_dir)).select("failure_idx", "task_id", "candidate_id", "sample_idx",
                                                   "entry_point", "error_type", "error_message", "traceback",
                                                   "guidance")


@query
def reflection_requests(spark, sf_dir):
    return feedback.reflection_requests(failures(Fixture(spark, sf_dir))).select("failure_idx", "request")


@query
def parse_reflections(spark, sf_dir):
    fx = Fixture(spark, sf_dir)
    return feedback.parse_reflections(fx.view("v_reflections")).select(
        "event_id", "has_change", "change_raw", "change", "analysis", "priority")


@query
def reflection_summary(spark, sf_dir):
    fx = Fixture(spark, sf_dir)
    return feedback.reflection_summary(fx.view("v_event_log"), fx.view("v_reflections"))


@query
def error_shift(spark, sf_dir):
    return feedback.error_shift(Fixture(spark, sf_dir).view("v_generations"), first_sample=False)


@query
def error_shift_first(spark, sf_dir):
    return feedback.error_shift(Fixture(spark, sf_dir).view("v_generations"), first_sample=True)


# ---------------------------------------------------------------- H: logs
@query
def token_rollup(spark, sf_dir):
    return events.token_rollup(Fixture(spark, sf_dir).view("v_event_log"))


@query
def batch_audit(spark, sf_dir):
    return events.batch_audit(Fixture(spark, sf_dir).view("v_event_log"))


@query
def call_latency(spark, sf_dir):
    return events.call_latency(Fixture(spark, sf_dir).view("v_event_log")).select("event_id", "run_name", "gap_us")


@query
def progress(spark, sf_dir):
    p = events.progress(Fixture(spark, sf_dir).view("v_event_log"))
    return p.select("event_id", "run_name", "processed", "total", "pct", "milestone")


@query
def latest_metric(spark, sf_dir):
    return events.latest_metric(Fixture(spark, sf_dir).view("v_metrics"))



# ---------------------------------------------------------------- A: sources and sinks
@query
def detailed_flatten(spark, sf_dir):
    """Detailed-results documents (one per task, a list per prompt type) flattened back to rows."""
    from evalframe.sources.files import flatten_detailed
    g = Fixture(spark, sf_dir).view("v_generations")
    item = F.struct(F.col("task_id"), F.col("sample_idx"), F.col("passed"), F.col("error_type"))
    docs = g.groupBy("task_id").agg(F.to_json(F.struct(
        F.collect_list(F.when(F.col("candidate_id") == 0, item)).alias("seed_results"),
        F.collect_list(F.when(F.col("candidate_id") == 1, item)).alias("optimized_results"))).alias("doc"))
    t = "struct<task_id:bigint,sample_idx:bigint,passed:boolean,error_type:string>"
    return flatten_detailed(docs, "doc", t).select("prompt_type", "task_id", "sample_idx", "passed", "error_type")


@query
def split_roundtrip(spark, sf_dir):
    """Code tasks written as a split CSV (multi-line quoted texts) and read back."""
    from evalframe.session import scratch_path
    from evalframe.sources.files import code_split_rows, read_split, write_split
    path = scratch_path(spark, "split")
    write_split(code_split_rows(Fixture(spark, sf_dir).view("v_code_tasks")), path, mode="overwrite")
    r = read_split(spark, path)
    return r.select("task_id", "entry_point", "input", "answer", "test",
                    F.col("additional_context")["test"].alias("ctx_test"))


@query
def fewshot_roundtrip(spark, sf_dir):
    """Validated few-shots written to a few-shot CSV and read back (items or raw text)."""
    from evalframe.session import scratch_path
    from evalframe.sources.files import read_fewshot, write_fewshot
    fx = Fixture(spark, sf_dir)
    p = shaping.parse_fewshot(fx.view("v_fewshot"))
    rows = p.select("id", "input", F.lit(None).cast("string").alias("answer"),
                    F.when(F.col("id") % 5 == 0, F.lit("not json"))
                     .otherwise(F.to_json(F.create_map(F.lit("id"), F.col("id").cast("string")))).alias("additional_context"),
                    F.col("stored").alias("few_shot"))
    path = scratch_path(spark, "fewshot")
    write_fewshot(rows, path)
    r = read_fewshot(spark, path)
    return r.select("id", F.size("items").alias("n_items"), F.col("few_shot_raw").isNotNull().alias("is_raw"),
                    F.array_join(F.transform("items", lambda x: x["label"]), ",").alias("labels"),
                    F.col("context")["id"].alias("ctx_id"))


@query
def synthetic_claims(spark, sf_dir):
    """One synthetic claim per document id (md5-seeded words and labels)."""
    from evalframe.sources.files import synthetic_claims as synth
    docs = Fixture(spark, sf_dir).table("documents")
    return synth(docs.select(F.col("doc_id").alias("id")), "id", seed=0)


# ---------------------------------------------------------------- E6: prediction through a user function
def stub_model(batch):
    """``stub_replies``, but calls that have not landed fail."""
    if ((batch["claim_id"] + batch["candidate_id"]) % 11 == 10).any():
        raise RuntimeError("no reply")
    return stub_replies(batch)


def stub_replies(batch):
    """Deterministic stand-in for a model: the fixture reply for (claim, candidate)."""
    from evalframe.plans.views import FIXTURE_REPLIES, QUOTING, reply_index
    out = []
    for i, u in zip(reply_index(batch["claim_id"], batch["candidate_id"]), batch["user_content"]):
        claim = u.split("\n\nContext:\n", 1)[0].removeprefix("Claim: ")
        out.append(FIXTURE_REPLIES[int(i)] + (f"\n{claim}" if int(i) in QUOTING else ""))
    return out


@query
def predict_stub(spark, sf_dir):
    from evalframe.operators.inference import predict
    fx = Fixture(spark, sf_dir)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the examples are dealt out before they are multiplied by the candidates
    grid = joins.evaluation_grid(claims(fx).select("claim_id", "input").repartition(parts), fx.view("v_candidates"))
    req = shaping.build_requests(grid, style="claims", items="items", system_prompt="prompt_type")
    out = predict(req, stub_replies, keys=["claim_id", "candidate_id"], inputs=["system_content", "user_content"],
                  batch_size=64)
    return out.withColumn("predicted_label", parse_verdict(F.col("response")))


# ---------------------------------------------------------------- H6 / H7: streaming
@query
def stream_accuracy(spark, sf_dir):
    """Accuracy per candidate computed by a stream over the documents file (complete mode)."""
    from evalframe.plans.views import landed, replies_for
    from evalframe.streaming.live import live_accuracy, parquet_stream, run_complete
    fx = Fixture(spark, sf_dir)
    docs = parquet_stream(spark, sf_dir, "documents", fx.table("documents").schema)
    resp = landed(replies_for(docs, fx.view("v_candidates")))
    return run_complete(live_accuracy(resp, claims(fx).select("claim_id", "answer"), unique=True), "stream_accuracy")


@query
def stream_batch_audit(spark, sf_dir):
    """Batches per run by a stream over the event file: those that the next start, or an hour of silence, closes by the last watermark."""
    from evalframe.streaming.live import live_batch_audit, parquet_stream, run_stream
    static = Fixture(spark, sf_dir)
    ev = parquet_stream(spark, sf_dir, "events", static.table("events").schema)
    log = Fixture(spark, sf_dir, overrides={"events": ev}).view("v_event_log")
    return run_stream(live_batch_audit(log.select("event_id", "ts", "run_name", "event_type")), "batch-audit")


@query
def stream_windows(spark, sf_dir):
    """Event counts and tokens per run in tumbling (1 h), sliding (2 h / 1 h) and session (30 min) windows."""
    from evalframe.streaming.live import parquet_stream, run_complete, token_windows
    static = Fixture(spark, sf_dir)
    ev = parquet_stream(spark, sf_dir, "events", static.table("events").schema)
    log = Fixture(spark, sf_dir, overrides={"events": ev}).view("v_event_log")
    parts = [run_complete(token_windows(log, "tumbling", size="1 hour"), "win_tumbling"),
             run_complete(token_windows(log, "sliding", size="2 hours", slide="1 hour"), "win_sliding"),
             run_complete(token_windows(log, "session", gap="30 minutes"), "win_session")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def stream_windows_append(spark, sf_dir):
    """Tumbling windows in append mode: those that the watermark (1 h behind the latest event) has closed."""
    from evalframe.streaming.live import parquet_stream, run_stream, token_windows
    static = Fixture(spark, sf_dir)
    ev = parquet_stream(spark, sf_dir, "events", static.table("events").schema)
    log = Fixture(spark, sf_dir, overrides={"events": ev}).view("v_event_log")
    return run_stream(token_windows(log, "tumbling", size="1 hour", delay="1 hour"), "win_append")


@query
def code_comparison(spark, sf_dir):
    """Seed (candidate 0) vs optimised (candidate 1) on pass@1/3/5 over all generations."""
    pk = metrics.pass_at_k(Fixture(spark, sf_dir).view("v_generations"), ks=(1, 3, 5))
    return compare.compare_pass_at_k(pk, 0, 1, (1, 3, 5))


@query
def claims_evaluation(spark, sf_dir):
    """The claims evaluation flow end to end: requests -> stub model -> persisted outputs -> comparison."""
    from evalframe.plans.evaluate import evaluate_claims
    fx = Fixture(spark, sf_dir)
    cands = fx.view("v_candidates").withColumn("system_prompt", F.col("prompt_type"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    r = evaluate_claims(claims(fx).select("claim_id", "input", "answer"), cands, stub_model, parallelism=parts,
                        batch_size=64)
    return r["comparison"].select("candidate_id", "correct", "total", "accuracy", "delta_absolute", "delta_percent",
                                  "additional_correct", "verdict", "accuracy_pct", "improvement_pct")


def stub_coder(batch):
    """Deterministic stand-in for a code model: four reply shapes chosen by (task, candidate, sample)."""
    fence = "`" * 3
    out = []
    for t, c, i in zip(batch["task_id"], batch["candidate_id"], batch["sample_idx"]):
        k = (int(t) + 3 * int(c) + int(i)) % 4
        name = f"f{int(t)}"
        out.append([f"{fence}python\ndef {name}(x):\n    return 1\n{fence}",
                    f"{fence}python\ndef {name}(x):\n    return 0\n{fence}",
                    "def g(x): return 1",
                    f"{fence}\npy\ndef {name}(x): return 1\n{fence}"][k])
    return out


def stub_coder_shared(batch):
    """``stub_coder`` for tasks whose entry points repeat."""
    return [r.replace(f"def f{int(t)}(", f"def f{int(t) % 5}(") for r, t in zip(stub_coder(batch), batch["task_id"])]


def stub_runner(batch):
    """Deterministic stand-in for a sandboxed test run: passes iff the code returns 1."""
    import pandas as pd
    ok = ["return 1" in c for c in batch["code"]]
    return pd.DataFrame({"passed": ok, "error_type": [None if o else "AssertionError" for o in ok],
                         "error_message": [None if o else "assert failed" for o in ok], "traceback": None})


@query
def code_evaluation(spark, sf_dir):
    """The code evaluation flow end to end: 5 samples per (task, candidate) -> stub model -> extraction ->
    pre-classification -> stub runner -> pass@1/3/5."""
    from evalframe.plans.evaluate import evaluate_code
    fx = Fixture(spark, sf_dir)
    cands = fx.view("v_candidates").withColumn("system_prompt", F.col("prompt_type"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    r = evaluate_code(fx.view("v_code_tasks"), cands, stub_coder, stub_runner, ks=(1, 3, 5), parallelism=parts,
                      batch_size=64)
    return r["pass_at_k"]


@query
def code_evaluation_feedback(spark, sf_dir):
    """Feedback for every failed generation of the code flow (entry points shared by many tasks): task, error, message, text."""
    from evalframe.plans.evaluate import code_feedback_of, evaluate_code
    fx = Fixture(spark, sf_dir)
    cands = fx.view("v_candidates").withColumn("system_prompt", F.col("prompt_type"))
    # entry points repeat: the stub's code defines f<task % 5>
    tasks = fx.view("v_code_tasks").withColumn("entry_point", F.concat(F.lit("f"), (F.col("task_id") % 5).cast("string")))
    r = evaluate_code(tasks, cands, stub_coder_shared, stub_runner, ks=(1, 2), parallelism=int(spark.conf.get("spark.sql.shuffle.partitions")), batch_size=64)
    f = code_feedback_of(r["generations"], only_failed=True)
    return f.select("task_id", "candidate_id", "sample_idx", "entry_point", "execution_status", "error_type", "error_message", "feedback", "score")


@query
def stream_scored_append(spark, sf_dir):
    """Scored claims appended batch by batch by a resumable stream (batch-id keyed overwrite), read back."""
    from evalframe.plans.views import landed, replies_for
    from evalframe.session import scratch_path
    from evalframe.streaming.live import parquet_stream, read_committed, stream_score
    fx = Fixture(spark, sf_dir)
    docs = parquet_stream(spark, sf_dir, "documents", fx.table("documents").schema)
    resp = landed(replies_for(docs, fx.view("v_candidates")))
    scored = joins.parse_and_score(resp, claims(fx).select("claim_id", "answer"))
    sink = scratch_path(spark, "scored")
    q = stream_score(scored.select("claim_id", "candidate_id", "predicted_label", "answer", "correct", "score"),
                     sink, scratch_path(spark, "scored-ckpt"))
    q.awaitTermination()
    return read_committed(spark, sink, scored.select("claim_id", "candidate_id", "predicted_label", "answer", "correct", "score").schema)


def stub_reflector(batch):
    """Deterministic stand-in for a reflector: answers from the error type named in the request."""
    out = []
    for idx, req in zip(batch["failure_idx"], batch["request"]):
        err = req.split("\n- Error Type: ", 1)[1].split("\n", 1)[0]
        prio = "HIGH" if int(idx) % 2 == 0 else "LOW"
        out.append(f"MUTATION_ANALYSIS: {err} seen\n\nSUGGESTED_PROMPT_CHANGE: handle {err}\n\nPRIORITY_LEVEL: {prio}")
    return out


@query
def reflection_flow(spark, sf_dir):
    """Failures -> reflection requests -> stub reflector -> parsed suggestions, over all generations."""
    from evalframe.plans.evaluate import reflection_log
    fx = Fixture(spark, sf_dir)
    d = fx.view("v_exec_details").select("task_id", "candidate_id", "sample_idx", "passed", "error_type",
                                         "error_message", "traceback")
    r = reflection_log(d, stub_reflector, ["task_id", "candidate_id", "sample_idx"], run_name="reflection_run",
                       batch_size=64)
    return r["reflections"].select("failure_idx", "task_id", "error_type", "has_change", "change", "priority", "analysis")


# ---------------------------------------------------------------- resume, logs, documents, flows
@query
def claims_evaluation_resumed(spark, sf_dir):
    """The claims flow over half of the claims, then over all with the same output folder: one output per call."""
    from evalframe.plans.evaluate import evaluate_claims
    from evalframe.session import scratch_path
    fx = Fixture(spark, sf_dir)
    cands = fx.view("v_candidates").withColumn("system_prompt", F.col("prompt_type"))
    ex = claims(fx).select("claim_id", "input", "answer")
    out = scratch_path(spark, "resumed")
    evaluate_claims(ex.filter("claim_id % 2 = 0"), cands, stub_model, out_dir=out, batch_size=16)
    r = evaluate_claims(ex, cands, stub_model, out_dir=out, batch_size=16)
    return r["scored"].select("claim_id", "candidate_id", "failed", "predicted_label", "score")


class Killed(BaseException):
    """Stands for an executor that goes away: no batch call catches it."""


def stub_model_killed(batch):
    """``stub_replies`` until a call meets one of the claims that end the job."""
    if (batch["claim_id"] % 9 == 4).any():
        raise Killed("executor lost")
    return stub_replies(batch)


@query
def resume_after_failure(spark, sf_dir):
    """The claims flow in a job that dies on the way, then again: outputs per candidate, calls in the log, and requests called twice."""
    from evalframe.operators.landing import call_log
    from evalframe.plans.evaluate import evaluate_claims
    from evalframe.session import scratch_path
    fx = Fixture(spark, sf_dir)
    cands = fx.view("v_candidates").withColumn("system_prompt", F.col("prompt_type"))
    ex = claims(fx).select("claim_id", "input", "answer")
    out = scratch_path(spark, "killed")
    try:
        evaluate_claims(ex, cands, stub_model_killed, out_dir=out, batch_size=1)
        raise AssertionError("the first job should have died")
    except Exception as e:
        if "executor lost" not in str(e):
            raise
    r = evaluate_claims(ex, cands, stub_replies, out_dir=out, batch_size=16)
    calls = call_log(spark, f"{out}/claims_outputs").groupBy("digest").agg(F.count(F.lit(1)).alias("n")).agg(
        F.sum("n").alias("n_calls"), F.count_if(F.col("n") > 1).alias("n_called_twice"))
    return r["accuracy"].select("candidate_id", "correct", "total").join(F.broadcast(calls), F.lit(True))


@query
def resume_changed_prompt(spark, sf_dir):
    """The claims flow with one set of prompts, then with others and the same folder: the accuracies are the others'."""
    from evalframe.plans.evaluate import evaluate_claims
    from evalframe.session import scratch_path
    fx = Fixture(spark, sf_dir)
    cands = fx.view("v_candidates").withColumn("system_prompt", F.col("prompt_type"))
    ex = claims(fx).select("claim_id", "input", "answer")
    out = scratch_path(spark, "prompts")
    evaluate_claims(ex, cands.withColumn("system_prompt", F.concat("system_prompt", F.lit(" old"))), stub_silent, out_dir=out, batch_size=64)
    r = evaluate_claims(ex, cands, stub_model, out_dir=out, batch_size=16)
    return r["accuracy"].select("candidate_id", "correct", "total")


def stub_silent(batch):
    """A model that has no answer to anything."""
    return [""] * len(batch)


@query
def resume_retries_failed(spark, sf_dir):
    """The claims flow with calls that fail, then again: per candidate failures left, and attempts in the log."""
    from evalframe.operators.landing import call_log
    from evalframe.plans.evaluate import evaluate_claims
    from evalframe.session import scratch_path
    fx = Fixture(spark, sf_dir)
    cands = fx.view("v_candidates").withColumn("system_prompt", F.col("prompt_type"))
    ex = claims(fx).select("claim_id", "input", "answer")
    out = scratch_path(spark, "failed-calls")
    first = evaluate_claims(ex, cands, stub_model, out_dir=out, batch_size=16)["outputs"].filter("failed").groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n_failed_before"))
    then = evaluate_claims(ex, cands, stub_replies, out_dir=out, batch_size=16)["outputs"]
    left = then.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n_outputs"), F.count_if("failed").alias("n_failed"))
    attempts = call_log(spark, f"{out}/claims_outputs").agg(F.count(F.lit(1)).alias("n_attempts"), F.count_if("failed").alias("n_failed_attempts"))
    return left.join(first, "candidate_id", "left").join(F.broadcast(attempts), F.lit(True))


def stub_reflector_plain(batch):
    """``stub_reflector`` that answers from the request alone, as its place among others may change."""
    return [f"MUTATION_ANALYSIS: x\n\nSUGGESTED_PROMPT_CHANGE: handle {r.split(chr(10) + '- Error Type: ', 1)[1].split(chr(10), 1)[0]} of {r.split('- Task ID: ', 1)[1].split(chr(10), 1)[0]}"
            for r in batch["request"]]


@query
def reflection_resumed(spark, sf_dir):
    """Reflections of the failures of every other task, then of all with the same folder: each failure keeps its own, and is reflected on once."""
    from evalframe.operators.landing import call_log
    from evalframe.plans.evaluate import reflection_log
    from evalframe.session import scratch_path
    d = Fixture(spark, sf_dir).view("v_exec_details").select("task_id", "candidate_id", "sample_idx", "passed", "error_type", "error_message", "traceback")
    keys, out = ["task_id", "candidate_id", "sample_idx"], scratch_path(spark, "reflections")
    reflection_log(d.filter("task_id % 2 = 1"), stub_reflector_plain, keys, run_name="half", batch_size=64, out_dir=out)
    r = reflection_log(d, stub_reflector_plain, keys, run_name="all", batch_size=64, out_dir=out)
    calls = call_log(spark, f"{out}/reflections").agg(F.count(F.lit(1)).alias("n_calls"))
    return r["reflections"].select("failure_idx", "task_id", "error_type", "change").join(F.broadcast(calls), F.lit(True))


#: Tasks that write the lines of one run.
RUN_PARTS = 16


@query
def event_log_roundtrip(spark, sf_dir):
    """Runs written as log lines of the real shape (no run name in invocations), read back and audited."""
    from evalframe.session import scratch_path
    from evalframe.sources.files import EVENT_SCHEMA, append_events, read_events
    log = Fixture(spark, sf_dir).view("v_event_log").filter(F.col("run_name").isNotNull())
    # a run's lines are dealt out to several tasks, however few tasks read the table
    log = log.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "run_name", F.pmod(F.xxhash64("event_id", "ts"), F.lit(RUN_PARTS)))
    data = {f.name: F.lit(None).cast(f.dataType) for f in EVENT_SCHEMA["data"].dataType}
    inv = F.col("event_type") == "reflector_invocation"
    data["run_name"] = F.when(~inv, F.col("run_name"))
    data["task_id"] = F.when(inv, F.col("event_id").cast("string"))
    data["error_type"] = F.when(inv, F.col("error_type"))
    data["num_failures"] = F.when(F.col("event_type") == "batch_start", F.col("event_id"))
    data["usage"] = F.when(inv, F.struct(F.lit(None).cast("long").alias("prompt_tokens"), F.lit(None).cast("long").alias("completion_tokens"), "total_tokens"))
    rows = log.select(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), "event_type",
                      F.struct(*[c.alias(k) for k, c in data.items()]).alias("data"), F.col("run_name").alias("run"))
    path = scratch_path(spark, "event-log")
    # one folder per run, as the log has one file per run
    rows.write.partitionBy("run").json(path)
    back = read_events(spark, f"{path}/run=*")
    back = back.withColumn("run_name", F.regexp_replace("run_name", "^run=", ""))
    return events.token_rollup(back).select("run_name", "error_type", "n_calls", "sum_tokens", "level")


@query
def reflection_list(spark, sf_dir):
    fx = Fixture(spark, sf_dir)
    return feedback.reflection_list(fx.view("v_event_log"), fx.view("v_reflections"))


@query
def comparison_documents(spark, sf_dir):
    """Full comparison documents per run: baseline, optimised and few-shot blocks, written as JSON and read back long."""
    from evalframe.session import scratch_path
    from evalframe.sources.files import comparison_documents as documents
    from evalframe.sources.files import read_comparisons, write_report
    c = compare.compare(run_metrics(Fixture(spark, sf_dir)), baseline="1")
    path = scratch_path(spark, "comparisons")
    write_report(documents(c, {"baseline": "1", "optimized": "2", "fewshot_optimized": "3"}), path)
    r = read_comparisons(spark, f"{path}/run_id=*")
    return r.select(F.regexp_replace("run_dir", "^run_id=", "").alias("run_id"), "test_size", "variant", "score", "correct", "total", "delta_absolute", "delta_percent")


@query
def report_doc(spark, sf_dir):
    """Evaluation report of candidate 1 against the seed: performance, distributions, comparison and summary sections."""
    fx = Fixture(spark, sf_dir)
    s = scored_claims(fx)
    return compare.report_document(metrics.accuracy(s), metrics.label_distribution(s, claims(fx)), seed_id=0, other_id=1)


def stub_fewshot_model(batch):
    """Deterministic stand-in for a few-shot model: a valid array, an invalid one, or no JSON."""
    shapes = ('[{"input":"a","label":"SUPPORTED"},{"input":"b","label":"not_supported"}]', '[{"input":"a","label":"maybe"}]', "no json")
    return [shapes[int(i) % 3] for i in batch["claim_id"]]


@query
def fewshot_flow(spark, sf_dir):
    """Few-shot generation end to end: requests -> stub model -> validated items."""
    from evalframe.plans.evaluate import generate_fewshots
    r = generate_fewshots(claims(Fixture(spark, sf_dir)).select("claim_id", "input", "answer"), stub_fewshot_model)
    return r.select("claim_id", "answer", "valid", "n_items", "stored")


@query
def training_set_flow(spark, sf_dir):
    """Training rows: shaped claims, their split, and the validated few-shots of their text."""
    from evalframe.plans.evaluate import training_set
    fx = Fixture(spark, sf_dir)
    ex = fx.view("v_claims").select("claim_id", F.col("evidence").alias("input"), normalize_gold(F.col("label_raw")).alias("answer"))
    t = training_set(ex, fx.view("v_fewshot_gaps").withColumnRenamed("reply", "few_shot"), fraction=0.8, seed=SPLIT_SEED)
    return t.select("claim_id", "answer", "split", "attached", F.size("items").alias("n_items"))


# ---------------------------------------------------------------- A: file sources, written in their own shape and read back
@query
def claims_file_roundtrip(spark, sf_dir):
    from evalframe.session import scratch_path
    from evalframe.sources.files import read_claims
    c = Fixture(spark, sf_dir).view("v_claims")
    path = scratch_path(spark, "claims")
    c.select(F.col("claim_id").cast("string").alias("id"), "claim", "evidence", F.col("label_raw").alias("label"),
             F.when(F.col("claim_id") % 4 == 0, "test").otherwise("train").alias("split")).write.partitionBy("split").json(path)
    r = read_claims(spark, path, split="split=train").unionByName(read_claims(spark, path, split="split=test"))
    return r.select("id", F.md5("claim").alias("claim_md5"), F.md5("evidence").alias("evidence_md5"), "label")


@query
def code_tasks_file_roundtrip(spark, sf_dir):
    from evalframe.session import scratch_path
    from evalframe.sources.files import read_code_tasks
    path = scratch_path(spark, "tasks")
    Fixture(spark, sf_dir).view("v_code_tasks").select(F.col("task_id").cast("string").alias("task_id"), "prompt", "test", "entry_point").write.json(path)
    return read_code_tasks(spark, path).select("task_id", "prompt", "test", "entry_point", "canonical_solution")


@query
def runs_roundtrip(spark, sf_dir):
    """Run configs, one file per run in its folder, read as one table with their candidate scores."""
    from evalframe.session import scratch_path
    from evalframe.sources.files import candidate_scores_of_runs, read_runs
    path = scratch_path(spark, "runs")
    m = run_metrics(Fixture(spark, sf_dir))
    score = (F.col("correct") / F.col("total")).alias("score")
    docs = m.select("run_id", F.concat(F.lit("candidate_"), F.col("variant")).alias("k"), score).groupBy("run_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "score")))).alias("all_candidate_scores"))
    docs.repartition("run_id").write.partitionBy("run_id").json(path)
    s = candidate_scores_of_runs(read_runs(spark, f"{path}/run_id=*"))
    return s.select(F.regexp_replace("run_dir", "^run_id=", "").alias("run_id"), "candidate_id", "score")


def folder_of(key: str):
    """One of 256 folders for a task's files: a folder of all tasks would be listed by one task."""
    return F.substring(F.md5(F.col(key).cast("string")), 1, 2)


@query
def prompts_roundtrip(spark, sf_dir):
    """Prompt files of one run per code task, written and read back; every third run has its seed prompt in its config alone."""
    from evalframe.session import scratch_path
    from evalframe.sources.files import read_prompts, write_files
    root = scratch_path(spark, "prompts")
    t = Fixture(spark, sf_dir).view("v_code_tasks").select(F.concat(F.lit("run"), "task_id").alias("run_dir"), "task_id", "prompt")
    run = F.concat(folder_of("task_id"), F.lit("/"), "run_dir")
    seed = t.filter("task_id % 3 <> 0").select(F.concat(run, F.lit("/seed_prompt.txt")).alias("path"), F.concat(F.lit("  "), "prompt", F.lit("\n")).alias("text"))
    best = t.select(F.concat(run, F.lit("/optimized_prompt.txt")).alias("path"), F.concat(F.lit("\n"), "prompt", F.lit(" better ")).alias("text"))
    write_files(seed.unionByName(best), root)
    runs = t.select("run_dir", F.concat(F.lit("config of "), "run_dir").alias("seed_prompt_text"))
    return read_prompts(spark, f"{root}/*/*/*_prompt.txt", runs).select("run_dir", "seed_prompt", "optimized_prompt")


@query
def best_outputs_roundtrip(spark, sf_dir):
    """The best generation of each code task as a file named by task, iteration and program, read back as a table."""
    from evalframe.session import scratch_path, written_once
    from evalframe.sources.files import read_best_outputs, write_files
    root = scratch_path(spark, "best")
    fx = Fixture(spark, sf_dir)
    # The generations of code tasks alone are ranked: the others' rows would be shuffled and sorted for nothing.
    own = fx.table("lineitem").join(fx.view("v_code_tasks").select(F.col("task_id").alias("l_orderkey")), "l_orderkey", "left_semi")
    g = Fixture(spark, sf_dir, overrides={"lineitem": own}).view("v_generations")
    score = F.when(F.coalesce("passed", F.lit(False)), 1.0).otherwise(0.0)
    best = g.groupBy("task_id").agg(F.min(F.struct((-score).alias("s"), F.col("candidate_id").alias("p"), F.col("sample_idx").alias("i"))).alias("b"))
    name = F.format_string("%s/task_%d/iter_%d_prog_%d.json", folder_of("task_id"), F.col("task_id"), F.col("b.i"), F.col("b.p"))
    rows = written_once(best.select(name.alias("path"), (0 - F.col("b.s")).cast("string").alias("text")), "best-rows")
    write_files(rows, root)
    return read_best_outputs(spark, f"{root}/*/task_*/*.json")


@query
def metrics_log_roundtrip(spark, sf_dir):
    """Metric points appended to a log, read back, and the latest value of each metric."""
    from evalframe.session import scratch_path
    from evalframe.sources.files import append_metrics, read_metrics
    path = scratch_path(spark, "metrics")
    m = Fixture(spark, sf_dir).view("v_metrics").select(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), "name", "value", "step")
    append_metrics(m.filter("step % 2 = 0"), path)
    append_metrics(m.filter("step % 2 <> 0"), path)
    return read_metrics(spark, path).groupBy("name").agg(F.count("*").alias("n_points"), F.max("step").alias("last_step"), F.min("value").alias("least"), F.max("value").alias("greatest"))
