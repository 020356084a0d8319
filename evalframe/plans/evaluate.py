"""End-to-end flows built from the operators.

* ``training_set``: raw examples -> shaped -> split -> few-shots attached (the input of a prompt search).
* ``generate_fewshots``: claims -> few-shot requests -> model -> validated few-shots.
* ``evaluate_claims``: every candidate prompt on every claim example -> model
  outputs (persisted once) -> verdicts -> scores -> accuracy, label
  distributions, comparison with the seed prompt.
* ``evaluate_code``: every candidate on every task, ``max(ks)`` samples each ->
  code extraction -> pre-classification (no test, missing function) -> the
  caller's scorer on the rest -> pass@k, error distribution, comparison.
* ``reflection_log``: failures of a detailed-results table -> reflection
  requests -> the caller's reflector -> parsed suggestions and an event log.

Model and scorer calls are user functions run by ``predict`` / ``score_with``;
everything else is DataFrame work. Replies land in a log under the shared checkpoint
folder (or ``out_dir``) while the job runs, and outputs are written once before any metric reads
them. A flow that is run again with the same ``out_dir``, after a failure or with more rows, calls
the model only for requests, keys and texts, that have no reply there; failed calls are tried again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalframe.functions.code import extract_code, status_of
from evalframe.operators import compare, feedback, inference, joins, landing, metrics, scoring, shaping, splits
from evalframe.session import scratch_path

EXEC_RESULT = T.StructType([T.StructField("passed", T.BooleanType()), T.StructField("error_type", T.StringType()),
                            T.StructField("error_message", T.StringType()), T.StructField("traceback", T.StringType())])


def _out(spark, out_dir: str | None, name: str) -> str:
    return f"{out_dir.rstrip('/')}/{name}" if out_dir else scratch_path(spark, name)


def _dealt(rows: DataFrame, key: str, candidates: DataFrame, path: str, parallelism: int | None, samples: int = 1) -> tuple[DataFrame, str]:
    """Rows dealt out by their key for a log at ``path`` of all their requests, and the path."""
    n = rows.count() * candidates.select("candidate_id").distinct().count() * samples
    return landing.dealt(rows, [key], landing.slots_of(path, n, parallelism or 1)), path


def training_set(examples: DataFrame, fewshots: DataFrame | None = None, fraction: float = 0.8, seed=42, key: str = "claim_id",
                 text: str = "input", k: int | None = None) -> DataFrame:
    """Shaped examples with their split and, where a few-shot row has the same text, its validated items.

    ``examples``: (key, text, answer); ``fewshots``: (id, input, few_shot). ``k`` keeps the first k items of
    each few-shot. Examples whose few-shot does not validate keep none.
    """
    out = splits.split_fraction(examples, key, fraction, seed).drop("rank")
    none = "array<struct<input:string,label:string>>"
    if fewshots is None:
        return out.withColumn("items", F.lit(None).cast(none)).withColumn("attached", F.lit(False))
    att = joins.attach_fewshot(out, fewshots, example_key=text, fewshot_key="input", value_col="few_shot")
    val = shaping.parse_fewshot(att, reply="few_shot")
    items = F.when(F.col("valid"), F.slice("items", 1, k) if k else F.col("items"))
    return val.withColumn("items", items).select(*out.columns, "items", "attached")


def generate_fewshots(examples: DataFrame, model_fn, key: str = "claim_id", out_dir: str | None = None, batch_size: int = 8,
                      parallelism: int | None = None, factory: bool = False) -> DataFrame:
    """Few-shot rows (key, input, answer, valid, n_items, stored, failed) for every example (key, input, answer).

    ``model_fn`` gets a pandas batch with ``request``. ``stored`` is the validated JSON array, or the reply
    wrapped with the reason why it is not one. Resumable by ``out_dir``.
    """
    path = _out(examples.sparkSession, out_dir, "fewshot_replies")
    spread = landing.dealt(examples, [key], landing.slots_of(path, examples.count(), parallelism or 1))
    req = shaping.fewshot_requests(spread)
    out = landing.predict_landed(req, model_fn, [key], ["request"], path, output="reply", batch_size=batch_size, factory=factory)
    got = shaping.parse_fewshot(out.join(examples.select(key, "input", "answer"), key))
    return got.select(key, "input", "answer", "valid", "n_items", "stored", "failed")


def evaluate_claims(examples: DataFrame, candidates: DataFrame, model_fn, key: str = "claim_id",
                    out_dir: str | None = None, batch_size: int = 32, parallelism: int | None = None,
                    failure_score: float = 0.0, factory: bool = False, seed_id: int = 0, raw: str = "few_shot_raw",
                    whole_call: bool = False) -> dict[str, DataFrame]:
    """Claims evaluation.

    ``examples``: (key, input, answer[, items][, few_shot_raw]) where ``items`` are attached
    few-shots and ``raw`` names the column of few-shots kept as text; ``candidates``:
    (candidate_id, system_prompt). ``model_fn`` gets a pandas batch with ``system_content`` /
    ``user_content`` and returns reply texts. Examples are dealt out before they are multiplied
    by the candidates, so their texts are shuffled once, also when replies are taken from the log.
    """
    spark = examples.sparkSession
    cols = [key, "input"] + [c for c in ("items", raw) if c in examples.columns]
    spread, path = _dealt(examples.select(*cols), key, candidates, _out(spark, out_dir, "claims_outputs"), parallelism)
    grid = joins.evaluation_grid(spread, candidates.select("candidate_id", "system_prompt"))
    req = shaping.build_requests(grid, style="claims", items="items", raw=raw, system_prompt="system_prompt")
    # one folder per candidate: reading one candidate's outputs prunes the others
    out = landing.predict_landed(req, model_fn, [key, "candidate_id"], ["system_content", "user_content"], path, partition_by=["candidate_id"],
                                 batch_size=batch_size, factory=factory, whole_call=whole_call)
    # the outputs hold one row per grid key, failed calls included
    scored = joins.score_failed(out, examples.select(key, "answer"), failure_score=failure_score, key=key)
    acc = metrics.accuracy(scored)
    dist = metrics.label_distribution(scored, examples)
    cmp = compare.verdict(compare.compare(acc.withColumn("run_id", F.lit("claims")).withColumnRenamed("candidate_id", "variant"),
                                          baseline=seed_id))
    return {"outputs": out, "scored": scored, "accuracy": acc, "distribution": dist,
            "comparison": cmp.withColumnRenamed("variant", "candidate_id").drop("run_id")}


def _unknown(e: Exception) -> dict:
    return {"passed": False, "error_type": "UnknownError", "error_message": inference.describe(e), "traceback": None}


def evaluate_code(tasks: DataFrame, candidates: DataFrame, model_fn, scorer_fn, ks=(1, 3, 5),
                  out_dir: str | None = None, batch_size: int = 16, parallelism: int | None = None,
                  factory: bool = False, seed_id: int = 0, other_id: int = 1, failure_score: float = 0.0,
                  whole_call: bool = False) -> dict[str, DataFrame]:
    """Code evaluation with ``max(ks)`` samples per (task, candidate).

    ``tasks``: (task_id, prompt, entry_point, test), one row per task_id; entry points may repeat.
    ``candidates``: (candidate_id, system_prompt). ``model_fn`` returns replies; ``scorer_fn(batch) ->
    pandas DataFrame(passed, error_type, error_message, traceback)`` scores (code, test)
    rows that still need execution; a scorer that raises makes its row an ``UnknownError``.
    ``generations`` carries code, entry point, prompt, message and traceback, so feedback,
    failures and reflection follow from it. Failed calls score ``failure_score``.
    """
    spark = tasks.sparkSession
    n = max(ks)
    keys = ["task_id", "candidate_id", "sample_idx"]
    t = tasks.select("task_id", "prompt", "entry_point", "test")
    spread, path = _dealt(t, "task_id", candidates, _out(spark, out_dir, "code_outputs"), parallelism, n)
    grid = joins.evaluation_grid(spread, candidates.select("candidate_id", "system_prompt"))
    # the sample index is part of the key: the feature asks for n samples per pair
    grid = grid.withColumn("sample_idx", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long"))))
    req = shaping.build_requests(grid, style="code", input_col="prompt", items="items", system_prompt="system_prompt")
    out = landing.predict_landed(req, model_fn, keys, ["system_content", "user_content"], path, partition_by=["candidate_id"],
                                 batch_size=batch_size, factory=factory, whole_call=whole_call)
    # the task's fields come along once, by its own key
    gens = out.join(t, "task_id").withColumn("code", extract_code(F.col("response")))
    # a result belongs to what was run: other code or another test for the same key is run again
    ran = F.sha2(F.to_json(F.struct(*keys, "code", "test"), {"ignoreNullFields": "false"}), 256)
    # code is cut out once: what is run, its results and what reads the generations meet the written rows
    gens = inference.persist_outputs(gens.withColumn("_ef_run", ran), scratch_path(spark, "code_generations"))
    path = _out(spark, out_dir, "code_results")
    schema = T.StructType([gens.schema["_ef_run"], *EXEC_RESULT.fields])
    todo = scoring.needs_execution(gens.filter(~F.col("failed")))
    todo = splits.remaining(todo, inference.landed_outputs(spark, path, schema), ["_ef_run"])
    results = inference.score_with(todo, scorer_fn, keys=["_ef_run"], inputs=["code", "test"], result_schema=EXEC_RESULT, on_error=_unknown)
    results = inference.persist_outputs(results, path).dropDuplicates(["_ef_run"]).withColumn("_ef_ran", F.lit(True))
    classified = scoring.classify(gens.join(results, "_ef_run", "left"), F.col("_ef_ran").isNotNull()).drop("_ef_ran", "_ef_run", "test")
    classified = inference.fill_llm_failures(classified)
    classified = classified.withColumn("score", F.when(F.col("failed"), F.lit(float(failure_score))).when(F.col("passed"), 1.0).otherwise(0.0))
    pk = metrics.pass_at_k(classified, ks=ks)
    return {"outputs": out, "generations": classified, "pass_at_k": pk,
            "errors": metrics.error_distribution(classified, first_sample=True),
            "comparison": compare.compare_pass_at_k(pk, seed_id, other_id, ks)}


def code_feedback_of(generations: DataFrame, only_failed: bool = False) -> DataFrame:
    """Reflection feedback (11 fields) from the ``generations`` of ``evaluate_code``."""
    g = generations.filter(~F.col("passed")) if only_failed else generations
    return feedback.code_feedback(g.withColumn("exec_status", status_of(F.col("passed"), F.col("error_type"))))


def reflection_log(detailed: DataFrame, reflector_fn, order_cols: list, run_name: str, limit: int | None = None,
                   batch_size: int = 8, factory: bool = False, out_dir: str | None = None, model: str | None = None,
                   log_path: str | None = None) -> dict[str, DataFrame]:
    """Failures -> reflection requests -> the caller's reflector -> parsed suggestions and log events.

    ``reflector_fn`` gets a pandas batch with ``request`` and returns the reflector texts. They are
    written once before anything reads them. ``events`` has the shape of the event log
    (timestamp, event_type, data): a batch start, one invocation per failure, a batch end; with
    ``log_path`` it is appended there, in a folder of the run's own.
    """
    from evalframe.sources import files
    spark = detailed.sparkSession
    # written once, as the requests, their number and the parsed reflections all read them
    fails = inference.persist_outputs(feedback.extract_failures(detailed, order_cols, limit), scratch_path(spark, "failures"))
    req = feedback.reflection_requests(fails)
    # a reflection belongs to its failure and request, not to the failure's place among others
    same = [c for c in order_cols if isinstance(c, str)]
    out = landing.predict_landed(req, reflector_fn, ["failure_idx"], ["request"], _out(spark, out_dir, "reflections"), output="reflector_output",
                                 identity=[*same, "request"], batch_size=batch_size, factory=factory)
    parsed = feedback.parse_reflections(out.join(fails, "failure_idx"))
    summary = parsed.agg(F.count(F.lit(1)).alias("failures_found"),
                         F.count_if(F.col("reflector_output").isNotNull()).alias("reflections_generated"),
                         F.count_if(F.col("has_change")).alias("suggestions")).withColumn("run_name", F.lit(run_name))
    events = files.reflection_events(parsed, summary, run_name, model)
    if log_path:
        files.append_events(events, f"{log_path.rstrip('/')}/{run_name}")
    return {"failures": fails, "reflections": parsed, "events": events, "summary": summary}
