"""Feedback sets for reflection: claims and code feedback, failure digests, failure extraction,
reflection requests and their parsing, reflection batch summaries, error shifts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalframe.functions.code import ERROR_GUIDANCE, guidance, guidance_key
from evalframe.functions.constants import (CLAIMS_FEEDBACK_NOTES,
                                           CODE_PASS_NOTES, DEFAULT_GUIDANCE,
                                           FAILURE_DEFAULTS,
                                           REFLECTION_ANALYSIS_MARKER,
                                           REFLECTION_CHANGE_MARKER,
                                           REFLECTION_FOOTER,
                                           REFLECTION_HEADER,
                                           REFLECTION_NO_CHANGE,
                                           REFLECTION_PRIORITY_MARKER)
from evalframe.functions.text import preview, py_str, py_strip
from evalframe.operators.ordering import global_row_number, null_safe_join

COMPONENT = "system_prompt"


def require_nonempty(df: DataFrame, what: str = "feedback") -> DataFrame:
    """Raise when a feedback set is empty (checks one row only)."""
    if not df.take(1):
        raise ValueError(f"No valid predictions found for any module ({what} is empty).")
    return df


def attach_guidance(df: DataFrame, status: str = "status", error_type: str = "error_type",
                    rules=ERROR_GUIDANCE) -> DataFrame:
    """First-match guidance per row (rules in order; a CASE expression, no join)."""
    return (df.withColumn("guidance_key", guidance_key(F.col(status), F.col(error_type), rules))
              .withColumn("guidance", guidance(F.col(status), F.col(error_type), rules)))


def attach_guidance_table(df: DataFrame, rules: DataFrame, status: str = "status", error_type: str = "error_type", default: str = DEFAULT_GUIDANCE) -> DataFrame:
    """``attach_guidance`` with the rules as rows: (priority, rule, guidance); the match of least priority wins.

    Rules are compared without case with the distinct (status, error type) pairs, far fewer than the rows
    as a rule: each pair's texts are cut into their substrings of the lengths that rules have, and meet the
    rules in a join on the text. The work is linear in the pairs' texts, however many rules there are, and
    rows meet their pair's rule in a join. A null status or error type is read as empty; an empty rule
    matches all. Of rules with one priority the smaller text wins.
    """
    r = rules.filter(F.col("rule").isNotNull() & F.col("priority").isNotNull()).select(
        F.lower("rule").alias("_ef_k"), F.struct(F.col("priority").alias("p"), F.col("rule").alias("k"), F.col("guidance").alias("g")).alias("_ef_r"))
    r = r.groupBy("_ef_k").agg(F.min("_ef_r").alias("_ef_r"))
    lengths = F.broadcast(r.agg(F.sort_array(F.collect_set(F.length("_ef_k"))).alias("_ef_n")))  # one row: the lengths that rules have
    s, e = (F.lower(F.coalesce(F.col(c), F.lit(""))) for c in (status, error_type))
    pairs = df.select(s.alias("_ef_s"), e.alias("_ef_e")).distinct()
    parts = lambda c: F.flatten(F.transform("_ef_n", lambda n: F.when(n == 0, F.array(F.lit(""))).when(
        F.length(c) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.col(c).substr(i, n)))))
    cut = pairs.join(lengths, F.lit(True)).select("_ef_s", "_ef_e", F.explode(F.array_distinct(F.concat(parts("_ef_s"), parts("_ef_e")))).alias("_ef_k"))
    best = cut.join(r, "_ef_k").groupBy("_ef_s", "_ef_e").agg(F.min("_ef_r").alias("_ef_r"))
    out = df.withColumn("_ef_s", s).withColumn("_ef_e", e).join(best, ["_ef_s", "_ef_e"], "left")
    return out.withColumn("guidance_key", F.coalesce(F.col("_ef_r.k"), F.lit("default"))).withColumn(
        "guidance", F.when(F.col("_ef_r").isNull(), F.lit(default)).otherwise(F.col("_ef_r.g"))).drop("_ef_s", "_ef_e", "_ef_r")


def guidance_rules(spark, rules=ERROR_GUIDANCE) -> DataFrame:
    """The fixed rules as a table (priority, rule, guidance)."""
    return spark.createDataFrame([(i, k, g) for i, (k, g) in enumerate(rules)], "priority int, rule string, guidance string")


def claims_feedback(scored: DataFrame, input_col: str = "input", response: str = "response",
                    predicted: str = "predicted_label", answer: str = "answer", score: str = "score",
                    component: str = COMPONENT, check_nonempty: bool = False) -> DataFrame:
    """Reflection rows for claims: status, input, reply, predicted, correct answer, feedback text, score."""
    status = F.when(F.col(score) > 0, F.lit("CORRECT")).otherwise(F.lit("INCORRECT"))
    out = scored.withColumn("status", status).withColumn("feedback", F.concat(
        F.col("status"), F.lit(': Model predicted "'), py_str(F.col(predicted)), F.lit('", correct answer is "'),
        py_str(F.col(answer)), F.lit('".\n\nInput: '), py_str(F.col(input_col)),
        F.lit("\n\nResponse: "), py_str(F.col(response)), F.lit("\n\n" + CLAIMS_FEEDBACK_NOTES)))
    out = out.withColumn("component", F.lit(component))
    return require_nonempty(out, "claims feedback") if check_nonempty else out


def code_feedback(gens: DataFrame, rules=ERROR_GUIDANCE, component: str = COMPONENT,
                  check_nonempty: bool = False) -> DataFrame:
    """Reflection rows for code (11 fields).

    Input columns: task_id, entry_point, prompt, code, exec_status, error_type,
    error_message, traceback, score. Passing rows get the pass text with the full
    code; failing rows get previews (problem 500, code 800, traceback 600, the
    traceback only when non-empty) and guidance.
    """
    tid, ep = py_str(F.col("task_id")), py_str(F.col("entry_point"))
    status = F.when(F.col("score") > 0, F.lit("PASSED")).otherwise(F.lit("FAILED"))
    pass_text = F.concat(F.lit("PASSED: Task "), tid, F.lit("\n\nThe generated code for function `"), ep,
                         F.lit("` passed all tests.\n\nGenerated Code:\n```python\n"), py_str(F.col("code")),
                         F.lit("\n```\n\n" + CODE_PASS_NOTES))
    tb = F.col("traceback")
    fail_text = F.concat_ws(
        "\n",
        F.concat(F.lit("FAILED: Task "), tid),
        F.concat(F.lit("Function: `"), ep, F.lit("`")),
        F.concat(F.lit("Execution Status: "), py_str(F.col("exec_status"))),
        F.concat(F.lit("Error Type: "), py_str(F.col("error_type"))),
        F.concat(F.lit("Error Message: "), py_str(F.col("error_message"))),
        F.concat(F.lit("\nProblem:\n"), preview(py_str(F.col("prompt")), 500)),
        F.concat(F.lit("\nGenerated Code:\n```python\n"), preview(py_str(F.col("code")), 800), F.lit("\n```")),
        F.when(F.coalesce(tb, F.lit("")) != "", F.concat(F.lit("\nTraceback:\n"), preview(tb, 600))),
        F.concat(F.lit("\nGuidance:\n"), guidance(F.col("exec_status"), F.col("error_type"), rules)))
    out = gens.select(
        status.alias("status"), F.col("task_id"), F.col("entry_point"), F.col("prompt").alias("problem"),
        F.col("code").alias("generated_code"), F.col("exec_status").alias("execution_status"),
        F.col("error_type"), F.col("error_message"), F.col("traceback"),
        F.when(F.col("score") > 0, pass_text).otherwise(fail_text).alias("feedback"),
        F.col("score"), *[c for c in ("candidate_id", "sample_idx") if c in gens.columns]
    ).withColumn("component", F.lit(component))
    return require_nonempty(out, "code feedback") if check_nonempty else out


def failure_digest(results: DataFrame) -> DataFrame:
    """Short digest per execution result: traceback 1000 (+ truncation note), stdout/stderr 500."""
    def nonempty(c):
        return F.coalesce(F.col(c), F.lit("")) != ""
    tb = F.col("traceback")
    tb_text = F.when(F.length(tb) > 1000, F.concat(F.substring(tb, 1, 1000), F.lit("\n... (truncated)"))).otherwise(tb)
    digest = F.concat_ws(
        "\n\n",
        F.concat(F.lit("FAILED: "), py_str(F.col("status"))),
        F.when(nonempty("error_type"), F.concat(F.lit("Error Type: "), F.col("error_type"))),
        F.when(nonempty("error_message"), F.concat(F.lit("Error Message: "), F.col("error_message"))),
        F.when(nonempty("traceback"), F.concat(F.lit("Traceback:\n"), tb_text)),
        F.when(py_strip(F.coalesce(F.col("stdout"), F.lit(""))) != "",
               F.concat(F.lit("Stdout:\n"), F.substring(F.col("stdout"), 1, 500))),
        F.when(py_strip(F.coalesce(F.col("stderr"), F.lit(""))) != "",
               F.concat(F.lit("Stderr:\n"), F.substring(F.col("stderr"), 1, 500))))
    return results.withColumn("digest", F.when(F.coalesce(F.col("passed"), F.lit(False)),
                                               F.lit("PASSED: All tests passed successfully.")).otherwise(digest))


def extract_failures(detailed: DataFrame, order_cols: list, limit: int | None = None) -> DataFrame:
    """Failures: ``status = 'FAILED'`` or ``passed = false`` (a null ``passed`` is not a failure).

    Absent fields get defaults; present nulls stay null. ``failure_idx`` is the
    1-based position in ``order_cols`` order; ``limit`` keeps the first n.
    """
    cols = detailed.columns
    cond = F.lit(False)
    if "status" in cols:
        cond = cond | F.coalesce(F.col("status") == "FAILED", F.lit(False))
    if "passed" in cols:
        cond = cond | F.coalesce(F.col("passed") == F.lit(False), F.lit(False))
    f = detailed.filter(cond)
    for c, default in FAILURE_DEFAULTS.items():
        if c not in cols:
            f = f.withColumn(c, F.lit(default))
    f = f.withColumn("guidance", F.concat(F.lit("Failed on problem "), py_str(F.col("task_id"))))
    # only the keys are sorted and written; the rows meet their numbers in a join
    numbered = global_row_number(f.select(*order_cols), order_cols, name="failure_idx")
    if limit:
        numbered = numbered.filter(F.col("failure_idx") <= limit)
    return null_safe_join(f, numbered, list(order_cols))


def reflection_requests(failures: DataFrame) -> DataFrame:
    """Reflection request text per failure; traceback / guidance lines are blank when absent."""
    def opt_line(c, label):
        return F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(label), F.col(c))).otherwise(F.lit(""))
    req = F.concat(
        F.lit(REFLECTION_HEADER + "\n\nTask Context:\n- Task ID: "), py_str(F.col("task_id")),
        F.lit("\n- Function/Entry Point: "), py_str(F.col("entry_point")),
        F.lit("\n- Error Type: "), py_str(F.col("error_type")),
        F.lit("\n- Error Message: "), py_str(F.col("error_message")),
        F.lit("\n\nFailure Signal Details:\n"), opt_line("traceback", "Traceback: "),
        F.lit("\n"), opt_line("guidance", "Guidance: "), F.lit("\n\n" + REFLECTION_FOOTER))
    return failures.withColumn("request", req)


def parse_reflections(df: DataFrame, output: str = "reflector_output") -> DataFrame:
    """Suggested change (text after the last marker, else ``See log``), analysis and priority.

    ``change_raw`` keeps a trailing priority line, as the source does; ``change``
    is the same text without it.
    """
    o = F.coalesce(F.col(output), F.lit(""))
    has = o.contains(REFLECTION_CHANGE_MARKER)
    after = py_strip(F.element_at(F.split(o, REFLECTION_CHANGE_MARKER, -1), -1))
    change_raw = F.when(has, after).otherwise(F.lit(REFLECTION_NO_CHANGE))
    change = F.when(has, py_strip(F.substring_index(after, REFLECTION_PRIORITY_MARKER, 1))).otherwise(F.lit(REFLECTION_NO_CHANGE))
    analysis = F.when(o.contains(REFLECTION_ANALYSIS_MARKER),
                      py_strip(F.regexp_extract(o, REFLECTION_ANALYSIS_MARKER + "([^\\n]*)", 1)))
    prio = F.regexp_extract(o, REFLECTION_PRIORITY_MARKER + "[ \\t]*(HIGH|MEDIUM|LOW)", 1)
    return (df.withColumn("has_change", has).withColumn("change_raw", change_raw).withColumn("change", change)
              .withColumn("analysis", analysis).withColumn("priority", F.when(prio != "", prio)))


def reflection_summary(events: DataFrame, reflections: DataFrame, run: str = "run_name") -> DataFrame:
    """Per run: failures found, reflections generated, suggestions made, distinct error types."""
    inv = events.filter(F.col("event_type") == "reflector_invocation")
    p = parse_reflections(inv.join(reflections, "event_id", "left"))
    return p.groupBy(run).agg(
        F.count(F.lit(1)).alias("failures_found"),
        F.count_if(F.col("reflector_output").isNotNull()).alias("reflections_generated"),
        F.count_if(F.col("has_change")).alias("suggestions"),
        F.countDistinct("error_type").alias("n_error_types"))


def reflection_list(events: DataFrame, reflections: DataFrame) -> DataFrame:
    """The (task, error, suggested change) rows of each run, as a long table."""
    inv = events.filter(F.col("event_type") == "reflector_invocation")
    p = parse_reflections(inv.join(reflections, "event_id", "left"))
    return p.select("run_name", "event_id", "task_id", "error_type", F.col("change_raw").alias("mutation_suggested"))


def error_shift(gens: DataFrame, seed_id: int = 0, other_id: int = 1, cand: str = "candidate_id",
                sample: str = "sample_idx", first_sample: bool = False) -> DataFrame:
    """Failures per error type for the seed and another candidate, and the change; of all samples,
    or of each task's first one."""
    g = gens.filter(~F.coalesce(F.col("passed"), F.lit(False)))
    g = g.filter(F.col(sample) == 1) if first_sample else g
    p = g.groupBy("error_type").pivot(cand, [seed_id, other_id]).agg(F.count(F.lit(1)))
    p = (p.withColumn("seed_failures", F.coalesce(F.col(str(seed_id)), F.lit(0)).cast("long"))
          .withColumn("optimized_failures", F.coalesce(F.col(str(other_id)), F.lit(0)).cast("long")))
    return (p.select("error_type", "seed_failures", "optimized_failures")
             .withColumn("change", F.col("optimized_failures") - F.col("seed_failures")))
