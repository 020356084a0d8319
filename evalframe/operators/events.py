"""Run-log analytics: token roll-ups, batch audits, call latency, progress, latest metric values.

Per-run ordered logic (running counts, previous event) goes through
``running_count`` / ``keyed_lag``, which split a run by time bucket, so one run
holding a large share of the log does not become a single window task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.operators.ordering import keyed_lag, null_safe_join, running_count

EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def micros_between(start, end) -> Column:
    """Microseconds from ``start`` to ``end`` (time zone independent for TIMESTAMP_NTZ)."""
    s = F.col(start) if isinstance(start, str) else start
    e = F.col(end) if isinstance(end, str) else end
    return F.timestamp_diff("MICROSECOND", s, e)


def epoch_micros(ts) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH_NTZ), c)


def token_rollup(events: DataFrame, run: str = "run_name", error: str = "error_type",
                 tokens: str = "total_tokens") -> DataFrame:
    """Invocation calls and tokens per (run, error type), per run and overall (ROLLUP).

    ``level`` is the grouping id: 0 detail, 1 run total, 3 grand total.
    """
    inv = events.filter(F.col("event_type") == "reflector_invocation")
    r = inv.rollup(run, error).agg(F.count(F.lit(1)).alias("n_calls"), F.sum(tokens).alias("sum_tokens"),
                                   F.max(tokens).alias("max_tokens"), F.grouping_id().cast("int").alias("level"))
    return r.withColumn("avg_tokens", F.col("sum_tokens").cast("double") / F.col("n_calls"))


def batch_audit(events: DataFrame, run: str = "run_name", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Batches per run: each ``batch_start`` opens a batch holding the events up to the next start.

    Per batch: invocations observed, completions, whether it completed, and the
    duration from the start to the first completion. Batch 0 holds events seen
    before any start.
    """
    e = running_count(events, run, ts, tie, flag=F.col("event_type") == "batch_start", name="batch_seq")
    is_start = F.col("event_type") == "batch_start"
    is_done = F.col("event_type") == "batch_complete"
    extra = []
    # logs read with ``read_events`` also carry the declared and processed counts
    if "num_failures" in events.columns:
        extra.append(F.max(F.when(is_start, F.col("num_failures"))).alias("declared"))
    if "num_processed" in events.columns:
        extra.append(F.max(F.when(is_done, F.col("num_processed"))).alias("processed"))
    b = e.groupBy(run, "batch_seq").agg(
        F.min(F.when(is_start, F.col(ts))).alias("_start"),
        F.min(F.when(is_done, F.col(ts))).alias("_done"),
        F.count_if(F.col("event_type") == "reflector_invocation").alias("n_invocations"),
        F.count_if(is_done).alias("n_completes"), *extra)
    return (b.withColumn("complete", F.col("n_completes") > 0)
             .withColumn("duration_us", micros_between("_start", "_done"))
             .drop("_start", "_done"))


def call_latency(events: DataFrame, run: str = "run_name", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Gap to the previous event of the same run, in microseconds (null for the first)."""
    e = keyed_lag(events, run, ts, tie, ts, "prev_ts")
    return e.withColumn("gap_us", micros_between("prev_ts", ts))


def progress(events: DataFrame, run: str = "run_name", ts: str = "ts", tie: str = "event_id",
             every: int = 10) -> DataFrame:
    """Running progress over invocations: processed so far, total, ``int(cur/total*100)``, every-n marker."""
    inv = events.filter(F.col("event_type") == "reflector_invocation")
    totals = inv.groupBy(run).agg(F.count(F.lit(1)).alias("total"))
    r = null_safe_join(running_count(inv, run, ts, tie, name="processed"), totals, [run])
    return (r.withColumn("pct", F.floor(F.col("processed") / F.col("total") * 100).cast("int"))
             .withColumn("milestone", (F.col("processed") % every) == 0))


def latest_metric(metrics: DataFrame, name: str = "name", step: str = "step", value: str = "value",
                  ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Value at the highest step per metric; a later timestamp (then event id) breaks ties."""
    order = F.struct(F.col(step), F.col(ts), F.col(tie))
    return metrics.groupBy(name).agg(F.max(step).alias("latest_step"),
                                     F.max_by(F.col(value), order).alias("latest_value"),
                                     F.count(F.lit(1)).alias("n_points"))
