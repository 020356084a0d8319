"""Baseline comparisons, verdicts, wide comparison documents, run summaries, latest runs, leaderboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalframe.functions.text import pct_string
from evalframe.operators.ordering import global_row_number, null_safe_join
from evalframe.session import ensure_checkpoint_dir

#: Rows that one window task may rank.
FEW = 10_000


def compare(metrics: DataFrame, baseline: str = "1", zero_baseline: float | None = None, run: str = "run_id",
            variant: str = "variant") -> DataFrame:
    """Each variant against the run's baseline variant.

    ``delta_absolute``, ``delta_percent`` (``zero_baseline`` when the baseline
    accuracy is 0: None for the comparison file, 0.0 for reports) and
    ``additional_correct``. ``metrics`` is an aggregate (one row per run and
    variant); the baseline values come from a window over each run's rows, so
    the upstream plan runs once (no self-join).
    """
    m = metrics.withColumn("accuracy", F.when(F.col("total") > 0, F.col("correct") / F.col("total")).otherwise(F.lit(0.0)))
    w = Window.partitionBy(run)
    is_base = F.col(variant) == baseline
    base = F.max(F.when(is_base, F.struct(F.col("accuracy").alias("a"), F.col("correct").alias("c"),
                                          F.col("total").alias("t")))).over(w)
    j = (m.withColumn("_ef_b", base)
          .withColumn("baseline_accuracy", F.col("_ef_b.a"))
          .withColumn("baseline_correct", F.col("_ef_b.c"))
          .withColumn("baseline_total", F.col("_ef_b.t")).drop("_ef_b"))
    d = F.col("accuracy") - F.col("baseline_accuracy")
    return (j.withColumn("delta_absolute", d)
             .withColumn("delta_percent", F.when(F.col("baseline_accuracy") != 0, d / F.col("baseline_accuracy") * 100)
                         .otherwise(F.lit(zero_baseline).cast("double")))
             .withColumn("additional_correct", F.col("correct") - F.col("baseline_correct")))


def verdict(compared: DataFrame) -> DataFrame:
    """IMPROVED / NO_CHANGE / DEGRADED and percent strings, decided on exact integer ratios."""
    lhs = F.col("correct").cast("long") * F.col("baseline_total")
    rhs = F.col("baseline_correct").cast("long") * F.col("total")
    # without a baseline there is nothing to compare: null
    v = F.when(lhs > rhs, F.lit("IMPROVED")).when(lhs == rhs, F.lit("NO_CHANGE")).when(lhs < rhs, F.lit("DEGRADED"))
    return (compared.withColumn("verdict", v)
                    .withColumn("accuracy_pct", pct_string("correct", "total"))
                    .withColumn("baseline_pct", pct_string("baseline_correct", "baseline_total"))
                    .withColumn("improvement_pct", pct_string(lhs - rhs, F.col("total").cast("long") * F.col("baseline_total"))))


def comparison_doc(compared: DataFrame, variants, run: str = "run_id", variant: str = "variant") -> DataFrame:
    """One row per run, one column group per variant (null when a variant is missing)."""
    p = compared.groupBy(run).pivot(variant, list(variants)).agg(
        F.max("accuracy").alias("acc"), F.max("delta_absolute").alias("delta"))
    for v in variants:
        p = p.withColumnRenamed(f"{v}_acc", f"acc_{v}").withColumnRenamed(f"{v}_delta", f"delta_{v}")
    return p


def run_summary(scores: DataFrame, frontier_summary: DataFrame, cand: str = "candidate_id",
                score: str = "val_score", seed_id: int = 0, by=()) -> DataFrame:
    """Best, seed, improvement, percent (0.0 when seed <= 0), frontier score and its gap, counts.

    ``by`` names the run columns; with them the two per-run aggregates meet in an
    equi-join on the run key. ``num_candidates`` is also the iteration count.
    """
    s = scores.groupBy(*by).agg(
        F.max_by(F.col(cand), F.struct(F.col(score), -F.col(cand))).alias("best_candidate_id"),
        F.max(score).alias("best_score"),
        F.max(F.when(F.col(cand) == seed_id, F.col(score))).alias("seed_score"),
        F.count(F.lit(1)).alias("num_candidates"))
    s = (s.withColumn("improvement", F.col("best_score") - F.col("seed_score"))
          .withColumn("improvement_pct", F.when(F.col("seed_score") > 0,
                                                (F.col("best_score") - F.col("seed_score")) / F.col("seed_score") * 100)
                      .otherwise(F.lit(0.0))))
    if by:
        j = s.join(frontier_summary, list(by))
    else:
        # both sides are single-row aggregates
        j = s.withColumn("_k", F.lit(1)).join(frontier_summary.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return j.withColumn("frontier_improvement", F.col("frontier_score") - F.col("best_score"))


def latest(df: DataFrame, by: str, order: str, required: bool = False) -> DataFrame:
    """The row with the greatest ``order`` value per ``by`` group (a partial aggregate).

    ``required=True`` raises when there is nothing to pick from (one-row check).
    """
    other = [c for c in df.columns if c != by]
    out = df.groupBy(by).agg(F.max_by(F.struct(*[F.col(c) for c in other]), F.col(order)).alias("_l")).select(by, "_l.*")
    if required and not out.take(1):
        raise ValueError(f"no rows to pick the latest {order} from")
    return out


def leaderboard(compared: DataFrame, baseline: str = "1", run: str = "run_id", variant: str = "variant") -> DataFrame:
    """Per run: best variant (ties: smallest name), its accuracy, the baseline's, the gain and a dense rank.

    The runs are computed once. Up to ``FEW`` distinct accuracies are ranked in one window, more are
    numbered by a range partitioning; the runs meet their rank in a join.
    """
    per_run = compared.groupBy(run).agg(
        F.min_by(F.col(variant), F.struct(-F.col("accuracy"), F.col(variant))).alias("best_variant"),
        F.max("accuracy").alias("best_accuracy"),
        F.max(F.when(F.col(variant) == baseline, F.col("accuracy"))).alias("baseline_accuracy"))
    ensure_checkpoint_dir(compared.sparkSession)
    per_run = per_run.withColumn("gain", F.col("best_accuracy") - F.col("baseline_accuracy")).checkpoint(eager=True)
    values = per_run.select("best_accuracy").distinct()
    if per_run.count() <= FEW:  # one row per run bounds the distinct values
        ranks = values.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("best_accuracy").desc())))
    else:
        ranks = global_row_number(values, [F.col("best_accuracy").desc()], name="rank").withColumn("rank", F.col("rank").cast("int"))
    return null_safe_join(per_run, ranks, ["best_accuracy"])


def compare_pass_at_k(pk: DataFrame, seed_id: int = 0, other_id: int = 1, ks=(1, 3, 5),
                      cand: str = "candidate_id") -> DataFrame:
    """Code comparison document: seed vs other candidate on pass@k (input: ``metrics.pass_at_k``).

    ``relative_improvement_percent`` is 0.0 when the seed's pass@1 is 0 (the code
    report's rule); pass@k improvements for k > 1 are null unless both sides have
    them; the verdict and the signed improvement string use exact counts.
    One row, from a conditional aggregate over the per-candidate table (no join).
    """
    def side(c, cid):
        return F.max(F.when(F.col(cand) == cid, F.col(c)))
    cols = [side("n_tasks", seed_id).alias("seed_total"), side("n_tasks", other_id).alias("optimized_total")]
    for k in ks:
        cols += [side(f"pass_at_{k}", seed_id).alias(f"seed_pass_at_{k}"), side(f"pass_at_{k}", other_id).alias(f"optimized_pass_at_{k}")]
    cols += [side("solved_at_1", seed_id).alias("seed_passed"), side("solved_at_1", other_id).alias("optimized_passed")]
    a = pk.agg(*cols)
    imp = F.col("optimized_pass_at_1") - F.col("seed_pass_at_1")
    a = (a.withColumn("absolute_improvement", imp)
          .withColumn("relative_improvement_percent",
                      F.when(F.col("seed_pass_at_1") > 0, imp / F.col("seed_pass_at_1") * 100).otherwise(F.lit(0.0)))
          .withColumn("additional_problems_solved", F.col("optimized_passed") - F.col("seed_passed")))
    for k in ks:
        if k != 1:
            a = a.withColumn(f"pass_at_{k}_improvement", F.col(f"optimized_pass_at_{k}") - F.col(f"seed_pass_at_{k}"))
    lhs = F.col("optimized_passed") * F.col("seed_total")
    rhs = F.col("seed_passed") * F.col("optimized_total")
    return (a.withColumn("verdict", F.when(lhs > rhs, F.lit("IMPROVED")).when(lhs < rhs, F.lit("DEGRADED"))
                         .otherwise(F.lit("NO_CHANGE")))
             .withColumn("improvement", pct_string(lhs - rhs, F.col("seed_total") * F.col("optimized_total"), signed=True)))


def summarize_run(scored: DataFrame, key: str = "claim_id", cand: str = "candidate_id", score: str = "score",
                  seed_id: int = 0) -> DataFrame:
    """``run_summary`` in one pass over a scored grid (one score per example and candidate).

    Grouping sets give the totals of each candidate and the best score of each example from one scan
    (partial aggregates, no column per candidate); one global aggregate over them is the summary. An
    empty table gives one row: no candidate, frontier score 0.0.
    """
    sets = scored.groupingSets([[cand], [key]], cand, key).agg(
        F.grouping(cand).alias("_ex"), F.sum(score).alias("_sum"), F.count(score).alias("_n"), F.max(score).alias("_max"))
    is_cand, is_ex = F.col("_ex") == 0, F.col("_ex") == 1
    mean = F.when(is_cand, F.col("_sum") / F.col("_n"))
    g = sets.agg(
        F.max(F.when(is_cand & F.col(cand).isNotNull(), F.struct(mean.alias("s"), (-F.col(cand)).alias("neg_id")))).alias("_best"),
        F.max(F.when(is_cand & (F.col(cand) == seed_id), mean)).alias("seed_score"),
        F.count_if(is_cand & F.col(cand).isNotNull()).alias("num_candidates"),
        F.count_if(is_ex).alias("n_examples"), F.count_if(is_ex & F.col("_max").isNotNull()).alias("_ne"),
        F.count_if(is_ex & (F.col("_max") > 0)).alias("_solved"))
    ratio = lambda c: F.when(F.col("n_examples") > 0, F.col(c) / F.col("n_examples")).otherwise(F.lit(0.0))
    out = g.select(
        (-F.col("_best.neg_id")).cast(scored.schema[cand].dataType).alias("best_candidate_id"), F.col("_best.s").alias("best_score"),
        "seed_score", "num_candidates", "n_examples",
        ratio("_ne").alias("frontier_score"), ratio("_solved").alias("solved_by_any"))
    out = (out.withColumn("improvement", F.col("best_score") - F.col("seed_score"))
              .withColumn("improvement_pct", F.when(F.col("seed_score") > 0,
                                                    (F.col("best_score") - F.col("seed_score")) / F.col("seed_score") * 100)
                          .otherwise(F.lit(0.0))))
    return out.withColumn("frontier_improvement", F.col("frontier_score") - F.col("best_score"))


def report_document(acc: DataFrame, distribution: DataFrame, seed_id: int = 0, other_id: int = 1, cand: str = "candidate_id") -> DataFrame:
    """One row with the sections of an evaluation report: both candidates' performance with their predicted and
    actual label counts, the comparison and the summary. Percent strings come from exact counts."""
    dist = distribution.groupBy(cand).agg(
        *[F.max(F.when(F.col("label") == lab, F.col(side))).alias(f"{side}_{name}")
          for lab, name in (("SUPPORTED", "supported"), ("NOT_SUPPORTED", "not_supported")) for side in ("predicted", "actual")])
    rows = acc.join(dist, cand, "left")
    fields = ["accuracy", "correct", "total", "predicted_supported", "predicted_not_supported", "actual_supported", "actual_not_supported"]
    one = rows.agg(*[F.max(F.when(F.col(cand) == cid, F.col(f))).alias(f"{side}_{f}")
                     for side, cid in (("seed", seed_id), ("optimized", other_id)) for f in fields])
    gain = F.col("optimized_accuracy") - F.col("seed_accuracy")
    lhs, rhs = F.col("optimized_correct") * F.col("seed_total"), F.col("seed_correct") * F.col("optimized_total")
    one = one.withColumn("test_set_size", F.col("seed_total")).withColumn("accuracy_improvement", gain)
    one = one.withColumn("accuracy_improvement_percentage", F.when(F.col("seed_accuracy") > 0, gain / F.col("seed_accuracy") * 100).otherwise(0.0))
    return (one.withColumn("additional_correct_predictions", F.col("optimized_correct") - F.col("seed_correct"))
               .withColumn("seed_pct", pct_string("seed_correct", "seed_total"))
               .withColumn("optimized_pct", pct_string("optimized_correct", "optimized_total"))
               .withColumn("relative_improvement", F.concat("optimized_pct", F.lit(" vs "), "seed_pct"))
               .withColumn("improvement", pct_string(lhs - rhs, F.col("seed_total") * F.col("optimized_total")))
               .withColumn("verdict", F.when(lhs > rhs, F.lit("IMPROVED")).when(lhs < rhs, F.lit("DEGRADED")).when(lhs == rhs, F.lit("NO_CHANGE"))))
