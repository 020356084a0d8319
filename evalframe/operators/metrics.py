"""Quality aggregates: accuracy, label distributions, pass@k, error histograms, sample reports.

All are hash aggregates with a partial (map-side) phase, so a group that holds a
large share of rows is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalframe.functions.constants import NEGATIVE, POSITIVE


def _ratio(num: str, den: str):
    return F.when(F.col(den) > 0, F.col(num) / F.col(den)).otherwise(F.lit(0.0))


def accuracy(scored: DataFrame, by=("candidate_id",), correct: str = "correct") -> DataFrame:
    """correct / total per group; 0.0 for an empty group. Rows without gold count in total."""
    return (scored.groupBy(*by)
                  .agg(F.count_if(F.coalesce(F.col(correct), F.lit(False))).alias("correct"),
                       F.count(F.lit(1)).alias("total"))
                  .withColumn("accuracy", _ratio("correct", "total")))


def label_distribution(scored: DataFrame, examples: DataFrame, by: str = "candidate_id",
                       predicted: str = "predicted_label", gold: str = "answer") -> DataFrame:
    """Two rows per group: predicted count (evaluated rows) and actual count (all examples) per label.

    Only the two canonical labels are counted; zero counts are kept.
    """
    pred = scored.groupBy(by).agg(F.count_if(F.col(predicted) == POSITIVE).alias("_p"),
                                  F.count_if(F.col(predicted) == NEGATIVE).alias("_n"))
    pred_long = pred.select(by, F.explode(F.array(
        F.struct(F.lit(POSITIVE).alias("label"), F.col("_p").alias("predicted")),
        F.struct(F.lit(NEGATIVE).alias("label"), F.col("_n").alias("predicted")))).alias("_x")).select(by, "_x.*")
    act = examples.agg(F.count_if(F.col(gold) == POSITIVE).alias("_p"), F.count_if(F.col(gold) == NEGATIVE).alias("_n"))
    act_long = act.select(F.explode(F.array(
        F.struct(F.lit(POSITIVE).alias("label"), F.col("_p").alias("actual")),
        F.struct(F.lit(NEGATIVE).alias("label"), F.col("_n").alias("actual")))).alias("_x")).select("_x.*")
    # two rows: a proven bound
    return pred_long.join(F.broadcast(act_long), "label")


def pass_at_1(gens: DataFrame, by=("candidate_id",), sample: str | None = "sample_idx") -> DataFrame:
    """passed / total over the first sample of each task; ``sample=None``: the table has one sample per task."""
    g = gens.filter(F.col(sample) == 1) if sample else gens
    return (g.groupBy(*by).agg(F.count_if(F.coalesce(F.col("passed"), F.lit(False))).alias("passed"),
                               F.count(F.lit(1)).alias("total"))
             .withColumn("pass_at_1", _ratio("passed", "total")))


def error_distribution(gens: DataFrame, by=("candidate_id",), sample: str = "sample_idx", first_sample: bool = False) -> DataFrame:
    """Failures per error type, of all samples or of each task's first one; a null error type is its own bucket."""
    g = gens.filter(~F.coalesce(F.col("passed"), F.lit(False)))
    g = g.filter(F.col(sample) == 1) if first_sample else g
    return g.groupBy(*by, "error_type").agg(F.count(F.lit(1)).alias("n"))


def pass_at_k(gens: DataFrame, ks=(1, 3, 5), by=("candidate_id",), task: str = "task_id",
              sample: str = "sample_idx") -> DataFrame:
    """pass@k for all k in one scan: a task is solved at k iff one of its first k samples passed.

    One sample table, prefixes by ``sample <= k``: monotone in k by construction
    (not the unbiased estimator).
    """
    passed = F.coalesce(F.col("passed"), F.lit(False))
    per_task = gens.groupBy(*by, task).agg(*[F.bool_or(passed & (F.col(sample) <= k)).alias(f"_s{k}") for k in ks])
    out = per_task.groupBy(*by).agg(F.count(F.lit(1)).alias("n_tasks"),
                                    *[F.count_if(F.col(f"_s{k}")).alias(f"solved_at_{k}") for k in ks])
    for k in ks:
        out = out.withColumn(f"pass_at_{k}", _ratio(f"solved_at_{k}", "n_tasks"))
    return out


def sample_report(gens: DataFrame, k: int = 5, by=("candidate_id",), task: str = "task_id",
                  sample: str = "sample_idx", code: str | None = None) -> DataFrame:
    """Per task: samples passed, samples, solved flag and the ordered sample list.

    Only the first ``k`` samples are reported (the report is about k samples), so
    each list has at most ``k`` entries. Code is cut to 200 characters.
    """
    g = gens.filter(F.col(sample) <= k)
    passed = F.coalesce(F.col("passed"), F.lit(False))
    fields = [F.col(sample).alias("i"), passed.alias("p"), F.col("error_type").alias("e")]
    if code:
        fields.append(F.substring(F.col(code), 1, 200).alias("c"))
    rep = g.groupBy(*by, task).agg(
        F.count_if(passed).alias("samples_passed"),
        F.count(F.lit(1)).alias("samples"),
        F.bool_or(passed).alias("solved"),
        F.sort_array(F.collect_list(F.struct(*fields))).alias("sample_list"))
    text = F.array_join(F.transform(F.col("sample_list"), lambda s: F.concat(
        s["i"].cast("string"), F.lit(":"), F.when(s["p"], F.lit("P")).otherwise(F.lit("F")),
        F.coalesce(F.concat(F.lit("("), s["e"], F.lit(")")), F.lit("")))), ",")
    return rep.withColumn("sample_text", text)
