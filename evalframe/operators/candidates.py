"""Candidate analytics: scoreboard, best candidate, per-example frontier, coverage, minibatch gate.

Every function takes ``by``: the columns that identify a run (empty = the table
is one run). Many runs are then analysed in one pass, grouped by run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def candidate_scores(scored: DataFrame, cand: str = "candidate_id", score: str = "score", by=()) -> DataFrame:
    """Mean score per candidate (sum / count)."""
    return (scored.groupBy(*by, cand).agg(F.count(F.lit(1)).alias("n"), F.sum(score).alias("score_sum"))
                  .withColumn("val_score", F.col("score_sum") / F.col("n")))


def best_candidate(scores: DataFrame, cand: str = "candidate_id", score: str = "val_score", by=()) -> DataFrame:
    """Highest score; ties go to the lowest candidate id."""
    return scores.groupBy(*by).agg(F.max_by(F.col(cand), F.struct(F.col(score), -F.col(cand))).alias("best_candidate_id"),
                                   F.max(score).alias("best_score"))


def instance_frontier(scored: DataFrame, key: str = "claim_id", cand: str = "candidate_id",
                      score: str = "score", by=()) -> DataFrame:
    """Per example: the best score and the sorted set of candidates reaching it.

    The best score comes from a window over the example's rows (one per candidate), the set from a
    group on the same key: one exchange, however many candidates there are. An example without a
    score has a null best score and an empty frontier.
    """
    w = Window.partitionBy(*by, key)
    best = scored.withColumn("_ef_best", F.max(score).over(w))
    out = best.groupBy(*by, key).agg(
        F.max("_ef_best").alias("best_score"),
        F.sort_array(F.collect_set(F.when(F.col(score) == F.col("_ef_best"), F.col(cand)))).alias("frontier"))
    return out.withColumn("frontier_size", F.size("frontier")).select(*by, key, "best_score", "frontier", "frontier_size")


def frontier_score(frontier: DataFrame, by=()) -> DataFrame:
    """Share of examples with a non-empty frontier (always 1.0 when every example was scored)
    and the share whose best score is positive (``solved_by_any``)."""
    a = frontier.groupBy(*by).agg(F.count(F.lit(1)).alias("n_examples"),
                                  F.count_if(F.col("frontier_size") > 0).alias("_ne"),
                                  F.count_if(F.col("best_score") > 0).alias("_solved"))

    def ratio(c):
        return F.when(F.col("n_examples") > 0, F.col(c) / F.col("n_examples")).otherwise(F.lit(0.0))

    return a.select(*by, "n_examples", ratio("_ne").alias("frontier_score"), ratio("_solved").alias("solved_by_any"))


def frontier_coverage(frontier: DataFrame, candidates: DataFrame, cand: str = "candidate_id", by=()) -> DataFrame:
    """How many examples each candidate is on the frontier of (zeros kept for listed candidates)."""
    wins = frontier.select(*by, F.explode("frontier").alias(cand)).groupBy(*by, cand).agg(F.count(F.lit(1)).alias("n_wins"))
    return (candidates.select(*by, cand).join(wins, [*by, cand], "left")
                      .withColumn("n_wins", F.coalesce(F.col("n_wins"), F.lit(0))))


def minibatch_gate(scored: DataFrame, minibatches: DataFrame, pairs: DataFrame, key: str = "claim_id",
                   cand: str = "candidate_id", parent: str = "parent_id", score: str = "score") -> DataFrame:
    """New candidate vs its parent on the same minibatch; ``promote`` only if the new sum is higher.

    ``pairs``: (iteration, candidate_id, parent_id). One join of the scored table
    against the (minibatch x pair x role) rows, then conditional sums.
    """
    roles = (minibatches.join(pairs, "iteration")
             .select("iteration", key, F.col(cand).alias("_new"), F.col(parent).alias("_parent"),
                     F.explode(F.array(F.struct(F.lit("new").alias("role"), F.col(cand).alias("_c")),
                                       F.struct(F.lit("parent").alias("role"), F.col(parent).alias("_c")))).alias("_r"))
             .select("iteration", key, "_new", "_parent", "_r.role", F.col("_r._c").alias(cand)))
    j = roles.join(scored.select(key, cand, score), [key, cand], "left")
    s = F.coalesce(F.col(score), F.lit(0.0))
    out = j.groupBy("iteration", "_new", "_parent").agg(
        F.sum(F.when(F.col("role") == "new", s).otherwise(0.0)).alias("new_score"),
        F.sum(F.when(F.col("role") == "parent", s).otherwise(0.0)).alias("parent_score"),
        F.count_if(F.col("role") == "new").alias("n"))
    return (out.withColumnRenamed("_new", cand).withColumnRenamed("_parent", parent)
               .withColumn("promote", F.col("new_score") > F.col("parent_score")))


def score_progression(scores: DataFrame, cand: str = "candidate_id", score: str = "val_score", by=()) -> DataFrame:
    """Candidate scores in id order with the previous score, the change and the best so far.

    The window is partitioned by run and holds one row per candidate (bounded).
    """
    w = Window.partitionBy(*by).orderBy(cand) if by else Window.orderBy(cand)
    return (scores.select(*by, cand, score)
                  .withColumn("prev_score", F.lag(score).over(w))
                  .withColumn("delta", F.col(score) - F.col("prev_score"))
                  .withColumn("best_so_far", F.max(score).over(w.rowsBetween(Window.unboundedPreceding, 0))))


# ------------------------------------------------------- wins as bitmaps, parents
def win_bitmaps(scored: DataFrame, key: str = "claim_id", cand: str = "candidate_id", score: str = "score", by=()) -> DataFrame:
    """Per candidate and block of examples a bitmap of those on whose frontier it is: (by..., candidate, block, wins).

    ``key`` is a whole number; Spark's bitmap aggregates put 32,768 of them in a block of 4 KB, so no
    example's set of candidates is gathered and none is shuffled. An example without a score has no winner.
    """
    best = F.max(score).over(Window.partitionBy(*by, key))
    won = scored.withColumn("_ef_best", best).filter(F.col(score) == F.col("_ef_best"))
    return won.groupBy(*by, cand, F.bitmap_bucket_number(key).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(key)).alias("wins"))


def coverage_of(bitmaps: DataFrame, candidates: DataFrame, cand: str = "candidate_id", by=()) -> DataFrame:
    """``frontier_coverage`` from bitmaps."""
    wins = bitmaps.groupBy(*by, cand).agg(F.sum(F.bitmap_count("wins")).cast("long").alias("n_wins"))
    return candidates.select(*by, cand).join(wins, [*by, cand], "left").withColumn("n_wins", F.coalesce("n_wins", F.lit(0).cast("long")))


def undominated(bitmaps: DataFrame, scores: DataFrame, cand: str = "candidate_id", score: str = "val_score", by=()) -> DataFrame:
    """Candidates with a win that no other candidate has all wins of: (by..., candidate, n_wins, score).

    One that wins the same examples as another stays only if its score is higher, or equal with a
    smaller id. Two candidates meet in the blocks that both have wins in, and the AND of their bitmaps
    counts the examples that both win.
    """
    n = bitmaps.groupBy(*by, cand).agg(F.sum(F.bitmap_count("wins")).alias("n_wins")).join(scores.select(*by, cand, F.col(score).alias("_ef_score")), [*by, cand])
    other = bitmaps.select(*by, F.col(cand).alias("_ef_o"), "block", F.col("wins").alias("_ef_w"))
    pairs = bitmaps.join(other, [*by, "block"]).filter(F.col(cand) != F.col("_ef_o"))
    # the AND of two: an aggregate over the two rows of a pair's block
    two = pairs.select(*by, cand, "_ef_o", "block", F.explode(F.array("wins", "_ef_w")).alias("w"))
    both = two.groupBy(*by, cand, "_ef_o", "block").agg(F.bitmap_count(F.expr("bitmap_and_agg(w)")).alias("n")).groupBy(*by, cand, "_ef_o").agg(F.sum("n").alias("_ef_both"))
    o = n.select(*by, F.col(cand).alias("_ef_o"), F.col("n_wins").alias("_ef_on"), F.col("_ef_score").alias("_ef_os"))
    j = both.join(n, [*by, cand]).join(o, [*by, "_ef_o"])
    ahead = (F.col("_ef_on") > F.col("n_wins")) | (F.col("_ef_os") > F.col("_ef_score")) | ((F.col("_ef_os") == F.col("_ef_score")) & (F.col("_ef_o") < F.col(cand)))
    beaten = j.filter((F.col("_ef_both") == F.col("n_wins")) & ahead).select(*by, cand).distinct()
    return n.join(beaten, [*by, cand], "left_anti").select(*by, cand, F.col("n_wins").cast("long").alias("n_wins"), F.col("_ef_score").alias(score))


def select_parents(front: DataFrame, k: int, seed=42, cand: str = "candidate_id", weight: str = "n_wins", by=(), round_: Column | int = 0) -> DataFrame:
    """``k`` candidates drawn without replacement with probability by ``weight``, and their place in the draw.

    Each candidate's key is -ln(u) / weight, u in (0, 1] from md5(seed|round|id): the k smallest are such
    a draw, whatever the partitioning, and each round is another one. Candidates without weight are not drawn.
    """
    r = round_ if isinstance(round_, Column) else F.lit(round_)
    h = F.md5(F.concat(F.lit(str(seed)), F.lit("|"), r.cast("string"), F.lit("|"), F.col(cand).cast("string")))
    u = (F.conv(F.substring(h, 1, 12), 16, 10).cast("double") + 1) / F.lit(float(1 << 48))
    keyed = front.filter(F.col(weight) > 0).withColumn("_ef_key", -F.log(u) / F.col(weight))
    # one row per candidate of a run
    w = Window.partitionBy(*by).orderBy("_ef_key", cand) if by else Window.partitionBy(F.lit(0)).orderBy("_ef_key", cand)
    return keyed.withColumn("draw", F.row_number().over(w)).filter(F.col("draw") <= k).drop("_ef_key")
