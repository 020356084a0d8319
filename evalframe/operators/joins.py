"""Keyed joins: evaluation grid, gold scoring, few-shot attachment, training merge, failure fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalframe.functions.constants import NEGATIVE
from evalframe.functions.verdicts import label_match, parse_verdict
from evalframe.operators.ordering import hashed_rows

#: Candidate tables up to this many bytes are broadcast; larger ones are met in a salted join.
BROADCAST_BYTES = 32 << 20
GRID_SALTS = 64


def evaluation_grid(examples: DataFrame, candidates: DataFrame, key: str = "candidate_id",
                    broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Every candidate on every example; no cartesian join operator and no bound on the candidates.

    Candidates are numbered, each example is expanded to all numbers by a generator, and an
    equi-join on the number brings the attributes. The candidate table is measured: it is broadcast
    up to ``broadcast_bytes``; beyond, the number is salted on both sides, so that few candidates
    do not make few tasks. One row per candidate id: of rows that repeat an id the smallest is
    taken; rows with a null id are left out. Example rows should be spread before, not after.
    """
    other = [c for c in candidates.columns if c != key]
    k = candidates.filter(F.col(key).isNotNull())
    k = k.groupBy(key).agg(F.min(F.struct(*other)).alias("_ef_o")).select(key, "_ef_o.*") if other else k.distinct()
    n, size = k.agg(F.count(F.lit(1)), F.sum(F.length(F.to_json(F.struct(*k.columns))))).first()
    if not n:
        return examples.withColumn(key, F.lit(None).cast(candidates.schema[key].dataType)).limit(0).select(
            "*", *[F.lit(None).cast(candidates.schema[c].dataType).alias(c) for c in other])
    grid = examples.withColumn("_ef_no", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long"))))
    if size <= broadcast_bytes:  # so few bytes may also be numbered in one task
        numbered = k.withColumn("_ef_no", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(key)).cast("long"))
        out = grid.join(F.broadcast(numbered), "_ef_no")
    else:
        numbered = hashed_rows(k.withColumn("_ef_h", F.md5(F.col(key).cast("string"))), "_ef_h", key, name="_ef_no")[0].drop("_ef_h")
        salt = F.pmod(F.xxhash64(*examples.columns), F.lit(GRID_SALTS))
        salted = numbered.withColumn("_ef_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(GRID_SALTS - 1).cast("long"))))
        out = grid.withColumn("_ef_salt", salt).join(salted, ["_ef_no", "_ef_salt"]).drop("_ef_salt")
    return out.drop("_ef_no").select(*examples.columns, key, *other)


def score_outputs(outputs: DataFrame, examples: DataFrame, key: str = "claim_id",
                  predicted: str = "predicted_label", gold: str = "answer") -> DataFrame:
    """Predictions joined to gold by key (left join: rows without gold stay, scored 0).

    Adds ``answer``, ``correct`` (bool) and ``score`` (1.0 / 0.0).
    """
    g = examples.select(key, F.col(gold).alias("answer"))
    j = outputs.join(g, key, "left")
    ok = label_match(F.col(predicted), F.col("answer"))
    return j.withColumn("correct", ok).withColumn("score", F.when(ok, 1.0).otherwise(0.0))


def parse_and_score(responses: DataFrame, examples: DataFrame, key: str = "claim_id",
                    response: str = "response") -> DataFrame:
    """Verdict parsing (E1) followed by gold scoring (D1/E5)."""
    return score_outputs(responses.withColumn("predicted_label", parse_verdict(F.col(response))),
                         examples, key=key)


def text_key(col: str) -> Column:
    """A 256-bit digest that stands for a long text in joins and groups; null for null."""
    return F.sha2(F.col(col), 256)


def attach_fewshot(examples: DataFrame, fewshot: DataFrame, example_key: str = "input",
                   fewshot_key: str = "input", id_col: str = "id", value_col: str = "few_shot") -> DataFrame:
    """Attach few-shots by exact key; duplicate few-shot keys: the row with the largest id wins.

    Adds ``fewshot_id``, ``few_shot`` and ``attached``. The per-key pick is a
    partial (map-side) aggregate, so a hot key never gathers in one task. Keys are whole
    texts: their digests are what is grouped, shuffled and compared.
    """
    last = (fewshot.groupBy(text_key(fewshot_key).alias("_ef_key"))
                   .agg(F.max_by(F.struct(F.col(id_col).alias("fewshot_id"), F.col(value_col).alias("few_shot")),
                                 F.col(id_col)).alias("_ef_fs")))
    j = examples.withColumn("_ef_k", text_key(example_key)).join(last, F.col("_ef_k") == F.col("_ef_key"), "left").drop("_ef_k")
    return (j.withColumn("fewshot_id", F.col("_ef_fs.fewshot_id"))
             .withColumn("few_shot", F.col("_ef_fs.few_shot"))
             .withColumn("attached", F.col("_ef_key").isNotNull())
             .drop("_ef_key", "_ef_fs"))


def attach_stats(attached: DataFrame) -> DataFrame:
    """Count attached / total after ``attach_fewshot``."""
    return attached.agg(F.count_if(F.col("attached")).alias("attached"), F.count(F.lit(1)).alias("total"))


def merge_training(csv_rows: DataFrame, canonical: DataFrame, key: str = "input", canonical_id: str = "id",
                   take: tuple[str, ...] = ("answer", "context_id")) -> DataFrame:
    """Training rows from a few-shot CSV, preferring the canonical row's fields.

    Canonical duplicates: largest id wins. A matched row takes the canonical
    values even when they are null (gated on the match flag); an unmatched row
    keeps its CSV values. One output row per CSV row.
    """
    canon = (canonical.groupBy(text_key(key).alias("_ef_key"))
                      .agg(F.max_by(F.struct(*[F.col(c) for c in take]), F.col(canonical_id)).alias("_ef_c")))
    j = csv_rows.withColumn("_ef_k", text_key(key)).join(canon, F.col("_ef_k") == F.col("_ef_key"), "left").drop("_ef_k")
    matched = F.col("_ef_key").isNotNull()
    for c in take:
        csv_val = F.col(c) if c in csv_rows.columns else F.lit(None)
        j = j.withColumn(c, F.when(matched, F.col(f"_ef_c.{c}")).otherwise(csv_val))
    return j.withColumn("matched", matched).drop("_ef_key", "_ef_c")


def fill_failures(grid: DataFrame, outputs: DataFrame, keys: list[str], response: str = "response") -> DataFrame:
    """Grid left-joined to landed outputs; missing calls get an empty response and ``failed``."""
    o = outputs.select(*keys, F.col(response).alias("_ef_resp")).withColumn("_ef_hit", F.lit(True))
    j = grid.join(o, keys, "left")
    failed = F.col("_ef_hit").isNull()
    return (j.withColumn(response, F.when(failed, F.lit("")).otherwise(F.coalesce(F.col("_ef_resp"), F.lit(""))))
             .withColumn("failed", failed)
             .drop("_ef_resp", "_ef_hit"))


def fill_claim_failures(grid: DataFrame, outputs: DataFrame, examples: DataFrame, failure_score: float = 0.0,
                        key: str = "claim_id", candidate: str = "candidate_id") -> DataFrame:
    """Claims flavour: failed calls read ``NOT_SUPPORTED`` and score ``failure_score``."""
    f = fill_failures(grid, outputs, [key, candidate])
    f = f.withColumn("predicted_label", F.when(F.col("failed"), F.lit(NEGATIVE)).otherwise(parse_verdict(F.col("response"))))
    s = score_outputs(f, examples, key=key)
    return s.withColumn("score", F.when(F.col("failed"), F.lit(float(failure_score))).otherwise(F.col("score")))


def score_failed(outputs: DataFrame, examples: DataFrame, failure_score: float = 0.0, key: str = "claim_id") -> DataFrame:
    """Score outputs that hold their failed calls (``failed``): those read ``NOT_SUPPORTED`` and score ``failure_score``."""
    f = outputs.withColumn("predicted_label", F.when(F.col("failed"), F.lit(NEGATIVE)).otherwise(parse_verdict(F.col("response"))))
    s = score_outputs(f, examples, key=key)
    return s.withColumn("score", F.when(F.col("failed"), F.lit(float(failure_score))).otherwise(F.col("score")))
