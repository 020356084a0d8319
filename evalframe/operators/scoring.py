"""Classification of generations: test presence, entry-point check, then the execution result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.functions.code import missing_function, status_of

# FIXED VALUES: messages of generations that are decided without a run.
NO_TEST_MESSAGE = "No test code provided for this problem"
MISSING_FUNCTION_MESSAGE = ("Function '", "' not found in generated code")
NO_RESULT_MESSAGE = "No execution result"


def classify(rows: DataFrame, ran: Column) -> DataFrame:
    """Precedence ``NoTestCode`` > ``MissingFunction`` (entry point not a substring of the code)
    > the execution result; a row that has not ``ran`` is ``UnknownError``.

    ``rows``: code, entry_point, test, and the result columns passed, error_type, error_message
    (null where nothing ran). Adds ``status``.
    """
    no_test = F.coalesce(F.col("test"), F.lit("")) == ""
    missing = missing_function(F.col("code"), F.col("entry_point"))
    err = (F.when(no_test, F.lit("NoTestCode")).when(missing, F.lit("MissingFunction"))
            .when(~ran, F.lit("UnknownError")).otherwise(F.col("error_type")))
    msg = (F.when(no_test, F.lit(NO_TEST_MESSAGE))
            .when(missing, F.concat(F.lit(MISSING_FUNCTION_MESSAGE[0]), F.col("entry_point"), F.lit(MISSING_FUNCTION_MESSAGE[1])))
            .when(~ran, F.lit(NO_RESULT_MESSAGE)).otherwise(F.col("error_message")))
    passed = F.when(no_test | missing | ~ran, F.lit(False)).otherwise(F.col("passed"))
    out = rows.select(*[c for c in rows.columns if c not in ("passed", "error_type", "error_message")],
                      passed.alias("passed"), err.alias("error_type"), msg.alias("error_message"))
    return out.withColumn("status", status_of(F.col("passed"), F.col("error_type")))


def classify_generations(gens: DataFrame, tasks: DataFrame, results: DataFrame, key="reply_id",
                         task_key: str = "task_id") -> DataFrame:
    """``classify`` over separate tables.

    ``gens``: (key, task_key, code); ``tasks``: (task_key, entry_point, test), one row per task;
    ``results``: (key, passed, error_type[, error_message, traceback]). ``key`` may be several columns.
    Tasks meet generations by their own key: entry points may repeat.
    """
    keys = [key] if isinstance(key, str) else list(key)
    extra = [c for c in ("traceback",) if c in results.columns]
    msg = F.col("error_message") if "error_message" in results.columns else F.lit(None).cast("string").alias("error_message")
    r = results.select(*keys, "passed", "error_type", msg, *extra, F.lit(True).alias("_ef_ran"))
    j = gens.join(tasks.select(task_key, "entry_point", "test"), task_key, "left").join(r, keys, "left")
    return classify(j, F.col("_ef_ran").isNotNull()).drop("_ef_ran", "test")


def needs_execution(gens: DataFrame) -> DataFrame:
    """Generations (with test and entry_point) that still need a scorer: a test exists and the entry point is present."""
    return gens.filter((F.coalesce(F.col("test"), F.lit("")) != "") & ~missing_function(F.col("code"), F.col("entry_point")))
