"""Batched prediction and scoring through user-supplied Python functions (the one slow path).

``predict`` and ``score_with`` run the caller's function in ``mapInPandas``:
Arrow batches, the client is built once per task, requests are sent in groups
of ``batch_size``. Select / filter before calling them: nothing is pushed
through the Python stage. Persist the outputs (``persist_outputs``) before
computing metrics so that task retries and several consumers never call the
model twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalframe.session import scratch_path


def with_retries(call: Callable, retries: int = 3, max_wait: float = 5.0, sleep=time.sleep) -> Callable:
    """Wrap ``call`` with ``retries`` extra attempts and waits of ``min(2**attempt, max_wait)`` seconds."""
    def wrapped(*a, **kw):
        for attempt in range(retries + 1):
            try:
                return call(*a, **kw)
            except Exception:
                if attempt == retries:
                    raise
                sleep(min(2 ** attempt, max_wait))
    return wrapped


def per_request(call: Callable, column: str = "messages") -> Callable:
    """Adapt a one-request function (e.g. messages -> reply text) to the batch interface."""
    def batch(pdf):
        return [call(_plain(x)) for x in pdf[column]]
    return batch


def _plain(x):
    """Arrow hands nested values as numpy arrays of dicts; give the caller lists and dicts."""
    if hasattr(x, "tolist") and not isinstance(x, (str, bytes)):
        x = x.tolist()
    if isinstance(x, list):
        return [_plain(v) for v in x]
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    return x


def predict(df: DataFrame, fn: Callable, keys: Sequence[str], inputs: Sequence[str] = ("messages",),
            output: str = "response", batch_size: int = 32, parallelism: int | None = None,
            factory: bool = False, whole_call: bool = False) -> DataFrame:
    """Call ``fn`` on batches of rows and return (keys..., output, failed, error).

    ``fn(batch: pandas.DataFrame) -> Sequence[str]``; with ``factory=True``,
    ``fn()`` builds that callable once per task (e.g. a model client). Prefer
    flat string inputs (``system_content``, ``user_content``) over the nested
    ``messages`` array: nested values cost a Python object per element on the
    way into pandas; build the chat messages inside ``fn``. A batch call that raises
    is repeated in halves, down to single rows; a row that still raises gets ``''``, ``failed = true`` and the
    exception in ``error``. With ``whole_call=True`` a call that raises fails all its rows
    and nothing is called twice. Output rows keep their keys, so order never matters.
    """
    import pandas as pd

    keys, inputs = list(keys), list(inputs)
    src = df.select(*keys, *[c for c in inputs if c not in keys])
    if parallelism:
        src = src.repartition(parallelism)
    schema = T.StructType([src.schema[k] for k in keys] + [T.StructField(output, T.StringType()), T.StructField("failed", T.BooleanType()),
                                                           T.StructField("error", T.StringType())])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = fn() if factory else fn
        for pdf in it:
            rows = []
            for start in range(0, len(pdf), batch_size):
                rows += call_group(call, pdf.iloc[start:start + batch_size].reset_index(drop=True), whole_call)
            res = pdf[keys].reset_index(drop=True)
            res[output] = [r[0] for r in rows]
            res["failed"] = [r[1] for r in rows]
            res["error"] = [r[2] for r in rows]
            yield res

    return src.mapInPandas(run, schema)


def call_group(call: Callable, part, whole_call: bool = False) -> list[tuple[str, bool, str | None]]:
    """(reply, failed, error) of each row of a pandas batch: one call, or by halves down to the rows that fail."""
    try:
        outs = [("" if o is None else str(o)) for o in call(part)]
        if len(outs) != len(part):
            raise ValueError(f"prediction function returned {len(outs)} rows for {len(part)}")
        return [(o, False, None) for o in outs]
    except Exception as e:
        if whole_call or len(part) == 1:
            return [("", True, describe(e))] * len(part)
    # halves, down to the rows that fail: few calls where few rows do
    mid = len(part) // 2
    return [r for half in (part.iloc[:mid], part.iloc[mid:]) for r in call_group(call, half.reset_index(drop=True), whole_call)]


def describe(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


def score_with(df: DataFrame, fn: Callable, keys: Sequence[str], inputs: Sequence[str], result_schema: T.StructType,
               batch_size: int = 64, parallelism: int | None = None, factory: bool = False, on_error: Callable | None = None) -> DataFrame:
    """Run a user scorer over batches: ``fn(batch) -> pandas.DataFrame`` with ``result_schema``'s columns.

    The output is (keys..., result columns). Rows that a scorer need not see
    (already classified, e.g. missing function) should be filtered out first. A call that raises, or
    answers with another number of rows, is repeated in halves; a row that still fails gets
    ``on_error(exception)``, a dict of result columns, or raises where that is not given.
    """
    import pandas as pd

    keys, inputs = list(keys), list(inputs)
    src = df.select(*keys, *[c for c in inputs if c not in keys])
    if parallelism:
        src = src.repartition(parallelism)
    schema = T.StructType([src.schema[k] for k in keys] + list(result_schema.fields))
    names = result_schema.names

    def one_group(call, part):
        try:
            out = pd.DataFrame(call(part)).reset_index(drop=True)
            if len(out) != len(part):
                raise ValueError(f"scorer returned {len(out)} rows for {len(part)}")
            return list(zip(*[out[n].tolist() if n in out.columns else [None] * len(part) for n in names], strict=True))
        except Exception as e:
            if len(part) == 1:
                if on_error is None:
                    raise
                failed = on_error(e)
                return [tuple(failed.get(n) for n in names)]
        mid = len(part) // 2
        return [r for half in (part.iloc[:mid], part.iloc[mid:]) for r in one_group(call, half.reset_index(drop=True))]

    def run(it):
        call = fn() if factory else fn
        for pdf in it:
            for start in range(0, len(pdf), batch_size):
                part = pdf.iloc[start:start + batch_size].reset_index(drop=True)
                rows = one_group(call, part)
                res = part[keys].copy()
                for n, values in zip(names, zip(*rows, strict=True), strict=True):
                    res[n] = pd.Series(values, dtype=object)
                yield res

    return src.mapInPandas(run, schema)


def persist_outputs(df: DataFrame, path: str | None = None, partition_by: Sequence[str] = (), mode: str = "append") -> DataFrame:
    """Write model outputs once (parquet under the shared checkpoint folder by default) and read them back.

    Outputs that lie there already stay: what a model has answered is not overwritten. Callers that
    resume write only what is missing (``landed_outputs``, ``splits.remaining``).
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, "outputs")
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def landed_outputs(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Outputs of an earlier run at ``path``, in any store that Spark reads; none where the folder does not exist."""
    from pyspark.errors import AnalysisException
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def fill_llm_failures(code_outputs: DataFrame) -> DataFrame:
    """Code flavour of a failed call: not passed, ``LLMError`` / ``llm_error``, the call's error as message."""
    f = F.coalesce(F.col("failed"), F.lit(False))
    out = (code_outputs.withColumn("passed", F.when(f, F.lit(False)).otherwise(F.col("passed")))
                       .withColumn("error_type", F.when(f, F.lit("LLMError")).otherwise(F.col("error_type")))
                       .withColumn("status", F.when(f, F.lit("llm_error")).otherwise(F.col("status"))))
    if "error" in out.columns and "error_message" in out.columns:
        out = out.withColumn("error_message", F.when(f, F.col("error")).otherwise(F.col("error_message")))
    return out
