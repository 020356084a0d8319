"""Seeded, exact, keyed splits and samples.

Row order comes from ``md5(seed || '|' || id)`` with the id as tie-breaker, so a
split is reproducible on any engine that has md5. Exact sizes need positions;
``hashed_rows`` (md5 keys) and ``global_row_number`` give them without an un-partitioned window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalframe.operators.ordering import first_hashed, global_row_number, hashed_rows, number_rows


def shuffle_key(id_col, seed) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    # a null id is shuffled like the empty text
    return F.md5(F.concat(F.lit(str(seed)), F.lit("|"), F.coalesce(c.cast("string"), F.lit(""))))


def shuffled_with_total(df: DataFrame, id_col: str, seed, name: str = "rank") -> tuple[DataFrame, int]:
    # md5 keys are uniform: numbered by hash buckets, nothing is materialised
    r, n = hashed_rows(df.withColumn("_ef_key", shuffle_key(id_col, seed)), "_ef_key", id_col, name=name)
    return r.drop("_ef_key"), n


def shuffled(df: DataFrame, id_col: str, seed, name: str = "rank") -> DataFrame:
    """Add the 1-based position in the seeded shuffle."""
    return shuffled_with_total(df, id_col, seed, name)[0]


def split_fraction(df: DataFrame, id_col: str, fraction: float = 0.8, seed=42,
                   names: tuple[str, str] = ("train", "val")) -> DataFrame:
    """Seeded shuffle, first ``int(n * fraction)`` rows are ``names[0]``, the rest ``names[1]``."""
    r, n = shuffled_with_total(df, id_col, seed)
    cut = int(n * fraction)
    return r.withColumn("split", F.when(F.col("rank") <= cut, F.lit(names[0])).otherwise(F.lit(names[1])))


def split_fixed(df: DataFrame, id_col: str, sizes=(50, 50), seed=42,
                names: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """Fixed-size parts in shuffled order; the last name takes the rest."""
    r = shuffled(df, id_col, seed)
    bounds = []
    acc = 0
    for s in sizes:
        acc += s
        bounds.append(acc)
    expr = None
    for b, name in zip(bounds, names):
        cond = F.col("rank") <= b
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return r.withColumn("split", expr.otherwise(F.lit(names[len(bounds)])))


def sample_n(df: DataFrame, id_col: str, n: int, seed=42) -> DataFrame:
    """``n`` rows of the seeded shuffle, with their sample position (LONG). Only the rows that can be among them are numbered."""
    first = first_hashed(df.withColumn("_ef_first", shuffle_key(id_col, seed)), "_ef_first", n).drop("_ef_first")
    return shuffled(first, id_col, seed, name="sample_rank").filter(F.col("sample_rank") <= n)


def head_pct(df: DataFrame, order_col: str, pct: float) -> DataFrame:
    """First ``max(1, int(n * pct / 100))`` rows in ``order_col`` order (a unique key) and their ``position``.

    A numeric key's quantile, a little beyond the boundary, tells which keys can be among them: those alone
    are sorted and numbered. The rows are cut by the boundary key, a filter that reaches the scan, and
    meet their positions in a join on the key.
    """
    n, keys, key = df.count(), df.select(order_col), F.col(order_col)
    k = max(1, int(n * pct / 100))
    if n and isinstance(df.schema[order_col].dataType, T.NumericType):
        edge = keys.agg(F.percentile_approx(key, min(1.0, 1.02 * k / n + 0.001), 10_000)).first()[0]
        few = keys.filter(key.isNull() | (key <= F.lit(edge))) if edge is not None else keys
        keys = few if few.count() >= k else keys  # the quantile is an estimate, the size is not
    first = number_rows(keys, [order_col], name="position")[0].filter(F.col("position") <= k)
    if df.columns == [order_col]:
        return first
    bound = first.agg(F.max(order_col)).first()[0]
    rows = df.filter(key <= F.lit(bound)) if bound is not None else df
    return rows.join(first, order_col).select(*df.columns, "position")


def holdout(all_rows: DataFrame, train: DataFrame, key: str = "input") -> DataFrame:
    """Rows whose key text is not in train (their duplicates go too).

    Digests of the texts are compared and shuffled, not the texts. The train keys are made
    distinct first (a map-side partial aggregate), so a text repeated across many train rows
    reaches the join once.
    """
    seen = train.select(F.sha2(F.col(key), 256).alias("_ef_k")).distinct()
    return all_rows.withColumn("_ef_k", F.sha2(F.col(key), 256)).join(seen, "_ef_k", "left_anti").drop("_ef_k")


def assign_batches(df: DataFrame, order_col: str, k: int) -> DataFrame:
    """Contiguous batches of ``k`` in ``order_col`` order: ``batch`` and 1-based ``position``."""
    r = global_row_number(df, [order_col], name="position")
    return r.withColumn("batch", F.floor((F.col("position") - 1) / k).cast("long"))


def batch_ranges(df: DataFrame, k: int) -> DataFrame:
    """One row per batch of ``k`` with its 1-based ``[start, end]`` positions and size: the row count settles them."""
    n = df.count()
    b = df.sparkSession.range(0, -(-n // k)).select(F.col("id").alias("batch"), (F.col("id") * k + 1).alias("start"))
    return b.withColumn("end", F.least(F.col("start") + (k - 1), F.lit(n).cast("long"))).withColumn("n", F.col("end") - F.col("start") + 1)


def remaining(examples: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work still to do after an interruption: examples whose key has no output yet (keys of
    repeated outputs are collapsed before the join)."""
    return examples.join(done.select(*keys).distinct(), keys, "left_anti")


def minibatches(df: DataFrame, id_col: str, size: int, iters: int, seed=42) -> DataFrame:
    """Reflection minibatches: iteration ``j`` takes the next ``size`` rows of an epoch shuffle.

    Epoch ``e`` is the seeded shuffle ``md5(seed|e|id)``, a null id like the empty text; it yields
    ``m = ceil(n / size)`` minibatches (the last one may be shorter). Only the
    epochs that iterations reach are generated, so the work is proportional to
    ``n + iters * size``.
    """
    n = df.count()
    if n == 0 or iters <= 0:
        return df.sparkSession.createDataFrame([], f"iteration long, {id_col} {df.schema[id_col].dataType.simpleString()}, slot long")
    m = math.ceil(n / size)
    epochs = math.ceil(iters / m)
    e = df.select(id_col).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(epochs - 1).cast("long"))))
    e = e.withColumn("_ef_key", F.md5(F.concat(F.lit(str(seed)), F.lit("|"), F.col("epoch").cast("string"),
                                                F.lit("|"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))))
    r, _ = hashed_rows(e, "_ef_key", id_col, name="_ef_rn", group="epoch")
    pos = F.col("_ef_rn") - 1
    r = r.withColumn("iteration", (F.col("epoch") * m + F.floor(pos / size)).cast("long")) \
         .withColumn("slot", (pos % size + 1).cast("long"))
    return r.filter(F.col("iteration") < iters).select("iteration", id_col, "slot")
