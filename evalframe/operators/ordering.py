"""Order-dependent building blocks that stay distributed under skew.

* ``global_row_number``: exact 1..n positions in a total order without a
  single-partition window: range-partition, sort inside partitions, then add
  per-partition offsets from a table with one row per partition.
* ``running_count`` / ``keyed_lag``: per-key running sums and previous values
  where one key may hold a large share of the rows. The key is split into segments
  (time buckets, or ranges of equal size where a bucket is crowded); each (key, segment)
  is a window partition, and a small per-segment table carries what came before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalframe.functions.text import col_of
from evalframe.session import ensure_checkpoint_dir

#: Rows of one key in one time bucket up to which the bucket is a segment: one window task sorts them.
CELL_ROWS = 4_000_000


def _partitions(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def number_rows(df: DataFrame, order_cols: list, name: str = "rn",
                num_partitions: int | None = None) -> tuple[DataFrame, int]:
    """Add ``name`` = 1-based position of each row in the order ``order_cols``; also return the row count.

    ``order_cols`` must form a unique key (append a tie-breaker); then the
    numbering is deterministic, also when a task is rerun.
    """
    spark = df.sparkSession
    cols = [col_of(c) for c in order_cols]
    ensure_checkpoint_dir(spark)
    # Materialised once (reliable checkpoint in the shared folder): the counts
    # and the numbering below read the same partitions. Two live branches would
    # each plan their own range exchange and sample different bounds.
    ranged = (df.repartitionByRange(_partitions(df, num_partitions), *cols)
                .sortWithinPartitions(*cols)
                .withColumn("_ef_pid", F.spark_partition_id())
                .withColumn("_ef_mid", F.monotonically_increasing_id())
                .checkpoint(eager=True))
    # one row per partition: bounded metadata
    stats = sorted(ranged.groupBy("_ef_pid").agg(F.count(F.lit(1)).alias("n"), F.min("_ef_mid").alias("m0")).collect())
    offsets, total = [], 0
    for r in stats:
        offsets.append((r["_ef_pid"], r["m0"], total))
        total += r["n"]
    off = spark.createDataFrame(offsets, "_ef_pid int, _ef_mid0 long, _ef_off long")
    out = ranged.join(F.broadcast(off), "_ef_pid")
    out = (out.withColumn(name, (F.col("_ef_off") + F.col("_ef_mid") - F.col("_ef_mid0") + 1).cast("long"))
              .drop("_ef_pid", "_ef_mid", "_ef_mid0", "_ef_off"))
    return out, total


def global_row_number(df: DataFrame, order_cols: list, name: str = "rn",
                      num_partitions: int | None = None) -> DataFrame:
    """``number_rows`` without the count."""
    return number_rows(df, order_cols, name, num_partitions)[0]


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    r = right.select(*[F.col(k).alias(f"_ef_r_{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"_ef_r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(r, cond, "inner").drop(*[f"_ef_r_{k}" for k in keys])


def segments(df: DataFrame, key: str, ts: str, tie: str, bucket: str = "hour", cell_rows: int = CELL_ROWS) -> DataFrame:
    """``df`` with ``_ef_b``: a segment that rises with (ts, tie) within each key, so that no key and segment holds a large share.

    A segment is a time bucket where every key's buckets hold at most ``cell_rows`` rows: a function of
    the row, nothing is written. Where one holds more, whatever its times, the rows are cut into
    ranges of (key, ts, tie) of about equal size and materialised, and a segment is a range.
    """
    cut = df.withColumn("_ef_b", F.date_trunc(bucket, F.col(ts)))
    if (cut.groupBy(key, "_ef_b").count().agg(F.max("count")).first()[0] or 0) <= cell_rows:
        return cut
    ensure_checkpoint_dir(df.sparkSession)
    cols = [F.col(c).asc_nulls_first() for c in (key, ts, tie)]
    return df.repartitionByRange(_partitions(df, None), *cols).withColumn("_ef_b", F.spark_partition_id().cast("long")).checkpoint(eager=True)


def running_count(df: DataFrame, key: str, ts: str, tie: str, flag: Column | None = None,
                  name: str = "running", bucket: str = "hour", cell_rows: int = CELL_ROWS) -> DataFrame:
    """Running count of rows (or of rows where ``flag``) per ``key`` in (ts, tie) order, inclusive.

    A segmented scan: counts within each key's segment, and the sum of its earlier segments carried in.
    """
    f = F.lit(1) if flag is None else F.when(flag, F.lit(1)).otherwise(F.lit(0))
    d = segments(df, key, ts, tie, bucket, cell_rows).withColumn("_ef_f", f.cast("long"))
    per_bucket = d.groupBy(key, "_ef_b").agg(F.sum("_ef_f").alias("_ef_bn"))
    prior = Window.partitionBy(key).orderBy("_ef_b").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = per_bucket.select(key, "_ef_b", F.coalesce(F.sum("_ef_bn").over(prior), F.lit(0)).alias("_ef_before"))
    inside = Window.partitionBy(key, "_ef_b").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_ef_in", F.sum("_ef_f").over(inside))
    d = null_safe_join(d, per_bucket, [key, "_ef_b"])
    return d.withColumn(name, (F.col("_ef_before") + F.col("_ef_in")).cast("long")).drop(
        "_ef_b", "_ef_f", "_ef_in", "_ef_before")


def keyed_lag(df: DataFrame, key: str, ts: str, tie: str, value: str, name: str,
              bucket: str = "hour", cell_rows: int = CELL_ROWS) -> DataFrame:
    """Previous row's ``value`` per ``key`` in (ts, tie) order (null for the first row)."""
    d = segments(df, key, ts, tie, bucket, cell_rows)
    last = d.groupBy(key, "_ef_b").agg(F.max_by(F.col(value), F.struct(F.col(ts), F.col(tie))).alias("_ef_last"))
    wb = Window.partitionBy(key).orderBy("_ef_b")
    last = last.select(key, "_ef_b", F.lag("_ef_last").over(wb).alias("_ef_prev_last"))
    inside = Window.partitionBy(key, "_ef_b").orderBy(ts, tie)
    d = d.withColumn("_ef_first", F.row_number().over(inside) == 1).withColumn(name, F.lag(value).over(inside))
    d = null_safe_join(d, last, [key, "_ef_b"])
    return d.withColumn(name, F.when(F.col("_ef_first"), F.col("_ef_prev_last")).otherwise(F.col(name))).drop(
        "_ef_b", "_ef_first", "_ef_prev_last")


def hashed_rows(df: DataFrame, hex_key: str, tie: str, name: str = "rn",
                buckets: int | None = None, group: str | None = None) -> tuple[DataFrame, int]:
    """``number_rows`` for an order key that is a uniform hex digest (e.g. md5): no materialisation.

    The bucket of a row is a pure function of its key (leading hex digits), so
    buckets are equal-sized and deterministic without sampling or partition ids:
    per-bucket counts (one row per bucket) give the offsets, and a window
    partitioned by bucket numbers the rows inside it. A task rerun recomputes
    the same numbers. With ``group`` each group is numbered from 1 on its own.
    """
    spark = df.sparkSession
    n_b = buckets or _partitions(df, None)
    b = (F.conv(F.substring(F.col(hex_key), 1, 8), 16, 10).cast("long") * n_b / F.lit(1 << 32)).cast("int")
    g = F.col(group) if group else F.lit(0)
    d = df.withColumn("_ef_b", b).withColumn("_ef_g", g.cast("long"))
    # one row per group and bucket, summed up where it is counted
    counts = d.groupBy("_ef_g", "_ef_b").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("_ef_g").orderBy("_ef_b").rowsBetween(Window.unboundedPreceding, -1)
    w = Window.partitionBy("_ef_g", "_ef_b").orderBy(F.col(hex_key), F.col(tie))
    if group:
        off = counts.select("_ef_g", "_ef_b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_ef_off"))
        total = df.count()
    else:
        rows, total, offsets = sorted(counts.select("_ef_b", "n").collect()), 0, []
        for r in rows:
            offsets.append((0, r["_ef_b"], total))
            total += r["n"]
        off = F.broadcast(spark.createDataFrame(offsets, "_ef_g long, _ef_b int, _ef_off long"))
    out = d.withColumn("_ef_in", F.row_number().over(w)).join(off, ["_ef_g", "_ef_b"])
    return (out.withColumn(name, (F.col("_ef_off") + F.col("_ef_in")).cast("long"))
               .drop("_ef_g", "_ef_b", "_ef_in", "_ef_off")), total


def first_hashed(df: DataFrame, hex_key: str, n: int, most: int = 1 << 17) -> DataFrame:
    """The rows with the ``n`` smallest uniform hex digests, and few more: a filter, no sort.

    A histogram of the leading digits tells up to which prefix there are ``n`` rows; the last prefix is
    refined, four digits at a time, while it holds more than ``most`` rows.
    """
    key, prefix, before = F.col(hex_key), "", 0
    while len(prefix) < 32:
        width = len(prefix) + 4
        own = df.filter(key.startswith(prefix)) if prefix else df
        size = 0
        for r in own.groupBy(F.substring(key, 1, width).alias("p")).count().orderBy("p").collect():  # 65,536 rows at most
            if before + r["count"] >= n:
                prefix, size = r.p, r["count"]
                break
            before += r["count"]
        else:
            return df  # fewer than n rows
        if size <= most:
            break
    return df.filter(F.substring(key, 1, len(prefix)) <= F.lit(prefix))
