"""Session helpers: recommended configuration and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings a cluster job should run with. AQE re-plans joins from runtime sizes
# (so broadcasts happen only for sides measured under the threshold), splits
# skewed shuffle partitions and coalesces small ones.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, app: str = "evalframe",
                shuffle_partitions: int | None = None,
                extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or fetch) a session with the recommended settings.

    On a cluster leave ``master`` as None so spark-submit decides.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in RECOMMENDED_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared file system folder and is used as
    is; without it a cluster job stops here. Only in local mode, when it is unset, a private folder is created.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # sessions without a local SparkContext (e.g. Spark Connect): the server's setting
        conf_dir = spark.conf.get("spark.checkpoint.dir", None)
        if not conf_dir:
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        return conf_dir
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="evalframe-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


def written_once(df: DataFrame, name: str) -> DataFrame:
    """``df`` written under the shared checkpoint folder and read back.

    The blocks it was shuffled by are dropped as soon as it is written: else they stay on disk until the driver
    collects garbage, beside whatever the next steps write.
    """
    spark, schema, key = df.sparkSession, df.schema, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = scratch_path(spark, name), spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(schema).parquet(path)


def cluster_settings(input_bytes: int, executor_cores: int = 1000, target_partition_bytes: int = 256 << 20,
                     avg_request_bytes: int = 8 << 10, python_batch_bytes: int = 64 << 20) -> dict[str, str]:
    """Settings for a large run, derived from the input size.

    * shuffle partitions: enough for ``target_partition_bytes`` per partition
      (at least 3 waves of the cores); AQE coalesces small ones and splits skewed ones.
    * file splits of the same target size, so each scan task reads about that much.
    * Arrow batches for the Python stage sized so that one batch of requests stays
      near ``python_batch_bytes`` (long prompts make 10,000-row batches too large).
    """
    parts = max(3 * executor_cores, -(-input_bytes // target_partition_bytes))
    rows_per_batch = max(64, python_batch_bytes // max(1, avg_request_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(rows_per_batch),
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
