"""Model calls whose replies survive a failed job.

``predict_landed`` is ``predict`` with a log: the Python stage writes every few replies as a
file of its own, whole or not at all, under the folder of the request's slot. A job that dies
loses no reply that had landed; a task that is tried again, a stage that is computed again and
a later run find the replies in the log and call the model for the rest alone.

A reply belongs to the digest of what identifies the request: keys and contents, so another
prompt is another request. Failed calls are in the log, but count as not yet answered when a
run starts. The log only grows; of several replies to one request the first that did not fail
stands.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalframe.operators.inference import call_group

#: Requests in a slot of a new log, about: a slot's files are read once per Arrow batch of its requests.
SLOT_ROWS = 4096
#: Slots of a partition, at most, where there are more slots than shuffle partitions.
TASK_SLOTS = 8
SLOT = "_ef_slot"
LOG = T.StructType([T.StructField("digest", T.StringType()), T.StructField("reply", T.StringType()), T.StructField("failed", T.BooleanType()),
                    T.StructField("error", T.StringType()), T.StructField("run", T.StringType()), T.StructField("at", T.DoubleType())])


def file_system(path: str):
    """(pyarrow file system, path in it) of a folder that driver and executors share."""
    from pyarrow import fs
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return fs.LocalFileSystem(), path


def write_whole(store, path: str, write: Callable) -> None:
    """A file at ``path`` that is never seen half written: written beside it under a hidden name, then moved."""
    folder, name = path.rsplit("/", 1)
    store.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        write(f)
    store.move(part, path)


def slots_of(path: str, requests: int, at_least: int = 1, slot_rows: int = SLOT_ROWS) -> int:
    """Number of slots of the log at ``path``; a new log gets as many as its first requests fill, and ``at_least`` so many."""
    from pyarrow import fs
    store, at = file_system(path)
    name = f"{at.rstrip('/')}/_layout.json"
    if store.get_file_info(name).type == fs.FileType.NotFound:
        layout = json.dumps({"slots": max(1, at_least, -(-requests // slot_rows))}).encode()
        write_whole(store, name, lambda f: f.write(layout))
    with store.open_input_stream(name) as f:
        return int(json.loads(f.read())["slots"])


def slot(keys: Sequence[str], slots: int) -> Column:
    """Slot of a row by the digest of its keys, null or not."""
    digest = F.md5(F.to_json(F.struct(*[F.col(k) for k in keys]), {"ignoreNullFields": "false"}))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("int")


def dealt(rows: DataFrame, keys: Sequence[str], slots: int) -> DataFrame:
    """``rows`` with their slot, a slot's rows together in one partition. What is made of each row after this stays there.

    Up to the shuffle partitions a slot has a partition of its own; beyond, partitions hold equal numbers of slots, up
    to TASK_SLOTS, so that tasks, their files and the blocks between them grow with a fraction of the slots.
    """
    n = min(slots, 1 << 16, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-slots // TASK_SLOTS)))
    out = rows.withColumn(SLOT, slot(keys, slots))
    return out.repartitionById(n, F.pmod(F.col(SLOT), F.lit(n))).sortWithinPartitions(SLOT)


def _landed(store, folder: str, wanted: Sequence[str], run: str | None) -> dict[str, tuple]:
    """digest -> (reply, failed, error) of the wanted requests: the first success, or this run's own failure."""
    import pyarrow as pa
    import pyarrow.compute as pc
    import pyarrow.parquet as pq
    from pyarrow import fs
    if store.get_file_info(folder).type != fs.FileType.Directory:
        return {}
    found: dict[str, tuple] = {}
    digests = pa.array(wanted, pa.string())
    for info in store.get_file_info(fs.FileSelector(folder)):
        if not info.base_name.endswith(".parquet") or info.base_name.startswith("."):
            continue
        with store.open_input_file(info.path) as f:
            rows = pq.ParquetFile(f).read(columns=LOG.names)
        rows = rows.filter(pc.is_in(rows.column("digest"), value_set=digests))
        for digest, reply, failed, error, by, at in zip(*(rows.column(c).to_pylist() for c in LOG.names), strict=True):
            if not failed or by == run:
                old = found.get(digest)
                if old is None or (failed, at) < (old[1], old[3]):
                    found[digest] = (reply, failed, error, at)
    return {d: r[:3] for d, r in found.items()}


def predict_landed(df: DataFrame, fn: Callable, keys: Sequence[str], inputs: Sequence[str], path: str, output: str = "response",
                   identity: Sequence[str] | None = None, batch_size: int = 32, parallelism: int | None = None, factory: bool = False, whole_call: bool = False,
                   land_rows: int = 256, land_seconds: float = 30.0, partition_by: Sequence[str] = ()) -> DataFrame:
    """(keys..., output, failed, error) for every row of ``df``, replies logged at ``path`` as they come.

    ``fn`` and the rows it gets are those of ``predict``. ``identity``: the columns that make a request
    the same (default: keys and inputs); rows that repeat a request are answered by one call. Replies land every ``land_rows`` rows and every
    ``land_seconds``, and when a call ends the task. Rows that ``dealt`` has dealt stay where they are;
    others are dealt by their requests. The result is written once under ``path`` and holds the rows
    of ``df`` alone, whatever else is in the log.
    """
    import pandas as pd

    spark = df.sparkSession
    keys, inputs, path = list(keys), list(inputs), path.rstrip("/")
    same = list(identity) if identity is not None else [*keys, *[c for c in inputs if c not in keys]]
    if SLOT not in df.columns:
        df = dealt(df, same, slots_of(path, df.count(), parallelism or 1))
    run = uuid.uuid4().hex
    digest = F.sha2(F.to_json(F.struct(*[F.col(c) for c in same]), {"ignoreNullFields": "false"}), 256)
    src = df.select(SLOT, digest.alias("_ef_digest"), *keys, *[c for c in inputs if c not in keys])
    schema = T.StructType([src.schema[k] for k in keys] + [T.StructField(output, T.StringType()), T.StructField("failed", T.BooleanType()), T.StructField("error", T.StringType())])

    columns = [c for c in src.columns if c not in (SLOT, "_ef_digest")]

    def work(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow as pa
        import pyarrow.parquet as pq
        call = fn() if factory else fn
        store, at = file_system(path)
        log = pa.schema([("digest", pa.string()), ("reply", pa.string()), ("failed", pa.bool_()), ("error", pa.string()), ("run", pa.string()), ("at", pa.float64())])

        def land(place: int, held: list[tuple]) -> None:
            if held:
                table = pa.table([list(c) for c in zip(*held, strict=True)], schema=log)
                write_whole(store, f"{at}/log/slot={place}/{uuid.uuid4().hex}.parquet", lambda f: pq.write_table(table, f, use_dictionary=False, write_statistics=False))
                held.clear()

        for pdf in it:
            for place, own in pdf.groupby(SLOT, sort=False):
                digests = own["_ef_digest"].tolist()
                got = _landed(store, f"{at}/log/slot={place}", digests, run)
                # the rows to call for, one of each request
                first = dict(zip(reversed(digests), range(len(digests) - 1, -1, -1), strict=True))
                todo = [i for d, i in first.items() if d not in got]
                todo.sort()
                calls = own[columns].iloc[todo] if len(todo) < len(own) else own[columns]
                held: list[tuple] = []
                since = time.monotonic()
                try:
                    for start in range(0, len(todo), batch_size):
                        part = calls.iloc[start:start + batch_size].reset_index(drop=True)
                        for i, (reply, failed, error) in zip(todo[start:start + batch_size], call_group(call, part, whole_call), strict=True):
                            got[digests[i]] = (reply, failed, error)
                            held.append((digests[i], reply, failed, error, run, time.time()))
                        if len(held) >= land_rows or time.monotonic() - since >= land_seconds:
                            land(place, held)
                            since = time.monotonic()
                finally:  # what has been answered lands, also when the next call ends the task
                    land(place, held)
                res = own[keys].reset_index(drop=True)
                for c, values in zip((output, "failed", "error"), zip(*[got[d] for d in digests], strict=True), strict=True):
                    res[c] = values
                yield res

    # Written once: what reads the result does not come back to the log, and sees none of its other replies.
    final = f"{path}/result-{run}"
    src.mapInPandas(work, schema).write.partitionBy(*partition_by).parquet(final)
    return spark.read.schema(schema).parquet(final).select(*schema.names)


def call_log(spark: SparkSession, path: str) -> DataFrame:
    """Every answer in the log at ``path``: slot, digest, reply, failed, error, run, at."""
    from pyspark.errors import AnalysisException
    schema = T.StructType([*LOG.fields, T.StructField("slot", T.IntegerType())])
    try:
        return spark.read.schema(schema).parquet(f"{path.rstrip('/')}/log")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
