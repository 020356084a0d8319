"""Structured Streaming jobs: live accuracy, windowed event counts, resumable scored appends.

Each job is a streaming DataFrame plus a ``run_*`` helper that drives it with a
checkpoint location under the shared checkpoint folder. ``availableNow``
processes what has landed and stops, which is how the batch-equality tests and
the registered queries run them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.functions.verdicts import label_match, parse_verdict
from evalframe.operators import landing
from evalframe.operators.events import epoch_micros
from evalframe.session import scratch_path


def event_time(ts) -> Column:
    """Event time as TIMESTAMP from a TIMESTAMP_NTZ column, independent of the session zone
    (watermarks need TIMESTAMP)."""
    return F.timestamp_micros(epoch_micros(ts))


def live_accuracy(responses: DataFrame, examples: DataFrame, keys=("claim_id", "candidate_id"),
                  by: str = "candidate_id", key: str = "claim_id", event_time_col: str | None = None,
                  delay: str = "1 hour", unique: bool = False) -> DataFrame:
    """Accuracy totals that refresh as outputs land; each (example, candidate) counts once.

    ``responses`` is a stream (claim_id, candidate_id, response); ``examples`` a
    static (claim_id, answer) table joined stream-static. Duplicates are dropped within the
    watermark (``delay``) of the event-time column, and older keys leave the state. A stream whose
    outputs come once each (``unique=True``, e.g. from a sink that replaces its own batches) needs no
    such state. One of the two must be given: without either the state would hold a key per output for ever.
    """
    if event_time_col:
        r = responses.withWatermark(event_time_col, delay).dropDuplicatesWithinWatermark(list(keys))
    elif unique:
        r = responses
    else:
        raise ValueError("give event_time_col, or unique=True for outputs that come once each")
    r = r.withColumn("predicted_label", parse_verdict(F.col("response")))
    j = r.join(examples.select(key, "answer"), key, "left")
    ok = label_match(F.col("predicted_label"), F.col("answer"))
    return j.groupBy(by).agg(F.count_if(ok).alias("correct"), F.count(F.lit(1)).alias("total")) \
            .withColumn("accuracy", F.when(F.col("total") > 0, F.col("correct") / F.col("total")).otherwise(F.lit(0.0)))


def token_windows(events: DataFrame, kind: str, ts: str = "ts", run: str = "run_name", tokens: str = "total_tokens",
                  size: str = "1 hour", slide: str | None = None, gap: str = "30 minutes",
                  delay: str = "1 hour") -> DataFrame:
    """Event counts and tokens per run in tumbling / sliding / session windows.

    Rows later than the watermark (``delay`` behind the latest event time) are
    dropped by the state store in append/update modes.
    """
    e = events.withColumn("event_time", event_time(F.col(ts))).withWatermark("event_time", delay)
    if kind == "tumbling":
        w = F.window("event_time", size)
    elif kind == "sliding":
        w = F.window("event_time", size, slide or size)
    elif kind == "session":
        w = F.session_window("event_time", gap)
    else:
        raise ValueError(kind)
    a = e.groupBy(w.alias("w"), F.col(run)).agg(F.count(F.lit(1)).alias("n_events"), F.sum(tokens).alias("tokens"))
    return a.select(F.lit(kind).alias("kind"), run,
                    F.unix_micros(F.col("w.start")).alias("window_start_us"),
                    F.unix_micros(F.col("w.end")).alias("window_end_us"), "n_events", "tokens")


AUDITED = "batch_seq long, n_invocations long, n_completes long, complete boolean, duration_us long"


def live_batch_audit(events: DataFrame, ts: str = "ts", run: str = "run_name", tie: str = "event_id", delay: str = "1 hour", idle_ms: int = 3_600_000) -> DataFrame:
    """``batch_audit`` of a stream of events: one row per batch, when the next one of its run has started or the run has been silent for ``idle_ms``.

    Events of a run wait in its state until the watermark (``delay`` behind the latest event) has passed
    them, so they are taken in the order of time and id, however they came. The state holds those and
    the open batch's counts; a run that is silent is given out as it stands and leaves the state, and
    what it sends later counts its batches from 0 again. Later events than the watermark are dropped.
    """
    import pandas as pd

    e = events.select(run, event_time(F.col(ts)).alias("event_time"), epoch_micros(F.col(ts)).alias("us"), F.col(tie).cast("string").alias("tie"), "event_type") \
        .withColumn("number", F.col("tie").cast("long")).withWatermark("event_time", delay)

    def audit(key, pdfs, state):
        seq, start, done, calls, ends, some, last, waiting = state.get if state.exists else (0, None, None, 0, 0, False, 0, "[]")
        waiting = json.loads(waiting)
        for pdf in pdfs:
            waiting += [list(x) for x in zip(pdf["us"].tolist(), [None if pd.isna(n) else int(n) for n in pdf["number"]], pdf["tie"].tolist(), pdf["event_type"].tolist(), strict=True)]
        now = state.getCurrentWatermarkMs()
        waiting.sort(key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2] or ""))
        rows, at = [], 0

        def row():
            return (key[0], seq, calls, ends, ends > 0, done - start if start is not None and done is not None else None)
        while at < len(waiting) and waiting[at][0] <= now * 1000:
            us, _, _, kind = waiting[at]
            if kind == "batch_start":
                if some:
                    rows.append(row())
                seq, start, done, calls, ends = seq + 1, us, None, 0, 0
            elif kind == "batch_complete":
                ends, done = ends + 1, us if done is None else done
            elif kind == "reflector_invocation":
                calls += 1
            some, last, at = True, us, at + 1
        waiting = waiting[at:]
        if not waiting and last <= (now - idle_ms) * 1000:
            rows.append(row())
            state.remove()
        else:
            state.update((seq, start, done, calls, ends, some, last, json.dumps(waiting)))
            due = waiting[0][0] // 1000 if waiting else last // 1000 + idle_ms
            state.setTimeoutTimestamp(max(now + 1, due))
        yield pd.DataFrame(rows, columns=[run, "batch_seq", "n_invocations", "n_completes", "complete", "duration_us"]).astype({"duration_us": "Int64"})

    name = f"{run} {events.schema[run].dataType.simpleString()}"
    return e.groupBy(run).applyInPandasWithState(audit, f"{name}, {AUDITED}", "seq long, start long, done long, calls long, ends long, some boolean, last long, waiting string",
                                                 "append", "EventTimeTimeout")


def run_complete(stream: DataFrame, name: str, checkpoint: str | None = None) -> DataFrame:
    """Drive an aggregating stream in complete mode to the end of the available input.

    Every micro-batch takes the place of the result before it (``commit``); the
    last one is read back.
    """
    return run_stream(stream, name, "complete", checkpoint)


def run_stream(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Drive a stream to the end of the available input and read its output back.

    ``complete``: each micro-batch replaces the output. ``append``: each
    micro-batch adds the rows finalised by the watermark (windowed state is then
    evicted, so state stays bounded on an endless stream); a replayed batch
    takes its own place.
    """
    spark = stream.sparkSession
    out = scratch_path(spark, f"{name}-out")
    checkpoint = checkpoint or scratch_path(spark, f"{name}-ckpt")

    def sink(batch: DataFrame, batch_id: int) -> None:
        # complete: every batch takes the place of the one before; append: a replayed batch that of itself
        commit(batch, out, "complete" if mode == "complete" else f"batch-{batch_id}")

    q = (stream.writeStream.outputMode(mode).foreachBatch(sink)
               .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return read_committed(spark, out, stream.schema).select(*stream.columns)


def commit(batch: DataFrame, path: str, name: str) -> None:
    """Write ``batch`` to a folder of its own and let it take the place of what ``name`` stood for, at once.

    The manifest file of the name is replaced after the folder is written: a reader that goes by the
    manifest sees what was there before or what is there now, never nothing and never a part.
    """
    folder = f"{name}-{uuid.uuid4().hex}"
    batch.write.parquet(f"{path.rstrip('/')}/data/{folder}")
    store, at = landing.file_system(path)
    landing.write_whole(store, f"{at.rstrip('/')}/manifest/{name}.json", lambda f: f.write(json.dumps({"folder": folder}).encode()))


def read_committed(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of all committed batches at ``path``, as their manifest files name them at this moment."""
    from pyarrow import fs
    store, at = landing.file_system(path)
    folders = []
    if store.get_file_info(f"{at.rstrip('/')}/manifest").type == fs.FileType.Directory:
        for info in store.get_file_info(fs.FileSelector(f"{at.rstrip('/')}/manifest")):
            if info.base_name.endswith(".json") and not info.base_name.startswith("."):
                with store.open_input_stream(info.path) as f:
                    folders.append(f"{path.rstrip('/')}/data/{json.loads(f.read())['folder']}")
    return spark.read.schema(schema).parquet(*sorted(folders)) if folders else spark.createDataFrame([], schema)


def stream_score(stream: DataFrame, sink_path: str, checkpoint: str, trigger_available_now: bool = True):
    """Resumable append of scored batches: batch ``n`` is committed under its number, so a batch replayed
    after a failure takes its own place instead of duplicating it, and ``read_committed`` sees one of the
    two, whole, all the while."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        commit(batch, sink_path, f"batch-{batch_id}")

    w = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def parquet_stream(spark: SparkSession, folder: str, table: str, schema) -> DataFrame:
    """A file stream over one table file of a folder (a glob keeps the folder as the base path)."""
    return spark.readStream.schema(schema).parquet(f"{folder.rstrip('/')}/{table[:-1]}[{table[-1]}].parquet")
