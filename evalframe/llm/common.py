"""Shared helpers of the llm operators: Arrow map stages, tokenisation into words, model tables."""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evalframe.session import ensure_checkpoint_dir

#: ASCII white space: the separators of all word definitions here.
SPACE = "\\x20\\x09-\\x0D"


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; ``bytes.split`` cuts at exactly these six characters."""
    return text.encode("utf-8", "surrogatepass").split()


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32(doc_id as text) mod ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % F.lit(mod)


def arrow_map(df: DataFrame, fn: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str | StructType, max_bytes: int = 16 << 20) -> DataFrame:
    """``mapInArrow`` with per-task set-up: ``fn()`` runs once a task and returns the batch function, which gets slices of about ``max_bytes``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = fn()
        for b in batches:
            for part in bounded(b, max_bytes):
                out = step(part)
                if out is not None and out.num_rows:
                    yield out
    return df.mapInArrow(run, schema)


def bounded(b: pa.RecordBatch, max_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``max_bytes`` each, so that one step's memory is bounded by one row or this size."""
    n = b.num_rows
    if not n:
        return
    step = max(1, n // max(1, math.ceil(b.get_total_buffer_size() / max_bytes)))
    for i in range(0, n, step):
        yield b.slice(i, min(step, n - i))


def texts_of(b: pa.RecordBatch, column: str = "text") -> list[str]:
    """The text column with null as the empty text."""
    return [t or "" for t in b.column(b.schema.names.index(column)).to_pylist()]


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type)
                                       for c, f in zip(columns, schema, strict=True)], schema=schema)


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back: later steps reuse it, lost executors lose nothing. ``by``: columns to lay folders out by."""
    spark: SparkSession = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_counts(texts: DataFrame, words: Callable[[str], list[bytes]] = words_of, flush: int = 300_000) -> DataFrame:
    """word (binary), n over all rows of the column ``text``; each task sends partial counts whenever it holds ``flush`` words."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            keys = list(held)
            for i in range(0, len(keys), 50_000):
                part = keys[i:i + 50_000]
                yield batch(schema, part, [held[k] for k in part])
            held.clear()
        for b in batches:
            for part in bounded(b, 4 << 20):
                for t in texts_of(part):
                    held.update(words(t))
                    if len(held) >= flush:
                        yield from out()
        yield from out()
    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, limit: int, key: str = "word") -> DataFrame:
    """``limit`` rows of counts (``key``, n), or all if there are fewer, with the largest n.

    A histogram of the counts, in logarithmic buckets whose number is bounded, tells which buckets fit
    whole. Of the first that does not, rows are taken by the hash of their key: a histogram of its
    leading bits is refined within the bucket where the limit falls until the limit is met, so many
    equal counts are cut as well. No task sends rows that are not among them, and keys are distinct.
    """
    bucket = F.floor(F.log2(F.col("n")) * 64)
    place = F.xxhash64(key)
    room, cut = limit, None
    for r in counts.groupBy(bucket.alias("b")).count().orderBy(F.desc("b")).collect():
        if r["count"] > room:
            cut = r.b
            break
        room -= r["count"]
    if cut is None:
        return counts
    chosen, edge = bucket > F.lit(cut), bucket == F.lit(cut)
    for shift in (52, 40, 28, 16, 4, 0):
        if not room:
            break
        step = F.shiftrightunsigned(place, shift).bitwiseAND(4095)
        parts = counts.filter(edge).groupBy(step.alias("p")).count().orderBy("p").collect()
        at = -1  # the last part that fits
        for r in parts:
            if r["count"] > room:
                chosen, edge = chosen | (edge & (step <= F.lit(at))), edge & (step == F.lit(r.p))
                break
            room, at = room - r["count"], r.p
    return counts.filter(chosen)
