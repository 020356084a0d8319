"""Exact top-k inner products with a bit-sliced index (operator 4).

Components are quantised to integers. The rows are dealt to blocks by hash, and a block's
index holds one bitmap per attribute and bit: slice (d, j) has a 1 for each row whose
shifted component d has bit j. For a query the slices are added up with bitmap arithmetic:
component d contributes its slices once per set bit of the query's component, complemented
where that is negative, and full adders turn three bitmaps of one weight into one and a
carry until each weight has a single bitmap: the bit-sliced scores of all the block's rows.
The top k are selected from the most significant slice downward; the rows equal to the last
place in every slice form the boundary, which smaller ids settle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, stored

SCALE = 64.0
K = 20
BLOCK_ROWS = 1 << 15
#: Queries that stream through one index: the table is copied once per so many.
BLOCK_QUERIES = 1 << 14


def quantise(vectors: DataFrame, scale: float = SCALE, *more: str) -> DataFrame:
    """vec_id, q: floor(scale * x) of every component, and the columns ``more``; rows with a null id, or a null, empty or non-finite vector, are left out."""
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    q = F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(scale)))
    return vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull() & fine & (F.size(x) > 0)).select("vec_id", q.alias("q"), *more)


class BitSlicedIndex:
    """Bitmaps of a block of integer vectors; rows by ascending id, which decides ties, and number."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, q: np.ndarray):
        order = np.lexsort((rows, ids))
        self.ids, n = ids[order], len(ids)
        self.place = {r: i for i, r in enumerate(rows[order].tolist())}
        self.n, self.words = n, -(-n // 64)
        self.low = q.min(0) if n else np.zeros(q.shape[1], np.int64)
        up = (q[order] - self.low).astype(np.uint64)
        self.bits = [int(x).bit_length() for x in up.max(0)] if n else [0] * q.shape[1]
        self.all = self._pack(np.ones(n, bool))
        self.slices = [[self._pack((up[:, d] >> np.uint64(j)) & np.uint64(1)) for j in range(b)] for d, b in enumerate(self.bits)]
        self.zeros = [[self.all & ~s for s in own] for own in self.slices]

    def _pack(self, bits: np.ndarray) -> np.ndarray:
        out = np.zeros(self.words * 8, np.uint8)
        packed = np.packbits(bits.astype(np.uint8), bitorder="little")
        out[:len(packed)] = packed
        return out.view(np.uint64)

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Bit-sliced sums, least significant first, and the constant to add to them."""
        heaps: list[list[np.ndarray]] = []
        base = int(query @ self.low)
        for d, c in enumerate(query.tolist()):
            own = self.slices[d] if c > 0 else self.zeros[d]
            if c < 0:  # c * x = |c| * (2^bits - 1 - x) - |c| * (2^bits - 1)
                base += c * ((1 << self.bits[d]) - 1)
                c = -c
            i = 0
            while c:
                if c & 1:
                    for j, s in enumerate(own):
                        while len(heaps) <= i + j:
                            heaps.append([])
                        heaps[i + j].append(s)
                c >>= 1
                i += 1
        out, w = [], 0
        while w < len(heaps):
            heap = heaps[w]
            while len(heap) > 1:
                a, b = heap.pop(), heap.pop()
                ab = a ^ b
                if heap:  # full adder
                    c = heap.pop()
                    heap.append(ab ^ c)
                    carry = (a & b) | (ab & c)
                else:
                    heap.append(ab)
                    carry = a & b
                if w + 1 == len(heaps):
                    heaps.append([])
                heaps[w + 1].append(carry)
            out.append(heap[0] if heap else np.zeros(self.words, np.uint64))
            w += 1
        return out, base

    def top(self, query: np.ndarray, k: int, skip: int | None = None) -> list[tuple[int, int]]:
        """The k largest (id, score), ties to smaller ids; ``skip``: number of a row that takes no part."""
        if not self.n:
            return []
        slices, base = self.scores(query)
        ties, sure = self.all.copy(), np.zeros(self.words, np.uint64)
        if (at := self.place.get(skip)) is not None:
            ties[at >> 6] &= ~np.uint64(1 << (at & 63))
        have = 0
        for s in reversed(slices):
            more = ties & s
            n = int(np.bitwise_count(more).sum())
            if have + n > k:
                ties = more
            else:
                sure |= more
                have += n
                ties = ties & ~s
        # What still ties is equal in all slices: as many as there is room for, by smaller id.
        rows = np.concatenate([self._rows(sure), self._rows(ties)[:k - have]])
        value = np.zeros(len(rows), np.int64)
        for j, s in enumerate(slices):
            value += ((s[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << j
        found = sorted(zip((-(value + base)).tolist(), self.ids[rows].tolist(), strict=True))
        return [(i, -v) for v, i in found]

    def _rows(self, bitmap: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(bitmap)
        return np.concatenate([np.zeros(0, np.int64), *((int(w) << 6) + np.flatnonzero(np.unpackbits(bitmap[w:w + 1].view(np.uint8), bitorder="little")) for w in at)]).astype(np.int64)


def matrix(rows: pa.Array) -> np.ndarray:
    """Vectors of one length as the rows of a matrix."""
    return rows.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(rows), -1)


def top_k(vectors: DataFrame, queries: Column, k: int = K, scale: float = SCALE, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for every row where ``queries`` holds, its own row left out.

    A stated query set against all rows, in blocks: a block's index is built once for a block of queries,
    which stream through it. Fewer than k other rows give fewer results; an empty table gives none. A
    row is a query and a candidate by itself: rows that repeat a vec_id are each other's candidates and
    are answered each. Vectors of different lengths have no inner product; each length is searched
    among its own. Components so large that a score could pass 64 bits are an error. Other columns are
    not read.
    """
    spark = vectors.sparkSession
    q = quantise(vectors.withColumn("_asks", F.coalesce(queries, F.lit(False))), scale, "_asks")
    q = stored(q.withColumn("row", F.monotonically_increasing_id()).withColumn("d", F.size("q")), "topk-rows")
    large = F.array_max(F.transform("q", lambda x: F.abs(x)))
    plan = []
    for r in q.groupBy("d").agg(F.count("*").alias("n"), F.count_if("_asks").alias("m"), F.max(large).alias("most")).collect():
        if r.most < 0 or r.d * r.most * r.most >= 1 << 62:
            raise ValueError(f"components up to {r.most / scale} of vectors of length {r.d}: scores pass 64 bits")
        plan.append((r.d, math.ceil(r.n / block_rows), math.ceil(r.m / block_queries)))
    plan = spark.createDataFrame(plan, "d int, blocks int, chunks int")  # one row per length
    spread = lambda seed, parts: F.pmod(F.xxhash64("row", F.lit(seed)), F.col(parts)).cast("int")
    upto = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    row = ["row", "vec_id", "q"]
    both = q.join(F.broadcast(plan), "d")
    kept = both.filter("chunks > 0").select("d", spread(3, "blocks").alias("b"), upto("chunks").alias("a"), F.lit(0).alias("kind"), *row)
    asks = both.filter("_asks").select("d", upto("blocks").alias("b"), spread(5, "chunks").alias("a"), F.lit(1).alias("kind"), *row)
    unit = ["d", "b", "a"]
    dealt = kept.unionByName(asks).repartition(*unit).sortWithinPartitions(*unit, "kind")
    schema = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, index = None, None
        rows: list[pa.RecordBatch] = []
        for whole in batches:
            key = np.stack([whole.column(i).to_numpy() for i in range(4)], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                part, own, kind = whole.slice(i, j - i), tuple(key[i, :3].tolist()), int(key[i, 3])
                if own != at:
                    at, index, rows = own, None, []
                if kind == 0:  # a unit's rows come before its queries
                    rows.append(part)
                    continue
                if index is None:
                    held = pa.Table.from_batches(rows).combine_chunks() if rows else whole.slice(0, 0)
                    number, ids = (held.column(c).to_numpy() for c in (4, 5))
                    lists = held.column(6)
                    values = matrix(lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists) if len(number) else np.zeros((0, own[0]), np.int64)
                    index, rows = BitSlicedIndex(ids, number, values), []
                out: list[tuple[int, int, int, int]] = []
                for n, i_, v in zip(part.column(4).to_pylist(), part.column(5).to_pylist(), matrix(part.column(6)), strict=True):
                    out += [(n, i_, found, x) for found, x in index.top(v, k, n)]
                if out:
                    yield batch(schema, *zip(*out, strict=True))

    found = dealt.mapInArrow(search, "row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
