"""Packing by first-fit decreasing in randomised groups of documents (operator 10).

Documents become ids plus one end id; each is cut into full sequences and a
remainder. Only the pieces' lengths are shuffled: a hash of the document deals its
pieces to a group of a fixed expected size, and each group fills its own sequences, largest
piece first, into the first one with room. The first fit is found by descending a
tournament tree whose inner nodes hold the largest free capacity below them.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import TOKENIZER, word_encoder
from .common import arrow_map, batch, stored, texts_of

LENGTH = 2048
END_ID = 1
#: Expected pieces in a group: one group is one Arrow table of about 50 bytes a piece.
GROUP_PIECES = 2048
SEED = 17


class TournamentTree:
    """Free capacity of bins; ``place`` puts a size into the leftmost bin that has room and returns the bin and the offset there."""

    def __init__(self, bins: int, capacity: int):
        self.capacity = capacity
        self.leaves = 1 << max(0, (max(1, bins) - 1).bit_length())
        self.free = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        free, i = self.free, 1
        if size > free[1]:
            raise ValueError("no bin has room")
        while i < self.leaves:
            i *= 2
            if free[i] < size:
                i += 1
        bin_, offset = i - self.leaves, self.capacity - free[i]
        free[i] -= size
        while i > 1:
            i //= 2
            top = max(free[2 * i], free[2 * i + 1])
            if free[i] == top:
                break
            free[i] = top
        return bin_, offset


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item, in the items' order; items are taken by falling length, ties by position."""
    tree = TournamentTree(len(lengths), capacity)
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        bins[i], offsets[i] = tree.place(lengths[i])
    return bins, offsets


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, key long"


def pieces(docs: DataFrame, name: str = TOKENIZER, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document's ids and its end id: full sequences, then the remainder.

    ``key``: a hash of the document, alike for its pieces. Rows repeated in a partition are numbered, and
    the partition counts, so that equal rows have keys of their own; which of them has which key is all the same.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                        ("doc_tokens", pa.int64()), ("key", pa.int64())])
    end = np.asarray([end_id], "<u4").tobytes()

    def make():
        from pyspark import TaskContext
        enc, part_id, seen = word_encoder(name), TaskContext.get().partitionId(), Counter()

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            got = []
            for d, t in zip(b.column(0).to_pylist(), texts_of(b), strict=True):
                ids = enc.encode(t) + end
                n = len(ids) // 4
                own = xxhash.xxh3_64_intdigest(ids, 0 if d is None else d & 0xFFFFFFFFFFFFFFFF)
                key = xxhash.xxh3_64_intdigest(f"{d} {own} {part_id} {seen[own]}".encode()) - (1 << 63)
                seen[own] += 1
                for s in range(0, n, length):
                    part = ids[4 * s:4 * (s + length)]
                    got.append((d, s, len(part) // 4, zlib.crc32(part), n, key))
            return batch(schema, *zip(*got, strict=True))
        return step
    return arrow_map(docs.select("doc_id", "text"), make, PIECE)


PACKED = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack(docs: DataFrame, name: str = TOKENIZER, length: int = LENGTH, end_id: int = END_ID, group_pieces: int = GROUP_PIECES, seed: int = SEED) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null text counts as empty: one piece with the end id alone. A null doc_id is kept and repeated
    rows are packed each. An empty table gives no rows. Only doc_id and text are read. The pieces are
    counted, and their documents dealt to groups of about ``group_pieces`` by a hash that differs
    between equal rows, so no key grows a group. Ties in length go to the smaller (doc_id, start,
    checksum), a null id last.
    """
    cut = stored(pieces(docs, name, length, end_id), "packing-pieces")
    groups = max(1, math.ceil(cut.count() / group_pieces))
    dealt = cut.withColumn("grp", F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(groups)))

    def fill(g: pa.Table) -> pa.Table:
        g = g.take(pc.sort_indices(g, [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")], null_placement="at_end"))
        bins, offsets = first_fit_decreasing(g.column("length").to_pylist(), length)
        # Sequence ids are unique over groups: the group's number above, the sequence's below.
        sequence = np.asarray(bins, "int64") + (g.column("grp")[0].as_py() << 32)
        return pa.Table.from_arrays([*(g.column(c) for c in PACKED.names[:5]), pa.array(sequence), pa.array(offsets, pa.int64())], schema=PACKED)
    return dealt.drop("key").groupBy("grp").applyInArrow(
        fill, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
