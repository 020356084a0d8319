"""SimHash near-duplicates with BK-trees (operator 8).

Every document has a 64-bit fingerprint; two link at three or fewer differing bits.
Distinct fingerprints are cut into blocks of bits: two that differ in three bits agree in
all blocks but three, so the links lie inside the groups that share the bits of some choice
of all blocks but three. There are as many blocks as keep the groups near the size of a
tree: four of 16 bits, and from about a hundred million fingerprints on five or more, with
longer keys. Each group is the shard of one BK-tree, whose children are keyed by their Hamming distance to
the parent; a search follows only the edges within the radius of the distance to the
node. The trees of a task's groups are built and searched level by level in numpy.

Trees go to the tasks by shuffle instead of broadcast, as their size grows with the
corpus. A group of more than TREE_ROWS fingerprints is split by hash into shards, and
each pair of shards is searched in a task of its own. A task returns no links but a star
per connected part of a group; stars are joined up by alternating large-star and
small-star steps on Spark, with each step's edges in the shared checkpoint folder.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch, stored, texts_of

SHINGLE = 3
RADIUS = 3
SEED = 42
TREE_ROWS = 8192
#: (item, node) pairs looked at in one numpy step of a search.
FRONT = 1 << 17


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of the lower-cased word shingles, repeats included; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 15):
        h = np.fromiter((digest(b" ".join(words[i:i + shingle]), seed) for i in range(at, min(n, at + (1 << 15)))), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), text_hash of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("text_hash", pa.int64())])

    def make():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(b)
            fps = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            return batch(schema, b.column(0), fps, b.column(2))
        return step
    return arrow_map(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), make, "doc_id long, fp long, text_hash long")


class BKForest:
    """One BK-tree per group; ``group`` is sorted and the fingerprints of a group are distinct.

    Each tree is the one that inserting its group's rows in order gives: a row descends along the edge
    of its distance to the node until that edge is free, and hangs itself there.
    """

    def __init__(self, group: np.ndarray, fp: np.ndarray):
        n = len(fp)
        self.fp = fp
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if n else np.zeros(0, np.int64)
        self.root = np.repeat(first, np.diff(np.append(first, n)))
        at = self.root.copy()
        rows = np.flatnonzero(at != np.arange(n))
        keys, nodes = [], []
        while len(rows):
            edge = at[rows] * 65 + np.bitwise_count(fp[rows] ^ fp[at[rows]])
            key, lead, inverse = np.unique(edge, return_index=True, return_inverse=True)
            keys.append(key)
            nodes.append(rows[lead])
            at[rows] = rows[lead][inverse]
            rows = rows[at[rows] != rows]
        keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.nodes = np.concatenate(nodes)[order] if nodes else np.zeros(0, np.int64)

    def links(self, radius: int = RADIUS, front: int = FRONT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of linked rows (later, earlier): every row searches its tree for the rows before it."""
        n = len(self.fp)
        # A stack of fronts, the deepest first, keeps memory near the front's size times a node's children.
        for at in range(0, n, front):
            rows = np.arange(at, min(n, at + front))
            stack = [(rows, self.root[rows])]
            while stack:
                item, node = stack.pop()
                if len(item) > front:
                    stack.append((item[front:], node[front:]))
                    item, node = item[:front], node[:front]
                d = np.bitwise_count(self.fp[item] ^ self.fp[node]).astype(np.int64)
                hit = (d <= radius) & (node < item)
                if hit.any():
                    yield item[hit], node[hit]
                low = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 1), "left")
                high = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), "right")
                count = high - low
                if count.any():
                    own = np.repeat(np.arange(len(item)), count)
                    child = self.nodes[np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count) + low[own]]
                    # A subtree's rows come after its root: only rows that are later still have links there.
                    later = child < item[own]
                    stack.append((item[own][later], child[later]))


def connect(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest row of each row's connected part."""
    label = np.arange(n)
    for a, b in links:
        while True:
            x, y = label[a], label[b]
            open_ = x != y
            if not open_.any():
                break
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
    return label


def stars(group: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, fingerprint of its part's first row) for the rows that are not first in their part."""
    label = connect(len(fp), BKForest(group, fp).links(radius))
    other = np.flatnonzero(label != np.arange(len(fp)))
    return fp[other], fp[label[other]]


def key_masks(blocks: int, radius: int = RADIUS) -> list[int]:
    """Masks (signed 64-bit) of all choices of ``blocks - radius`` of about equal blocks of the 64 bits."""
    if not radius < blocks <= 64:
        raise ValueError("more blocks than differing bits are needed")
    edge = [64 * i // blocks for i in range(blocks + 1)]
    block = [(1 << edge[i + 1]) - (1 << edge[i]) for i in range(blocks)]
    masks = [sum(block[i] for i in own) for own in itertools.combinations(range(blocks), blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def blocks_for(rows: int, radius: int = RADIUS, tree_rows: int = TREE_ROWS) -> int:
    """Fewest blocks for which an even spread of ``rows`` over the shortest key leaves a quarter of a tree in a group."""
    blocks = radius + 1
    while blocks < 64 and rows >> min(m.bit_count() if m >= 0 else (m + (1 << 64)).bit_count() for m in key_masks(blocks, radius)) > tree_rows // 4:
        blocks += 1
    return blocks


def group_stars(distinct: DataFrame, radius: int = RADIUS, bands: int | None = None, tree_rows: int = TREE_ROWS) -> DataFrame:
    """Star edges (u, v) of the links within each group of fingerprints (column fp) that share a key; ``bands``: the number of blocks, else by the row count."""
    bands = blocks_for(distinct.count(), radius, tree_rows) if bands is None else bands
    band = F.explode(F.array([F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(m).alias("value")) for i, m in enumerate(key_masks(bands, radius))]))
    rows = distinct.select("fp", band.alias("b")).select("fp", "b.band", "b.value")
    big = rows.groupBy("band", "value").count().filter(F.col("count") > tree_rows) \
        .select("band", "value", F.ceil(F.col("count") / tree_rows).cast("int").alias("shards"))
    shard = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("shards")).cast("int")
    split = rows.join(big, ["band", "value"], "left").withColumn("shards", F.coalesce("shards", F.lit(1))).withColumn("shard", shard)
    # A fingerprint of shard s works in the pairs (s, t) of all other shards t; alone in (0, 0) where there is one.
    others = F.when(F.col("shards") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("shards") - 1), lambda t: t != F.col("shard")))
    units = split.withColumn("t", F.explode(others)).select("band", "value", F.least("shard", "t").alias("s"), F.greatest("shard", "t").alias("t"), "fp")
    key = ["band", "value", "s", "t"]
    dealt = units.repartition(*key).sortWithinPartitions(*key, "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(k: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            new = np.append(True, (k[1:] != k[:-1]).any(1))
            u, v = stars(np.cumsum(new), fp.view(np.uint64), radius)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        held_k, held = np.zeros((0, 4), np.int64), np.zeros(0, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            held_k = np.concatenate([held_k, np.column_stack([b.column(i).to_numpy().astype(np.int64) for i in range(4)])])
            held = np.concatenate([held, b.column(4).to_numpy()])
            # The last group may go on in the next batch.
            same = (held_k == held_k[-1]).all(1)
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield from done(held_k[:cut], held[:cut])
                held_k, held = held_k[cut:], held[cut:]
        if len(held):
            yield from done(held_k, held)
    return dealt.mapInArrow(run, "u long, v long")


def connected(edges: DataFrame, name: str = "simhash-edges") -> DataFrame:
    """(u, v): every node of the edges that is not the smallest of its component, with that smallest node.

    Alternating large-star and small-star steps, until a round leaves the edges as they are. Each step
    is written to the shared folder, so a lost executor repeats one step at most.
    """
    def large(e: DataFrame) -> DataFrame:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()

    now = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    seen = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38,0)))")).first())
        if mark == seen or not mark[0]:
            return now
        seen = mark
        now = stored(small(stored(large(now), name)), name)


def components(prints: DataFrame, radius: int = RADIUS, bands: int | None = None, tree_rows: int = TREE_ROWS) -> DataFrame:
    """fp, root: a common fingerprint for all that reach each other, from prints (doc_id, fp, ...)."""
    distinct = prints.select("fp").distinct()
    ends = connected(group_stars(distinct, radius, bands, tree_rows))
    return distinct.join(ends.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, bands: int | None = None, tree_rows: int = TREE_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) of every row.

    Null and empty texts and texts of white space have fingerprint zero and link like any other. Rows
    with a null id link too, but a component's id is null only if all its ids are. Repeated rows are in
    one component; an empty table gives no rows; only doc_id and text are read.
    """
    prints = stored(fingerprints(docs, shingle), "simhash-prints")
    roots = stored(components(prints, radius, bands, tree_rows), "simhash-roots")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    ids = least.join(roots, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.join(ids, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of ``docs`` per component, with all its columns: the smallest doc_id (null last), then the least text hash."""
    prints = stored(fingerprints(docs, shingle), "simhash-prints")
    roots = stored(components(prints, radius), "simhash-roots")
    row = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_hash")
    first = prints.groupBy("fp").agg(F.min(row).alias("row"), F.count("*").alias("n")).join(roots, "fp").groupBy("root").agg(F.min("row").alias("row"))
    keep = first.select(F.col("row.doc_id").alias("__id"), F.col("row.text_hash").alias("__hash"))
    repeats = prints.groupBy("doc_id", "text_hash").count().filter("count > 1").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    same = lambda d, k: d["doc_id"].eqNullSafe(k["__id"]) & (F.xxhash64(d["text"]) == k["__hash"])
    once = docs.join(keep, same(docs, keep), "left_semi")
    twice = repeats.join(keep, repeats["__id"].eqNullSafe(keep["__id"]) & (repeats["__hash"] == keep["__hash"]), "left_semi")
    single = once.join(twice, same(once, twice), "left_anti")
    # Rows repeated with the same id and text: any one of them is the same row to this operator.
    return single.unionByName(once.join(twice, same(once, twice), "left_semi").dropDuplicates(["doc_id", "text"]))
