"""N-gram Jaccard join with count-vector R-trees (operator 11).

A document is the set of its distinct word shingles. Shingles are hashed into groups, about as
many as the set has shingles within bounds, and the counts by group are the document's point: two
sets share at most the sum of the smaller count in each group. Points are the rows of R-trees whose nodes hold the largest and smallest
coordinates below them; a search leaves a node whose bound, the summed minima with the node's
upper corner, is less than the overlap that a link to any of its rows needs. What survives is
verified on the sets themselves.

The tree is one per shard. Sets that link share one of their first shingles in an order of the
whole corpus (rarest first, by a sketch of counts over all documents; the order decides the
work, not the result), so each such shingle's documents of similar size are a shard. Shards
with the same documents are searched once, shards over TREE_ROWS are split into pairs of parts.

Components need no more links than join them. Early rounds search a few shards of each
document in small parts and verify each document's nearest points; their links merge documents
into components. The last round searches all shards in which more than one component is left,
between components only, and verifies every pair that survives: no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch, bounded, stored, texts_of
from .simhash import connected

SHINGLE = 4
#: A link needs NEED / 100 of the union in common.
NEED = 85
#: Fewest and most groups of a point; between them as many as the power of two at or below the set's size.
DIMS = (32, 1024)
LEAF = 16
TREE_ROWS = 8192
#: Counters of the sketch, and how many go in a row of it.
SKETCH, CHUNK = 1 << 20, 1 << 14
#: Early rounds: shards of a document, rows in a part, pairs of a row. The last round has none of these.
ROUNDS = ((2, 64, 1), (6, 512, 2))
#: Coordinates looked at in one numpy step of a search.
FRONT = 1 << 21
#: Hashes of words that a task holds, and the bytes of texts whose sets it holds at once.
WORDS_HELD, TEXT_BYTES = 1 << 16, 4 << 20


class _WordHash(dict):
    """64-bit hash of each word, kept while there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_HELD:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def shingle_set(text: str, hashes: _WordHash, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the lower-cased word shingles; of the whole sequence where it is shorter; none without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(size, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[i:len(w) - k + 1 + i])
    return np.unique(h)


def dims_of(band: int) -> int:
    """Groups of the points of a band of sizes, from 2^band on."""
    return min(max(1 << min(band, 20), DIMS[0]), DIMS[1])


def bands_of(n: int, need: int = NEED) -> list[int]:
    """Bands a set of ``n`` is in: its own, and the next where it may link into that."""
    band = n.bit_length() - 1
    return [band, band + 1] if 100 * n >= 2 * need << band else [band]


def counts_of(own: np.ndarray, dims: int) -> np.ndarray:
    """The set's point: how many of its shingles fall in each group."""
    return np.bincount((own & np.uint64(dims - 1)).astype(np.int64), minlength=dims)


def width_of(n: int) -> np.dtype:
    """Type of a set's counts: groups hold a set evenly, far from the type's largest number."""
    return np.dtype("<u1" if n < 1 << 15 else "<u2" if n < 1 << 23 else "<u4")


def least_overlap(n: int, need: int = NEED) -> int:
    """What a set of ``n`` has in common with any set it links with."""
    return -(-need * n // 100)


# ------------------------------------------------------------------- sets and their order
DOC = "kind int, doc_id long, n long, digest binary, chunk int, counts binary"


def scan(docs: DataFrame, shingle: int = SHINGLE) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n, digest) of every row, and for each counter of the sketch a level that rises with its count."""
    schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("chunk", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sketch = _WordHash(), np.zeros(SKETCH, np.int64)
        for whole in batches:
            for part in bounded(whole, TEXT_BYTES):
                sets = [shingle_set(t, hashes, shingle) for t in texts_of(part)]
                sketch += np.bincount((np.concatenate(sets) >> np.uint64(44)).astype(np.int64), minlength=SKETCH)
                n = part.num_rows
                yield batch(schema, np.zeros(n, np.int32), part.column(0), [len(s) for s in sets], [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                            pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()))
        if sketch.any():
            n = SKETCH // CHUNK
            empty = [pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.binary())]
            yield batch(schema, np.ones(n, np.int32), *empty, np.arange(n, dtype=np.int32), [sketch[i:i + CHUNK].tobytes() for i in range(0, SKETCH, CHUNK)])

    both = stored(docs.select("doc_id", "text").mapInArrow(run, DOC), "ngram-scan", "kind")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[chunk] = total.get(chunk, 0) + np.frombuffer(counts, np.int64)
        if total:
            yield batch(pa.schema([("chunk", pa.int32()), ("counts", pa.binary())]), list(total), [c.tobytes() for c in total.values()])

    # Added up in the partitions as they come, then in up to 64 a chunk, then in one: what a task holds is the sketch at most.
    parts = both.filter("kind = 1").select("chunk", "counts").mapInArrow(add, "chunk int, counts binary")
    parts = parts.withColumn("part", F.spark_partition_id() % 64).repartition("chunk", "part").mapInArrow(add, "chunk int, counts binary")
    level = np.zeros(SKETCH, np.uint8)
    # One Python step in a task: each further one is a further worker, which later tasks take in turn and fill.
    for r in parts.repartition("chunk").mapInArrow(lambda batches: _levels(add(batches)), "chunk int, counts binary").collect():
        level[r.chunk * CHUNK:(r.chunk + 1) * CHUNK] = np.frombuffer(r.counts, np.uint8)
    return both.filter("kind = 0").select("doc_id", "n", "digest"), level


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield batch(b.schema, b.column(0), [(4 * np.log2(1 + np.frombuffer(c, np.int64))).astype(np.uint8).tobytes() for c in b.column(1).to_pylist()])


def text_hash() -> Column:
    """128 bits of the text."""
    return F.unhex(F.md5("text")).alias("text_hash")


def points(docs: DataFrame, level: np.ndarray, shingle: int = SHINGLE, need: int = NEED) -> DataFrame:
    """sid, digest, text_hash, n, point, first: one row per distinct set that isn't empty, stored. ``first``: its rarest shingles, one of which any set it links with has among its own."""
    schema = pa.schema([("text_hash", pa.binary()), ("digest", pa.binary()), ("n", pa.int64()), ("point", pa.binary()), ("first", pa.list_(pa.int64()))])

    def make():
        hashes = _WordHash()

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            got = []
            for x, t in zip(b.column(0).to_pylist(), texts_of(b), strict=True):
                own = shingle_set(t, hashes, shingle)
                n = len(own)
                if not n:
                    continue
                order = np.lexsort((own, level[(own >> np.uint64(44)).astype(np.int64)]))
                point = counts_of(own, dims_of(bands_of(n, need)[-1])).astype(width_of(n))
                got.append((x, xxhash.xxh3_128_digest(own.tobytes()), n, point.tobytes(), own[order[:n - least_overlap(n, need) + 1]].view(np.int64)))
            return batch(schema, *(zip(*got, strict=True) if got else [[]] * 5))
        return step
    rows = arrow_map(docs.select(text_hash(), "text"), make, "text_hash binary, digest binary, n long, point binary, first array<long>", TEXT_BYTES)
    # Rows of one digest are alike in all but the text's hash.
    one = rows.groupBy("digest").agg(F.min("text_hash").alias("text_hash"), F.first("n").alias("n"), F.first("point").alias("point"), F.first("first").alias("first"))
    return stored(one.withColumn("sid", F.monotonically_increasing_id()), "ngram-points")


def shards(point: DataFrame, need: int = NEED) -> DataFrame:
    """shard, band, sid, size: the documents of each shard of two or more, each set of documents once.

    A shard is a shingle and a band of sizes, between a power of two and the next; a set so near the
    next band that it may link into it is in that band as well.
    """
    band = F.floor(F.log2("n")).cast("int")
    near = F.lit(100) * F.col("n") >= F.lit(2 * need) * F.call_function("shiftleft", F.lit(1).cast("long"), band)
    bands = F.when(near, F.array(band, band + 1)).otherwise(F.array(band))
    rows = point.select("sid", F.explode("first").alias("token"), bands.alias("bands")).select("sid", F.explode("bands").alias("band"), "token") \
        .select(F.xxhash64("token", "band").alias("shard"), "band", "sid")
    # Equal numbers of documents with equal sums (modulo 2, by bit) of two hashes: the same documents, as none is twice in a shard.
    # 16 bytes of state for each shard; decimal sums take three times as much of a task's memory.
    sums = [F.bit_xor(F.xxhash64("sid", F.lit(i))).alias(f"sum{i}") for i in (1, 2)]
    own = rows.groupBy("shard", "band").agg(F.count("*").alias("size"), *sums).filter("size > 1")
    own = own.groupBy("band", "size", "sum1", "sum2").agg(F.min("shard").alias("shard")).select("shard", "size")
    # Both sides are large: no broadcast, whatever their compressed sizes suggest.
    return stored(rows.join(own.hint("merge"), "shard"), "ngram-shards")


# ------------------------------------------------------------------------------- R-trees
class RForest:
    """One R-tree per shard; ``shard`` is sorted. Each level's nodes are runs of up to LEAF of the level below."""

    def __init__(self, shard: np.ndarray, label: np.ndarray, n: np.ndarray, point: np.ndarray, leaf: int = LEAF):
        order = self.tiles(shard, label, n, point, leaf)
        self.order, self.shard, self.label, self.n, self.point = order, shard[order], label[order], n[order], point[order]
        rows = len(order)
        start = np.arange(rows)
        high, least, most, low_label, high_label, shard = self.point, self.n, self.n, self.label, self.label, self.shard
        #: From the rows up: (first child, upper corner, least and most shingles, least and most label, end of the rows below).
        self.levels = [(start, high, least, most, low_label, high_label, start + 1)]
        while rows:
            new = np.append(True, shard[1:] != shard[:-1])
            first = np.maximum.accumulate(np.where(new, np.arange(len(shard)), 0))
            if new.all():
                break
            begin = np.flatnonzero((np.arange(len(shard)) - first) % leaf == 0)
            high, least, most = np.maximum.reduceat(high, begin), np.minimum.reduceat(least, begin), np.maximum.reduceat(most, begin)
            low_label, high_label = np.minimum.reduceat(low_label, begin), np.maximum.reduceat(high_label, begin)
            end = self.levels[-1][6][np.append(begin[1:], len(shard)) - 1]
            shard = shard[begin]
            self.levels.append((begin, high, least, most, low_label, high_label, end))
        self.top_shard = shard

    @staticmethod
    def tiles(shard: np.ndarray, label: np.ndarray, n: np.ndarray, point: np.ndarray, leaf: int) -> np.ndarray:
        """Order of the rows: by shard, in slabs by size, within a slab by component and by the share of the first half of the groups."""
        by_size = np.lexsort((n, shard))
        s = shard[by_size]
        new = np.append(True, s[1:] != s[:-1]) if len(s) else np.zeros(0, bool)
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(s)))
        slab_rows = leaf * np.maximum(1, np.ceil(np.sqrt(size / leaf)).astype(np.int64))
        of = np.cumsum(new) - 1
        slab = np.empty(len(s), np.int64)
        slab[by_size] = (np.arange(len(s)) - start[of]) // slab_rows[of] if len(s) else 0
        half = point[:, :point.shape[1] // 2].sum(1, dtype=np.int64)
        return np.lexsort((half, label, slab, shard))

    def survivors(self, need: int = NEED, front: int = FRONT) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of (row, later row, bound of their overlap) of one shard and two components that the bound does not part."""
        rows = len(self.order)
        top = len(self.levels) - 1
        root = np.searchsorted(self.top_shard, self.shard)
        step = max(1, front // self.point.shape[1])
        for at in range(0, rows, step):
            stack = [(top, np.arange(at, min(rows, at + step)), root[at:at + step])]
            while stack:
                depth, item, node = stack.pop()
                if len(item) > step:
                    stack.append((depth, item[step:], node[step:]))
                    item, node = item[:step], node[:step]
                begin, high, least, most, low_label, high_label, end = self.levels[depth]
                n, label = self.n[item], self.label[item]
                open_ = (end[node] > item + 1) & ~((low_label[node] == label) & (high_label[node] == label))
                open_ &= (100 * most[node] >= need * n) & (100 * n >= need * least[node])
                if depth == 0:
                    open_ &= node > item
                item, node, n = item[open_], node[open_], n[open_]
                if not len(item):
                    continue
                bound = np.minimum(self.point[item], high[node]).sum(1, dtype=np.int64)
                # 100 * overlap >= need * (n + m - overlap) for the smallest m that the node and the sizes allow.
                m = np.maximum(least[node], -(-need * n // 100))
                keep = (100 + need) * bound >= need * (n + m)
                item, node, bound = item[keep], node[keep], bound[keep]
                if not len(item):
                    continue
                if depth == 0:
                    yield item, node, bound
                    continue
                below = self.levels[depth - 1][0]
                last = np.append(begin[1:], len(below))[node]
                count = last - begin[node]
                own = np.repeat(np.arange(len(item)), count)
                child = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count) + begin[node][own]
                stack.append((depth - 1, item[own], child))


def nearest(a: np.ndarray, b: np.ndarray, share: np.ndarray, pairs: int) -> np.ndarray:
    """Places of the ``pairs`` best shares of each ``a``."""
    order = np.lexsort((b, -share, a))
    s = a[order]
    first = np.maximum.accumulate(np.where(np.append(True, s[1:] != s[:-1]), np.arange(len(s)), 0))
    return order[np.arange(len(s)) - first < pairs]


def candidates(units: DataFrame, pairs: int | None, need: int = NEED, held_rows: int = 1 << 13) -> DataFrame:
    """Distinct (a, b), a < b: sets of one unit that the trees' bounds leave; ``pairs``: at most so many, the nearest, for a row of a unit. ``units``: unit, band, sid, label, n, point."""
    dealt = units.repartition("unit").sortWithinPartitions("unit", "sid")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def search(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        band = t.column(1).to_numpy()
        for g in np.unique(band).tolist():
            yield from of_band(t.filter(pa.array(band == g)), dims_of(g))

    def of_band(t: pa.Table, dims: int) -> Iterator[pa.RecordBatch]:
        unit, _, sid, label, n = (t.column(i).to_numpy() for i in range(5))
        width = width_of(int(n.max()))
        point = np.empty((len(n), dims), width)
        for i, (raw, size) in enumerate(zip(t.column(5).to_pylist(), n.tolist(), strict=True)):
            own = np.frombuffer(raw, width_of(size))
            point[i] = own if len(own) == dims else own.reshape(-1, dims).sum(0)  # finer groups fold into these
        _, unit = np.unique(unit, return_inverse=True)
        forest = RForest(unit, label, n, point)
        sid, n = sid[forest.order], n[forest.order]
        if pairs is None:
            found = forest.survivors(need)
        else:
            blocks = [*forest.survivors(need)]
            if not blocks:
                return
            i, j, bound = (np.concatenate(x) for x in zip(*blocks, strict=True))
            best = nearest(i, j, bound / (n[i] + n[j]), pairs)
            found = [(i[best], j[best], bound[best])]
        for i, j, _ in found:
            own = np.unique(np.stack([np.minimum(sid[i], sid[j]), np.maximum(sid[i], sid[j])]), axis=1)
            yield batch(schema, own[0], own[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            unit = b.column(0).to_numpy()
            if rows >= held_rows:  # whole units only: the last one may go on in this batch
                cut = int(np.searchsorted(unit != held[-1].column(0)[-1].as_py(), True)) if unit[-1] != held[-1].column(0)[-1].as_py() else len(unit)
                if cut < len(unit):
                    yield from search([*held, b.slice(0, cut)])
                    held, rows, b = [], 0, b.slice(cut)
            held.append(b)
            rows += b.num_rows
        if held:
            yield from search(held)
    return dealt.select("unit", "band", "sid", "label", "n", "point").mapInArrow(run, "a long, b long").distinct()


def units_of_round(shard: DataFrame, salt: int, own: int, rows: int) -> DataFrame:
    """unit, band, sid: ``own`` shards of each document, chosen alike by alike documents, in random parts of about ``rows``."""
    order = F.xxhash64("shard", F.lit(salt))
    few = shard.groupBy("sid").agg(F.slice(F.array_sort(F.collect_list(F.struct(order.alias("o"), "shard", "band", "size"))), 1, own).alias("s")) \
        .select("sid", F.explode("s").alias("s"))
    part = F.pmod(F.xxhash64("sid", F.lit(salt)), F.ceil(F.col("s.size") / rows))
    return few.select(F.xxhash64("s.shard", part).alias("unit"), "s.band", "sid")


def units_of_rest(shard: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """unit, band, sid: all shards with more than one component, those of more than ``rows`` as pairs of parts.

    Documents of a shard's largest component need not meet each other: its parts meet those of the rest,
    and only the rest's parts meet among themselves.
    """
    named = shard.select("shard", "band", "sid").join(labels, "sid", "left").select("shard", "band", "sid", F.coalesce("label", "sid").alias("label"))
    sizes = named.groupBy("shard", "label").agg(F.count("*").alias("n")).groupBy("shard").agg(
        F.count("*").alias("labels"), F.sum("n").alias("size"), F.max("n").alias("most"), F.max_by("label", F.struct("n", "label")).alias("main")).filter("labels > 1")
    both = named.join(sizes.drop("labels"), "shard")
    split = F.col("size") > rows
    main = split & (F.col("label") == F.col("main"))
    mains, rests = F.ceil(F.col("most") / rows).cast("int"), F.greatest(F.lit(1), F.ceil((F.col("size") - F.col("most")) / rows)).cast("int")
    pick = lambda parts: F.pmod(F.xxhash64("sid", F.lit(7)), parts).cast("int")
    unit = lambda kind, i, j: F.struct(F.lit(kind).alias("k"), i.alias("i"), j.alias("j"))
    zero = F.lit(0)
    mine = pick(rests)
    meets = F.when(~split, F.array(unit(0, zero, zero))) \
        .when(main, F.transform(F.sequence(zero, rests - 1), lambda j: unit(1, pick(mains), j))) \
        .otherwise(F.concat(F.transform(F.sequence(zero, mains - 1), lambda i: unit(1, i, mine)),
                            F.transform(F.sequence(zero, rests - 1), lambda j: unit(2, F.least(mine, j), F.greatest(mine, j)))))
    return both.select("shard", "band", "sid", F.explode(meets).alias("m")).select(F.xxhash64("shard", "m.k", "m.i", "m.j").alias("unit"), "band", "sid")


# ------------------------------------------------------------------------------ the join
def sets_of(docs: DataFrame, wanted: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """sid, own (the set's hashes) of the sets in ``wanted`` (sid, digest, text_hash), from the texts; stored.

    Each text is sent once from each task, to where its hash meets the set's row, and the set is made there:
    texts are smaller than their sets, which are not sent.
    """
    schema = pa.schema([("sid", pa.int64()), ("own", pa.list_(pa.int64()))])

    def make():
        hashes = _WordHash()

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_set(t, hashes, shingle) for t in texts_of(b)]
            return batch(schema, b.column(0), [s.view(np.int64) for s in sets])
        return step
    texts = docs.select(text_hash(), "text").groupBy("text_hash").agg(F.first("text").alias("text"))
    # The texts are large: no broadcast, whatever the compressed size suggests.
    return stored(arrow_map(texts.hint("merge").join(wanted, "text_hash").select("sid", "text"), make, "sid long, own array<long>", TEXT_BYTES), "ngram-sets")


def verified(pairs: DataFrame, sets: DataFrame, need: int = NEED) -> DataFrame:
    """The pairs (a, b) whose sets link. Sets that are in no pair stay out of the joins."""
    ids = stored(pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct(), "ngram-ids")
    own = sets.join(ids, "sid", "left_semi")
    left, right = own.select(F.col("sid").alias("a"), F.col("own").alias("x")), own.select(F.col("sid").alias("b"), F.col("own").alias("y"))
    same = F.size(F.array_intersect("x", "y")).cast("long")
    both = pairs.join(left, "a").join(right, "b")
    return both.filter((100 + need) * same >= need * (F.size("x") + F.size("y"))).select("a", "b")


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (sid, label) after the links (a, b) have joined components; a set that isn't in it is its own label. Stored."""
    name = lambda end: labels.select(F.col("sid").alias(end), F.col("label").alias(f"{end}_label"))
    edges = links.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("a_label", "a").alias("u"), F.coalesce("b_label", "b").alias("v"))
    ends = connected(edges, "ngram-edges").select(F.col("u").alias("label"), F.col("v").alias("to"))
    moved = labels.join(ends, "label", "left").select("sid", F.coalesce("to", "label").alias("label"))
    fresh = ends.join(labels.select("sid"), ends["label"] == labels["sid"], "left_anti").select(F.col("label").alias("sid"), F.col("to").alias("label"))
    return stored(moved.unionByName(fresh), "ngram-labels")


def components(docs: DataFrame, point: DataFrame, need: int = NEED, shingle: int = SHINGLE, tree_rows: int = TREE_ROWS, rounds=ROUNDS) -> DataFrame:
    """sid, label of the sets that link with another: the smallest sid they reach."""
    spark = docs.sparkSession
    shard = shards(point, need)
    alive = shard.select("sid").distinct()
    sets = sets_of(docs, point.select("sid", "digest", "text_hash").join(alive, "sid", "left_semi"), shingle)
    labels = spark.range(0).select(F.col("id").alias("sid"), F.col("id").alias("label"))  # rows from Python would start workers of their own

    def with_points(units: DataFrame) -> DataFrame:
        return units.join(point.select("sid", "n", "point"), "sid").join(labels, "sid", "left").select("unit", "band", "sid", F.coalesce("label", "sid").alias("label"), "n", "point")

    for i, (own, rows, pairs) in enumerate(rounds):
        found = stored(candidates(with_points(units_of_round(shard, i, own, rows)), pairs, need), "ngram-pairs")
        labels = relabelled(labels, verified(found, sets, need))
    found = stored(candidates(with_points(units_of_rest(shard, labels, tree_rows)), None, need), "ngram-pairs")
    return relabelled(labels, verified(found, sets, need))


def join(docs: DataFrame, shingle: int = SHINGLE, need: int = NEED, tree_rows: int = TREE_ROWS, rounds=ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) of every row of ``docs``.

    Rows with the same set are one class and link. Null and empty texts and texts of white space have no
    shingles and link with nothing, not even each other. Rows with a null id link too, but a component's
    id is null only if all its ids are. An empty table gives no rows; only doc_id and text are read.
    """
    rows, level = scan(docs, shingle)
    point = points(docs, level, shingle, need)
    labels = components(docs, point, need, shingle, tree_rows, rounds)
    least = rows.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("least"))
    named = least.join(point.select("digest", "sid"), "digest").join(labels, "sid", "left").select("digest", "least", F.coalesce("label", "sid").alias("label"))
    ids = named.groupBy("label").agg(F.min("least").alias("component_id"))
    known = named.join(ids, "label").select("digest", "component_id")
    return rows.join(known, "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
