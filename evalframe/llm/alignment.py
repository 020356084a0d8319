"""Cross-tokenizer alignment by divide and conquer at shared cuts (operator 13).

Two tokenizations of one text end tokens at byte offsets. An offset where both end a token is
a shared cut. For a stretch of tokens the common end nearest its middle token is found by
bisection in the other side's ends, the stretch is cut there, and both halves are taken on in
the same way; a stretch without a common end inside is a group. All stretches of a batch of documents are
taken on together, level by level. Tokens of the two sides are linked where their byte ranges
overlap.

How often two ids are linked is a count over the corpus: each partition folds its documents'
distinct pairs into counts that Spark merges by pair. The LISTED most frequent pairs (a fixed
bound) are looked up in the tasks; all other links meet the counts in a shuffle join.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import tokenizer_path
from .common import batch, bounded, most_frequent, stored, texts_of

BYTE_LEVEL, RANKS, PIECES = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: Pairs that tasks look up: 17 bytes each.
LISTED = 1 << 19
#: Pairs of documents that a partition holds before it sends its counts on.
HELD = 1 << 22
#: With fewer open stretches than this, each is searched by itself.
FEW = 16
#: Characters after which a long text is cut at the next place where neither side's tokens can go on.
STRETCH = 1 << 16

_CUT = re.compile(r"(?<=[\w!-~])\x20(?=[\w!-~])")
#: Characters whose classes do not depend on the edition of Unicode a library was built with.
_PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7e\\xa1-\\u024f\\u2013\\u2014\\u2018-\\u201e\\u2026\\u20ac]*")


def byte_alphabet() -> dict[str, int]:
    """Character of the byte-level alphabet -> byte: visible Latin-1 characters are themselves, the others follow from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Side:
    """A tokenizer's ids of a text and the bytes of each id."""

    def __init__(self, token_bytes: list[bytes]):
        self.bytes = token_bytes
        self.lengths = np.array([len(b) for b in token_bytes], np.int64)
        self.size = len(token_bytes)


class ByteLevelSide(Side):
    """Byte-level BPE of a space and the text; strings of special tokens are plain text.

    The library that reads the vocabulary as ranks is several times faster; it is asked where both
    libraries are sure to class every character alike, and the tokenizer file itself elsewhere.
    """

    def __init__(self, name: str = BYTE_LEVEL, ranks: str | None = RANKS):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(tokenizer_path(name))
        self.tok.no_padding()
        self.tok.no_truncation()
        self.tok.encode_special_tokens = True
        alphabet = byte_alphabet()
        added = {i: t.content for i, t in self.tok.get_added_tokens_decoder().items()}
        super().__init__([added[i].encode() if i in added else bytes(map(alphabet.__getitem__, self.tok.id_to_token(i)))
                          for i in range(self.tok.get_vocab_size(with_added_tokens=True))])
        self.fast = None
        if ranks:
            import public_tokenizers
            import tiktoken
            with open(tokenizer_path(ranks), "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            if all(self.bytes[i] == b for b, i in table.items()):  # the same vocabulary
                self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast and _PLAIN.fullmatch(text):
            return self.fast.encode_ordinary(text)
        return self.tok.encode(text, add_special_tokens=False).ids

    def whole(self, parts: list[str]) -> list[int]:
        return [i for p in parts for i in self.encode(p)]


class PieceSide(Side):
    """Sentence pieces with byte fallback; the library puts a space before what it is given."""

    def __init__(self, name: str = PIECES):
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))
        super().__init__([bytes([int(p[3:5], 16)]) if self.sp.is_byte(i) else p.replace("▁", " ").encode()
                          for i, p in enumerate(map(self.sp.id_to_piece, range(self.sp.get_piece_size())))])

    def whole(self, parts: list[str]) -> list[int]:
        """Parts each begin with the space that the library adds."""
        return [i for p in parts for i in self.sp.encode(p[1:])]


def stretches(text: str, size: int = STRETCH) -> list[str]:
    """``text`` in parts of about ``size`` characters, cut before a space between visible characters.

    No token of either side goes on there: a byte-level pre-token holds a space only in front, and no
    piece holds one behind another character. A text without such places stays whole.
    """
    out, at = [], 0
    while len(text) - at > size:
        m = _CUT.search(text, at + size)
        if not m:
            break
        out.append(text[at:m.start()])
        at = m.start()
    return [*out, text[at:]]


@functools.cache
def sides(a: str, ranks: str | None, b: str) -> tuple[ByteLevelSide, PieceSide]:
    return ByteLevelSide(a, ranks), PieceSide(b)


@functools.cache
def _words(a: int, b: int) -> list[str]:
    """Ids with the mark that follows them: A's within a group and at its end, then B's."""
    return [f"{i}{mark}" for n, marks in ((a, ",|"), (b, ",;")) for mark in marks for i in range(n)]


def tokens(text: str, a: ByteLevelSide, b: PieceSide) -> tuple[list[int], list[int]]:
    """Ids of both sides; none where the text is empty or a side's bytes are not a space and the text."""
    if not text:
        return [], []
    parts = stretches(" " + text)
    x, y = a.whole(parts), b.whole(parts)
    want = (" " + text).encode("utf-8", "surrogatepass")
    if b"".join(map(a.bytes.__getitem__, x)) != want or b"".join(map(b.bytes.__getitem__, y)) != want:
        return [], []
    return x, y


def _common(ends: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which of ``ends`` are among ``other``, by bisection."""
    at = np.minimum(np.searchsorted(other, ends), len(other) - 1)
    return other[at] == ends


def _nearest(ea: np.ndarray, eb: np.ndarray, a0: int, a1: int, low: int, high: int) -> tuple[int, int, int, int]:
    """The common ends nearest to the middle of a stretch, by windows that double: (left, right, next low, next high), -1 where there is none."""
    w = 32
    while low >= a0 or high < a1:
        lo, hi = max(a0, low - w + 1), min(a1, high + w)
        left, right = np.flatnonzero(_common(ea[lo:low + 1], eb)), np.flatnonzero(_common(ea[high:hi], eb))
        if len(left) or len(right):
            i, j = (lo + int(left[-1]) if len(left) else -1), (high + int(right[0]) if len(right) else -1)
            return i, j, (i if i >= 0 else lo) - 1, (j if j >= 0 else hi - 1) + 1
        low, high, w = lo - 1, hi, 2 * w
    return -1, -1, low, high


def shared_cuts(ea: np.ndarray, eb: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places in ``ea`` of the ends that are in ``eb`` too, in order.

    Both rise over a batch of documents laid end to end; ``starts``: the first place of each document
    in ``ea``, and its length. A document's last end is shared. A stretch is the ends a0..a1-1; the
    two in its middle are looked up, those that are shared cut it, and else the next two outward,
    until it is cut or done.
    """
    full = starts[1:] > starts[:-1]
    a0, a1 = starts[:-1][full], starts[1:][full] - 1
    found = [a1]
    a0, a1 = a0[a1 > a0], a1[a1 > a0]
    low = (a0 + a1) >> 1
    high = low + 1
    while len(a0) > FEW:
        left = (low >= a0) & _common(ea[np.maximum(low, 0)], eb)
        right = (high < a1) & _common(ea[np.minimum(high, len(ea) - 1)], eb)
        found += [low[left], high[right]]
        cut = left | right
        open_ = ~cut & ((low > a0) | (high + 1 < a1))
        # Both halves of what was cut, and what has ends left to try.
        b0, b1 = np.concatenate([a0[cut], high[cut] + 1]), np.concatenate([low[cut], a1[cut]])
        more = b1 > b0
        b0, b1 = b0[more], b1[more]
        mid = (b0 + b1) >> 1
        a0, a1, low, high = (np.concatenate(z) for z in ((b0, a0[open_]), (b1, a1[open_]), (mid, low[open_] - 1), (mid + 1, high[open_] + 1)))
        order = np.argsort(a0, kind="stable")  # runs that rise are merged, and rising ends are looked up where the last one was
        a0, a1, low, high = a0[order], a1[order], low[order], high[order]
    todo = list(zip(a0.tolist(), a1.tolist(), low.tolist(), high.tolist(), strict=True))
    while todo:
        p, q, lo, hi = todo.pop()
        i, j, lo, hi = _nearest(ea, eb, p, q, lo, hi)
        found.append(np.array([k for k in (i, j) if k >= 0], np.int64))
        if i >= 0 or j >= 0:
            todo += [(s, e, (s + e) >> 1, ((s + e) >> 1) + 1) for s, e in ((p, lo + 1), (hi, q)) if e > s]
    return np.sort(np.concatenate(found))


class Batch:
    """Tokens, groups and links of a batch of texts, laid end to end."""

    def __init__(self, texts: list[str], a: ByteLevelSide, b: PieceSide):
        got = [tokens(t, a, b) for t in texts]
        self.a, self.b, self.n = a, b, len(texts)
        self.at, self.bt = (np.append(0, np.cumsum([len(g[s]) for g in got])) for s in (0, 1))
        self.x, self.y = (np.fromiter(chain.from_iterable(g[s] for g in got), np.int64, n) for s, n in ((0, self.at[-1]), (1, self.bt[-1])))
        self.ea, self.eb = np.cumsum(a.lengths[self.x]), np.cumsum(b.lengths[self.y])
        #: The last token of each group, on either side.
        self.cut = shared_cuts(self.ea, self.eb, self.at) if len(self.x) else np.zeros(0, np.int64)
        self.cut_b = np.searchsorted(self.eb, self.ea[self.cut])
        self.groups = np.diff(np.searchsorted(self.cut, self.at))

    def texts(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each text: decimal ids of each group."""
        i, j = np.arange(len(self.x)), np.arange(len(self.y))
        ga, gb = np.searchsorted(self.cut, i), np.searchsorted(self.cut_b, j)
        before = np.append(0, self.cut_b + 1)  # B's tokens ahead of each group
        word = np.empty(len(i) + len(j), np.int64)
        word[i + before[ga]] = self.x + self.a.size * (self.cut[ga] == i)
        word[j + self.cut[gb] + 1] = self.y + 2 * self.a.size + self.b.size * (self.cut_b[gb] == j)
        words, word = _words(self.a.size, self.b.size), word.tolist()
        both = (self.at + self.bt).tolist()
        return ["".join(map(words.__getitem__, word[s:e]))[:-1] for s, e in zip(both[:-1], both[1:], strict=True)]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pair, times), in order: how often each document links two ids. A pair is A's id times B's size, plus B's id.

        Between two neighbouring ends, of whichever side, lies one token of each: one link.
        """
        ends = np.concatenate([self.ea, self.eb])
        ends.sort(kind="stable")  # two sorted runs are merged
        ends = ends[np.append(ends[1:] != ends[:-1], True)[:len(ends)]]
        i = np.searchsorted(self.ea, ends)
        pairs = self.a.size * self.b.size
        link = (np.searchsorted(self.at, i, "right") - 1) * pairs + self.x[i] * self.b.size + self.y[np.searchsorted(self.eb, ends)]
        link, times = np.unique(link, return_counts=True)
        document = link // pairs
        return document, link - document * pairs, times


ALIGNED = "kind int, row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary, pair long, n long"


def align(docs: DataFrame, name_a: str = BYTE_LEVEL, name_b: str = PIECES, ranks: str | None = RANKS, held: int = HELD) -> tuple[DataFrame, DataFrame]:
    """Aligned documents, and partial counts (pair, n) of the documents that hold a pair linked; stored.

    A document's row: row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs (its distinct ones,
    little-endian 64-bit) and times (32-bit).
    """
    fields = [("kind", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
              ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary()), ("pair", pa.int64()), ("n", pa.int64())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 33
        a, b = sides(name_a, ranks, name_b)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def counts() -> pa.RecordBatch:
            n = len(parts[0][0])
            return batch(schema, np.ones(n, np.int32), *(pa.nulls(n, t) for _, t in fields[1:10]), *parts[0])

        def fold() -> list[tuple[np.ndarray, np.ndarray]]:
            pairs, place = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
            return [(pairs, np.bincount(place, np.concatenate([n for _, n in parts]), len(pairs)).astype(np.int64))]

        for whole in batches:
            for part in bounded(whole, 4 << 20):
                own = Batch(texts_of(part), a, b)
                document, pair, times = own.links()
                bounds = np.searchsorted(document, np.arange(own.n + 1))
                cut = lambda v, kind, bounds=bounds: [v[s:e].tobytes() for v in [v.astype(kind)] for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in own.texts()]
                links = np.bincount(document, times, own.n).astype(np.int64)
                yield batch(schema, np.zeros(own.n, np.int32), np.arange(number, number + own.n), part.column(0), np.diff(own.at), np.diff(own.bt), own.groups, links, digests,
                            cut(pair, "<i8"), cut(times, "<i4"), pa.nulls(own.n, pa.int64()), pa.nulls(own.n, pa.int64()))
                number += own.n
                parts.append((pair, np.ones(len(pair), np.int64)))
                size += len(pair)
                if size >= held:
                    parts = fold()
                    size = len(parts[0][0])
                    if size >= held // 2:
                        yield counts()
                        parts, size = [], 0
        if parts:
            parts = fold()
            yield counts()
    both = stored(docs.select("doc_id", "text").mapInArrow(run, ALIGNED), "alignment", "kind")
    return both.filter("kind = 0").drop("kind", "pair", "n"), both.filter("kind = 1").select("pair", "n")


def pair_counts(partial: DataFrame, size_b: int) -> DataFrame:
    """pair, n (documents that hold it linked), best (n is the highest of its A id)."""
    n = partial.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.expr(f"pair div {size_b}"))
    # An id has no more partners than the other vocabulary has ids.
    top = n.groupBy("a").agg(F.max("n").alias("top"))
    return n.join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def compare(docs: DataFrame, name_a: str = BYTE_LEVEL, name_b: str = PIECES, ranks: str | None = RANKS, listed: int = LISTED) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of ``docs``.

    Null and empty texts, and texts that a side does not give back byte for byte, have no tokens: zeros
    and an empty digest. A null doc_id is kept; a repeated row gives its result again and counts as a
    document of its own; an empty table gives no rows. Other columns are not read.
    """
    aligned, partial = align(docs, name_a, name_b, ranks)
    counts = stored(pair_counts(partial, sides(name_a, ranks, name_b)[1].size), "alignment-pairs")
    top = most_frequent(counts, listed, "pair").toPandas().sort_values("pair")
    known, known_n, known_best = top.pair.to_numpy("int64"), top.n.to_numpy("int64"), top.best.to_numpy(bool)
    rest_type = pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())]))
    schema = pa.schema([("row", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("rest", rest_type)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in bounded(whole, 4 << 20):
                pair, times = (np.concatenate([np.zeros(0, kind), *(np.frombuffer(v, kind) for v in part.column(c).to_pylist())]).astype(np.int64)
                               for c, kind in ((1, "<i8"), (2, "<i4")))
                bounds = np.append(0, np.cumsum([len(v) // 8 for v in part.column(1).to_pylist()]))
                at = np.searchsorted(known, pair)
                at[at == len(known)] = 0
                hit = known[at] == pair if len(known) else np.zeros(len(pair), bool)
                at, weight = at[hit], np.where(hit, times, 0)[hit]
                total = lambda v, hit=hit, bounds=bounds: np.diff(np.append(0, np.cumsum(v))[np.append(0, np.cumsum(hit))[bounds]])
                pairs = pa.StructArray.from_arrays([pa.array(pair[~hit]), pa.array(times[~hit])], ["pair", "times"])
                rest = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(~hit))[bounds].astype(np.int32)), pairs)
                yield batch(schema, part.column(0), total(weight * known_best[at]), total(weight * known_n[at]), rest)

    first = stored(aligned.select("row", "pairs", "times").mapInArrow(run, "row long, n_best long, count_sum long, rest array<struct<pair:long,times:long>>"), "alignment-links")
    rest = first.select("row", F.explode("rest").alias("r")).select("row", "r.pair", "r.times")
    more = rest.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best"), F.sum(F.col("times") * F.col("n")).alias("sum"))
    whole = aligned.drop("pairs", "times").join(first.drop("rest"), "row").join(more, "row", "left")
    zero = F.lit(0)
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("best", zero)).alias("n_best"),
                        (F.col("count_sum") + F.coalesce("sum", zero)).alias("count_sum"), "groups_sha256")
