"""Source divergence audit with in-mapper stripes (operator 12).

Each partition folds whole documents into hash stripes: for a term of a language, the number
of documents and of occurrences by source. A partition that holds SPILL cells sends its
stripes on and starts anew; stripes are merged by key, so what is shuffled grows with the
distinct cells a partition saw and no longer with the words. From the merged stripes come the
totals of each group (language, source), and then, stripe by stripe, the divergences: a
stripe alone decides what its term adds to each pair of sources and how far each source
exceeds its language.

A pair's sum runs over all kept terms. A stripe has cells only for sources that have its
term, so what a term adds to a pair is found from the cells of either source; terms that
neither has all add the same, and are counted instead of visited.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, bounded, stored

MIN_DOCS = 10
TOP = 10
UNIT = 1_000_000_000
#: Cells (term, source) that a partition holds before it sends its stripes on: about 150 MB.
SPILL = 600_000
#: Numbers in one matrix of a block of stripes.
BLOCK = 1 << 20

#: Every byte that belongs to no term becomes a space, and A-Z become a-z: bytes beyond ASCII are those of the other term characters.
_TERMS = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def terms_of(text: str) -> list[bytes]:
    """``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TERMS).split()


def stripes(docs: DataFrame, spill: int = SPILL) -> DataFrame:
    """lang, term, source, docs, n: cells of the partitions' stripes, not yet merged. The empty term marks that a group occurs."""
    schema = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("source", pa.string()), ("docs", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[bytes, dict[str, list[int]]]] = {}  # lang -> term -> source -> [docs, n]
        cells = 0

        def out() -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            for lang, own in held.items():
                for term, stripe in own.items():
                    rows += [(lang, term, source, *cell) for source, cell in stripe.items()]
                    if len(rows) >= 50_000:
                        yield batch(schema, *zip(*rows, strict=True))
                        rows = []
            if rows:
                yield batch(schema, *zip(*rows, strict=True))
            held.clear()

        for b in batches:
            for part in bounded(b, 4 << 20):
                for lang, source, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    own = held.setdefault(lang, {})
                    own.setdefault(b"", {}).setdefault(source, [0, 0])[0] += 1
                    for term, n in Counter(terms_of(text)).items():
                        stripe = own.get(term)
                        if stripe is None:
                            own[term] = {source: [1, n]}
                            cells += 1
                            continue
                        cell = stripe.get(source)
                        if cell is None:
                            stripe[source] = [1, n]
                            cells += 1
                        else:
                            cell[0] += 1
                            cell[1] += n
                    if cells >= spill:
                        yield from out()
                        cells = 0
        yield from out()
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(*text).mapInArrow(run, "lang string, term binary, source string, docs long, n long")


def merged(cells: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, stripe (sources and their counts): one row per kept term, and one for the empty term of each language.

    One shuffle: both groupings are by what the cells were dealt by. Every partition sends a cell
    once per spill, so a key's rows are bounded by spills and sources, not by documents.
    """
    one = cells.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    whole = one.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("stripe"))
    return whole.filter((F.col("docs") >= min_docs) | (F.length("term") == 0)).select("lang", "term", "stripe")


class Language:
    """Sources of a language in order, their totals, the language's total and its number of kept terms."""

    def __init__(self, groups: list[tuple[str, int]], kept: int):
        groups = sorted(groups)
        self.sources = [s for s, _ in groups]
        self.place = {s: i for i, s in enumerate(self.sources)}
        self.kept = kept
        self.totals = np.array([n + 2 * kept for _, n in groups], object)
        self.whole = sum(n for _, n in groups) + 2 * kept
        #: Share of a term that the group does not have.
        self.zero = np.array([1 + 2 * UNIT // t if t else 0 for t in self.totals.tolist()], np.int64)


def share(n: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(UNIT * (n + 2) / total), exact: in 64 bits where they hold the product, else in Python's integers."""
    if not len(n) or int(n.max()) < (1 << 63) // UNIT - 3:
        total = total.astype(np.int64) if isinstance(total, np.ndarray) else np.int64(total)
        return 1 + UNIT * (n + 2) // total
    return (1 + UNIT * (n.astype(object) + 2) // total).astype(np.int64)


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); shares are at most UNIT + 1, so the square fits 64 bits."""
    d = p - q
    return d * d // (p + q)


class Audit:
    """What stripes of one language add to the pairs of its sources, and each source's best terms among them."""

    def __init__(self, lang: Language, top: int = TOP):
        s = len(lang.sources)
        self.lang, self.top = lang, top
        self.twice, self.either = np.zeros((s, s), np.int64), np.zeros((s, s), np.int64)
        self.best: list[list[tuple[int, bytes]]] = [[] for _ in range(s)]

    def add(self, terms: list[bytes], ends: np.ndarray, source: np.ndarray, n: np.ndarray) -> None:
        """Stripes as flat cells: those of term i end before ``ends[i]``; every term has a cell."""
        lang, s = self.lang, len(self.lang.sources)
        row = np.repeat(np.arange(len(terms)), np.diff(ends, prepend=0))
        p = share(n, lang.totals[source])
        has = np.zeros((len(terms), s), bool)
        has[row, source] = True
        shares = np.broadcast_to(lang.zero, (len(terms), s)).copy()
        shares[row, source] = p
        order = np.argsort(source, kind="stable")
        step = max(1, BLOCK // max(1, s))
        for i in range(0, len(order), step):
            cells = order[i:i + step]
            # Two sources that both have the term meet in both their cells, others in one: doubled, and once for both.
            f = gap(p[cells][:, None], shares[row[cells]]) * (2 - has[row[cells]])
            own, first = np.unique(source[cells], return_index=True)
            self.twice[own] += np.add.reduceat(f, first)
        each, count = has.astype(np.float64), has.sum(0)
        self.either += count[:, None] + count[None, :] - (each.T @ each).astype(np.int64)
        q = share(np.add.reduceat(n, np.append(0, ends[:-1])), lang.whole)[row]
        more = np.flatnonzero(p > q)
        value = gap(p[more], q[more])
        order = np.lexsort((-value, source[more]))
        more, value = more[order], value[order]
        for i, j in _runs(source[more]):
            last = value[min(i + self.top, j) - 1]
            j = i + int(np.searchsorted(-value[i:j], -last, "right"))  # all that tie with the last place, for the order by term
            src = int(source[more[i]])
            found = self.best[src] + [(-int(x), terms[row[k]]) for x, k in zip(value[i:j], more[i:j], strict=True)]
            self.best[src] = sorted(found)[:self.top]

    def results(self) -> Iterator[tuple[str, str, str, bytes, int]]:
        """(source, part, other source, term, value): additions to pairs, less what each of their terms would add if neither had it."""
        lang = self.lang
        add = (self.twice + self.twice.T) // 2 - self.either * gap(lang.zero[:, None], lang.zero[None, :])
        for i, source in enumerate(lang.sources):
            yield from ((source, "pair", other, None, int(add[i, j])) for j, other in enumerate(lang.sources) if i != j)
            yield from ((source, "term", None, term, -value) for value, term in self.best[i])


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each run of equal values."""
    if not len(x):
        return []
    cut = np.flatnonzero(x[1:] != x[:-1]) + 1
    return list(zip([0, *cut.tolist()], [*cut.tolist(), len(x)], strict=True))


def emitted(kept: DataFrame, langs: dict[str, Language], top: int = TOP) -> DataFrame:
    """lang, source, part, other, term, value: what each partition of merged stripes adds up to."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("other", pa.string()), ("term", pa.binary()), ("value", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audits: dict[str, Audit] = {}
        for b in batches:
            lang_of = b.column(0).to_numpy(zero_copy_only=False)
            for lang in dict.fromkeys(lang_of.tolist()):
                audit = audits.get(lang) or audits.setdefault(lang, Audit(langs[lang], top))
                place = audit.lang.place
                mine = b.filter(pa.array(lang_of == lang))
                step = max(1, BLOCK // max(1, len(place)))
                for i in range(0, mine.num_rows, step):
                    part = mine.slice(i, step)
                    lists = part.column(2)
                    cells = lists.flatten()
                    source = np.fromiter((place[x] for x in cells.field(0).to_pylist()), np.int64, len(cells))
                    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
                    audit.add(part.column(1).to_pylist(), ends, source, cells.field(1).to_numpy(zero_copy_only=False).astype(np.int64))
        for lang, audit in audits.items():
            rows: list[tuple] = []
            for x in audit.results():
                rows.append((lang, *x))
                if len(rows) >= 50_000:
                    yield batch(schema, *zip(*rows, strict=True))
                    rows = []
            if rows:
                yield batch(schema, *zip(*rows, strict=True))
    return kept.select("lang", "term", "stripe").mapInArrow(run, "lang string, source string, part string, other string, term binary, value long")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, spill: int = SPILL) -> DataFrame:
    """lang, source, part, item, value, rank: divergences of every group (lang, source) of ``docs``.

    ``pair``: from each other source of the language, over all kept terms. ``term``: the ``top`` kept
    terms by which the group exceeds its language. Null lang, source and text count as empty; a group
    without terms has counts of zero; a repeated row counts each time; an empty table gives no rows;
    a language with one source has no ``pair`` rows. Other columns are not read. The driver and every
    task hold one row per group (their number's square is the number of ``pair`` rows), a task also
    two 64-bit numbers per pair of sources.
    """
    spark = docs.sparkSession
    stripe = stored(merged(stripes(docs, spill), min_docs), "divergence-stripes")
    kept = stripe.filter(F.length("term") > 0)
    cells = stripe.select("lang", (F.length("term") > 0).cast("int").alias("kept"), F.explode("stripe").alias("c")).select("lang", "kept", "c.source", "c.n")
    groups: dict[str, list[tuple[str, int]]] = {}
    # The empty term's cells, with no count, name every group.
    for r in cells.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("kept")).alias("n")).collect():
        groups.setdefault(r.lang, []).append((r.source, r.n))
    terms = {r.lang: r["count"] for r in kept.groupBy("lang").count().collect()}
    langs = {x: Language(own, terms.get(x, 0)) for x, own in groups.items()}
    sums = emitted(kept, langs, top)
    rows = [(x, s, int(z), own.kept) for x, own in langs.items() for s, z in zip(own.sources, own.zero.tolist(), strict=True)]
    group = spark.createDataFrame(rows, "lang string, source string, zero long, kept long")
    other = group.select("lang", F.col("source").alias("other"), F.col("zero").alias("zero2"))
    found = sums.groupBy("lang", "source", "part", "other", "term").agg(F.sum("value").alias("value"))
    found = stored(found, "divergence-sums")
    pairs = group.join(other, "lang").filter(F.col("source") != F.col("other")).join(found.filter("part = 'pair'").select("lang", "source", "other", "value"), ["lang", "source", "other"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"),
        (F.coalesce("value", F.lit(0)) + F.when(F.col("kept") > 0, F.expr("kept * ((zero - zero2) * (zero - zero2) div (zero + zero2))")).otherwise(0)).alias("value"))
    best = found.filter("part = 'term'").select("lang", "source", "part", F.col("term").cast("string").alias("item"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order))
    # Ranked apart: each partition's rows beyond the limit stay out of the shuffle.
    both = ranked(pairs).unionByName(ranked(best).filter(F.col("rank") <= top))
    return both.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank")
