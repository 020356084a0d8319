"""Information-theoretic sanitisation of personal data (operator 5), in DataFrame expressions alone.

Fixed patterns find e-mail addresses, IP addresses, card and phone numbers: the protected
entities. A term t of the corpus discloses an entity e as far as it tells us that e is near:
PMI(e; t) = log2(p(e, t) / (p(e) p(t))) against the information of the entity itself,
IC(e) = -log2 p(e). The ratio is 1 if t occurs with e only. Probabilities are shares of all
documents, over all documents. A term that reaches DISCLOSE and is near the entity more often
than chance allows is generalised to its kind wherever it stands; from REMOVE on it is removed.
Chance is judged over distinct texts, since copies of a text are no further evidence: were terms
dealt at random, at most CHANCE pairs of an entity and a term would be expected to pass, over
all pairs. Two texts can be enough; how many must be depends on the corpus alone.

A text's matches are found by marking them with a character that cannot be in it and cutting
there; the lengths of the pieces give the offsets.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

KINDS = ("email", "ip", "card", "phone")
#: Pairs of an entity and a term that may pass by chance, expected over the whole corpus.
CHANCE = 0.05
DISCLOSE = 0.95
REMOVE = 0.99
MIN_TERM = 3
#: Tables that measure up to this are broadcast.
BROADCAST_BYTES = 16 << 20

_MARK, _OTHER = "\ue000", "\ue001"  # the mark is replaced in texts, one character for one, before it is used

# The base patterns. Possessive loops and the look-behinds find the same spans as the
# plain patterns, without their quadratic time and recursion on long runs.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_OCTET = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
#: What stands between terms.
_GAP = r"[\x20\x09-\x0D.,;:!?\"()\[\]{}|<>]"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a text of digits passes the Luhn check."""
    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 1, twice).otherwise(d)
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), value)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _spans(text: Column, pattern: str, maybe: Column, keep: Callable[[Column], Column]) -> Column:
    """array<struct<s, e, v>> of the matches of ``pattern`` that ``keep`` accepts; ``maybe``: a cheap test that there can be any."""
    kind = "array<struct<s:int,e:int,v:string>>"
    none = F.array().cast(kind)
    pieces = F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("in"), none.alias("out"))

    def step(a: Column, p: Column) -> Column:
        end = a["at"] + F.length(p)
        more = F.concat(a["out"], F.array(F.struct(a["at"].alias("s"), end.alias("e"), p.alias("v"))))
        return F.struct(end.alias("at"), (~a["in"]).alias("in"), F.when(a["in"] & keep(p), more).otherwise(a["out"]).alias("out"))
    return F.when(maybe, F.aggregate(pieces, start, step, lambda a: a["out"])).otherwise(none)


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each kind, leftmost and without overlap, in code points."""
    t = F.translate(F.coalesce(text, F.lit("")), _MARK, _OTHER)
    return {
        "email": _spans(t, EMAIL, F.instr(t, "@") > 0, lambda m: F.lit(True)),
        "ip": _spans(t, IP, t.rlike(r"[0-9]\.[0-9]"), lambda m: F.forall(F.split(m, r"\."), lambda x: x.rlike(_OCTET))),
        "card": _spans(t, CARD, t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), lambda m: luhn(_digits(m))),
        "phone": _spans(t, PHONE, F.instr(t, "+") > 0, lambda m: F.length(_digits(m)).between(8, 15)),
    }


def terms(text: Column) -> Column:
    """Distinct lower-cased terms of a text, base spans taken out before."""
    return F.array_distinct(F.split(F.lower(text), f"{_GAP}+"))


def _without_base(text: Column) -> Column:
    for p in (EMAIL, IP, CARD, PHONE):
        text = F.regexp_replace(text, p, " ")
    return text


def _joined(spans: Column, kind: str = "") -> Column:
    """"kind:start:end" of each span, comma-joined; the kind is the spans' own unless given."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind) if kind else x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def _entities(kind: str) -> Column:
    """"kind:value" of each span, in a form that does not depend on how it is written."""
    value = {"email": F.lower, "ip": lambda v: v}.get(kind, _digits)
    return F.transform(kind, lambda x: F.concat(F.lit(f"{kind}:"), value(x["v"])))


def _placed(spans: Column, order: int, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(order).alias("o"), x["e"].alias("e"), F.lit(kind).alias("k")))


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, key (a digest of the text), the four arrays of spans, entities, and term hashes of the texts that hold any."""
    rows = docs.select("doc_id", "text", F.md5(F.coalesce("text", F.lit(""))).alias("key"))
    rows = rows.select("*", *(c.alias(k) for k, c in base_spans(F.col("text")).items()))
    named = F.concat(*map(_entities, KINDS))
    rows = rows.withColumn("entities", F.array_distinct(named))
    hashes = F.transform(F.filter(terms(_without_base(F.col("text"))), lambda w: F.length(w) >= MIN_TERM), lambda w: F.xxhash64(w))
    return rows.select("doc_id", "key", *KINDS, "entities", F.when(F.size("entities") > 0, hashes).alias("terms"))


def term_frequencies(docs: DataFrame) -> DataFrame:
    """h (hash of a term), df: in how many documents, over all documents, dt: in how many distinct texts."""
    texts = docs.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.count("*").alias("n"))
    words = texts.select("n", F.explode(terms(F.col("text"))).alias("w")).filter(F.length("w") >= MIN_TERM)
    return words.select(F.xxhash64("w").alias("h"), "n").groupBy("h").agg(F.sum("n").alias("df"), F.count("*").alias("dt"))


def log_chance(both: Column, a: Column, b: Column, total: int, factors: int = 16) -> Column:
    """Upper bound of ln P(at least ``both`` of ``a`` random texts are among ``b`` given ones, of ``total``).

    The expected number of j-subsets of the common texts over that in ``both`` texts, by Markov; j is ``both``
    up to ``factors``. Exact where both = a = b <= factors.
    """
    def factor(i: int) -> Column:
        return F.when(both > i, F.log((a - i).cast("double") * (b - i) / ((F.lit(float(total)) - i) * (both - i)))).otherwise(0.0)
    return sum((factor(i) for i in range(1, factors)), factor(0))


def least_texts(total: int, limit: float) -> int:
    """The least number of texts in which a pair can pass ``limit``, a bound of ln P: fewer can't however rare the term and the entity."""
    most = 0.0
    for k in range(1, min(total, 16) + 1):
        most += math.log(k / (total - k + 1))  # -ln C(total, k)
        if most <= limit:
            return k
    return total + 1


def disclosing_terms(docs: DataFrame, found: DataFrame, chance: float = CHANCE, disclose: float = DISCLOSE) -> DataFrame:
    """h, ratio: the terms that disclose an entity, with their greatest PMI(e; t) / IC(e)."""
    total = docs.count()
    distinct = found.select("key").distinct().count()
    # Copies of a text are counted once with their number before anything is multiplied out.
    texts = found.filter(F.size("entities") > 0).groupBy("key").agg(F.count("*").alias("n"), F.first("entities").alias("entities"), F.first("terms").alias("terms"))
    tests = texts.agg(F.sum(F.size("entities").cast("long") * F.size("terms"))).first()[0] or 1
    limit = math.log(chance / tests)
    least = least_texts(distinct, limit)
    near = texts.select(F.explode("entities").alias("e"), "n", "terms")
    known = near.groupBy("e").agg(F.sum("n").alias("de"), F.count("*").alias("et")).filter(F.col("et") >= least)
    pairs = near.join(known, "e").select(F.xxhash64("e").alias("e"), "de", "et", "n", F.explode("terms").alias("h")) \
        .groupBy("e", "h").agg(F.sum("n").alias("both"), F.count("*").alias("bt"), F.first("de").alias("de"), F.first("et").alias("et")).filter(F.col("bt") >= least)
    pmi = F.log2(F.col("both") * F.lit(float(total)) / (F.col("de") * F.col("df")))
    information = F.log2(F.lit(float(total)) / F.col("de"))
    ratio = F.when(information > 0, pmi / information).otherwise(0.0)
    # A term is counted in texts without their base spans, its frequency in whole ones: the latter is no less, but for a term that a span hid.
    bound = log_chance(F.col("bt"), F.col("et"), F.greatest("dt", "bt"), distinct)
    return pairs.join(term_frequencies(docs), "h").filter(bound <= limit).select("h", ratio.alias("ratio")) \
        .filter(F.col("ratio") >= disclose).groupBy("h").agg(F.max("ratio").alias("ratio"))


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """A hint to broadcast ``df`` (a stored table) where its rows measure at most BROADCAST_BYTES; as it is beyond."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def term_spans(docs: DataFrame, disclosing: DataFrame) -> DataFrame:
    """key, hits: array<struct<s, e, ratio, kind>> of the disclosing terms in each text that holds any.

    The terms of all texts meet the disclosing ones first; each text that holds some gets a map of its
    own few. Its terms are then walked in one expression, with offsets from the lengths of what stands
    before: no row per term.
    """
    key, t = F.md5(F.coalesce("text", F.lit(""))), F.translate(F.coalesce("text", F.lit("")), _MARK, _OTHER)
    words = docs.select(key.alias("key"), F.explode(terms(F.coalesce("text", F.lit("")))).alias("w")).filter(F.length("w") >= MIN_TERM)
    met = words.select("key", F.xxhash64("w").alias("h")).join(small(disclosing, 16), "h").distinct()
    held = stored(met.groupBy("key").agg(F.map_from_entries(F.collect_set(F.struct("h", "ratio"))).alias("own")), "pii-held")
    # Spans of the base are blanked, one character for one, so that terms are those that were counted.
    blank = t
    for p in (EMAIL, IP, CARD, PHONE):
        pieces = F.split(F.regexp_replace(blank, p, f"{_MARK}$0{_MARK}"), _MARK, -1)
        blank = F.array_join(F.transform(pieces, lambda x, i: F.when(i % 2 == 1, F.repeat(F.lit(" "), F.length(x))).otherwise(x)), "")
    some = docs.withColumn("key", key).join(small(held, 256), "key").select("key", "own", blank.alias("t"))
    # A piece: the gap before the text's first term, or a term and the gap after it.
    pieces = F.split("t", f"(?<={_GAP})(?!{_GAP})", -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,ratio:double,kind:string>>").alias("out"))

    def step(a: Column, piece: Column) -> Column:
        w = F.regexp_replace(piece, f"{_GAP}+$", "")
        ratio = F.try_element_at(F.col("own"), F.xxhash64(F.lower(w)))
        kind = F.when(w.rlike("^[0-9]+$"), "NUMBER").when(w.rlike(r"^\p{Lu}"), "NAME").otherwise("TERM")
        hit = F.struct(a["at"].alias("s"), (a["at"] + F.length(w)).alias("e"), ratio.alias("ratio"), kind.alias("kind"))
        more = F.when((F.length(w) >= MIN_TERM) & ratio.isNotNull(), F.concat(a["out"], F.array(hit))).otherwise(a["out"])
        return F.struct((a["at"] + F.length(piece)).alias("at"), more.alias("out"))
    found = some.select("key", F.aggregate(pieces, start, step, lambda a: a["out"]).alias("hits")).filter(F.size("hits") > 0)
    return found.groupBy("key").agg(F.first("hits").alias("hits"))


def find(docs: DataFrame, chance: float = CHANCE, disclose: float = DISCLOSE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, n_terms, spans, key and hits of every row of ``docs``.

    Null and empty texts hold nothing (the digest of the empty text). Null ids are kept; repeated rows
    have the same results; an empty table gives none; only doc_id and text are read.
    """
    rows = docs.select("doc_id", "text")
    found = stored(detect(rows), "pii-base")
    # stored, so that the join below reads both sides from shuffles of its own, whose hot keys (copies of a text) Spark can split
    hits = stored(term_spans(rows, stored(disclosing_terms(rows, found, chance, disclose), "pii-terms")), "pii-hits")
    all_ = found.drop("entities", "terms").join(hits, "key", "left")
    base = F.array_join(F.filter(F.array(*(_joined(F.col(k), k) for k in KINDS)), lambda x: x != ""), ",")
    # All spans by start, then kind as listed, terms last.
    none = F.array().cast("array<struct<s:int,o:int,e:int,k:string>>")
    order = F.concat(*(_placed(F.col(k), i, k) for i, k in enumerate(KINDS)), F.coalesce(_placed(F.col("hits"), len(KINDS), "term"), none))
    return all_.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(base, 256).alias("base_sha256"),
                       F.coalesce(F.size("hits"), F.lit(0)).cast("long").alias("n_terms"), _joined(F.sort_array(order)).alias("spans"), "key", "hits")


def sanitise(docs: DataFrame, chance: float = CHANCE, disclose: float = DISCLOSE, remove: float = REMOVE) -> DataFrame:
    """``docs`` with its columns, each base span replaced by its kind in brackets, disclosing terms generalised to their kind or removed."""
    found = find(docs, chance, disclose).select("key", "spans", "hits").dropDuplicates(["key"])
    names = docs.columns
    own = docs.withColumn("__key", F.md5(F.coalesce("text", F.lit("")))).join(found.select(F.col("key").alias("__key"), F.col("spans").alias("__spans"), F.col("hits").alias("__hits")), "__key", "left")
    span = F.transform(F.filter(F.split("__spans", ","), lambda x: x != ""), lambda x: F.struct(
        F.split(x, ":")[1].cast("int").alias("s"), F.split(x, ":")[2].cast("int").alias("e"), F.split(x, ":")[0].alias("k")))
    def mark(x: Column) -> Column:
        hit = F.element_at(F.filter(F.coalesce("__hits", F.array().cast("array<struct<s:int,e:int,ratio:double,kind:string>>")), lambda h: h["s"] == x["s"]), 1)
        return F.when(x["k"] != "term", F.concat(F.lit("["), F.upper(x["k"]), F.lit("]"))).when(hit["ratio"] >= remove, F.lit("")).otherwise(F.concat(F.lit("["), hit["kind"], F.lit("]")))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        new = F.concat(a["out"], F.substring("text", a["at"] + 1, x["s"] - a["at"]), mark(x))
        return F.when(x["s"] >= a["at"], F.struct(x["e"].alias("at"), new.alias("out"))).otherwise(F.struct(F.greatest(a["at"], x["e"]).alias("at"), a["out"].alias("out")))
    text = F.aggregate(span, start, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    return own.withColumn("text", F.when(F.size(span) > 0, text).otherwise(F.col("text"))).select(*names)
