"""Secret scans with password guess costs (operator 3).

Fixed patterns give the base spans. Values in a credential context (assigned to a key, after
"bearer", in a URL's user part) are priced by the least number of guesses: dynamic programming
over all ways to cut the value into words, dates, years, repeats, keyboard walks, runs of
consecutive characters and brute-force spans. A value that costs at least MIN_GUESSES is a
secret even where no fixed pattern holds. Words are priced by their rank among the corpus's
most frequent words, counted over all documents, after a short list of common passwords.
"""

from __future__ import annotations

import hashlib
import math
import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch, most_frequent, stored, texts_of, word_counts

KINDS = ("assign", "access", "hex", "guess")
MIN_GUESSES = 10.0  # log10
#: At most so many words of the corpus enter the dictionary: its size bound.
WORDS = 20_000
#: A longer run of letters is no word: it would make the dictionary's size unbounded.
LONGEST = 64

# The patterns of the base spans.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")

#: A value in quotes goes to the closing quote of its line, white space included; another one to white space or a mark.
VALUE = r"""(?:"([^"\n]++)"|'([^'\n]++)'|["']?([^\s"'<>,;]+))"""
CONTEXTS = [re.compile(p + VALUE, re.ASCII | re.IGNORECASE) for p in (
    r"""(?:password|passwd|passphrase|pwd|secret|token|credentials?|api_?key|access_?key|private_?key|auth_?key)["']?\s*+(?:[:=]|\bis\b)\s*+""",
    r"""\bauthorization["']?\s*+[:=]\s*+["']?(?:basic|bearer|token)\s++""",
    r"""\bbearer\s++""",
)]
#: The user part of a URL, and what follows up to white space or the next URL: the password ends at its last '@'. A port and its path are no password.
URL = re.compile(r"(?<=[a-z0-9+.-])://[^\s/:@]*+:(?![0-9]{0,5}[/?#])([^\s:]*+(?::(?!//)[^\s:]*+)*+)", re.ASCII | re.IGNORECASE)
HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "authorization", "bearer", "://")

# Common passwords, most common first.
COMMON = """password qwerty abc letmein monkey dragon baseball iloveyou trustno master sunshine ashley bailey shadow superman
michael football princess login welcome admin hello charlie donald secret changeme default test guest root user demo example
sample temp pass token dummy placeholder your here null none true false undefined value string insert replace todo
foobar foo bar access server local system service account private public key""".split()

KEYBOARD = ("`1234567890-=", " qwertyuiop[]\\", " asdfghjkl;'", " zxcvbnm,./")
_LEET = str.maketrans("4@310$57!", "aaeiosstl"[:9])


def _neighbours() -> dict[str, str]:
    """Keys next to each key: in its row, and those that touch it in the rows above and below."""
    at = {c: (r, i) for r, row in enumerate(KEYBOARD) for i, c in enumerate(row) if c != " "}
    return {c: "".join(d for d, (s, j) in at.items() if d != c and ((r == s and abs(i - j) == 1) or (s == r + 1 and j - i in (-1, 0)) or (s == r - 1 and j - i in (0, 1))))
            for c, (r, i) in at.items()}


ADJACENT = _neighbours()
KEYS, DEGREE = len(ADJACENT), sum(map(len, ADJACENT.values())) / len(ADJACENT)
_DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d)")
_YEAR = re.compile(r"(?:19|20)\d\d")
DATE_COST, YEAR_COST = math.log10(365 * 100 * 4), math.log10(119)


def _char_cost(c: str) -> float:
    size = 10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 100
    return math.log10(size)


def _word_cost(part: str, ranks: dict[str, int]) -> float | None:
    """log10 guesses of a dictionary word with its capitals and swapped characters, or None."""
    low = part.lower()
    rank, swaps = ranks.get(low), 0
    if rank is None:
        plain = low.translate(_LEET)
        if plain == low:
            return None
        rank, swaps = ranks.get(plain), sum(a != b for a, b in zip(low, plain, strict=True))
        if rank is None:
            return None
    upper = sum(c.isupper() for c in part)
    if upper == 0:
        case = 0.0
    elif upper == len(part) or (upper == 1 and part[0].isupper()):
        case = math.log10(2)
    else:
        case = math.log10(sum(math.comb(len(part), i) for i in range(1, min(upper, len(part) - upper) + 1)) + 1)
    return math.log10(rank + 1) + case + swaps * math.log10(2)


def stretches(value: str) -> list[tuple[str, int, int, object]]:
    """Longest stretches (kind, start, end, what they are of): repeats of a unit of one to four characters, keyboard walks, runs of consecutive characters."""
    n, low, out = len(value), value.lower(), []
    for unit in (1, 2, 3, 4):
        i = 0
        while i + 2 * unit <= n:
            j = i + unit
            while j < n and value[j] == value[j - unit]:
                j += 1
            if j - i >= max(3, 2 * unit):
                out.append(("repeat", i, j, unit))
            i = max(i + 1, j - unit + 1)
    i = 0
    while i + 2 < n:  # a walk: each key next to the one before
        j = i + 1
        while j < n and low[j] in ADJACENT.get(low[j - 1], ""):
            j += 1
        if j - i >= 3:
            out.append(("walk", i, j, [ADJACENT[low[k]].find(low[k + 1]) for k in range(i, j - 1)]))
        i = max(i + 1, j - 1)
    i = 0
    while i + 2 < n:  # a run: the same step up or down
        step = ord(low[i + 1]) - ord(low[i])
        j = i + 1
        while j < n and abs(step) == 1 and ord(low[j]) - ord(low[j - 1]) == step:
            j += 1
        if j - i >= 3:
            out.append(("run", i, j, None))
        i = max(i + 1, j - 1)
    return out


class _Stretch:
    """The cheapest of all parts of a stretch that end at each place.

    A part costs what its start does and the logarithm of its units, so of two parts that end together the earlier
    one gains as the end moves on: a start that an earlier one has overtaken is never cheapest again. The starts that
    may be are kept for each offset in a unit, the cheapest last, each with the end from which the one before it is no
    dearer. A start is put in and taken out once, so a value's time grows with its length.
    """

    def __init__(self, value: str, kind: str, start: int, end: int, of: object):
        self.kind, self.start, self.end = kind, start, end
        self.unit, self.least = (of, max(3, 2 * of)) if kind == "repeat" else (1, 3)
        self.starts: list[list[tuple[int, float, float]]] = [[] for _ in range(self.unit)]
        if kind == "repeat":
            chars = [*accumulate(map(_char_cost, value[start:end]), initial=0.0)]
            self.own = [b - a for a, b in zip(chars, chars[of:], strict=False)]  # of the unit that begins at each place
        elif kind == "walk":
            self.turns = [*accumulate((a != b for a, b in zip(of, of[1:], strict=False)), initial=1)]  # up to each step

    def _cost(self, first: int, e: int) -> float:
        if self.kind == "repeat":
            return self.own[first] + math.log10((e - first) // self.unit)
        if self.kind == "walk":
            return math.log10(KEYS) + math.log10(DEGREE) * (self.turns[e - 2] - self.turns[first] + 2) + math.log10(e - first)
        return math.log10(26 * 2) + math.log10(e - first)

    def cheapest(self, end: int, into: list[float]) -> tuple[float, int]:
        """Cost and start of the cheapest way over a part that ends at ``end``; asked for each end once, in order. ``into``: the cost before a segment at each place."""
        e = end - self.start
        new = e - self.least  # from this end on there is a part that begins here
        if new < 0:
            return math.inf, 0
        starts = self.starts[new % self.unit]
        while starts and starts[-1][2] <= e:
            starts.pop()
        head = into[self.start + new] + (self.own[new] if self.kind == "repeat" else -math.log10(DEGREE) * self.turns[new] if self.kind == "walk" else 0.0)
        if not starts or head + math.log10(self.least // self.unit) < starts[-1][1] + math.log10((e - starts[-1][0]) // self.unit):
            until = math.inf
            while starts:
                first, before, overtaken = starts[-1]
                until = new + (new - first) / math.expm1(math.log(10) * (head - before)) if head > before else math.inf
                if until < overtaken:
                    break
                starts.pop()  # overtaken before it would be cheapest again
                until = math.inf
            starts.append((new, head, until))
        first = starts[-1][0]
        return into[self.start + first] + self._cost(first, e), self.start + first


def lengths_of(ranks: dict[str, int]) -> list[int]:
    """Lengths that dictionary words have, from 3 on."""
    return sorted({len(w) for w in ranks if len(w) >= 3})


def guess_cost(value: str, ranks: dict[str, int], lengths: list[int] | None = None) -> tuple[float, list[tuple[int, int, str]]]:
    """Least log10 guesses over all segmentations, and that segmentation as (start, end, kind).

    Segments are dictionary words, dates, years, all parts of three or more characters (two units or
    more) of repeats, walks and runs, and brute-force spans. Each segment but the first costs a factor
    of two more, as it may stand in two places. The state is the place and whether a brute-force span
    ends there, which goes on at no such cost.
    """
    n, after = len(value), math.log10(2)
    if not n:
        return 0.0, []
    lengths = lengths_of(ranks) if lengths is None else lengths
    # The cheapest way to each place, by whether its last segment is a brute-force span: (cost, start, kind, that of the way to the start).
    ways: list[list[tuple[float, int, str, int]]] = [[(0.0, 0, "", 0)], [(math.inf, 0, "", 0)]]
    begin, live = {}, []
    for s in stretches(value):
        begin.setdefault(s[1], []).append(_Stretch(value, *s))
    dates: dict[int, list[tuple[int, float]]] = {}
    for m, cost in ((m, c) for i in range(n) if value[i].isdigit() for m, c in ((_DATE.match(value, i), DATE_COST), (_YEAR.match(value, i), YEAR_COST)) if m):
        dates.setdefault(m.end(), []).append((m.start(), cost))
    cheap = [0.0]  # the cheapest way to a place where a new segment begins
    last = [0]  # which way that is
    for j in range(1, n + 1):
        best = (math.inf, 0, "", 0)
        for length in lengths:
            i = j - length
            if i < 0:
                break
            if cheap[i] < best[0]:
                cost = _word_cost(value[i:j], ranks)
                if cost is not None and cheap[i] + cost < best[0]:
                    best = (cheap[i] + cost, i, "word", last[i])
        for i, cost in dates.get(j, ()):
            if cheap[i] + cost < best[0]:
                best = (cheap[i] + cost, i, "date", last[i])
        live = [s for s in live if s.end >= j] + begin.get(j - 1, [])
        for s in live:
            cost, i = s.cheapest(j, cheap)
            if cost < best[0]:
                best = (cost, i, s.kind, last[i])
        own = _char_cost(value[j - 1])
        brute = min((ways[1][j - 1][0] + own, j - 1, "brute", 1), (cheap[j - 1] + own, j - 1, "brute", last[j - 1]))
        ways[0].append(best)
        ways[1].append(brute)
        last.append(int(brute[0] < best[0]))
        cheap.append(min(best[0], brute[0]) + after)
    parts: list[tuple[int, int, str]] = []
    at, which, on = n, last[n], False
    while at:
        _, i, kind, before = ways[which][at]
        if on:
            parts[-1] = (i, parts[-1][1], kind)
        else:
            parts.append((i, at, kind))
        on = kind == "brute" and before == 1  # a span that goes on: a new one after a brute-force span costs more
        at, which = i, before
    return min(ways[0][n][0], ways[1][n][0]), parts[::-1]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, each kind leftmost and without overlap."""
    out = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    low = text.lower()
    if any(h in low for h in ("passw", "secret", "token", "api")):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    return ordered(out)


def guess_spans(text: str, ranks: dict[str, int], base: list[tuple[int, int, str]], least: float = MIN_GUESSES, lengths: list[int] | None = None, min_value: int = 1) -> list[tuple[int, int, str]]:
    """Spans of credential-context values that cost at least ``least`` and lie in no base span."""
    low = text.lower()
    if not any(h in low for h in HINTS):
        return []
    found = {m.span(m.lastindex) for p in CONTEXTS for m in p.finditer(text)}
    found |= {(m.start(1), max(m.start(1), text.rfind("@", *m.span(1)))) for m in URL.finditer(text)}
    out = []
    for s, e in sorted(found):
        while e > s and text[e - 1] in ".:!?)]}":  # marks of the sentence
            e -= 1
        if e - s < min_value or any(a <= s and e <= b for a, b, _ in base):
            continue
        if guess_cost(text[s:e], ranks, lengths)[0] >= least:
            out.append((s, e, "guess"))
    return [*dict.fromkeys(out)]


def ordered(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def dictionary(docs: DataFrame, words: int = WORDS) -> dict[str, int]:
    """Rank from 1 of common passwords, then of the corpus's most frequent words of 3 ASCII letters or more, counted over all rows."""
    def letters(text: str) -> list[bytes]:
        return [w for w in text.encode("utf-8", "surrogatepass").lower().split() if w.isalpha() and len(w) >= 3]
    counts = stored(word_counts(docs, letters), "secrets-words").filter(F.length("word") <= LONGEST)
    top = most_frequent(counts, words).select(F.col("word").cast("string").alias("word"), "n").toPandas().sort_values(["n", "word"], ascending=[False, True])
    return {w: i + 1 for i, w in enumerate(dict.fromkeys([*COMMON, *top.word]))}


def scan(docs: DataFrame, ranks: dict[str, int] | None = None, least: float = MIN_GUESSES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, n_guess, spans of every row of ``docs``.

    Null and empty texts have no spans (the digest of the empty text). Null ids are kept; repeated rows
    give repeated results; an empty table gives none; only doc_id and text are read.
    """
    ranks = dictionary(docs) if ranks is None else ranks
    lengths = lengths_of(ranks)
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
                        ("base_sha256", pa.string()), ("n_guess", pa.int64()), ("spans", pa.string())])

    def make():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            got = []
            for t in texts_of(b):
                base = base_spans(t)
                more = guess_spans(t, ranks, base, least, lengths)
                n = [sum(k == x for _, _, x in base) for k in KINDS[:3]]
                got.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), len(more), joined(ordered(base + more))))
            return batch(schema, b.column(0), *zip(*got, strict=True))
        return step
    return arrow_map(docs.select("doc_id", "text"), make, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, n_guess long, spans string")


def redact_text(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """The text with each maximal union of spans replaced by ``mark``."""
    out, at = [], 0
    for s, e, _ in sorted(spans):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, ranks: dict[str, int] | None = None, least: float = MIN_GUESSES) -> DataFrame:
    """``docs`` with its columns, secrets in ``text`` replaced; ``n_chars``, where there is one, is the new length. Null texts stay null."""
    ranks = dictionary(docs) if ranks is None else ranks
    lengths = lengths_of(ranks)

    def make():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            names, columns = b.schema.names, list(b.columns)
            new = []
            for t in b.column(names.index("text")).to_pylist():
                spans = base_spans(t) if t else []
                spans = spans + guess_spans(t, ranks, spans, least, lengths) if t else spans
                new.append(redact_text(t, spans) if spans else t)
            columns[names.index("text")] = pa.array(new, pa.string())
            if "n_chars" in names:
                old = b.column(names.index("n_chars"))
                columns[names.index("n_chars")] = pa.array([o if t is None else len(t) for o, t in zip(old.to_pylist(), new, strict=True)], old.type)
            return pa.RecordBatch.from_arrays(columns, schema=pa.schema([pa.field(f.name, c.type) for f, c in zip(b.schema, columns, strict=True)]))
        return step
    return arrow_map(docs, make, docs.schema)
