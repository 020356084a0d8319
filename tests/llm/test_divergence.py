"""Source divergence audit against a plain Python version: nulls, no terms, ties, repeats, spills, counts beyond 64 bits."""

import re
from collections import Counter

import numpy as np
import pytest

from evalframe.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term binary, value long, stripe string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def plain(rows, min_docs, top):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(UPPER))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for _, _, ts in own for t in set(ts))
        kept = [t for t, n in df.items() if n >= min_docs]
        counts = {s: Counter() for s in {d[1] for d in own}}
        for _, s, ts in own:
            counts[s].update(t for t in ts if df[t] >= min_docs)
        v = len(kept)

        def shares(c):
            n = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * v) for t in kept}  # noqa: B023

        p, q = {s: shares(c) for s, c in counts.items()}, shares(sum(counts.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in p:
            pair = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in p if o != s]
            term = [(f(p[s][t], q[t]), t) for t in kept if counts[s][t] > 0 and p[s][t] > q[t]]
            for part, items, limit in (("pair", pair, None), ("term", term, top)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(items[:limit])]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def make(spark, rows):
    return spark.createDataFrame([(i, t, la, s, b"x", 7, "y") for i, (t, la, s) in enumerate(rows)], SCHEMA)


def sample(n=240):
    rng = np.random.default_rng(5)
    words = ["The", "the", "of", "Été", "été", "naïve", "x1y", "STRASSE", "日本", "a-b", "ÀB", "k", "Kelvin", "İ", "zz", "q", "w", "e", "r", "t", "rare"]
    rows = []
    for i in range(n):
        k = int(rng.integers(0, 12))
        part = words[: 8 + i % 13]
        rows.append((" ".join(rng.choice(part, k)), ["en", "fr", None][i % 3], None if i % 11 == 0 else f"s{rng.integers(0, 5) if i % 2 else 0}"))
    rows += [(None, "en", "s1"), ("", "de", "only"), ("12 34 @[`{", "en", "none"), (None, None, None), ("", "", ""), ("the " * 4000, "en", "long")]
    return rows + rows[:5] * 3


@pytest.mark.parametrize(("min_docs", "top", "spill"), [(10, 10, 600_000), (2, 3, 5), (10_000, 10, 40)])
def test_equals_the_plain_version(spark, min_docs, top, spill):
    rows = sample()
    want = plain(rows, min_docs, top)
    assert result(divergence.audit(make(spark, rows).repartition(5), min_docs, top, spill)) == want
    assert result(divergence.audit(make(spark, rows).coalesce(1), min_docs, top, spill)) == want


def test_empty_table(spark):
    df = divergence.audit(make(spark, sample(0)).limit(0))
    assert df.count() == 0
    assert df.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]


def test_shares_beyond_64_bits():
    n = np.array([0, 5, 3 * 10**10, 7 * 10**12], np.int64)
    assert divergence.share(n, 9 * 10**12).tolist() == [1 + 10**9 * (int(x) + 2) // (9 * 10**12) for x in n]


def test_cells_do_not_grow_with_the_documents_of_a_partition(spark):
    docs = make(spark, [("one two three", "en", "hot")] * 3000).coalesce(1)
    assert divergence.stripes(docs).count() == 4  # three terms and the group's mark


def test_blocks_of_stripes(monkeypatch, spark):
    rows = sample()
    want = plain(rows, 2, 4)
    monkeypatch.setattr(divergence, "BLOCK", 7)
    langs_of = divergence.Audit  # blocks are cut in this process too
    stripes = [(b"a", {0: 3, 1: 1}), (b"b", {1: 2}), (b"c", {0: 1, 2: 5})]
    lang = divergence.Language([("x", 4), ("y", 3), ("z", 5)], 3)
    whole, parts = langs_of(lang, 2), langs_of(lang, 2)
    flat = lambda ss: ([t for t, _ in ss], np.cumsum([len(c) for _, c in ss]), np.array([s for _, c in ss for s in c]), np.array([n for _, c in ss for n in c.values()]))
    whole.add(*flat(stripes))
    for one in stripes:
        parts.add(*flat([one]))
    assert list(whole.results()) == list(parts.results())
    assert result(divergence.audit(make(spark, rows), 2, 4)) == want
