"""Cross-tokenizer alignment against a plain version over both libraries: odd texts, repeats, links beyond the listed pairs, long texts."""

import base64
import hashlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("tokenizers")
pytest.importorskip("sentencepiece")
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from evalframe.llm import alignment  # noqa: E402
from evalframe.llm.bpe import tokenizer_path  # noqa: E402
from evalframe.llm.common import most_frequent  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, row long, a binary, pair long, n long"
TEXTS = ["the cat sat on the mat", "the the the the", "Écoute, naïve café — “ça va” … œuvre", "  leading   runs  of\tspace \n\n and lines\n ", "日本語のテキスト 🙂🙂 mixed", "<|endoftext|> is text <s> </s> <unk> <0x41>",
         "a▁b literal mark", "x" * 3000, "word " * 900, "\u0085   odd spaces　here", "\x00\x01 control", "I'll they've don't 123456 7,890.50", " ", "\n", "é combining", "ﬁ ﬂ ligatures ½ ² ™", "▁▁ ▁"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path(alignment.BYTE_LEVEL))
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(alignment.PIECES))


def plain(texts, libraries):
    """Groups and links by sets of offsets, without any of the operator's code."""
    t, sp = libraries
    with open(tokenizer_path(alignment.RANKS), "rb") as f:
        table = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    docs = []
    for text in texts:
        docs.append(([], [], ""))
        if not text:
            continue
        x, y = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
        xb = [table[i] for i in x]
        yb = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if b"".join(xb) != (" " + text).encode() or b"".join(yb) != (" " + text).encode():
            continue
        spans = []
        for parts in (xb, yb):
            at, own = 0, []
            for p in parts:
                own.append((at, at + len(p)))
                at += len(p)
            spans.append(own)
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        ga, gb, low = [], [], 0
        for c in cuts:
            ga.append([i for i, (s, e) in zip(x, spans[0], strict=True) if low <= s and e <= c])
            gb.append([i for i, (s, e) in zip(y, spans[1], strict=True) if low <= s and e <= c])
            low = c
        pairs = []
        j0 = 0
        for i, (s, e) in enumerate(spans[0]):
            while spans[1][j0][1] <= s:
                j0 += 1
            j = j0
            while j < len(y) and spans[1][j][0] < e:
                pairs.append((x[i], y[j]))
                j += 1
        docs[-1] = (x, y, ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in zip(ga, gb, strict=True)), pairs, len(cuts))
    counts = Counter(p for d in docs if d[0] for p in set(d[3]))
    top = {}
    for (a, _), n in counts.items():
        top[a] = max(n, top.get(a, 0))
    return [(len(d[0]), len(d[1]), d[4], len(d[3]), sum(counts[p] == top[p[0]] for p in d[3]), sum(counts[p] for p in d[3]), hashlib.sha256(d[2].encode()).hexdigest())
            if d[0] else (0, 0, 0, 0, 0, 0, "") for d in docs]


def rows_of(df):
    cols = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=lambda r: (r[0] is None, r[0], r[1:]))


@pytest.mark.parametrize("listed", [1 << 19, 3, 0])
def test_equals_the_plain_version(spark, libraries, listed):
    texts = [*TEXTS, None, "", *TEXTS[:4], TEXTS[0]]
    ids = [*range(len(texts) - 2), None, 0]
    want = sorted(((i, *r) for i, r in zip(ids, plain(texts, libraries), strict=True)), key=lambda r: (r[0] is None, r[0], r[1:]))
    docs = spark.createDataFrame([(i, t, "en", 5, b"x", 6, 7) for i, t in zip(ids, texts, strict=True)], SCHEMA).repartition(3)
    assert rows_of(alignment.compare(docs, listed=listed)) == want


def test_empty_table(spark):
    df = alignment.compare(spark.createDataFrame([], SCHEMA))
    assert df.count() == 0
    assert [c for c, _ in df.dtypes] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_partial_counts_are_merged(spark):
    docs = spark.createDataFrame([(i, t, "en", 5, b"x", 6, 7) for i, t in enumerate(TEXTS * 3)], SCHEMA).coalesce(1)
    size = alignment.sides(alignment.BYTE_LEVEL, alignment.RANKS, alignment.PIECES)[1].size
    few, whole = (alignment.pair_counts(alignment.align(docs, held=held)[1], size).orderBy("pair").collect() for held in (8, 1 << 22))
    assert few == whole
    assert min(r.n for r in few) == 3


@settings(max_examples=200, deadline=None)
@given(st.lists(st.booleans(), max_size=60), st.lists(st.booleans(), max_size=60))
def test_shared_cuts_are_the_common_ends(x, y):
    n = max(len(x), len(y)) + 1
    ea, eb = (np.array([i + 1 for i, on in enumerate(s) if on and i + 1 < n] + [n]) for s in (x, y))
    want = [i for i, e in enumerate(ea.tolist()) if e in set(eb.tolist())]
    assert alignment.shared_cuts(ea, eb, np.array([0, len(ea)])).tolist() == want
    # Many documents at once: level by level, and the rest one by one.
    k = 40
    many_a, many_b = (np.concatenate([e + n * d for d in range(k)]) for e in (ea, eb))
    got = alignment.shared_cuts(many_a, many_b, np.arange(k + 1) * len(ea)).tolist()
    assert got == [i + d * len(ea) for d in range(k) for i in want]


def test_long_stretches_without_a_cut():
    ea = np.append(np.arange(1, 200_000, 2), 200_000)
    eb = np.append(np.arange(2, 200_000, 2), 200_000)
    assert alignment.shared_cuts(ea, eb, np.array([0, len(ea)])).tolist() == [len(ea) - 1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["word", " ", "  ", "\n", "é", "▁", "'s", "1", ".", "　", "日本", "x" * 9, "\t "]), max_size=40).map("".join))
def test_stretches_do_not_change_ids(libraries, text):
    a, b = alignment.sides(alignment.BYTE_LEVEL, alignment.RANKS, alignment.PIECES)
    t, sp = libraries
    parts = alignment.stretches(" " + text, 3)
    assert "".join(parts) == " " + text
    assert a.whole(parts) == t.encode(" " + text, add_special_tokens=False).ids
    if text:
        assert b.whole(parts) == sp.encode(text)


def test_both_byte_level_libraries_class_plain_characters_alike(libraries):
    a, _ = alignment.sides(alignment.BYTE_LEVEL, alignment.RANKS, alignment.PIECES)
    assert a.fast is not None
    chars = [c for c in map(chr, range(0x3000)) if alignment._PLAIN.fullmatch(c)]
    assert len(chars) > 500
    for c in chars:
        text = f" a{c}b {c}{c} 1{c}2 .{c}. {c}\n {c} \t{c}s'{c}"
        assert a.fast.encode_ordinary(text) == libraries[0].encode(text, add_special_tokens=False).ids, hex(ord(c))


def test_most_frequent_cuts_equal_counts(spark):
    flat = spark.range(21_000).selectExpr("cast(id as string) as word", "1L as n")
    for limit in (0, 1, 777, 20_000, 21_000, 30_000):
        got = most_frequent(flat, limit)
        assert got.count() == min(limit, 21_000)
    mixed = flat.unionByName(spark.range(50).selectExpr("concat('w', id) as word", "id + 100 as n"))
    got = {r.word for r in most_frequent(mixed, 60).collect()}
    assert len(got) == 60 and {f"w{i}" for i in range(50)} <= got
