"""BPE encoding and decoding with tree concatenation (operator 2).

The tokenizer file is one of the ``tokenizers`` library: normaliser, pre-tokeniser
and a BPE model whose last symbol of a pre-token may carry a word-end suffix.
White space never becomes part of a token and none of the added tokens holds any,
so a text's ids are the ids of its ASCII-white-space words one after another:
words are encoded once per task and kept in a bounded cache.

Unsplit text longer than a leaf (a single run without white space) is normalised
and pre-tokenised, and each pre-token that is still longer than a leaf is cut into
halves, the halves into halves, down to leaves. Leaves are rows that Spark deals
out to all tasks; fragments that do not end their pre-token are encoded by the same
merges without the word-end suffix. The tree is then folded up again: around each
join a window of tokens is re-encoded and doubled until its first token equals the
left side's token there and its last token the right side's. BPE encodings are
exactly the sequences all of whose neighbouring pairs are encodings of their own
texts, so one agreeing token on either side makes the spliced sequence exact.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch, texts_of

TOKENIZER = "word_bpe_49k.json"
LEAF_CHARS = 16_384
CACHE_WORDS = 200_000


def tokenizer_path(name: str) -> str:
    """A file path as it is, or the name of one of the public tokenizer files of the machine that asks."""
    if "/" in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


def load(name: str):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path(name))
    t.no_padding()
    t.no_truncation()
    return t


class WordEncoder:
    """Ids of whole texts, word by word, with a bounded cache of words. Ids are bytes of little-endian uint32.

    The cache has two generations: when the young one is full it becomes the old one, so words in
    use are kept and the rest is forgotten.
    """

    def __init__(self, name: str = TOKENIZER, cache_words: int = CACHE_WORDS):
        self.tok = load(name)
        self.young, self.old, self.limit = {}, {}, cache_words
        self.model, self.special = self.tok.model, [t.content for t in self.tok.get_added_tokens_decoder().values()]
        ab, a, b = (self._library(x) for x in (" ab, \n c", "ab,", "c"))
        if ab != a + b or self._library(" "):
            raise ValueError(f"{name}: white space is part of its tokens; words can't be encoded apart")
        # Latin-1 texts are their own normal form but for case and white space, which one byte table settles.
        lower = bytes(ord(c.lower()) if len(c.lower().encode("latin-1", "ignore")) == 1 else ord(c) for c in map(chr, range(256)))
        self.table = bytes(32 if chr(i).isspace() and not 0x1c <= i <= 0x1f else lower[i] for i in range(256))
        self.letters = bytes(i for i in range(256) if chr(i).isalpha() and lower[i] == i)
        # A full stop or comma between a letter and white space is a pre-token of its own.
        self.mark = re.compile(b"(?<=[" + self.letters + b"])([.,])(?= )")
        # byte -> pre-tokeniser character, for the bytes that Latin letters beyond ASCII have in UTF-8
        self.chars = {i: c for x in map(chr, range(0xaa, 0x100)) if x.isalpha()
                      for i, c in zip(x.encode(), self.tok.pre_tokenizer.pre_tokenize_str(x)[0][0], strict=True)}

    def _library(self, word: str) -> bytes:
        return array("I", self.tok.encode(word, add_special_tokens=False).ids).tobytes()

    def _model(self, token: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(token)]).tobytes()

    def _steps(self, text: str) -> bytes:
        """The library's own steps one by one, without its cost for a call; no added token in ``text``."""
        norm = self.tok.normalizer.normalize_str(text) if self.tok.normalizer else text
        return b"".join([self._model(t) for t, _ in self.tok.pre_tokenizer.pre_tokenize_str(norm)])

    def _latin(self, w: bytes) -> bytes:
        """Ids of a word in lower-case Latin-1."""
        ids = self.old.get(w)
        if ids is None:
            if w.isalpha():
                ids = self._model(w.decode())
            elif not w.translate(None, self.letters):
                ids = self._model(w.decode("latin-1").encode().decode("latin-1").translate(self.chars))
            else:
                ids = self._steps(w.decode("latin-1"))
        if len(w) <= 64:
            self.young[w] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return b"".join([self._library(w) for w in re.split(r"[\x20\x09-\x0D]+", text) if w])
        try:
            flat = text.encode("latin-1").translate(self.table)
        except UnicodeEncodeError:
            flat = None
        if flat is None:
            return b"".join([self._any(w) for w in text.encode("utf-8", "surrogatepass").split()])
        words = self.mark.sub(rb" \1", flat).split()
        if len(self.young) + len(words) > self.limit:
            self.old, self.young = self.young, {}
        get, word = self.young.get, self._latin
        return b"".join([get(w) or word(w) for w in words])

    def _any(self, w: bytes) -> bytes:
        """Ids of a word of any text, in UTF-8 and as it stands."""
        key = b"\x00" + w  # apart from the Latin-1 words
        ids = self.young.get(key) or self.old.get(key)
        if ids is None:
            ids = self._steps(w.decode("utf-8", "surrogatepass"))
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        if len(w) <= 64:
            self.young[key] = ids
        return ids


class TreeJoin:
    """Fragments of one pre-token: encoding without the word end, and exact concatenation."""

    def __init__(self, name: str = TOKENIZER, window: int = 4):
        from tokenizers import Tokenizer
        spec = json.loads(open(tokenizer_path(name), encoding="utf-8").read())
        spec |= {"normalizer": None, "pre_tokenizer": None, "added_tokens": [], "truncation": None, "padding": None}
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.whole = Tokenizer.from_str(json.dumps(spec))
        spec["model"]["end_of_word_suffix"] = None
        self.inner = Tokenizer.from_str(json.dumps(spec))
        self.window = window

    def encode(self, fragment: str, last: bool) -> list[int]:
        """Ids of a fragment in pre-tokeniser characters; ``last``: it ends its pre-token."""
        return (self.whole if last else self.inner).encode(fragment, add_special_tokens=False).ids

    def _text(self, ids: list[int], last: bool) -> str:
        text = "".join(map(self.whole.id_to_token, ids))
        return text[:-len(self.suffix)] if last and self.suffix and text.endswith(self.suffix) else text

    def join(self, left: list[int], right: list[int], last: bool) -> list[int]:
        """Ids of the two neighbouring fragments as one; ``last``: the right one ends the pre-token."""
        w = self.window
        while True:
            a, b = left[-w:], right[:w]
            end = last and len(b) == len(right)
            got = self.encode(self._text(a + b, end), end)
            if (len(a) == len(left) or got[0] == a[0]) and (len(b) == len(right) or got[-1] == b[-1]):
                return left[:len(left) - len(a)] + got + right[len(b):]
            w *= 2

    def fold(self, parts: list[list[int]], last: bool = True) -> list[int]:
        """Join neighbours pairwise, level by level, up to the root."""
        while len(parts) > 1:
            ends = [last and i + 2 >= len(parts) for i in range(0, len(parts), 2)]
            parts = [self.join(parts[i], parts[i + 1], ends[i // 2]) if i + 1 < len(parts) else parts[i]
                     for i in range(0, len(parts), 2)]
        return parts[0] if parts else []


@functools.cache
def word_encoder(name: str) -> WordEncoder:
    return WordEncoder(name)


@functools.cache
def tree_join(name: str) -> TreeJoin:
    return TreeJoin(name)


def halves(text: str, leaf: int) -> list[str]:
    """Leaves of the halving tree, from left to right."""
    if len(text) <= leaf:
        return [text]
    mid = len(text) // 2
    return halves(text[:mid], leaf) + halves(text[mid:], leaf)


def cut(text: str, name: str = TOKENIZER, leaf: int = LEAF_CHARS) -> list[tuple[str, str]]:
    """A text as segments (kind, text) that can be encoded apart.

    ``text``: words, complete. ``tokens``: whole pre-tokens, space-joined. ``part`` and ``end``: a
    fragment within a pre-token and the one that ends it. ``special``: an added token.
    """
    enc = word_encoder(name)
    out: list[tuple[str, str]] = []
    held: list[str] = []
    size = 0

    def flush(kind: str) -> None:
        nonlocal size
        if held:
            out.append((kind, " ".join(held)))
        held.clear()
        size = 0

    added = sorted((t.content for t in enc.tok.get_added_tokens_decoder().values()), key=len, reverse=True)
    special = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
    for word in re.split(r"[\x20\x09-\x0D]+", text):
        if not word:
            continue
        if len(word) <= leaf:
            if size + len(word) > leaf:
                flush("text")
            held.append(word)
            size += len(word) + 1
            continue
        flush("text")
        for i, piece in enumerate(special.split(word) if special else [word]):
            if i % 2:
                flush("tokens")
                out.append(("special", piece))
                continue
            norm = enc.tok.normalizer.normalize_str(piece) if enc.tok.normalizer else piece
            for token, _ in enc.tok.pre_tokenizer.pre_tokenize_str(norm):
                if len(token) <= leaf:
                    if size + len(token) > leaf:
                        flush("tokens")
                    held.append(token)
                    size += len(token) + 1
                else:
                    flush("tokens")
                    leaves = halves(token, leaf)
                    out.extend(("part", x) for x in leaves[:-1])
                    out.append(("end", leaves[-1]))
        flush("tokens")
    flush("text")
    return out


def encode_segment(kind: str, text: str, name: str = TOKENIZER) -> bytes:
    """Ids (little-endian uint32 bytes) of a segment that ``cut`` made."""
    if kind == "text":
        return word_encoder(name).encode(text)
    if kind == "special":
        return np.asarray([word_encoder(name).tok.token_to_id(text)], "<u4").tobytes()
    tree = tree_join(name)
    if kind == "tokens":
        return b"".join(np.asarray(tree.encode(t, True), "<u4").tobytes() for t in text.split(" "))
    return np.asarray(tree.encode(text, kind == "end"), "<u4").tobytes()


def concatenate(kinds: list[str], ids: list[bytes], name: str = TOKENIZER) -> bytes:
    """Ids of the whole text from its segments' ids, in order."""
    out: list[bytes] = []
    run: list[list[int]] = []
    for kind, x in zip(kinds, ids, strict=True):
        if kind in ("part", "end"):
            run.append(np.frombuffer(x, "<u4").tolist())
            if kind == "end":
                out.append(np.asarray(tree_join(name).fold(run), "<u4").tobytes())
                run = []
        else:
            out.append(x)
    return b"".join(out)


def decode(ids: bytes, name: str = TOKENIZER) -> str:
    return word_encoder(name).tok.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])


def encode_documents(docs: DataFrame, name: str = TOKENIZER, leaf: int = LEAF_CHARS, finish=None, schema: pa.Schema = ENCODED,
                     ddl: str = "doc_id long, ids binary, decoded string") -> DataFrame:
    """Ids and decoded text of every row of ``docs`` (doc_id, text; other columns are not read).

    One row per input row. Null text counts as empty (no ids, empty decoded text); a null doc_id
    is kept; repeated rows give repeated results; an empty table gives none. ``finish`` may turn
    (ids, decoded text) into other columns inside the task, so that whole ids need not leave it.
    """
    finish = finish or (lambda ids, text: (ids, text))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    long = F.length("text") > leaf

    def short_step():
        enc = word_encoder(name)

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            got = []
            for t in texts_of(b):
                ids = enc.encode(t)
                got.append(finish(ids, decode(ids, name)))
            return batch(schema, b.column(0), *([g[i] for g in got] for i in range(len(schema) - 1)))
        return step

    def cut_step():
        out_schema = pa.schema([("doc_id", pa.int64()), ("whole", pa.string()), ("seg", pa.int32()), ("kind", pa.string()), ("text", pa.string())])

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            got = []
            for d, t in zip(b.column(0).to_pylist(), texts_of(b), strict=True):
                key = hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()
                got += [(d, key, i, k, s) for i, (k, s) in enumerate(cut(t, name, leaf) or [("text", "")])]
            return batch(out_schema, *zip(*got, strict=True))
        return step

    def leaf_step():
        out_schema = pa.schema([("doc_id", pa.int64()), ("whole", pa.string()), ("seg", pa.int32()), ("kind", pa.string()), ("ids", pa.binary())])

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            ids = [encode_segment(k, t, name) for k, t in zip(b.column(3).to_pylist(), texts_of(b), strict=True)]
            return batch(out_schema, *b.columns[:4], ids)
        return step

    def up(g: pd.DataFrame) -> pd.DataFrame:
        # Repeated rows give each segment several times, all alike: join one set, answer for each.
        g = g.sort_values("seg", kind="stable")
        copies = int((g.seg == g.seg.iloc[0]).sum())
        one = g.iloc[::copies]
        ids = concatenate(one.kind.tolist(), one.ids.tolist(), name)
        doc = g.doc_id.iloc[0]
        row = (None if pd.isna(doc) else int(doc), *finish(ids, decode(ids, name)))
        out = pd.DataFrame([row] * copies, columns=schema.names)
        return out.astype({"doc_id": "Int64"})

    short = arrow_map(rows.filter(~long), short_step, ddl)
    leaves = arrow_map(rows.filter(long), cut_step, "doc_id long, whole string, seg int, kind string, text string")
    parts = arrow_map(leaves.repartition(F.col("whole"), F.col("seg")), leaf_step, "doc_id long, whole string, seg int, kind string, ids binary")
    return short.unionByName(parts.groupBy("doc_id", "whole").applyInPandas(up, ddl))


def digests(docs: DataFrame, name: str = TOKENIZER, leaf: int = LEAF_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    def finish(ids: bytes, text: str) -> tuple:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return encode_documents(docs, name, leaf, finish, schema, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
