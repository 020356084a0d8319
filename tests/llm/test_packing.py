"""Packing: ids beyond doubles beside nulls, repeated rows, groups of documents sized by their pieces."""

from collections import Counter, defaultdict

import pytest

pytest.importorskip("tokenizers")
from evalframe.llm import packing  # noqa: E402

SCHEMA = "doc_id long, text string, grp long, key long"
BIG = 1 << 60


def make(spark, rows):
    return spark.createDataFrame([(d, t, 5, 6) for d, t in rows], SCHEMA)


def test_large_ids_beside_a_null(spark):
    rows = [(BIG + 1, "alpha beta"), (BIG + 2, "gamma delta epsilon"), (None, "zeta"), (None, None), (-BIG - 1, "eta"), (BIG + 3, "")]
    got = packing.pack(make(spark, rows), group_pieces=1000).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in rows)
    ids = {r.doc_id: r.doc_tokens for r in got}
    assert ids[BIG + 3] == 1 and ids[BIG + 2] > ids[BIG + 1] > 1


def test_equal_rows_spread_over_groups(spark):
    got = packing.pack(make(spark, [(7, "the same words again")] * 300 + [(None, "x")] * 300).repartition(3), group_pieces=20).collect()
    sizes = Counter(r.sequence_id >> 32 for r in got)
    assert len(got) == 600 and len(sizes) >= 25 and max(sizes.values()) <= 60


def test_groups_hold_whole_documents_and_are_sized_by_pieces(spark):
    rows = [(i, "word " * (400 if i % 10 == 0 else 3)) for i in range(100)]  # 10 documents of over 25 pieces
    got = packing.pack(make(spark, rows), length=16, group_pieces=40).collect()
    groups = defaultdict(set)
    for r in got:
        groups[r.doc_id].add(r.sequence_id >> 32)
    assert all(len(g) == 1 for g in groups.values())
    assert len(set.union(*groups.values())) >= 6  # over 340 pieces, though only 100 documents
    again = packing.pack(make(spark, rows), length=16, group_pieces=40).collect()
    assert sorted(got) == sorted(again)
