"""The pipeline and the registered queries on the smallest fixture."""

import os

import duckdb
import pytest

pytest.importorskip("tokenizers")
import corpus_pipeline  # noqa: E402
from evalframe.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="fixture tables not found")


def test_stages_and_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "quality classifier", "simhash near-dedup", "secret scans", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.withColumn("score", docs.doc_id), SF)
        assert out.columns == [*docs.columns, "score"], name
        assert out.dtypes[:-1] == docs.dtypes
        docs = out.drop("score").checkpoint()
    assert 0 < docs.count() <= 200


def test_run_equals_the_operators_one_by_one(spark):
    from pyspark.sql import functions as F
    from evalframe.llm import packing, quality_classifier, quality_rules, secrets, simhash
    from evalframe.llm.common import remainder
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in quality_rules.judge(docs, labels).filter("kept").collect()}
    good = {r.doc_id for r in quality_classifier.classify(docs, labels, remainder(F.col("doc_id"), 5) == 0).filter("predicted = 1").collect()}
    left = docs.filter(F.col("doc_id").isin(sorted(kept & good)))
    first = {r.component_id for r in simhash.near_duplicates(left).collect()}
    want = packing.pack(secrets.redact(left.filter(F.col("doc_id").isin(sorted(first)))))
    key = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    assert sorted(tuple(r[k] for k in key) for r in corpus_pipeline.run(spark, SF).collect()) == sorted(tuple(r[k] for k in key) for r in want.collect())


def test_empty_table_passes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize(("name", "table"), [("op4_topk", "embeddings"), ("op11_ngram_join", "documents"), ("op12_divergence", "documents")])
def test_oracles(spark, name, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    cur = con.execute(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, SF).select(*[d[0] for d in cur.description])
    assert sorted(map(tuple, got.collect())) == sorted(cur.fetchall())
