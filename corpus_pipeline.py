"""Training-data pipeline over ``documents``: each stage works on what its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. Stages but the last are written to the shared checkpoint folder and read
again, so a lost executor repeats one stage at most. Labels join only by doc_id; an empty
table passes through every stage; null texts fail the quality rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.llm import packing, quality_classifier, quality_rules, secrets, simhash
from evalframe.llm.common import remainder, stored, table


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the isolation forest."""
    return quality_rules.keep_documents(docs, table(spark, sf_dir, "labels"))


def keep_by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as good. It learns from all of ``documents``: what the rules kept has hardly a bad one left."""
    return quality_classifier.keep_documents(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 5) == 0, learn_from=table(spark, sf_dir, "documents"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates."""
    return simhash.keep_first(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets replaced."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2,048 ids."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", keep_by_rules),
    ("quality classifier", keep_by_classifier),
    ("simhash near-dedup", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("packing", pack),
]

#: Models learned from the data cannot be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
