"""A training-corpus pipeline: toxicity, quality rules, near-duplicates, personal data, packing.

Each stage takes the documents that the one before it kept, written as Parquet and read again. All but
the last return the columns they were given, whatever these are called. Null texts count as empty, rows that
repeat an id or are equal are rows of their own, an empty table passes through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import packing, pii, quality, simhash, toxicity
from gridloom.llm.common import table, work_dir


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 by a model learnt from the labels of ``docs``; all where there are none."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fences of their language and source; empty texts fail."""
    return quality.passing(docs, quality.CLOSE)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id."""
    return simhash.drop_near_duplicates(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and terms that disclose it replaced in their texts."""
    return pii.sanitise(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their windows."""
    return packing.windows(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("quality", of_quality),
    ("simhash", without_near_duplicates),
    ("pii", without_personal_data),
    ("packing", packed),
]

#: No SQL expresses the stages; tests/llm/test_pipeline.py holds them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{work_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
