"""A corpus pipeline: quality, exact and near copies, source mix, sampled segmentations.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as
the next stage's docs; all but the last return the columns of documents. Stages keep what their
operators' docstrings say for nulls, empty texts, repeated rows and empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidentia.llm import exact_dedup, mixing, partenum, pieces, quality_model
from evidentia.llm.common import materialise, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of these documents, accepts."""
    return quality_model.accepted(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal up to white space, the one with the smallest id."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by shingle similarity, the one with the smallest id."""
    return partenum.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's share asks for; those past its budget are left out."""
    return mixing.mixed_rows(docs)


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations as token ids; a document that the mix repeats has them once for each row."""
    return pieces.encode(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("segment", segment)]

#: No SQL for the classifier, the signatures and the sampled segmentations; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
