"""Corpus pipeline: quality classifier, exact deduplication, near-duplicate join, packing.

Each stage takes the documents that the one before has kept and returns those
it keeps, with the columns of ``documents``; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chartmill.llm.common import read_table, write_table
from chartmill.llm.exact_dedup import drop_copies
from chartmill.llm.jaccard_join import drop_near_copies
from chartmill.llm.packing import pack_documents
from chartmill.llm.quality import accepted, fit, labelled_rows


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fitted on labelled rows outside the held-out fold, does not reject."""
    return accepted(docs, fit(labelled_rows(docs, read_table(spark, sf_dir, "labels"))))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal up to blanks the longest stays, then the one with the smallest id."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that links of similarity 0.8 or more on five-word shingles connect, the one with the smallest id stays."""
    return drop_near_copies(docs, width=5, num=80, den=100)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return pack_documents(docs)


STAGES = [("quality classifier", quality_classifier), ("exact dedup", exact_dedup), ("n-gram Jaccard join", near_dedup), ("best-fit packing", packing)]
# the classifier is fitted, which SQL can't express; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``; each reads the table that the one before has written."""
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = write_table(docs, f"stage-{number}")
    return docs
