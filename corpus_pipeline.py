"""A corpus pipeline: quality, toxicity, near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs. An empty table
passes through every stage; null and empty texts and repeated rows are rows like others, unless a stage says so; texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import decontaminate, ngram_join, packing, quality, toxicity
from quillspark.llm.common import discard, table, written


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Without labels none go; an empty text is scored like any; columns stay."""
    return quality.keep_good(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go. Without labels of both kinds none go; an empty text has the intercept's score; columns stay."""
    return toxicity.keep_clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, a Jaccard similarity of 0.8 or more.

    The smallest doc_id stays, a null one last; documents without words stay; rows that share a doc_id but not the text are judged apart; columns stay.
    """
    return ngram_join.keep_one(docs)


def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark text go. Without benchmark items none go; short items count where they stand as a whole; columns stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets a bucket, a batch and a place; repeated rows and ties get places of their own; texts and other columns are left out."""
    return packing.pack(docs)


STAGES = [("quality_classifier", good), ("toxicity", clean), ("ngram_jaccard_join", distinct), ("benchmark_decontamination", unleaked), ("packing", packed)]

#: SQL can't express the classifiers; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, before = written(stage(spark, docs, sf_dir), name), docs
        discard(before)
    return docs
