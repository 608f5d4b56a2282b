"""The corpus pipeline over documents: quality rules, language, near duplicates, mixture, packing.

STAGES lists (name, function). Each function takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents. A stage
deletes the intermediate tables of the stage before, so its result must be written by then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.llm import language_id, mixing, near_duplicates, packing, quality
from lorebase.llm._spark import load, saved, swept


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules, without the lines that many texts of their source share, if enough is left."""
    with swept(spark):
        return quality.cleaned(docs).withColumn("n_chars", F.length("text").cast("long"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter whose language is their lang, or whose prediction against it is not sure."""
    with swept(spark):
        return language_id.accepted(docs)


def near_duplicate_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id."""
    with swept(spark):
        return near_duplicates.deduplicated(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of documents whose token shares follow tempered shares of source, language and topic."""
    with swept(spark):
        return mixing.sampled(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    with swept(spark):
        return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("language_id", language), ("ngram_jaccard_join", near_duplicate_join), ("mixing", mixture), ("best_fit_packing", packed)]

#: Suffix automata, raking and tokenisation have no SQL form; tests/llm/test_pipeline.py checks the stages instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through every stage."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
