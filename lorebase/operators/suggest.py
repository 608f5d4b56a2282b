"""Completions: phrases of matched index terms, by their mean score over the sections that match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.options import Options
from .index import Index
from .search import matches, query_terms, scores

SUGGESTION = "suggestion string, terms array<string>, score double"


def suggest(index: Index, query: str, options: Options) -> DataFrame:
    """Rows of SUGGESTION, best first; ties by phrase."""
    spark = index.documents.sparkSession
    rows = query_terms({0: query}, options)
    if not rows or options.limit == 0:
        return spark.createDataFrame([], SUGGESTION)
    found = matches(index, rows, options)
    scored = scores(found, options)
    # terms of one query position stand in reverse alphabetical order
    words = found.select("section_id", "pos", "index_term").distinct().groupBy("section_id", "pos").agg(F.sort_array(F.collect_set("index_term"), asc=False).alias("words"))
    phrase = words.groupBy("section_id").agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "words"))), lambda s: s["words"]))).alias("terms"))
    means = scored.join(phrase, "section_id").groupBy(F.array_join("terms", " ").alias("suggestion")).agg(F.first("terms").alias("terms"), F.avg("score").alias("mean"))
    return means.select("suggestion", "terms", F.round("mean", 6).cast("double").alias("score")).orderBy(F.desc("score"), "suggestion").limit(options.limit)
