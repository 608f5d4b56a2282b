"""Counts over documents: totals, types, statuses, trust tiers, degraded documents.

An index keeps its inventory: (kind, value, n), how many documents have each value of the columns KINDS, nulls included.
Changes are rows with signs, and what rows add up to is the inventory after them, so counts never read documents.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import utf16_order

KINDS = ("type", "status", "trust_tier", "conformance")
INVENTORY = "kind string, value string, n long"
STATUSES = {"draft": "draft", "stable": "stable", "deprecated": "deprecated"}
TIERS = {"unverified": "unverified", "machine_confirmed": "machine-confirmed", "human_reviewed": "human-reviewed"}


def inventory(documents: DataFrame) -> DataFrame:
    """Rows of INVENTORY of documents."""
    values = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in KINDS])
    return documents.select(F.explode(values).alias("x")).groupBy("x.kind", "x.value").agg(F.count(F.lit(1)).alias("n"))


def minus(rows: DataFrame) -> DataFrame:
    """Rows of INVENTORY of documents that are no longer there."""
    return rows.select("kind", "value", (-F.col("n")).alias("n"))


def added(rows: DataFrame) -> DataFrame:
    """The inventory that rows of INVENTORY add up to."""
    return rows.groupBy("kind", "value").agg(F.sum("n").alias("n")).where("n <> 0")


def summary(rows: Iterable) -> dict:
    """documents, types, statuses and trust_tiers of an inventory's rows, as the frames below have them."""
    held: dict[str, dict] = {k: {} for k in KINDS}
    for kind, value, n in rows:
        held[kind][value] = n
    counts = lambda kind, names: {name: held[kind].get(value, 0) for name, value in names.items()} | {"unclassified": held[kind].get(None, 0)}
    known = sorted((t for t in held["type"] if t is not None), key=str.encode)
    return {
        "documents": {"total": sum(held["conformance"].values()), "strict": held["conformance"].get("strict", 0), "degraded": held["conformance"].get("degraded", 0)},
        "types": [{"type": t, "document_count": held["type"][t]} for t in [*[None] * (None in held["type"]), *known]],
        "statuses": counts("status", STATUSES), "trust_tiers": counts("trust_tier", TIERS),
    }


def totals(documents: DataFrame) -> DataFrame:
    """One row: total, strict, degraded."""
    return documents.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("conformance") == "strict").alias("strict"), F.count_if(F.col("conformance") == "degraded").alias("degraded"))


def types(documents: DataFrame) -> DataFrame:
    """(type, document_count), by type."""
    return documents.groupBy("type").agg(F.count(F.lit(1)).alias("document_count")).orderBy("type")


def _buckets(documents: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    counts = [F.count_if(F.col(column) == value).alias(name) for name, value in names.items()]
    return documents.agg(*counts, F.count_if(F.col(column).isNull()).alias("unclassified"))


def statuses(documents: DataFrame) -> DataFrame:
    """One row: draft, stable, deprecated, unclassified."""
    return _buckets(documents, "status", STATUSES)


def trust_tiers(documents: DataFrame) -> DataFrame:
    """One row: unverified, machine_confirmed, human_reviewed, unclassified."""
    return _buckets(documents, "trust_tier", TIERS)


def degraded(documents: DataFrame) -> DataFrame:
    """Documents with diagnostics, by path in UTF-16 order."""
    columns = ["document_id", "path"] + (["diagnostics"] if "diagnostics" in documents.columns else [])
    return documents.where("conformance = 'degraded'").orderBy(utf16_order(F.col("path"))).select(*columns)
