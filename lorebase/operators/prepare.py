"""Preparation: raw (path, markdown) rows to typed documents and sections in one pass of Python workers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConceptError
from ..functions import frontmatter, paths, sections

DIAGNOSTIC = "struct<code:string,message:string,path:string,field:string>"
WINDOW = "struct<from:string,to:string>"
FIELDS = (
    "type string, title string, description string, resource string, tags array<string>, "
    f"sources array<struct<resource:string,id:string,title:string,author:string,usage_count:double,last_modified:string,usage_window:{WINDOW}>>, source_text string, usage_window {WINDOW}, "
    "generated struct<by:string,at:string>, verified array<struct<by:string,at:string>>, trust_tier string, status string, stale_after string, stale_after_epoch long, staleness_classified boolean, "
    "runtime string, parameters array<struct<name:string,type:string,required:boolean>>, computation string, executor struct<resource:string,receipt:array<string>>, attester struct<resource:string>, extensions string"
)
SECTION = "struct<section_id:string,heading_path:string,text:string,start_line:int,end_line:int>"
PREPARED = f"path string, document_id string, outcome string, conformance string, diagnostics array<{DIAGNOSTIC}>, body string, {FIELDS}, sections array<{SECTION}>"


def prepare_one(path: str, markdown: str, with_sections: bool = True) -> dict:
    """One document; path must be normalised. outcome is accepted or fatal."""
    identity = paths.document_id(path)
    fields, wrong, body, line = frontmatter.parse(markdown, path, paths.fallback_title(identity))
    out = {"path": path, "document_id": identity, "outcome": "fatal" if fields is None else "accepted", "conformance": None, "diagnostics": wrong, "body": body, "sections": None}
    if fields is not None:
        out |= fields | {"conformance": "degraded" if wrong else "strict"}
        if with_sections:
            out["sections"] = sections.sections(identity, fields["title"], body, line)
    return out


def _columns() -> list[str]:
    from pyspark.sql.types import _parse_datatype_string

    return [f.name for f in _parse_datatype_string(PREPARED).fields]


def _run(documents: DataFrame, with_sections: bool) -> DataFrame:
    names = _columns()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [prepare_one(p, m, with_sections) for p, m in zip(batch["path"], batch["markdown"], strict=True)]
            yield pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})

    return documents.select("path", "markdown").mapInPandas(run, PREPARED)


def normalized(documents: DataFrame) -> DataFrame:
    """(path, markdown, error_path) with normalised paths; error_path is set for those that cannot be."""
    return documents.select(paths.normalized(F.col("path")).alias("n"), "markdown").select("n.path", "markdown", "n.error_path")


def prepare(documents: DataFrame) -> DataFrame:
    """Rows of PREPARED for (path, markdown) rows with normalised paths; fatal documents keep their diagnostics only."""
    return _run(documents, True)


def validate(documents: DataFrame) -> DataFrame:
    """(path, is_valid, is_indexable, errors) of every (path, markdown) row; sections are not built."""
    rows = normalized(documents)
    bad = rows.where("error_path is not null").select(
        F.col("error_path").alias("path"), F.lit(False).alias("is_valid"), F.lit(False).alias("is_indexable"),
        F.array(F.struct(F.lit("ERR_FIELD").alias("code"), F.concat(F.lit("Invalid concept field: "), "error_path", F.lit(" (path)")).alias("message"), F.col("error_path").alias("path"), F.lit("path").alias("field"))).alias("errors"),
    )
    good = _run(rows.where("error_path is null"), False).select("path", (F.col("conformance") == "strict").alias("strict"), (F.col("outcome") == "accepted").alias("is_indexable"), "diagnostics")
    return good.select("path", F.coalesce("strict", F.lit(False)).alias("is_valid"), "is_indexable", F.col("diagnostics").alias("errors")).unionByName(bad)


def first_failure(documents: DataFrame, prepared: DataFrame) -> ConceptError | None:
    """The error that opening these documents raises: bad paths, then repeated identities, then the first fatal one.

    documents: normalized() rows; prepared: prepare() of the good ones. Each check fetches one row.
    """
    bad = documents.where("error_path is not null").orderBy("error_path").limit(1).collect()
    if bad:
        return ConceptError("ERR_FIELD", bad[0].error_path, "path")
    twice = documents.groupBy("path").count().where("count > 1").orderBy(paths.utf16_order(F.col("path"))).limit(1).collect()
    if twice:
        return ConceptError("ERR_FIELD", twice[0].path, "path")
    fatal = prepared.where("outcome = 'fatal'").orderBy(paths.utf16_order(F.col("path"))).select("path", F.col("diagnostics")[0].alias("d")).limit(1).collect()
    return ConceptError(fatal[0].d.code, fatal[0].path, fatal[0].d.field) if fatal else None


def split(prepared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, sections) frames of the accepted rows, as an index takes them."""
    good = prepared.where("outcome = 'accepted'")
    documents = good.select("document_id", "path", "type", "title", "tags", "status", "trust_tier", "stale_after_epoch", "staleness_classified", "conformance", "resource", "description", "source_text", "diagnostics")
    rows = good.select("document_id", F.explode("sections").alias("s"))
    return documents, rows.select("s.section_id", "document_id", "s.heading_path", "s.text", "s.start_line", "s.end_line")
