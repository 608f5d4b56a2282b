"""Sources of raw concept documents: a directory tree, rows of bytes, rows of text, a list in memory."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConceptError
from ..functions.paths import RESERVED, is_document
from . import shared

RAW = "path string, markdown string"


def _listed(root: str, below: str) -> Iterator[tuple[str, str]]:
    """(path, kind) of what a folder holds that is of interest: folder, document, or error."""
    try:
        entries = list(os.scandir(os.path.join(root, below)))
    except OSError:
        yield below or root, "error"
        return
    for entry in entries:
        name = f"{below}/{entry.name}" if below else entry.name
        try:
            name.encode()
        except UnicodeEncodeError:
            yield ascii(name), "error"
            continue
        if entry.is_dir(follow_symlinks=False):
            yield name, "folder"
        elif entry.is_file(follow_symlinks=False) and is_document(entry.name):
            yield name, "document"


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(path, kind) of the concept documents below a folder that all executors share, and of errors.

    Executors list the folders level by level, one job for each level; the driver holds no names. Links are skipped (the
    root itself may be one), hidden names count.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for below in batch["path"]:
                rows = iter(_listed(root, below))
                while part := list(islice(rows, 10_000)):
                    yield pd.DataFrame(part, columns=["path", "kind"])

    left, found = spark.createDataFrame([("",)], "path string"), []
    while not left.isEmpty():
        found.append(shared.cut(left.repartition(4 * spark.sparkContext.defaultParallelism).mapInPandas(run, "path string, kind string")))
        left = found[-1].where("kind = 'folder'").select("path")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.where("kind <> 'folder'")


def read_files(root: str, names: DataFrame) -> DataFrame:
    """(path, content, error): the bytes of files below a root that all executors share, read by them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                rows = []
                for name in batch["path"].iloc[at : at + 256]:
                    try:
                        with open(os.path.join(root, name), "rb") as f:
                            rows.append((name, f.read(), None))
                    except OSError as e:
                        rows.append((name, None, str(e)))
                yield pd.DataFrame(rows, columns=["path", "content", "error"])

    return names.repartition(4 * names.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, "path string, content binary, error string")


def scanned(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, error) of the concept documents below a folder.

    A folder of another file system is listed and read by Spark's own reader, which passes over names that begin with a
    dot or an underscore and holds each file as one value.
    """
    if re.match("(?!file:)[A-Za-z][A-Za-z0-9+.-]*:", root):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
        path = F.expr(f"substring(_metadata.file_path, {len(root.rstrip('/')) + 2})")
        files = files.select(path.alias("path"), "content", F.lit(None).cast("string").alias("error"))
        name = F.element_at(F.split("path", "/"), -1)
        return files.where(~name.isin(*RESERVED))
    root = re.sub("^file:(//)?", "", root)
    names = discover(spark, root)
    errors = names.where("kind = 'error'").select("path", F.lit(None).cast("binary").alias("content"), F.lit("not listed").alias("error"))
    return read_files(root, names.where("kind = 'document'").select("path")).unionByName(errors)


def decoded(files: DataFrame) -> DataFrame:
    """(path, markdown) of (path, content) rows: strict UTF-8, one leading byte-order mark dropped; null if invalid."""
    mark = F.substring(F.hex("content"), 1, 6) == "EFBBBF"
    return files.select("path", F.try_validate_utf8(F.when(mark, F.expr("substring(content, 4)")).otherwise(F.col("content")).cast("string")).alias("markdown"))


def directory(spark: SparkSession, root: str) -> DataFrame:
    """Rows of RAW for every concept document below root; raises ERR_READ or ERR_PARSE for the first that fails."""
    files = shared.cut(scanned(spark, root))
    texts = decoded(files)
    for rows, code in ((files.where("content is null"), "ERR_READ"), (texts.where("markdown is null"), "ERR_PARSE")):
        failed = rows.orderBy(F.hex(F.encode("path", "UTF-16BE"))).select("path").limit(1).collect()
        if failed:
            raise ConceptError(code, failed[0].path)
    return texts


def uploads(files: DataFrame, strip_root: bool = True) -> DataFrame:
    """Rows of RAW for (path, content) rows as a browser gives them: the first path component is the chosen folder."""
    kept = files.withColumn("path", F.regexp_replace("path", "^[^/]+/", "")) if strip_root else files
    name = F.element_at(F.split("path", "/"), -1)
    return decoded(kept.where(name.endswith(".md") & ~name.isin("index.md", "log.md")))


def in_memory(spark: SparkSession, documents: Iterable[dict | tuple[str, str]]) -> DataFrame:
    """Rows of RAW for documents given as (path, markdown) pairs or mappings, as they are now."""
    rows = [(d["path"], d["markdown"]) if isinstance(d, dict) else tuple(d) for d in documents]
    return spark.createDataFrame(rows, RAW)
