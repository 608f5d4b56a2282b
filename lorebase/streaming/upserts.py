"""Continuous ingestion: micro-batches of (path, markdown, version) as upserts of a handle, in order of their versions.

A journal in the checkpoint folder holds, for each batch, the rows that were applied: a row counts if no batch before
has a version of its path as great or greater, and a removal (a null markdown) keeps its version too. So an older version
that comes late changes nothing, and neither does a batch that is run again. A batch's rows are in the journal before
they reach the handle; start() first brings a handle to what the journal says, so a new handle after a restart has every
document, wherever the run before ended. The journal is folded every FOLD batches to the last row of each path.

Every path that comes has an outcome in the batch's outcomes: strict, degraded, fatal, rejected (no document's path),
removed, absent (nothing to remove), or stale. Cases: of rows with one path and version a removal counts, otherwise the
greater text; a null version is older than any; a null path is rejected.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import paths
from ..handle import MERGE_AFTER, ConceptSearch
from ..sources import shared
from ..sources.store import Place

APPLIED = "path string, version long, markdown string"
OUTCOME = "path string, version long, outcome string"
#: Batches after which the journal is folded.
FOLD = 20


class Journal:
    """Applied rows by batch: folders batch-<id>, and fold-<id> with the last rows of all batches up to that one."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._place = spark, Place(spark, folder)

    def _ids(self, kind: str) -> list[int]:
        """The ids of the complete folders of a kind, rising."""
        try:
            found = [s.getPath() for s in self._place._fs.listStatus(self._place._at)]
        except Py4JJavaError:
            return []
        return sorted(int(p.getName().removeprefix(f"{kind}-")) for p in found if p.getName().startswith(f"{kind}-") and Place(self._spark, f"{p.toString()}/_SUCCESS").exists())

    def _at(self, kind: str, batch: int) -> str:
        return self._place.of(f"{kind}-{batch:019}").url

    def rows(self, before: int | None = None) -> DataFrame:
        """Rows of APPLIED of the batches before one, each path once or more."""
        limit = float("inf") if before is None else before
        fold = max((i for i in self._ids("fold") if i < limit), default=-1)
        held = [self._at("fold", fold)] if fold >= 0 else []
        held += [self._at("batch", i) for i in self._ids("batch") if fold < i < limit]
        return self._spark.read.schema(APPLIED).parquet(*held) if held else self._spark.createDataFrame([], APPLIED)

    def write(self, batch: int, rows: DataFrame) -> DataFrame:
        """The rows of a batch, in place of those of a run before; read again."""
        at = self._at("batch", batch)
        rows.write.mode("overwrite").parquet(at)
        return self._spark.read.schema(APPLIED).parquet(at)

    def fold(self, before: int) -> None:
        """Folds the batches before one, if there are enough."""
        ids = [i for i in self._ids("batch") if i < before]
        if len(ids) < FOLD:
            return
        newest(self.rows(before)).write.mode("overwrite").parquet(self._at("fold", ids[-1]))
        for i in ids:
            Place(self._spark, self._at("batch", i)).delete()
        for i in self._ids("fold"):
            if i < ids[-1]:
                Place(self._spark, self._at("fold", i)).delete()

    def outcomes(self) -> DataFrame:
        """(batch, path, version, outcome) of every batch."""
        out = self._spark.createDataFrame([], f"batch long, {OUTCOME}")
        for i in self._ids("outcomes"):
            out = out.unionByName(self._spark.read.schema(OUTCOME).parquet(self._at("outcomes", i)).select(F.lit(i).cast("long").alias("batch"), "*"))
        return out

    def tell(self, batch: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(self._at("outcomes", batch))


def newest(rows: DataFrame) -> DataFrame:
    """The row of each path with the greatest version; of equal ones a removal, else the greater text."""
    best = F.max(F.struct(F.coalesce("version", F.lit(-(1 << 63)).cast("long")).alias("version"), F.isnull("markdown").alias("gone"), "markdown")).alias("best")
    return rows.groupBy("path").agg(best).select("path", "best.version", "best.markdown")


def _apply(handle: ConceptSearch, rows: DataFrame) -> DataFrame:
    """Brings rows of APPLIED, one for each path, to the handle; (path, outcome)."""
    spark, found = rows.sparkSession, []
    gone: list[str] = []
    for row in rows.where("markdown is null").select("path").toLocalIterator():
        gone.append(row.path)
        if len(gone) == MERGE_AFTER:
            found += handle.remove_many(gone)
            gone = []
    found += handle.remove_many(gone)
    removed = spark.createDataFrame([(p, True) for p in found], "path string, there boolean")
    told = rows.where("markdown is null").join(removed, "path", "left").select("path", F.when(F.col("there"), "removed").otherwise("absent").alias("outcome"))
    changed = rows.where("markdown is not null")
    if not changed.isEmpty():
        told = told.unionByName(handle.ingest_many(changed).select("path", "outcome"))
    return told


def upsert(handle: ConceptSearch, batch: DataFrame, journal: Journal, number: int) -> None:
    """Applies one micro-batch: of each path the greatest version, if it is greater than those of all batches before."""
    journal.fold(number)
    named = batch.select(paths.normalized(F.coalesce("path", F.lit(""))).alias("n"), "markdown", F.col("version").cast("long").alias("version"))
    given = shared.cut(named.select(F.coalesce("n.path", "n.error_path").alias("path"), F.col("n.error_path").isNull().alias("fine"), "markdown", "version"))
    last = newest(given.where("fine").select("path", "version", "markdown"))
    before = journal.rows(number).groupBy("path").agg(F.max("version").alias("known"))
    judged = shared.cut(last.join(before, "path", "left").withColumn("stale", F.coalesce(F.col("known") >= F.col("version"), F.lit(False))))
    rows = journal.write(number, judged.where("not stale").select("path", "version", "markdown"))
    told = rows.select("path", "version").join(_apply(handle, rows), "path", "left")
    stale = judged.where("stale").select("path", "version", F.lit("stale").alias("outcome"))
    bad = given.where("not fine").groupBy("path").agg(F.max("version").alias("version")).select("path", "version", F.lit("rejected").alias("outcome"))
    journal.tell(number, told.unionByName(stale).unionByName(bad))


def restored(handle: ConceptSearch, journal: Journal) -> None:
    """Brings a handle to what the journal says."""
    rows = journal.rows()
    if not rows.isEmpty():
        _apply(handle, shared.cut(newest(rows)))


def start(handle: ConceptSearch, stream: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """A running query that keeps handle up to date; trigger as in Spark, by default all that is there now.

    The checkpoint folder makes it resume where it stopped, also with a new handle.
    """
    journal = Journal(stream.sparkSession, f"{checkpoint.rstrip('/')}/upserts")
    restored(handle, journal)
    writer = stream.writeStream.foreachBatch(lambda batch, number: upsert(handle, batch, journal, number)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
