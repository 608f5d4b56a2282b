"""Shared folder, tables and small helpers of the corpus operators."""

from __future__ import annotations

import atexit
import ctypes
import re
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

#: Bytes of an Arrow batch: wide rows (texts, sets) come in batches of many MB otherwise, held by the JVM and the worker.
ARROW_BYTES = "2m"
#: Rows that a scan decodes at once, for the same reason: a column of 4,096 texts is an array of many MB in the JVM.
SCAN_ROWS = "512"
#: Shuffle files go when the query that wrote them has ended, not when the driver collects its objects.
_WRITING = {"spark.sql.execution.arrow.maxBytesPerBatch": ARROW_BYTES, "spark.sql.parquet.columnarReaderBatchSize": SCAN_ROWS, "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: White space between words, as one RE2/Java character class body.
SPACE = r"\x20\x09-\x0D"

_roots: dict[str, str] = {}
_made: list[str] = []
_spent: dict[str, list[str]] = {}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the driver's tables, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the context may be gone when the interpreter ends
        pass


def scratch(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, removed at exit.

    Where the setting is absent a folder of the driver serves if the master is local, where there is one machine; on a
    cluster the setting is required.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base and not re.match(r"local(\[[^,]*(,[^,\]]*)?\])?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = base or f"file://{tempfile.mkdtemp(prefix='lorebase-')}"
        _roots[app] = f"{base.rstrip('/')}/lorebase-{uuid.uuid4().hex}"
        atexit.register(_drop, spark, _roots[app])
    return _roots[app]


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """What is run inside decodes SCAN_ROWS and gives Python workers ARROW_BYTES at a time and deletes its shuffle files at its end."""
    before = {k: spark.conf.get(k) for k in _WRITING}
    for k, v in _WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def saved(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df written once to the shared folder, with the writer's options, and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    with writing(spark):
        df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    _made.append(path)
    return out


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """One stage of a chain of which each result is written before the next stage begins.

    Deletes what saved() wrote inside the stage before, which nobody reads any more, and remembers what is written inside.
    Shuffle files of that stage's result go too: Spark deletes them once the driver has collected the plan.
    """
    for path in _spent.pop(spark.sparkContext.applicationId, []):
        _drop(spark, path)
    spark.sparkContext._jvm.System.gc()
    before = len(_made)
    try:
        yield
    finally:
        _spent[spark.sparkContext.applicationId] = _made[before:]
        del _made[before:]


def dropped(*frames: DataFrame) -> None:
    """Deletes what saved() wrote for these frames; nothing that is yet to run may read them."""
    for frame in frames:
        _drop(frame.sparkSession, frame._saved_at)


def kept(name: tuple, make: Callable):
    """What make() gives, made once by each Python worker and kept for its later tasks.

    Functions reach workers by value, with new module globals for each task, so these can't hold it.
    """
    held = sys.modules.setdefault("_lorebase_kept", types.ModuleType("_lorebase_kept")).__dict__
    if name not in held:
        held[name] = make()
    return held[name]


def lean(run: Callable, *names: str) -> Callable:
    """run for mapInArrow, whose worker drops what it has kept but for these names, and gives free memory back at its end.

    A worker waits for tasks of any kind beside those that work, and its memory counts as its executor's.
    """

    def own(batches):
        held = sys.modules.setdefault("_lorebase_kept", types.ModuleType("_lorebase_kept")).__dict__
        for name in [k for k in held if isinstance(k, tuple) and k[0] not in names]:
            del held[name]
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
        if trim:
            trim(0)

    return own


def slots(spark: SparkSession) -> int:
    """Partitions for work whose size is not known: as many as shuffles get, or four for each core."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def quoted(name: str) -> Column:
    """The column of that name, whatever stands in it."""
    return F.col("`" + name.replace("`", "``") + "`")


#: A key is hot from this share of a frame's rows on, and from this number; so a frame has 1 / HOT_SHARE hot keys at most.
HOT_SHARE, HOT_ROWS = 1 / 2000, 200
SALTS = 64


def spread(left: DataFrame, right: DataFrame, keys: str | list[str], how: str = "inner", of: DataFrame | None = None) -> DataFrame:
    """left.join(right, keys, how) in which the rows of a key that many rows of left have go to SALTS tasks.

    right has one row for each key, or few; those of hot keys are copied for each task. Null keys, which meet nothing,
    are dealt out too. how is inner or left. The keys of left are counted first, in partial sums, in left, which is then a
    stored table, or in another frame with the same keys.
    """
    keys = [keys] if isinstance(keys, str) else keys
    of = left if of is None else of
    least = max(HOT_ROWS, int(of.count() * HOT_SHARE))
    known, none = F.lit(True), F.lit(False)
    for key in keys:
        known, none = known & F.col(key).isNotNull(), none | F.col(key).isNull()
    counts = of.where(known).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = F.broadcast(counts.where(F.col("_n") >= least).select(*keys, F.lit(True).alias("_hot")))  # 1 / HOT_SHARE rows at most
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    dealt = left.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot") | none, salt).otherwise(F.lit(0))).drop("_hot")
    every = F.sequence(F.lit(0), F.lit(SALTS - 1))
    met = right.join(hot, keys, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), every).otherwise(F.array(F.lit(0))))).drop("_hot")
    return dealt.join(met, [*keys, "_salt"], how).drop("_salt")


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows (..., n) of a stored frame with the greatest n, `most` at most: all from some n on, equal ones together.

    Rows are counted by the first ten binary digits of n, some 50,000 sums at the very most; nothing is sorted or sent
    to one task.
    """
    digits = F.length(F.bin("n"))
    coarse = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.expr("shiftleft(shiftright(n, CAST(d - 10 AS INT)), CAST(d - 10 AS INT))"))
    sizes = counts.select("n", digits.alias("d")).groupBy(coarse.alias("n")).agg(F.count(F.lit(1)).alias("rows")).collect()
    cut, total = None, 0
    for r in sorted(sizes, reverse=True):
        if total + r["rows"] > most:
            break
        cut, total = r["n"], total + r["rows"]
    return counts.where(F.col("n") >= cut) if cut is not None else counts.where("false")


def ascii_lower(c: Column | str) -> Column:
    """A-Z to a-z and nothing else."""
    c = F.col(c) if isinstance(c, str) else c
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(c: Column) -> Column:
    """The maximal runs of other characters than SPACE, as an array; null for null."""
    return F.filter(F.split(c, f"[{SPACE}]+"), lambda w: w != "")
