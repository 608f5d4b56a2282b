"""The folder that all executors share: lineage cuts and tables that outlive a plan."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}


def base(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; a new folder of this machine if it is unset and the master is local."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.match(r"local(\[[^,]*(,[^,\]]*)?\])?$", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or f"file://{tempfile.mkdtemp(prefix='lorebase-')}").rstrip("/")


def _drop(spark: SparkSession, folder: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the context may be gone when the interpreter ends
        pass


def folder(spark: SparkSession) -> str:
    """A new folder below the application's own one, which goes when the interpreter ends."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = f"{base(spark)}/lorebase-{uuid.uuid4().hex}"
        atexit.register(_drop, spark, _folders[app])
    return f"{_folders[app]}/{uuid.uuid4().hex}"


def cut(frame: DataFrame) -> DataFrame:
    """frame written to the shared folder and read again."""
    path = folder(frame.sparkSession)
    frame.write.parquet(path, compression="zstd")
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
