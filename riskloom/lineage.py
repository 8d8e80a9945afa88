"""Where lineage ends: tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: By application, the folder of a local run that names none.
_OWN: dict[str, str] = {}
#: The folder of each table that cut() made, for discard().
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _one_machine(spark: SparkSession) -> bool:
    """True where driver and tasks share a process; local-cluster runs executors of their own."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only a local run that names none gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not _one_machine(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="riskloom-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return _OWN[app]


def shared_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else has."""
    return f"{shared_folder(spark)}/riskloom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """``df`` written and read again: a lost executor costs no earlier stage, and its shuffle files go at once."""
    spark: SparkSession = df.sparkSession
    path = shared_path(spark, label)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that cut() made, once all that was derived from them has itself been cut. A table that cut()
    did not make is left alone."""
    for df in tables:
        path = _PATHS.pop(df, None)
        if path:
            _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Delete every table this application has cut; call it when results have been read."""
    _delete(spark, f"{shared_folder(spark)}/riskloom/{spark.sparkContext.applicationId}")
