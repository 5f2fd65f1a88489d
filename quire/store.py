"""Tables that several later steps read."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}
#: Spark deletes a query's shuffles when it ends, not when the driver happens to collect its garbage.
_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _delete(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the JVM may have ended before the interpreter
        pass


def folder(spark: SparkSession) -> str:
    """A folder for this application's tables under ``spark.checkpoint.dir``, deleted when the interpreter ends.

    Where that is unset, a local folder stands in if the session runs on one
    machine; on a cluster its absence is an error.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _folders:
        base = sc.getConf().get("spark.checkpoint.dir")
        if not base:
            if not re.match(r"local(\[|$)", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="spark-")
        _folders[sc.applicationId] = f"{base.rstrip('/')}/quire-kept-{sc.applicationId}"
        atexit.register(_delete, spark, _folders[sc.applicationId])
    return _folders[sc.applicationId]


def new_folder(spark: SparkSession) -> str:
    """A folder of its own in :func:`folder`."""
    return f"{folder(spark)}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df``, computed once, written to the shared folder and read from there: lost executors cost nothing, and later plans begin here."""
    if df.isStreaming:
        return df
    path = new_folder(df.sparkSession)
    conf = df.sparkSession.conf
    before = conf.get(_CLEANED, None)
    conf.set(_CLEANED, "true")  # what is kept is read from its folder
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(_CLEANED) if before is None else conf.set(_CLEANED, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)
