"""Helpers shared by the operators: shared folder, written tables, row keys."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_scratch: dict[str, str] = {}


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _delete_quietly(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # noqa: BLE001  the JVM may have ended before the interpreter
        pass


def shared_dir(spark: SparkSession) -> str:
    """A folder for this application's tables under ``spark.checkpoint.dir``.

    Where that setting is absent a local folder stands in if the session runs on
    one machine; on a cluster its absence is an error, as executors would each
    write to a disk of their own. The folder is removed when the driver's
    interpreter ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="spark-")
        _scratch[app] = f"{base.rstrip('/')}/quire-{app}"
        atexit.register(_delete_quietly, spark, _scratch[app])
    return _scratch[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    Cuts the lineage, survives lost executors and makes what a later step sees
    independent of a second evaluation.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quire_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Delete a table made by :func:`written` that nothing reads any more."""
    _delete_quietly(df.sparkSession, df._quire_path)


def lean_batches(spark: SparkSession) -> None:
    """Arrow batches of 8 MB at most, where the session doesn't say otherwise: texts are long and workers small."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext.getConf().get(key) is None:
        spark.conf.set(key, str(8 << 20))


def give_back_memory() -> None:
    """Give a worker's memory of earlier tasks back to the system, before a task that needs much itself."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not every C library can
        pass


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def crc_bucket(id_col: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus))


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once for each row.

    A lambda's variable is bound once, where the optimizer would copy the
    expression to each of its uses when it merges projections.
    """
    return F.element_at(F.transform(F.array(value), then), 1)


def unused(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def numbered(rows: DataFrame, group: str, *order: str | Column) -> DataFrame:
    """``rows`` with ``pos`` (0, 1, ... within its group by ``order``) and ``total`` (rows of the group).

    Rows are dealt by range over (group, order), so that a group may fill any number
    of tasks; what a task's numbers begin with comes from counts by task and group.
    ``group`` has no nulls. Rows that ``order`` doesn't tell apart are numbered as
    they come, once: the numbers are written.
    """
    mark = F.monotonically_increasing_id()
    own = unused(rows, "own")
    laid = written(rows.withColumn(own, mark).repartitionByRange(group, *order, own).sortWithinPartitions(group, *order, own).drop(own).withColumn("mark", mark), "laid")
    task = F.shiftright("mark", 33)
    counts = laid.groupBy(task.alias("task"), group).agg(F.min("mark").alias("first"), F.count("*").alias("n"))
    by = Window.partitionBy(group)
    before = F.sum("n").over(by.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("task", group, (F.coalesce(before, F.lit(0)) - F.col("first")).alias("base"), F.sum("n").over(by).alias("total"))
    counts = written(counts, "counts")
    out = laid.withColumn("task", task).join(counts, ["task", group]).withColumn("pos", F.col("mark") + F.col("base"))
    return out.select(*rows.columns, "pos", "total")
