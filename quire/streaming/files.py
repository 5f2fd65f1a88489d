"""Arriving files: the package and record decoders over a stream of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.classify import format_kind
from quire.sources import package

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def scan(spark: SparkSession, folder: str, *, most_bytes: int = 256 << 20, streaming: bool = False) -> DataFrame:
    """``path, kind, length, content`` of the documents in a folder, without what is in folders below.

    Hidden files and other formats aren't read; the size is checked before the
    content is.
    """
    reader = spark.readStream.schema(FILE_SCHEMA) if streaming else spark.read
    files = reader.format("binaryFile").option("pathGlobFilter", "*.[hH][wW][pP]{,[xX]}").load(folder)
    return files.where(F.col("length") <= most_bytes).select("path", format_kind(F.col("path")).alias("kind"), "length", "content")


def section_events(files: DataFrame) -> DataFrame:
    """Events of the sections of packages whose name carries its section, batch or stream (the decoders keep no state)."""
    parts = package.entries(files.where("kind = 'package'"))
    n = F.regexp_extract("name", r"^Contents/section(\d{1,3})\.xml$", 1).try_cast("int")
    return package.events(parts.withColumn("section", n).where("section is not null"))
