"""Conversion of files: which way each goes, what is written, and what became of it.

A batch is a DataFrame of files; a file that can't be read is a row with its error
and doesn't stop the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.classify import format_kind
from quire.functions.text import asset_name
from quire.operators.group import distinct_names
from quire.plans import binary_documents, package_documents, package_xml, render
from quire.sources import markdown
from quire.store import kept

MAX_MARKDOWN = 256 << 20
_META = ("title", "author", "subject", "description")


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """``path, length, content, kind`` of a folder's files of a known format; files in its folders aren't taken.

    Markdown of more than ``MAX_MARKDOWN`` bytes isn't read: its content is null.
    """
    read = lambda names: spark.read.format("binaryFile").option("pathGlobFilter", names).load(folder).select("path", "length", "content")
    texts = read("*.{[mM][dD],[mM][aA][rR][kK][dD][oO][wW][nN]}")
    short = F.col("length") <= MAX_MARKDOWN  # the source tests lengths before it reads contents
    files = read("*.[hH][wW][pP]{,[xX]}").unionByName(texts.where(short)).unionByName(texts.where(~short).withColumn("content", F.lit(None).cast("binary")))
    return files.withColumn("kind", format_kind(F.col("path")))


def blocks(files: DataFrame) -> dict[str, DataFrame]:
    """``blocks``, ``documents`` (path, title, ..., error) and ``assets`` of (path, kind, content) files of all formats.

    Which formats there are is asked first, as only their readers run.
    """
    kinds = {r.kind for r in files.select("kind").distinct().collect()}  # three at most
    readers = {"records": _binary, "package": _packed, "markdown": _marked}
    found = [read(files.where(F.col("kind") == kind)) for kind, read in readers.items() if kind in kinds] or [_marked(files.where("false"))]
    return {name: reduce(DataFrame.unionByName, (f[name] for f in found)) for name in ("blocks", "documents", "assets")}


#: ``name`` is what a picture is called, ``ref`` what blocks call it (``src``), ``resolved`` its name with the extension of its content.
_ASSETS = "path string, ord int, name string, ref string, resolved string, mime string, data binary"


def _binary(files: DataFrame) -> dict[str, DataFrame]:
    b = binary_documents.read(files.select("path", "content"))
    documents = b["documents"].select("path", "title", "author", "subject", F.lit(None).cast("string").alias("description"), F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"), "recovered", "error")
    return {"blocks": b["blocks"], "documents": documents, "assets": b["assets"].select("path", F.col("id").alias("ord"), "name", F.col("name").alias("ref"), "resolved", "mime", "data")}


def _packed(files: DataFrame) -> dict[str, DataFrame]:
    p = package_documents.read(files.select("path", "content"))
    documents = p["documents"].select("path", *_META, F.array().cast("array<string>").alias("keywords"), F.lit(False).alias("recovered"), "error")
    return {"blocks": p["blocks"], "documents": documents, "assets": p["assets"].select("path", "ord", "name", F.col("entry").alias("ref"), F.col("name").alias("resolved"), "mime", "data")}


def _marked(files: DataFrame) -> dict[str, DataFrame]:
    size = F.col("length") if "length" in files.columns else F.lit(None)
    texts = files.select("path", F.coalesce(size, F.octet_length("content")).alias("n"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    front = markdown.front_matter(F.col("text"))
    body = F.regexp_replace("text", r"(?s)^---\n.*?\n---(\n|$)", "")
    short = F.col("n") <= MAX_MARKDOWN
    blocks = markdown.nodes(texts.where(short).select("path", body.alias("text")), "path").withColumnRenamed("doc_id", "path")
    meta = [F.when(short, front.getField(k)).alias(k) for k in _META]
    documents = texts.select("path", *meta, F.coalesce(front.getField("keywords"), F.array().cast("array<string>")).alias("keywords"), F.lit(False).alias("recovered"), F.when(~short, "FileTooLarge").alias("error"))
    return {"blocks": blocks, "documents": documents, "assets": files.sparkSession.createDataFrame([], _ASSETS)}


def _with_text(documents: DataFrame, nodes: DataFrame, front_matter: bool) -> DataFrame:
    text = render.markdown(nodes, ["path"])
    out = documents.join(text, "path", "left").withColumn("markdown", F.when(F.col("error").isNull(), F.coalesce("markdown", F.lit(""))))
    if front_matter:
        head = render.front_matter(F.col("title"), F.col("author"), F.lit(None).cast("string"), F.col("subject"), F.col("description"), F.col("keywords"))
        out = out.withColumn("markdown", F.concat(F.when(F.coalesce("title", "author", "subject", "description").isNotNull() | (F.size("keywords") > 0), head).otherwise(""), "markdown"))
    return out.select("path", "markdown", "error")


def to_markdown(files: DataFrame, front_matter: bool = False) -> DataFrame:
    """``path, markdown, error`` of (path, kind, content) files; with ``front_matter``, that of their properties comes first."""
    parts = blocks(files)
    return _with_text(parts["documents"], parts["blocks"], front_matter)


def to_packages(files: DataFrame, style: Column | None = None) -> DataFrame:
    """``path, content`` of packages made of Markdown (path, content) files, in a style (:func:`quire.plans.style.literal`)."""
    parts = blocks(files.withColumn("kind", F.lit("markdown")))
    return package_xml.write(parts["blocks"], _styled(parts["documents"].where("error is null"), style))


def _styled(documents: DataFrame, style: Column | None) -> DataFrame:
    return documents if style is None else documents.withColumn("style", style)


def check(files: DataFrame) -> DataFrame:
    """``path, error`` of (path, kind, content) files: whether each can be read."""
    return blocks(files)["documents"].select("path", "error")


def targets(files: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """``path, target, status`` of (path, kind) files: ``convert``, ``skipped`` where the target is among ``existing`` (path) or another file's, ``ignored`` for Markdown beside its package.

    Binary and packaged files become Markdown, Markdown becomes a package. Of files with
    the same target the first by name is converted.
    """
    stem = F.regexp_replace("path", r"[.][^./]+$", "")
    t = files.withColumn("target", F.concat(stem, F.when(F.col("kind") == "markdown", ".hwpx").otherwise(".md")))
    first = F.row_number().over(Window.partitionBy("target").orderBy("path")) == 1
    known = existing.select(F.col("path").alias("target")).distinct().withColumn("there", F.lit(True))
    t = t.withColumn("first", first).join(known, "target", "left")
    status = F.when(~F.col("first") | (F.coalesce("there", F.lit(False)) & F.lit(not force)), "skipped").otherwise("convert")
    return t.select("path", "target", status.alias("status"))


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Write (name, content) rows as files of a folder, under a temporary name first; ``name, bytes`` of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        store, root = fs.FileSystem.from_uri(folder if ":/" in folder else f"file://{folder}")
        for b in batches:
            sizes = []
            for name, content in zip(b.column("name").to_pylist(), b.column("content").to_pylist(), strict=True):
                target = f"{root}/{name}"
                store.create_dir(target.rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{target}.{attempt}.tmp") as f:
                    f.write(content or b"")
                store.move(f"{target}.{attempt}.tmp", target)
                sizes.append(len(content or b""))
            yield pa.RecordBatch.from_arrays([b.column("name"), pa.array(sizes, pa.int64())], names=["name", "bytes"])

    return rows.select(F.col("name").cast("string").alias("name"), F.col("content").cast("binary").alias("content")).mapInArrow(run, "name string, bytes long")


def asset_files(assets: DataFrame, by: list[str]) -> DataFrame:
    """``by..., name, content`` of pictures under safe names, numbered where these collide."""
    safe = assets.withColumn("safe", asset_name(F.col("name")))
    return distinct_names(safe, by, ["ord"], "safe", "unique").select(*by, F.col("unique").alias("name"), F.col("data").alias("content"))


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """``path, target, status, error, bytes, n_assets`` of the files that earlier batches into ``folder`` went through."""
    path = f"{folder}/_outcomes"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.read.schema(_OUTCOME).parquet(path)
    return spark.createDataFrame([], _OUTCOME)


_OUTCOME = "path string, target string, status string, error string, bytes bigint, n_assets bigint"


def run_batch(files: DataFrame, folder: str, force: bool = False, front_matter: bool = True, style: Column | None = None) -> DataFrame:
    """Convert (path, kind, content) files into ``folder`` and return :func:`outcomes` of this batch.

    Binary and packaged files become Markdown, with their pictures under
    ``NAME.assets`` and links to them there; Markdown becomes packages in the ``style``, if there is one. A file whose
    target an earlier batch wrote, or another file of this one has, is ``skipped``
    unless ``force``; a file that can't be read is ``failed`` with its error and
    leaves nothing. Files appear under their names when they are whole, so a task
    that runs again leaves one. What became of each file is added to the folder's
    outcomes when all are written; a batch that breaks off is done again.
    """
    spark = files.sparkSession
    base = F.regexp_extract("path", "([^/]+)$", 1)
    done = outcomes(spark, folder).where("status = 'converted'").select(F.col("target").alias("path"))
    names = files.select(base.alias("path"), F.col("path").alias("source"), "kind")
    plan = targets(names, done, force).withColumnRenamed("path", "base").join(names.select(F.col("path").alias("base"), F.col("source").alias("path")), "base")
    plan = kept(plan.select("path", "target", F.when(F.col("status") == "convert", "converted").otherwise(F.col("status")).alias("status")))
    work = files.join(plan.where("status = 'converted'").select("path", "target"), "path")
    parts = blocks(work)
    is_text = F.endswith("target", F.lit(".hwpx"))
    chosen = plan.where("status = 'converted'").select("path", "target")
    documents = kept(parts["documents"].join(chosen, "path"))
    rows = kept(parts["blocks"])
    stem = F.regexp_replace("target", r"[.][^.]+$", "")

    pictures = parts["assets"].join(documents.where("error is null").select("path", stem.alias("stem")), "path")
    pictures = distinct_names(pictures.withColumn("safe", asset_name(F.col("resolved"))), ["path"], ["ord"], "safe", "unique")
    pictures = kept(pictures.select("path", "ref", F.concat("stem", F.lit(".assets/"), "unique").alias("name"), F.col("data").alias("content")))
    named = pictures.groupBy("path", F.col("ref").alias("src")).agg(F.min("name").alias("at"))
    linked = rows.join(named, ["path", "src"], "left").withColumn("src", F.coalesce("at", "src")).select(rows.columns)
    read = documents.where(~is_text & F.col("error").isNull())
    texts = _with_text(read, linked.join(read.select("path"), "path", "left_semi"), front_matter).select("path", F.encode("markdown", "UTF-8").alias("content"))
    marked = documents.where(is_text & F.col("error").isNull())
    packed = package_xml.write(rows.join(marked.select("path"), "path", "left_semi"), _styled(marked, style))
    made = texts.unionByName(packed).join(chosen, "path").select(F.col("target").alias("name"), "content")
    written = kept(write_files(made.unionByName(pictures.select("name", "content")), folder))

    count = pictures.groupBy("path").agg(F.count("*").alias("n_assets"))
    out = plan.join(documents.select("path", "error"), "path", "left").join(written.select(F.col("name").alias("target"), "bytes"), "target", "left").join(count, "path", "left")
    status = F.when(F.col("error").isNotNull(), "failed").otherwise(F.col("status"))
    own = F.col("status") == "converted"
    out = kept(out.select("path", "target", status.alias("status"), "error", F.when(own, F.col("bytes")).alias("bytes"), F.when(own, F.coalesce("n_assets", F.lit(0))).cast("bigint").alias("n_assets")))
    out.write.mode("append").parquet(f"{folder}/_outcomes")
    return out
