"""Statistics of documents and outcomes of batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.classify import format_kind


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_sections, n_blocks, n_chars`` of texts whose lines are paragraphs; blank ones don't count."""
    lines = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1), lambda x: ~x.rlike(r"^[ \t\r]*$"))
    n = F.aggregate(F.transform(lines, lambda x: F.char_length(x).cast("bigint")), F.lit(0).cast("bigint"), lambda a, b: a + b)
    return docs.select(F.col(id_col).alias("doc_id"), F.lit(1).cast("bigint").alias("n_sections"), F.size(lines).cast("bigint").alias("n_blocks"), n.alias("n_chars"))


def node_statistics(nodes: DataFrame) -> DataFrame:
    """Blocks and characters of (doc_id, section, region, depth, kind, via, text) nodes.

    Blocks are top-level ones of the body. Characters are code points of
    headings, paragraphs, code and formulas; what hangs on a list item as a child,
    and headers and footers, doesn't count.
    """
    body = F.col("region") == "body"
    counted = body & F.col("kind").isin("heading", "paragraph", "code", "math") & F.coalesce(F.col("via") != "children", F.lit(True))
    return nodes.groupBy("doc_id").agg(F.countDistinct("section").alias("n_sections"), F.count_if(body & (F.col("depth") == 0)).alias("n_blocks"), F.coalesce(F.sum(F.when(counted, F.char_length("text"))), F.lit(0)).cast("bigint").alias("n_chars"))


def batch_outcomes(files: DataFrame, force: bool) -> DataFrame:
    """``status, n`` of a batch of (path, output_exists, error) files.

    Files of another format are ignored, those whose output exists are skipped
    unless ``force``; an error is a failure of that file alone.
    """
    wanted = format_kind(F.col("path")).isin("records", "package")
    status = F.when(F.col("output_exists") & wanted & F.lit(not force), "skipped").when(~F.coalesce(wanted, F.lit(False)), "ignored").when(F.col("error").isNotNull(), "failed").otherwise("converted")
    return files.groupBy(status.alias("status")).agg(F.count("*").alias("n"))
