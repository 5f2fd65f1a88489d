"""The corpus pipeline: documents to packed training sequences in stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, jaccard_join, packing, pii, quality
from quire.llm.common import read_table, written
from quire.llm.queries import TOKENIZER


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    A null or empty text is judged by its statistics; rows that repeat an id are
    judged one by one; further columns stay; no rows give no rows.
    """
    return quality.keep_good(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8 at least.

    That with the smallest id stays; rows with a null id or without words stay; of
    rows that repeat an id and a text one stays; further columns stay.
    """
    return jaccard_join.keep_first(docs, shingle_words=5, num=80, den=100)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none. All rows of an id go if one of them holds an
    item; further columns stay; an empty benchmark removes nothing.
    """
    return decontaminate.remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; ``n_chars`` follows the text (null where that is).

    Rows and further columns stay as they are.
    """
    out = pii.mask_texts(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids, with their places in sequences of 4096 ids.

    A null or empty text is just the end id; each row is a document of its own,
    also where ids repeat or are null; further columns are left out.
    """
    out = packing.pack_documents(docs, tokenizer=TOKENIZER, capacity=4096, end_id=2)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_classifier", quality_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: The classifier, the CRF and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in turn; each result is written and read again as the next one's input."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
