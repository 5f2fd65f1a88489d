"""Benchmark decontamination: find short test items inside long documents.

Size-partitioned MinHash containment search. Items and documents are sets of word
shingles; one permutation (a 64-bit hash) orders these, and both sides are
sketched by their smallest hash values.

* Items are partitioned by size (powers of two). An item's sketch is its ``k``
  smallest values. A document that holds at least ``ceil(t * n)`` of the item's
  ``n`` shingles misses at most ``n - ceil(t * n)`` of them, so with
  ``k = n - ceil(t * n) + m`` it must hold ``m`` values of the sketch. The partition
  fixes ``m``: larger items ask for more matches, so a common phrase alone brings
  no candidate.
* A document has a signature for each partition: its values up to the largest
  that any sketch of the partition holds. As sizes differ widely, the signature
  is cut by value and not by number: one of fixed length would say nothing about
  40 words in 20,000. Documents too short for a partition have none in it.

Nothing is missed at any size, and each candidate is verified by exact shingle
containment. Only candidates' texts are shuffled.

Everything is DataFrame functions; no Python runs on the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import let, written

WORD_BREAK = r"[^\p{L}\p{N}]+"

#: Sketch rows, or ids of candidates (16 bytes each), up to which they are broadcast.
MAX_BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_BREAK), "")


def shingle_hashes(words_col: Column, size: int) -> Column:
    """Distinct 64-bit hashes of the word shingles; shorter texts count as one shingle."""
    n = F.size(words_col)
    many = F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.xxhash64(F.slice(words_col, i, size)))
    return F.when(n == 0, F.array().cast("array<bigint>")).when(n <= size, F.array(F.xxhash64(words_col))).otherwise(F.array_distinct(many))


def shingle_strings(words_col: Column, size: int) -> Column:
    n = F.size(words_col)
    many = F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.array_join(F.slice(words_col, i, size), " "))
    return F.when(n == 0, F.array().cast("array<string>")).when(n <= size, F.array(F.array_join(words_col, " "))).otherwise(F.array_distinct(many))


def needed(n: Column, threshold: float) -> Column:
    """Shingles that must be present: ceil(threshold * n), free of rounding noise."""
    return F.ceil(n * F.lit(threshold) - F.lit(1e-9)).cast("int")


def item_sketches(items: DataFrame, shingle_words: int, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """(item, size class, matches asked for, sketch hash), a row for each hash of each sketch."""
    h = items.select(F.col(id_col).alias("item_id"), let(words(F.col(text_col)), lambda w: shingle_hashes(w, shingle_words)).alias("h"))
    n = F.size("h")
    h = h.where(n > 0).select("item_id", "h", n.alias("n"), F.floor(F.log2(n)).cast("int").alias("size_class"))
    # size classes: below 8 one match, 8 to 31 two, 32 to 127 four, then eight
    asked = F.when(F.col("size_class") < 3, 1).when(F.col("size_class") < 5, 2).when(F.col("size_class") < 7, 4).otherwise(8)
    k = F.least(F.col("n") - needed(F.col("n"), threshold) + asked, F.col("n"))
    h = h.withColumn("k", k).withColumn("asked", F.col("k") - (F.col("n") - needed(F.col("n"), threshold)))
    return h.select("item_id", "size_class", "asked", F.explode_outer(F.slice(F.array_sort("h"), F.lit(1), F.col("k"))).alias("h"))


def contained_items(
    docs: DataFrame, items: DataFrame, *, threshold: float = 0.8, shingle_words: int = 5, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """Pairs (document, item) of which the document holds ``threshold`` of the item's shingles.

    Returns ``doc_id, item_id, n_item, n_shared, containment``, a row a pair.

    * null or empty text, or text without letters and digits: no shingles, no pair;
    * an item of fewer than ``shingle_words`` words is one shingle, the whole
      sequence, and matches documents of just these words;
    * repeated rows and repeated ids give one row a pair, with the largest containment;
    * a null document or item id is a value like any other;
    * empty tables give an empty result; further columns are ignored.
    """
    sketch = written(item_sketches(items, shingle_words, threshold, item_id, item_text), "sketches")
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # by partition: the shingles that a document needs at least, and the largest value of its sketches; a row for each power of two
    sizes = sketch.groupBy("size_class").agg(F.max("h").alias("top")).orderBy("size_class").collect()
    least = [(math.ceil(2 ** r["size_class"] * threshold - 1e-9), r["top"]) for r in sizes]
    if sketch.count() <= MAX_BROADCAST_ROWS:
        sketch = F.broadcast(sketch)

    def signature(h: Column) -> Column:
        """The values of all of the document's signatures, each once."""
        top = F.greatest(*[F.when(F.size(h) >= n, F.lit(top)) for n, top in least], F.lit(None).cast("long"), F.lit(None).cast("long"))
        return F.transform(F.filter(h, lambda x: x <= top), lambda x: F.struct(F.size(h).alias("n_doc"), x.alias("h")))

    # explode_outer: explode would have its input computed a second time, to filter out empty arrays
    sized = let(words(F.col("text")), lambda w: let(shingle_hashes(w, shingle_words), signature))
    probe = d.select("doc_id", F.explode_outer(sized).alias("s")).select("doc_id", "s.n_doc", "s.h")
    enough = F.col("n_doc") >= F.ceil(F.pow(F.lit(2.0), F.col("size_class")) * threshold - 1e-9)
    hits = probe.join(sketch, "h").where(enough)
    candidates = hits.groupBy("doc_id", "item_id").agg(F.count("*").alias("hits"), F.min("asked").alias("asked")).where("hits >= asked").select("doc_id", "item_id")
    candidates = written(candidates, "candidates")
    ids = candidates.select(F.col("doc_id").alias("found")).distinct()
    if candidates.count() <= MAX_BROADCAST_ROWS:  # beyond that the texts are shuffled
        ids = F.broadcast(ids)
    d = d.join(ids, F.col("doc_id").eqNullSafe(F.col("found")), "left_semi")
    bench = items.select(F.col(item_id).alias("item_id"), let(words(F.col(item_text)), lambda w: shingle_strings(w, shingle_words)).alias("item_sh"))
    c, b = candidates.alias("c"), bench.alias("b")
    pairs = c.join(b, F.col("c.item_id").eqNullSafe(F.col("b.item_id"))).select(F.col("c.doc_id").alias("c_doc"), "b.item_id", "item_sh")
    pairs = d.join(pairs, F.col("doc_id").eqNullSafe(F.col("c_doc")))
    shared = F.size(F.array_intersect("item_sh", let(words(F.col("text")), lambda w: shingle_strings(w, shingle_words))))
    found = pairs.select("doc_id", "item_id", F.size("item_sh").alias("n_item"), shared.alias("n_shared"))
    found = found.where(F.col("n_shared") >= needed(F.col("n_item"), threshold))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("n_shared") / F.col("n_item"), "n_item", "n_shared")).alias("m"))
    return best.select("doc_id", "item_id", F.col("m.n_item").cast("long").alias("n_item"), F.col("m.n_shared").cast("long").alias("n_shared"), (F.col("m.n_shared") / F.col("m.n_item")).alias("containment"))


def remove_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold an item; all their columns stay."""
    id_col = options.get("id_col", "doc_id")
    bad = contained_items(docs, items, **options).select("doc_id").distinct().alias("found")
    return docs.alias("kept").join(bad, F.col(f"kept.{id_col}").eqNullSafe(F.col("found.doc_id")), "left_anti")
