"""Near-duplicate documents by min-max hashing, links confirmed on whole sets.

A permutation of the shingle hashes gives two values of a signature: the least and
the greatest hash of the set. Each matches between two sets with the probability of
their Jaccard similarity, and the two matches of one permutation tend not to fail
together, so half the evaluations give signatures of lower variance. ``rows``
permutations make two bands, one of their minima and one of their maxima.

Two sets of similarity ``s`` meet in no band with a probability of at most
``(1 - s ** rows) ** bands``: 1.2e-5 at 0.8 with 48 bands of 7 rows, 5e-11 at 0.9.
What meets is compared by whole sets, so no wrong link is made.

* Documents with equal sets are one class; only classes are compared.
* A bucket (the classes of one band value) of thousands of near copies isn't
  expanded into pairs. In rounds, each class is compared with one other: the
  centre (the class with the fullest buckets) of the bucket's largest component
  with which it shares most buckets. What links is merged. When that finds
  little more, pairs are formed between classes of a bucket that are still in
  different components, and the remaining ones are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import drop_written, lean_batches, written
from quire.llm.components import components
from quire.llm.jaccard_join import _links, _only, _with_class
from quire.llm.text_hash import mix, shingle_sets, slices

#: Rounds against centres end after so many, or when a lesser share of the comparisons links.
MAX_ROUNDS = 6
WORTHWHILE = 0.25
#: Rows (32 bytes each) of the classes to compare up to which they are broadcast to the documents.
MAX_BROADCAST_CLASSES = 250_000
_SALTS = (0x9AE16A3B2F90404F, 0xC949C7DEFA9F4B1D)


def set_keys(flat: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """128 bits of each set (``flat[at[i]:at[i + 1]]``) as two columns."""
    n = np.diff(at).astype(np.uint64)
    keys = []
    for salt in _SALTS:
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(flat ^ np.uint64(salt)))])
        keys.append(mix(sums[at[1:]] - sums[at[:-1]] + n * np.uint64(salt | 1)).view(np.int64))
    return keys


def band_values(flat: np.ndarray, starts: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """(sets, bands): a hash of the band's number and signature values; ``starts`` of non-empty sets in ``flat``.

    A permutation of the 64-bit hashes is a product with an odd number.
    """
    odd = np.random.Generator(np.random.PCG64(rows)).integers(0, 1 << 63, bands // 2 * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros((len(starts), bands), np.uint64)
    for p, factor in enumerate(odd):
        v = flat * factor
        low = 2 * (p // rows)
        for band, best in ((low, np.minimum), (low + 1, np.maximum)):
            out[:, band] = mix((out[:, band] ^ best.reduceat(v, starts)) + np.uint64(band + 1))
    return out


def _flat(texts: pa.Array, size: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    sets = shingle_sets(texts, size)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return sets, np.concatenate(sets) if sets else np.zeros(0, np.uint64), at


def _signed(size: int, rows: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", 1 << 20):
                _, flat, at = _flat(b.column("text"), size)
                n = np.diff(at)
                some = np.flatnonzero(n)
                values = band_values(flat, at[some], rows, bands) if len(some) else np.zeros((0, bands), np.uint64)
                ends = np.concatenate([[0], np.cumsum((n > 0) * bands)]).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel().view(np.int64)))
                k1, k2 = set_keys(flat, at)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(k1), pa.array(k2), tokens], names=["doc_id", "n", "k1", "k2", "tokens"])

    return run


def _sets(size: int):
    """Sets of the rows whose text has the class's set; rows that repeat an id with another text go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                sets, flat, at = _flat(b.column("text"), size)
                k1, k2 = set_keys(flat, at)
                same = np.flatnonzero((b.column("k1").to_numpy() == k1) & (b.column("k2").to_numpy() == k2))
                yield pa.RecordBatch.from_arrays([b.column("node").take(pa.array(same)), pa.array([sets[i].tobytes() for i in same], pa.binary())], names=["node", "items"])

    return run


def _compared(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, linked) of the pairs (written), by both whole sets. Of ``sets`` only those in question move."""
    parts = []
    for side, name in (("a", "sx"), ("b", "sy")):
        ids = written(pairs.select(F.col(side).alias("id")).distinct(), "ids")
        parts.append(_only(sets, "node", ids).select(F.col("node").alias(side), F.col("items").alias(name)))
    both = pairs.join(parts[1], "b").join(parts[0], "a").select("a", "b", "sx", "sy")
    return written(both.mapInArrow(_links(num, den), "a long, b long, linked boolean"), "compared")


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [np.frombuffer(x, np.int64) for x in b.column("items").to_pylist()]
        ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([b.column("node"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))], names=["node", "items"])


def _prefix_pairs(nodes: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): the pairs among ``nodes`` (node, n, component) of different components that can link at all.

    Sets of sizes x and y that link share ``s = ceil(num * (x + y) / (num + den))``
    items, so in an order of all items, rare ones first, one of the ``x - s + 1`` first
    items of the one is among the ``y - s + 1`` first of the other. Near copies of one
    text that differ in other places have their own items there, and make no pair.
    """
    ids = written(nodes.select(F.col("node").alias("id")), "ids")
    rows = _only(sets, "node", ids).mapInArrow(_items, "node long, items array<long>").select("node", F.explode("items").alias("item"))
    rows = written(rows, "items")
    often = rows.groupBy("item").agg(F.count("*").alias("f")).where("f > 1")
    rows = rows.join(often, "item", "left").withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy(F.coalesce("f", F.lit(1)), "item")) - 1)
    rows = rows.where("f > 1").join(nodes, "node")
    share = lambda x, y: F.ceil(num * (x + y) / (num + den))
    n = F.col("n")
    longer = rows.where(F.col("place") <= n - F.ceil(num * n / den))  # against the shortest set that it can link with
    rows = written(longer, "prefixes")
    x, y = rows.alias("x"), rows.where(F.col("place") <= n - share(n, n)).alias("y")
    nx, ny = F.col("x.n"), F.col("y.n")
    apart = (F.col("x.item") == F.col("y.item")) & (F.col("x.component") != F.col("y.component"))
    order = (ny < nx) | ((ny == nx) & (F.col("y.node") < F.col("x.node")))
    within = (F.col("x.place") <= nx - share(nx, ny)) & (F.col("y.place") <= ny - share(nx, ny)) & (den * ny >= num * nx)
    pairs = x.join(y, apart & order & within)
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, shingle_words: int = 5, num: int = 80, den: int = 100, rows: int = 7, bands: int = 48, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row: links where ``den * intersection >= num * union``.

    A component is named by its smallest document id, and that document is kept.

    * A-Z are lower-cased; words are runs of bytes other than ASCII white space;
      a text of fewer than ``shingle_words`` words is one shingle;
    * null or empty texts and texts without words link with nothing;
    * rows that repeat an id and a text form one group; an id that is repeated
      with another text is judged row by row;
    * a row with a null id links with nothing, has a null component and is kept;
    * further columns are ignored; an empty table gives an empty result.
    """
    if bands % 2 or bands < 2 or rows < 1:
        raise ValueError("bands come in pairs, of a row at least")
    lean_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = written(d.mapInArrow(_signed(shingle_words, rows, bands), "doc_id long, n long, k1 long, k2 long, tokens array<long>"), "signed")
    classes = signed.where("n > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.count("*").alias("c"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    reps = signed.withColumnRenamed("doc_id", "rep").drop("n").join(classes.select("rep", "k1", "k2", "node", "n"), ["rep", "k1", "k2"])
    entries = reps.select("node", "n", F.explode("tokens").alias("token"))
    full = entries.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("members")).where("low < high").select("token", "members")
    entries = written(entries.join(full, "token"), "entries")  # of buckets with several classes
    degrees = written(entries.groupBy("node").agg(F.sum("members").alias("degree")), "degrees")
    wanted = written(degrees.join(classes, "node").select("node", "rep", "k1", "k2"), "wanted")
    of = F.broadcast(wanted) if wanted.count() <= MAX_BROADCAST_CLASSES else wanted
    sets = written(d.join(of, d["doc_id"] == of["rep"]).select("text", "node", "k1", "k2").mapInArrow(_sets(shingle_words), "node long, items binary").dropDuplicates(["node"]), "sets")
    sizes = classes.select("node", "n")

    def mixed(e: DataFrame) -> DataFrame:
        """Entries of the buckets that reach across components, with the bucket's largest component and its centre."""
        parts = e.groupBy("token", "component").agg(F.count("*").alias("c"), F.max(F.struct("degree", F.bitwise_not("node").alias("no"))).alias("m"))
        heads = parts.groupBy("token").agg(F.count("*").alias("parts"), F.max(F.struct("c", "m", "component")).alias("m")).where("parts > 1")
        heads = heads.select("token", F.col("m.component").alias("major"), F.bitwise_not("m.m.no").alias("centre"))
        return written(e.select("token", "node", "n", "degree", "component").join(heads, "token"), "mixed")

    def fits(x: str, y: str) -> Column:
        return den * F.least(x, y) >= num * F.greatest(x, y)

    e, tried = entries.join(degrees, "node").withColumn("component", F.col("node")), None
    for _ in range(MAX_ROUNDS):
        e = mixed(e)
        stars = e.where("component <> major").groupBy(F.col("centre").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("shared"), F.max("n").alias("nb"), F.max("component").alias("from"), F.max("major").alias("to"))
        stars = stars.join(sizes.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").where(fits("na", "nb"))
        if tried is not None:
            stars = stars.join(tried.select("a", "b"), ["a", "b"], "left_anti")
        stars = stars.groupBy("b").agg(F.max_by(F.struct("a", "from", "to"), F.struct("shared", F.bitwise_not("a"))).alias("s"))
        stars = written(stars.select("s.a", "b", "s.from", "s.to"), "stars")
        found = _compared(stars.select("a", "b"), sets, num, den)
        tried = found if tried is None else tried.unionByName(found)
        # Each component that links takes the name of one it links to, and that of the one which that takes: what bears a name is connected.
        hooks = stars.join(found.where("linked"), ["a", "b"]).groupBy("from").agg(F.max("to").alias("to"))
        further = hooks.select(F.col("from").alias("to"), F.col("to").alias("then"))
        hooks = hooks.join(further, "to", "left").select(F.col("from").alias("component"), F.coalesce("then", "to").alias("name"))
        e = e.join(hooks, "component", "left").withColumn("component", F.coalesce("name", "component"))
        if found.where("linked").count() <= WORTHWHILE * found.count():
            break
    links = tried.where("linked").select("a", "b")
    named = written(components(links), "components")
    e = mixed(e.drop("component").join(named, "node", "left").withColumn("component", F.coalesce("component", "node")))
    pairs = _prefix_pairs(e.select("node", "n", "component").distinct(), sets, num, den)
    met = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = written(pairs.join(met, ["a", "b"], "left_anti"), "pairs")
    more = _compared(rest, sets, num, den).where("linked").select("a", "b")
    if not more.isEmpty():
        named = components(links.unionByName(more))

    c = classes.join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = c.groupBy("component").agg(F.min("rep").alias("name"))
    c = c.join(names, "component").select("k1", "k2", "c", F.col("name").alias("component"))
    out = _with_class(signed.select("doc_id", "n", "k1", "k2"), written(c, "named"))
    drop_written(sets)
    drop_written(entries)
    own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that :func:`near_duplicates` doesn't keep; rows with a null id stay."""
    id_col = options.get("id_col", "doc_id")
    gone = near_duplicates(docs, **options).where("not kept").select("doc_id").distinct().alias("gone")
    return docs.alias("kept").join(gone, F.col(f"kept.{id_col}") == F.col("gone.doc_id"), "left_anti")
