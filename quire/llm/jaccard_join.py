"""N-gram Jaccard join: which documents link, and the groups that links form.

Two documents link if the Jaccard similarity of their sets of word shingles
reaches a threshold. No candidate is left out, and each is verified on whole sets.
Shingles are compared by 64-bit hashes and sets by 128 bits: two different
shingles count as one with a chance of 2**-64 a pair.

* Documents with equal sets are one class; only classes are compared.
* Shingles are put in one global order, rare ones first. How frequent a shingle
  is comes from a table of counters of fixed size (``2**SKETCH_BITS``) over all
  documents. Any order gives right results; a good one saves candidates.
* A document of ``n`` shingles shares ``o = ceil(t * n)`` of them with any partner,
  so its ``n - o + l`` first shingles hold ``l`` shared ones. Each document picks
  its own ``l`` by the estimated cost of its candidates: a longer prefix is more to
  read, but asks for more matches before a pair is verified. A pair must share
  as many prefix shingles as the smaller ``l`` of the two asks for.
* A group of thousands of near copies isn't expanded into pairs. In rounds, each
  document is verified against one other: of the centres of its prefix shingles
  (a document for each shingle, from its largest component) the one that it
  shares most with. What links is merged. When this finds little more, pairs
  are formed between documents that share prefix shingles and are still in
  different components, and only those remain to be verified. Two documents in
  one component need no check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import drop_written, lean_batches, unused, written
from quire.llm.components import components
from quire.llm.text_hash import mix, shingle_sets, slices

SKETCH_BITS = 19
MAX_MATCHES = 4
#: Rounds of verification against centres end after so many, or when a lesser share of the candidates links.
MAX_ROUNDS = 6
WORTHWHILE = 0.25
#: Cost of verifying a candidate, in units of one index entry read.
VERIFY_COST = 20.0
#: A set that one row in so many has is hot; there are no more hot ones than that.
HOT_SHARE = 1000
#: Ids (8 bytes each) of documents to verify up to which they are broadcast.
MAX_BROADCAST_IDS = 1_000_000


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _summaries(size: int):
    """Per document: set size and a 128-bit key of the set; per task: counts of shingles by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int32)
        for batch in batches:
            for b in slices(batch, "text"):
                sets = shingle_sets(b.column("text"), size)
                n = np.array([len(s) for s in sets], np.int64)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                buckets, times = np.unique(_bucket(flat), return_counts=True)
                counts[buckets] += times.astype(np.int32)
                keys = []
                for salt in (0x51ED270B7F4A7C15, 0x2545F4914F6CDD1D):
                    run_sum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(flat ^ np.uint64(salt)))])
                    at = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
                    keys.append(mix(run_sum[at[1:]] - run_sum[at[:-1]] + n.astype(np.uint64)).view(np.int64))
                none = pa.nulls(len(n), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(keys[0]), pa.array(keys[1]), none, none], names=["doc_id", "n", "k1", "k2", "bucket", "seen"])
        found = np.flatnonzero(counts)
        for i in range(0, len(found), 1 << 15):
            at = found[i : i + (1 << 15)]
            none = pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(at), pa.array(counts[at].astype(np.int64))], names=["doc_id", "n", "k1", "k2", "bucket", "seen"])

    return run


def choose_prefix(frequency: np.ndarray, n: int, overlap: int) -> tuple[int, int]:
    """(prefix length, matches asked for) at the least estimated cost.

    ``frequency`` estimates in how many other documents each shingle occurs, in
    global order. A candidate that must share l prefix shingles appears at
    l entries at least, so there are at most ``entries / l`` of them.
    """
    entries = np.cumsum(frequency)
    best = None
    for matches in range(1, min(MAX_MATCHES, overlap) + 1):
        length = n - overlap + matches
        cost = length + entries[length - 1] * (1 + VERIFY_COST / matches)
        if best is None or cost < best[0]:
            best = (cost, length, matches)
    return best[1], best[2]


def _prefixes(size: int, num: int, den: int, sketch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.frombuffer(sketch.value, np.uint32).astype(np.int64)
        noise = float(np.median(seen))
        others = np.maximum(seen - noise - 3 * np.sqrt(noise) - 1, 0.0)  # beyond what chance puts in a bucket
        for batch in batches:
            for b in slices(batch, "text"):
                ids, rows = b.column("doc_id").to_pylist(), []
                for doc, s in zip(ids, shingle_sets(b.column("text"), size), strict=True):
                    n = len(s)
                    if doc is None or not n:
                        continue
                    bucket = _bucket(s)
                    order = np.argsort(seen[bucket], kind="stable")
                    length, matches = choose_prefix(others[bucket[order]], n, -(-num * n // den))
                    head = order[:length]
                    place = np.flatnonzero(seen[bucket[head]] > 1)  # a bucket seen once holds a shingle that no other document has
                    end = order[length - 1]
                    rows.append((doc, n, matches, (s[head[place]].view(np.int64), place), n - length, int(seen[bucket[end]]), int(s[end]) - (1 << 63), int(1000 * seen[bucket].mean())))
                if rows:
                    ends = pa.array(np.cumsum([0] + [len(r[3][0]) for r in rows]).astype(np.int32))
                    prefix, places = (pa.ListArray.from_arrays(ends, pa.array(np.concatenate([r[3][k] for r in rows]).astype(t))) for k, t in ((0, np.int64), (1, np.int32)))
                    columns = {"node": 0, "n": 1, "matches": 2, "beyond": 4, "end_seen": 5, "end_hash": 6, "typical": 7}
                    yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], pa.int64()) for i in columns.values()), prefix, places], names=[*columns, "prefix", "places"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                sets = [s.tobytes() for s in shingle_sets(b.column("text"), size)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sets, pa.binary())], names=["node", "items"])

    return run


def _links(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("sx").to_pylist(), b.column("sy").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                shared = int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x)) if len(y) else 0
                keep.append(den * shared >= num * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(keep, pa.bool_())], names=["a", "b", "linked"])

    return run


def _only(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """``rows`` whose ``key`` is among ``ids`` (a written table of one column, id)."""
    if ids.count() <= MAX_BROADCAST_IDS:  # beyond that the rows are shuffled
        ids = F.broadcast(ids)
    return rows.join(ids, rows[key] == ids["id"], "left_semi")


def full_sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, items): the whole sets of the documents that ``nodes`` names, made once for all rounds."""
    ids = written(nodes.select(F.col("node").alias("id")).distinct(), "ids")
    return written(_only(docs, "doc_id", ids).mapInArrow(_sets(size), "node long, items binary"), "sets")


def verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, linked) of the pairs, by the full sets of both. Only the sets in question are shuffled."""
    ids = written(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "ids")
    wanted = _only(sets, "node", ids)
    both = pairs.join(wanted.select(F.col("node").alias("a"), F.col("items").alias("sx")), "a")
    both = both.join(wanted.select(F.col("node").alias("b"), F.col("items").alias("sy")), "b").select("a", "b", "sx", "sy")
    out = written(both.mapInArrow(_links(num, den), "a long, b long, linked boolean"), "links")
    drop_written(ids)
    return out


def _with_class(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``rows`` with the component of the class of their set.

    A set that a large share of the rows has would bring them all to one task:
    such classes, ``HOT_SHARE`` at most, are broadcast, the others are shuffled.
    """
    total = rows.count()
    hot = F.broadcast(classes.where(F.col("c") * HOT_SHARE >= total).select("k1", "k2", F.col("component").alias("hot")))
    rows = rows.join(hot, ["k1", "k2"], "left")
    rest = rows.where("hot is null").join(classes.where(F.col("c") * HOT_SHARE < total).select("k1", "k2", "component"), ["k1", "k2"], "left")
    return rows.where("hot is not null").select("doc_id", "n", F.col("hot").alias("component")).unionByName(rest.select("doc_id", "n", "component"))


def jaccard_groups(docs: DataFrame, *, shingle_words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each row: links where ``den * intersection >= num * union``.

    A component is named by its smallest document id.

    * A-Z are lower-cased; words are runs of bytes other than ASCII white space;
      a text of fewer than ``shingle_words`` words is one shingle;
    * null or empty texts and texts without words link with nothing;
    * rows that repeat an id and a text form one group; an id that is repeated
      with another text is judged row by row;
    * a row with a null id links with nothing and has a null component;
    * further columns are ignored; an empty table gives an empty result.
    """
    lean_batches(docs.sparkSession)
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    first = written(d.mapInArrow(_summaries(shingle_words), "doc_id long, n long, k1 long, k2 long, bucket long, seen long"), "summaries")
    counts = first.where("bucket is not null").groupBy("bucket").agg(F.sum("seen").alias("seen")).toArrow()
    sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
    sketch[counts["bucket"].to_numpy()] = np.minimum(counts["seen"].to_numpy(), 0xFFFFFFFF)
    shared_sketch = spark.sparkContext.broadcast(sketch.tobytes())  # 2 MB, whatever the input
    rows = first.where("bucket is null").select("doc_id", "n", "k1", "k2")
    classes = rows.where("n > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c"))

    prefixes = d.mapInArrow(_prefixes(shingle_words, num, den, shared_sketch), "node long, n long, matches long, beyond long, end_seen long, end_hash long, typical long, prefix array<long>, places array<int>")
    prefixes = written(prefixes.join(classes.select(F.col("rep").alias("node")).distinct(), "node", "left_semi"), "prefixes")
    # The centre of a group of copies is the document whose shingles are the most frequent: the one without edits.
    entries = prefixes.select("node", "typical", F.explode(F.arrays_zip("prefix", "places")).alias("e")).select("node", "typical", F.col("e.prefix").alias("token"), F.col("e.places").alias("place"))
    centres = entries.groupBy("token").agg(F.max_by("node", "typical").alias("centre"), F.count("*").alias("members")).where("members > 1").select("token", "centre")
    entries = written(entries.join(centres, "token"), "entries")  # entries of shared shingles
    own = entries.groupBy("node").agg(F.count("*").alias("own"))
    most = F.floor(((F.col("own") + F.col("beyond")) * (num + den) - num * F.col("n")) / num)
    about = prefixes.join(own, "node").select("node", F.struct("n", "matches", most.alias("most"), F.struct("end_seen", "end_hash").alias("end")).alias("of"))

    sizes, sets = prefixes.select("node", "n"), full_sets(d, entries, shingle_words)

    def best_centre(pairs: DataFrame) -> DataFrame:
        """Of the (a, b) pairs, the one for each b that shares most prefix shingles, if sizes allow a link."""
        p = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"))
        p = p.groupBy("b").agg(F.max_by("a", F.struct("shared", F.bitwise_not("a"))).alias("a"))
        p = p.join(sizes.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
        return p.where(den * F.least("na", "nb") >= num * F.greatest("na", "nb")).select("a", "b")

    tried = verify(written(best_centre(entries.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b"))), "stars"), sets, num, den)
    links = tried.where("linked").select("a", "b")
    groups = written(components(links), "groups")
    for turn in range(MAX_ROUNDS):
        e = entries.join(groups, "node", "left").select("token", "node", "typical", F.coalesce("component", "node").alias("component"))
        parts = e.groupBy("token", "component").agg(F.count("*").alias("c"), F.min("node").alias("low"), F.max_by("node", "typical").alias("high"))
        mixed = parts.groupBy("token").agg(F.count("*").alias("parts"), F.max(F.struct("c", "component", "low", "high")).alias("m")).where("parts > 1")
        mixed = mixed.select("token", F.col("m.component").alias("major"), F.col("m.low" if turn % 2 else "m.high").alias("centre"))
        e = written(e.join(mixed, "token"), "mixed")
        stars = e.where("component <> major").select(F.col("centre").alias("a"), F.col("node").alias("b"))
        stars = best_centre(stars.join(tried.select("a", "b").distinct(), ["a", "b"], "left_anti"))
        found = verify(written(stars, "stars"), sets, num, den)
        tried = tried.unionByName(found)
        links = tried.where("linked").select("a", "b")
        groups = written(components(links), "groups")
        if found.where("linked").count() < WORTHWHILE * found.count():
            break
    e = entries.join(groups, "node", "left").join(about, "node").select("token", "node", "place", "of", F.coalesce("component", "node").alias("component"))
    mixed = e.groupBy("token", "component").agg(F.count("*").alias("c")).groupBy("token").agg(F.count("*").alias("parts"), F.max(F.struct("c", "component")).alias("m")).where("parts > 1").select("token", F.col("m.component").alias("major"))
    e = written(e.join(mixed, "token"), "mixed")
    x, y = e.where("component <> major").alias("x"), e.alias("y")
    across = (F.col("x.token") == F.col("y.token")) & (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.major")) | (F.col("x.node") < F.col("y.node")))
    # The prefix that ends first has ``own`` shingles that any other prefix holds, and ``beyond`` behind it:
    # with a larger partner than ``most`` these can't reach the threshold.
    fits = ((F.col("x.of.end") <= F.col("y.of.end")) & (F.col("y.of.n") <= F.col("x.of.most"))) | ((F.col("y.of.end") <= F.col("x.of.end")) & (F.col("x.of.n") <= F.col("y.of.most")))
    nx, ny = F.col("x.of.n"), F.col("y.of.n")
    # Sets of these sizes must share so many shingles, hence one of them in prefixes of this pair's own length,
    share = lambda a, b: F.ceil(num * (a + b) / (num + den))
    within = (F.col("x.place") < nx - share(nx, ny) + 1) & (F.col("y.place") < ny - share(nx, ny) + 1)
    across = across & fits & within & (den * F.least(nx, ny) >= num * F.greatest(nx, ny))
    pairs = x.join(y, across).groupBy(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).agg(F.count("*").alias("c"))
    # and ``matches`` of them in prefixes that are longer by as much.
    heads = prefixes.select("node", F.struct("n", "matches", F.arrays_zip("prefix", "places").alias("e")).alias("head"))
    pairs = pairs.join(heads.select(F.col("node").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("node").alias("b"), F.col("head").alias("y")), "b")
    matches = F.least("x.matches", "y.matches")
    limit = share(F.col("x.n"), F.col("y.n")) - matches
    part = lambda h: F.transform(F.filter(F.col(f"{h}.e"), lambda t: t.places < F.col(f"{h}.n") - limit), lambda t: t.prefix)
    pairs = pairs.withColumn("shared", F.size(F.array_intersect(part("x"), part("y")))).withColumn("matches", matches)
    rest = written(pairs.where("shared >= matches").select("a", "b").join(tried.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    more = verify(rest, sets, num, den).where("linked").select("a", "b")
    named = components(links.unionByName(more))

    classes = classes.join(named.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", "c", F.coalesce("component", "rep").alias("component"))
    out = _with_class(rows, written(classes, "classes"))
    drop_written(sets)
    own = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group: the one whose id names it. Rows with a null id stay.

    Of rows that repeat an id and a text one is kept; rows that repeat an id with
    another text are documents of their own.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    again = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("times")).where("times > 1").select(id_col)
    if again.isEmpty():
        gone = jaccard_groups(docs, **options).where("doc_id <> component_id").select("doc_id").distinct().alias("gone")
        return docs.alias("kept").join(gone, F.col(f"kept.{id_col}") == F.col("gone.doc_id"), "left_anti")
    repeated = docs.join(again, id_col, "left_semi").dropDuplicates([id_col, text_col])
    rows = written(docs.join(again, id_col, "left_anti").select(docs.columns).unionByName(repeated.select(docs.columns)), "rows")
    # Numbers in the order of the ids stand for them, so that each row has its own.
    row, text_hash = unused(rows, "row"), F.xxhash64(text_col)
    keys = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("key_id"), text_hash.alias("key_hash")).distinct().orderBy("key_id", "key_hash")
    keys = written(keys.withColumn(row, F.monotonically_increasing_id()), "keys").alias("keys")
    rows = rows.alias("rows").join(keys, (F.col(f"rows.{id_col}") == F.col("keys.key_id")) & (F.xxhash64(f"rows.{text_col}") == F.col("keys.key_hash")), "left")
    rows = rows.select("rows.*", F.col(f"keys.{row}"))
    gone = jaccard_groups(rows, **options | {"id_col": row}).where("doc_id <> component_id").select(F.col("doc_id").alias(row))
    return rows.join(gone, row, "left_anti").select(docs.columns)
