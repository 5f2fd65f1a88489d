"""Document fingerprints by winnowing.

Words are hashed (in scripts that are written without spaces, each character is
a word), and a polynomial modulo the prime 2**31 - 1 rolls over ``k`` of
them in a row. Of every ``w`` hashes in a row the smallest is kept, of equal ones
the rightmost, with its position. Texts that share ``k + w - 1`` words in a row
share a fingerprint entry; matches of fewer than ``k`` words are never seen.

Everything is DataFrame functions on arrays within a row; rows are shuffled only
to put a document beside the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import let

PRIME = (1 << 31) - 1
BASE = 1_000_003
_LOW = (1 << 32) - 1

#: Where words end: at white space, and around characters of scripts that are written without spaces.
_UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
_BREAK = rf"[ \t\n\x0B\f\r]+|(?<={_UNSPACED})|(?={_UNSPACED})"

#: Rows in a range of ids, which one task sorts: few in small tables, for the sake of many ranges, and never more than the second.
ROWS_A_RANGE = (200, 20_000)
_MANY_RANGES = 8192


def _beside(a: Column, b: Column, distance: Column | int, then) -> Column:
    """then(a[i], b[i + distance]) for each i that has both."""
    n = F.greatest(F.size(b) - distance, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1) + distance, n), then)


def _rolled(h: Column, k: int) -> Column:
    """Polynomial hashes of k words in a row, from hashes of half as many."""
    if k == 1:
        return h
    half = k // 2
    if k % 2:
        return let(h, lambda x: _beside(_rolled(x, k - 1), x, k - 1, lambda a, b: (a * BASE + b) % PRIME))
    power = pow(BASE, half, PRIME)
    return let(_rolled(h, half), lambda x: _beside(x, x, half, lambda a, b: (a * power + b) % PRIME))


def _minima(v: Column, w: int) -> Column:
    """The minimum of each w in a row (of all, if there are fewer), by doubling."""

    def grow(x: Column, have: int) -> Column:
        if have == w:
            return x
        step = min(have, w - have)
        return let(_beside(x, x, step, lambda a, b: F.least(a, b)), lambda y: grow(y, have + step))

    return F.when(F.size(v) <= w, F.filter(F.array(F.array_min(v)), lambda x: x.isNotNull())).otherwise(grow(v, 1))


def winnow(text: Column, k: int = 5, w: int = 16) -> Column:
    """Kept entries in text order, each ``hash * 2**32 + (2**31 - 1 - position)``.

    That the position counts backwards makes the rightmost of equal hashes the
    smallest entry. A text of fewer than ``k`` words is one entry, for the whole
    sequence; one without words has none.
    """
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _BREAK), "")

    def of(x: Column) -> Column:
        short = F.array((F.abs(F.xxhash64(x) % PRIME) * (1 << 32)) + PRIME)
        hashes = _rolled(F.transform(x, lambda y: F.abs(F.xxhash64(y) % PRIME)), k)
        packed = F.transform(hashes, lambda h, i: h * (1 << 32) + (F.lit(PRIME) - i))
        many = let(packed, lambda v: F.array_distinct(_minima(v, w)))
        return F.when(F.size(x) == 0, F.array().cast("array<bigint>")).when(F.size(x) < k, short).otherwise(many)

    return let(words, of)


def entry_hashes(entries: Column) -> Column:
    return F.array_distinct(F.transform(entries, lambda v: F.shiftright(v, 32)))


def as_string(entries: Column) -> Column:
    """``hash:position`` of each entry, the hash in hexadecimal."""
    return F.array_join(F.transform(entries, lambda v: F.concat(F.hex(F.shiftright(v, 32)), F.lit(":"), (F.lit(PRIME) - v.bitwiseAND(_LOW)).cast("string"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes; 1 for two empty ones."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


def _range_of(docs: DataFrame) -> Column:
    """The range of ids that a row is in: 0 for null ids, then ascending. Ranges hold about as many rows each."""
    n = docs.count()
    ranges = max(1, min(_MANY_RANGES, n // ROWS_A_RANGE[0]), n // ROWS_A_RANGE[1])
    found = docs.select(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)] or [0.5], max(10_000, 4 * ranges)).alias("p")).first()
    bounds = sorted(set(found["p"] or []))
    side = max(1, round(len(bounds) ** 0.5))
    heads = F.lit(bounds[::side]) if bounds else F.array().cast("array<bigint>")
    every = F.lit(bounds) if bounds else heads

    def at(x: Column) -> Column:  # first among every side-th bound, then among those between
        block = F.size(F.filter(heads, lambda b: b <= x))
        within = F.size(F.filter(F.slice(every, (block - 1) * side + 1, F.lit(side)), lambda b: b <= x))
        return F.when(block == 0, F.lit(0)).otherwise((block - 1) * side + within)

    return F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(at(F.col("doc_id")) + 1)


def beside_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, entries, next_text, next_entries): each row with the one after it in descending id.

    After the last comes the first. Rows that share an id are ordered by text;
    null ids come last. Texts are shuffled once, by range of ids; the first
    row of each range is added to the range before it.
    """
    d = docs.withColumn("range", _range_of(docs))
    tops = d.groupBy("range").agg(F.max("doc_id").alias("top"))
    order = Window.orderBy(F.desc("range"))  # over a row for each range
    tops = tops.select("range", "top", F.lag("range").over(order).alias("before"), F.max("range").over(Window.partitionBy()).alias("highest"), F.min("range").over(Window.partitionBy()).alias("lowest"))
    tops = tops.select("top", F.coalesce("before", "lowest").alias("before"))
    t = F.broadcast(tops)
    firsts = docs.join(t, docs.doc_id.eqNullSafe(F.col("top"))).groupBy("before").agg(F.min("text").alias("text"))
    firsts = firsts.select(F.col("before").alias("range"), F.struct("text", winnow(F.col("text")).alias("entries")).alias("over"))
    rows = d.select("range", "doc_id", "text", winnow(F.col("text")).alias("entries"))
    down = Window.partitionBy("range").orderBy(F.desc_nulls_last("doc_id"), "text")
    rows = rows.withColumn("next", F.lead(F.struct("text", "entries")).over(down)).join(firsts, "range", "left")
    return rows.withColumn("next", F.coalesce("next", "over")).select("doc_id", "text", "entries", F.col("next.text").alias("next_text"), F.col("next.entries").alias("next_entries"))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The edited text has its last ``floor(n_chars / 2)`` code points replaced by as
    many first ones of the next document (see :func:`beside_next`).

    * a null text is empty; an empty text has an empty fingerprint, is like
      another empty one (1) and unlike any other (0);
    * equal texts have equal fingerprints, whatever their rows' ids;
    * a single row is its own next document; an empty table gives an empty
      result; further columns are ignored.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = beside_next(d).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))

    def of(edited: Column) -> Column:
        mine = entry_hashes(F.col("entries"))
        return let(mine, lambda a: F.struct(as_string(edited).alias("f"), likeness(a, entry_hashes(edited)).alias("near_edited"), likeness(a, entry_hashes(F.col("next_entries"))).alias("near_next")))

    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), as_string(F.col("entries")).alias("fingerprint"), let(winnow(F.col("edited")), of).alias("e"))
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", F.col("e.f").alias("edited_fingerprint"), "e.near_edited", "e.near_next")
