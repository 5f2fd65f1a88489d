"""Order-dependent operators: islands, numbering, regions and intervals.

What belongs to one document is ordered within it, so every window is
partitioned by document; nothing is sorted globally. Where a document's lines
come as one text, islands are found inside the row and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.classify import list_kind


def list_islands(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, list_no, kind, first_line, n_items``: runs of list lines of one kind, in a text's lines."""
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    kinds = F.transform(lines, lambda x: F.coalesce(list_kind(x), F.lit("")))
    d = docs.select(F.col(id_col).alias("doc_id"), F.element_at(F.transform(F.array(kinds), _islands), 1).alias("runs"))
    d = d.select("doc_id", F.posexplode_outer("runs").alias("list_no", "r")).where("r is not null")
    return d.select("doc_id", F.col("list_no").cast("long").alias("list_no"), "r.kind", F.col("r.first").cast("long").alias("first_line"), F.col("r.n").cast("long").alias("n_items"))


def _islands(kinds: Column) -> Column:
    """(kind, first, n) of each run of equal non-empty kinds."""
    n = F.size(kinds)
    at = F.sequence(F.lit(0), n - 1)
    kind = lambda i: F.get(kinds, i)
    edge = F.filter(at, lambda i: (i == 0) | (kind(i) != kind(i - 1)))
    runs = F.transform(edge, lambda i, k: F.struct(kind(i).alias("kind"), i.alias("first"), (F.coalesce(F.get(edge, k + 1), n) - i).alias("n")))
    return F.filter(runs, lambda r: r.kind != "")


def unused(rows: DataFrame, stem: str) -> str:
    """A column name that ``rows`` doesn't have."""
    taken = {c.lower() for c in rows.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def islands(rows: DataFrame, by: list[str], order: list[str], key: Column, name: str = "island") -> DataFrame:
    """Number the runs of equal ``key`` (nulls equal) within ``by`` from 0."""
    w = Window.partitionBy(*by).orderBy(*order)
    change = F.when(F.row_number().over(w) == 1, 0).otherwise((~key.eqNullSafe(F.lag(key).over(w))).cast("int"))
    mark = unused(rows, "change")
    return rows.withColumn(mark, change).withColumn(name, F.sum(mark).over(w)).drop(mark)


def nested_items(rows: DataFrame, by: list[str], order: list[str], depth: str) -> DataFrame:
    """The item that each list row hangs on: null at depth 0, else the last one of depth 0.

    A first row is taken for depth 0 whatever it says. ``item`` numbers the rows.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    number = F.row_number().over(w)
    top = (number == 1) | (F.col(depth) == 0)
    last = F.last_value(F.when(F.col("top"), F.col("number")), ignoreNulls=True).over(Window.partitionBy(*(F.col(f"r.{k}") for k in by)).orderBy("number"))
    d = rows.select(F.struct("*").alias("r"), number.alias("number"), top.alias("top"))
    return d.select("r.*", F.col("number").alias("item"), F.when(~F.col("top"), last).alias("parent_item"))


def interval_value(rows: DataFrame, by: list[str], order: list[str], opens: Column, closes: Column, value: Column, name: str) -> DataFrame:
    """The value of the interval each row lies in: from an opening row to a closing one, or to the end."""
    w = Window.partitionBy(*by).orderBy(*order)
    mark = F.when(opens, F.struct(value.alias("v"))).when(closes, F.struct(F.lit(None).cast("string").alias("v")))
    return rows.withColumn(name, F.last_value(mark, ignoreNulls=True).over(w).getField("v"))


def regions(rows: DataFrame, by: list[str], order: list[str], marker: Column, name: str = "region") -> DataFrame:
    """``header``, ``footer`` or ``body`` of each row by the markers before it; marker rows go.

    An end marker of either kind returns to the body. Where a region is still open
    at the end, all rows are the body's; ``moved`` then ranks those of headers (1)
    and footers (2), which come behind the others (0).
    """
    w, whole = Window.partitionBy(*by).orderBy(*order), Window.partitionBy(*by)
    state = F.when(marker.isin("header", "footer"), marker).when(marker.isin("/header", "/footer"), "body")
    sign, last, at = (unused(rows, x) for x in ("sign", "last", "at"))
    d = rows.withColumn(sign, marker).withColumn(name, F.coalesce(F.last_value(state, ignoreNulls=True).over(w), F.lit("body")))
    d = d.withColumn(at, F.when(state.isNotNull(), F.struct(*order))).withColumn(last, F.coalesce(F.max_by(state, at).over(whole), F.lit("body")))
    open_end = F.col(last) != "body"
    d = d.withColumn("moved", F.when(open_end & (F.col(name) == "header"), 1).when(open_end & (F.col(name) == "footer"), 2).otherwise(0))
    d = d.withColumn(name, F.when(open_end, "body").otherwise(F.col(name)))
    return d.where(F.col(sign).isNull()).drop(sign, last, at)


def run_ends(runs: DataFrame, by: list[str], order: str, total: str) -> DataFrame:
    """Where each run ends: at the next one's start, at ``total`` for the last."""
    w = Window.partitionBy(*by).orderBy(order)
    return runs.withColumn("run_end", F.least(F.coalesce(F.lead(order).over(w), F.col(total)), F.col(total)))


def numbered_notes(notes: DataFrame, by: list[str], order: list[str], is_endnote: str) -> DataFrame:
    """Note ids ``footnote-N`` and ``endnote-N``, counted through a document."""
    w = Window.partitionBy(*by, is_endnote).orderBy(*order)
    kind = F.when(F.col(is_endnote), "endnote-").otherwise("footnote-")
    return notes.withColumn("note_id", F.concat(kind, F.row_number().over(w).cast("string")))


def distinct_names(rows: DataFrame, by: list[str], order: list[str], name: str, out: str = "unique_name") -> DataFrame:
    """Names that collide get `` (N)`` before their extension, from the second on."""
    w = Window.partitionBy(*by, name).orderBy(*order)
    n = F.row_number().over(w)
    stem, ext = F.regexp_extract(name, r"^(.+?)([.][^.]*)?$", 1), F.regexp_extract(name, r"^.+?([.][^.]*)?$", 1)
    dotted = F.col(name).rlike(r"^[.][^.]*$")
    tagged = lambda a, b: F.concat(a, F.lit(" ("), n.cast("string"), F.lit(")"), b)
    return rows.withColumn(out, F.when(n == 1, F.col(name)).when(dotted, tagged(F.col(name), F.lit(""))).otherwise(tagged(stem, ext)))


def dictionary(rows: DataFrame, by: list[str], order: str, key: list[str]) -> DataFrame:
    """Distinct keys with ids in first-seen order from 1, a row a key."""
    d = rows.groupBy(*by, *key).agg(F.min(order).alias("first_seen"))
    return d.withColumn("id", F.row_number().over(Window.partitionBy(*by).orderBy("first_seen", *key)))


def enclosing(rows: DataFrame, by: list[str], order: str, level: str) -> DataFrame:
    """``subtree_end`` of each row of a level sequence: the first later row that isn't deeper (null: none).

    One pass over sorted partitions: open rows are on a stack, and a row closes
    those it isn't deeper than. What is held is as much as rows are nested,
    however long a sequence is.
    """
    d = rows.select(*by, order, level)
    names = d.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, here = [], None
        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:-2] != here:
                    out += [(*x, None) for x in stack]
                    stack, here = [], row[:-2]
                while stack and stack[-1][-1] >= row[-1]:
                    out.append((*stack.pop(), row[-2]))
                stack.append(row)
            if out:
                yield made(b.schema, out)
            schema = b.schema
        if stack:
            yield made(schema, [(*x, None) for x in stack])

    def made(schema: pa.Schema, out: list[tuple]) -> pa.RecordBatch:
        kinds = [*schema.types, schema.field(order).type]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[*names, "subtree_end"])

    schema = d.withColumn("subtree_end", F.when(F.lit(True), F.col(order))).schema
    schema["subtree_end"].nullable = True
    return d.repartition(*by).sortWithinPartitions(*by, order).mapInArrow(run, schema)


def duplicate_entries(names: DataFrame, by: list[str], order: str, name: str, out: str = "entry") -> DataFrame:
    """Names of a package's entries that collide get ``_N`` before their extension, N from 2, until they are free.

    A document's names are gone through in order, as each may take a name that a later one has: one pass over
    sorted partitions, which holds a document's names. A name's N only grows, so none is tried twice. Null stays null.
    """
    d = names.select(*by, order, name)
    n = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, taken, after = None, set(), {}
        for b in batches:
            entries = []
            for *key, _, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != here:
                    here, taken, after = key, set(), {}
                entry = x
                if x in taken:
                    stem, dot, ext = x.rpartition(".")
                    stem, ext = (stem, dot + ext) if dot else (x, "")
                    k = after.get(x, 2)
                    while (entry := f"{stem}_{k}{ext}") in taken:
                        k += 1
                    after[x] = k + 1
                if x is not None:
                    taken.add(entry)
                entries.append(entry)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n + 1)), pa.array(entries, pa.string())], names=[*b.schema.names[: n + 1], out])

    schema = d.select(*by, order, F.col(name).cast("string").alias(out)).schema
    return d.repartition(*by).sortWithinPartitions(*by, order, name).mapInArrow(run, schema)
