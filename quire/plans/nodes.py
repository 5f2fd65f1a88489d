"""The common form of documents: a row a block, whatever format it comes from.

A block has its place (``section``, ``region``, ``ord``), its kind, and what the
kind needs: runs of text, a level, the cells of a table, the lines of a note.
Items of lists are rows of their own; ``list_no`` says which list they are of.

Blocks form a tree. ``parent`` is the ``ord`` of the block that owns a block (an
item, a quote, a note or a table; null at the top), ``nest`` the number of owners,
and ``cell`` says which cell of a table it is in (:func:`cell_key`). ``via`` is how
it hangs there: ``blocks`` of its owner, or ``children`` if one of the owners is an
item that has it as an item of a list below itself. What an item, quote or note
says itself, as its one or first paragraph, is its own ``runs``; a cell's text is
in ``cells`` and, where it is more than a plain text, also in blocks (``owned``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.group import islands, unused
from quire.store import kept

RUN = "struct<text:string,bold:boolean,italic:boolean,underline:boolean,strike:boolean,superscript:boolean,subscript:boolean,code:boolean,colour:string,font:string,link:string,ruby:string,note:string>"
CELL = "struct<row:int,col:int,text:string,colspan:int,rowspan:int,is_header:boolean,owned:boolean>"

#: Columns of a block beside the document's key, with their types.
FIELDS = {
    "section": "int", "region": "string", "ord": "bigint", "kind": "string", "level": "int", "depth": "int", "ordered": "boolean", "list_no": "int", "number": "int", "checked": "boolean",
    "language": "string", "text": "string", "runs": f"array<{RUN}>", "src": "string", "alt": "string", "note_id": "string", "cells": f"array<{CELL}>",
    "parent": "bigint", "cell": "bigint", "nest": "int", "via": "string", "start": "int",
}
_RUN_FIELDS = [f.split(":") for f in RUN[7:-1].split(",")]


def block(**columns: Column) -> list[Column]:
    """The columns of a block; those not given are null (section 0, region body, depth 0)."""
    given = {"section": F.lit(0), "region": F.lit("body"), "depth": F.lit(0), "nest": F.lit(0)} | columns
    return [given.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in FIELDS.items()]


def cell_key(row: Column, col: Column) -> Column:
    """A cell's number within its table, in the order of rows and columns."""
    return F.shiftleft(row.cast("bigint"), 16) + col


def cell(row: Column, col: Column, text: Column, colspan: Column | None = None, rowspan: Column | None = None, is_header: Column | None = None, owned: Column | None = None) -> Column:
    """A cell; spans are 1 and the first row is the header unless given otherwise."""
    one = F.lit(1)
    values = (row, col, text, one if colspan is None else colspan, one if rowspan is None else rowspan, row == 0 if is_header is None else is_header, F.lit(False) if owned is None else owned)
    return F.struct(*(v.alias(f.split(":")[0]) for v, f in zip(values, CELL[7:-1].split(","), strict=True))).cast(CELL)


def run(**columns: Column) -> Column:
    """A run; flags not given are false, other parts null."""
    return F.struct(*((columns[n] if n in columns else F.lit(False) if t == "boolean" else F.lit(None)).cast(t).alias(n) for n, t in _RUN_FIELDS))


#: Parts of a run that make its format.
FORMAT = ("bold", "italic", "underline", "strike", "superscript", "subscript", "code", "colour", "font")


def is_plain(r: Column) -> Column:
    """Whether a run has the plain format."""
    return ~(r.bold | r.italic | r.underline | r.strike | r.superscript | r.subscript | r.code) & r.colour.isNull() & r.font.isNull()


def plain_runs(text: Column) -> Column:
    return F.array(run(text=text))


def runs_text(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: F.coalesce(r.text, F.lit(""))), "")


def without_text(runs: Column, text: Column) -> Column:
    """Runs, a single one without its text if it is ``text``, so that tables hold it once."""
    one = F.get(runs, F.lit(0))
    return F.when((F.size(runs) == 1) & (one.text == text), F.array(one.withField("text", F.lit(None).cast("string")))).otherwise(runs)


def with_text(runs: Column, text: Column) -> Column:
    """The runs that :func:`without_text` has shortened."""
    one = F.get(runs, F.lit(0))
    return F.when((F.size(runs) == 1) & one.text.isNull(), F.array(one.withField("text", text))).otherwise(runs)


def adjacent_links(runs: Column) -> Column:
    """Runs as (link, runs) groups of neighbours with equal links (null equal to null)."""
    n = F.size(runs)
    edge = F.filter(F.sequence(F.lit(0), n), lambda i: (i == n) | (i == 0) | ~F.get(runs, i).link.eqNullSafe(F.get(runs, i - 1).link))
    groups = F.transform(F.slice(edge, F.lit(1), F.size(edge) - 1), lambda i, k: F.struct(F.get(runs, i).link.alias("link"), F.slice(runs, i + 1, F.get(edge, k + 1) - i).alias("runs")))
    return F.when(n > 0, groups).otherwise(F.slice(groups, 1, 0))


def with_cells(every: DataFrame, cells: DataFrame, by: list[str]) -> DataFrame:
    """Tables get their ``cells`` (``by``, parent, cell, row, col and spans); a cell's plain paragraph (in whatever font) is its text, other blocks stay beside it.

    Tables without cells go.
    """
    owner = [*by, "parent", "cell"]
    inside = every.where("cell is not null")
    simple = (F.col("kind") == "paragraph") & (F.size("runs") <= 1) & ~F.exists("runs", lambda r: r.note.isNotNull() | r.link.isNotNull() | r.ruby.isNotNull() | ~is_plain(r.withField("font", F.lit(None).cast("string"))))
    texts = F.array_sort(F.collect_list(F.when(F.col("kind").isin("paragraph", "heading", "code"), F.struct("ord", "text"))))
    g = inside.groupBy(*owner).agg(F.count("*").alias("n"), F.every(simple).alias("simple"), F.array_join(F.filter(F.transform(texts, lambda x: x.text), lambda t: F.trim(t) != ""), " ").alias("text"))
    g = g.select(*owner, "text", ((F.col("n") > 1) | ~F.col("simple")).alias("owned"))
    c = cells.select(*owner, "row", "col", "colspan", "rowspan").join(g, owner, "left")
    one = cell(F.col("row"), F.col("col"), F.coalesce("text", F.lit("")), F.col("colspan"), F.col("rowspan"), F.col("row") == 0, F.coalesce("owned", F.lit(False)))
    grid = c.groupBy(*by, F.col("parent").alias("ord")).agg(F.array_sort(F.collect_list(one)).alias("found"))
    tables = every.where("kind = 'table'").join(grid, [*by, "ord"]).withColumn("cells", F.col("found")).select(every.columns)
    lone = inside.join(g.where("not owned").select(*owner), owner, "left_anti").unionByName(every.where("cell is null"))
    return lone.where("kind <> 'table'").unionByName(tables)


def spoken(every: DataFrame, by: list[str]) -> DataFrame:
    """What an item or note says itself: an item's first paragraph, a note's only one. Notes without blocks go."""
    w = Window.partitionBy(*by, "parent")
    d = every.where("parent is not null").withColumn("held", F.count("*").over(w)).withColumn("nth", F.row_number().over(w.orderBy("ord")))
    first = d.where("cell is null and nth = 1").select(*by, F.col("parent").alias("ord"), "held", F.when(F.col("kind") == "paragraph", F.struct("ord", "text", "runs")).alias("first"))
    box = every.where("kind in ('item', 'footnote') and runs is null").join(first, [*by, "ord"], "left")
    own = (F.col("kind") == "item") | (F.col("held") == 1)
    box = box.where("kind = 'item' or held is not null").withColumn("said", F.when(own, F.col("first")))
    gone = box.where("said is not null").select(*by, F.col("said.ord").alias("ord"))
    box = box.withColumn("text", F.when(F.col("kind") == "item", F.coalesce("said.text", F.lit(""))).otherwise(F.col("said.text"))).withColumn("runs", F.col("said.runs"))
    rest = every.where("kind not in ('item', 'footnote') or runs is not null")
    inner = rest.where("parent is not null").join(gone, [*by, "ord"], "left_anti")  # what is at the top is nobody's text
    return rest.where("parent is null").unionByName(inner).unionByName(box.select(every.columns))


def fold(rows: DataFrame, by: list[str], piece, owned, nest: int | None = None) -> DataFrame:
    """The top blocks of ``rows`` with ``piece``, a text made of the block and of the texts of the blocks below it.

    Levels are gone through from the innermost to the top. ``piece`` gives the text
    of a struct of a block's columns, ``inner`` (text of its blocks, null without) and
    ``in_cells`` (texts by cell); ``owned`` gives these two of each owner
    (``by``, section, parent) from its blocks' pieces. ``nest`` is how deep blocks are;
    null: it is looked up, for which ``rows`` are written.
    """
    if nest is None:
        rows = kept(rows)
        nest = rows.agg(F.max("nest")).first()[0] or 0
    none = {"inner": F.lit(None).cast("string"), "in_cells": F.lit(None).cast("map<bigint,string>")}
    made = lambda d: d.withColumn("piece", piece(F.struct(*d.columns)))
    level = (rows.where(F.col("nest") == nest) if nest else rows).withColumns(none)
    for d in range(nest - 1, -1, -1):
        below = owned(made(level), by).withColumnRenamed("parent", "ord")
        level = rows.where(F.col("nest") == d).join(below, [*by, "section", "ord"], "left").select(*rows.columns, "inner", "in_cells")
    return made(level)


def number_lists(rows: DataFrame, by: list[str], same_kind: bool, apart: str | None = None) -> DataFrame:
    """``list_no`` and ``number`` of the items among blocks, within their owners.

    A list ends at any other block and, with ``same_kind``, where ``ordered``
    changes; without it the first item's ``ordered`` goes for all. Items that hang
    on others by ``depth`` alone (``via`` is null) count within the item they hang
    on; such a first item is taken for one of depth 0. Numbers count from the first
    item's ``start`` (null: 1). Items that differ in the column ``apart``, which
    goes, are of different lists.
    """
    is_item = F.col("kind") == "item"
    key = F.struct(is_item, F.when(is_item, F.col("ordered"))) if same_kind else is_item
    if apart:
        key = F.struct(key.alias("key"), F.when(is_item, F.col(apart)).alias("apart"))
    owner = [*by, "section", "region", "parent", "cell"]
    d = islands(rows, owner, ["ord"], key, "list_no")
    d = d.drop(apart) if apart else d
    w = Window.partitionBy(*owner, "list_no").orderBy("ord")
    hangs, top = unused(d, "hangs"), unused(d, "top")
    d = d.withColumn(hangs, is_item & F.col("via").isNull() & (F.row_number().over(w) > 1) & (F.col("depth") > 0))
    d = d.withColumn("depth", F.when(F.col("via").isNotNull(), F.col("depth")).when(F.col(hangs), 1).otherwise(0))
    if not same_kind:
        d = d.withColumn("ordered", F.when(is_item, F.first("ordered").over(w)))
    first = F.when(F.col("ordered"), F.coalesce(F.first("start").over(w), F.lit(1))).otherwise(1)
    d = d.withColumn(top, F.sum((~F.col(hangs)).cast("int")).over(w))
    within = Window.partitionBy(*owner, "list_no", top).orderBy("ord")
    number = F.when(F.col(hangs), F.row_number().over(within) - 1).otherwise(F.col(top) + first - 1)
    return d.withColumn("number", F.when(is_item, number).cast("int")).withColumn("list_no", F.when(is_item, F.col("list_no")).cast("int")).drop(hangs, top)


def descend(nodes: DataFrame, by: list[str], node: str, parent: str, closed: Column, levels: int = 32) -> DataFrame:
    """``by..., node, depth`` of the nodes that a walk from the roots reaches which doesn't enter nodes that are ``closed``.

    ``levels`` bounds the walk, as the nesting of documents is bounded. Each level is written, so none is computed twice.
    """
    every = kept(nodes.select(F.struct(*by).alias("of"), F.col(node).alias("node"), F.col(parent).alias("parent"), closed.alias("closed")))
    here = kept(every.where("parent is null").select("of", "node", "closed", F.lit(0).alias("depth")))
    found = [here]
    for depth in range(1, levels):
        up = here.where("not coalesce(closed, false)").select("of", F.col("node").alias("parent"))
        here = kept(every.join(up, ["of", "parent"]).select("of", "node", "closed", F.lit(depth).alias("depth")))
        if here.isEmpty():
            break
        found.append(here)
    out = reduce(DataFrame.unionByName, found)
    return out.select(*(F.col(f"of.{k}").alias(k) for k in by), F.col("node").alias(node), "depth")


def statistics(nodes: DataFrame, by: list[str], assets: DataFrame | None = None) -> DataFrame:
    """``n_sections, n_blocks, n_chars, n_assets`` of each document.

    Blocks are those at the top of bodies, a list as one. Characters are code
    points of texts, code, formulas and cells, in blocks at any depth of bodies;
    those that hang on an item as children don't count. ``assets`` has a row for each.
    """
    body = F.col("region") == "body"
    top = body & F.col("parent").isNull()
    is_item = F.col("kind") == "item"
    cells = F.coalesce(F.aggregate(F.transform(F.filter("cells", lambda c: ~F.coalesce(c.owned, F.lit(False))), lambda c: F.char_length(c.text)), F.lit(0), lambda a, b: a + b), F.lit(0))
    hangs = (F.col("via") == "children") | (F.col("via").isNull() & (F.col("depth") > 0))
    said = F.when(F.col("kind").isin("heading", "paragraph", "code", "math", "quote", "item", "footnote"), F.char_length("text")).when(F.col("kind") == "table", cells)
    lists = F.countDistinct(F.when(top & is_item, F.struct("section", "list_no")))
    out = nodes.groupBy(*by).agg(F.countDistinct("section").alias("n_sections"), (F.count_if(top & ~is_item) + lists).alias("n_blocks"), F.coalesce(F.sum(F.when(body & ~F.coalesce(hangs, F.lit(False)), said)), F.lit(0)).cast("bigint").alias("n_chars"))
    if assets is None:
        return out.withColumn("n_assets", F.lit(0).cast("bigint"))
    held = assets.groupBy(*by).agg(F.count("*").alias("n_assets"))
    return out.join(held, by, "left").withColumn("n_assets", F.coalesce("n_assets", F.lit(0)))
