"""Rendering of relational documents: Markdown and HTML text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.classify import has_spans
from quire.functions.text import cell_text, escape_html, escape_inline, escape_line_starts, escape_yaml, let, run_markdown
from quire.plans.nodes import CELL, cell_key, fold

_JOIN = "\n\n"


def in_order(by: Column | str, value: Column | str, separator: str) -> Column:
    """Values of a group joined in the order of ``by``."""
    value = F.col(value) if isinstance(value, str) else value
    by = F.col(by) if isinstance(by, str) else by
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by.alias("o"), value.alias("v")))), lambda x: x.v), separator)


def table_markdown(rows: Column) -> Column:
    """A pipe table of an array of rows of cell texts, the first one the header. Short rows are filled up."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    def made(rows: Column, width: Column) -> Column:
        full = F.transform(rows, lambda r: line(F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.coalesce(cell_text(F.get(r, i)), F.lit("")))))
        dashes = line(F.array_repeat(F.lit("---"), width))
        return let(full, lambda f: F.array_join(F.concat(F.slice(f, 1, 1), F.array(dashes), F.slice(f, F.lit(2), F.greatest(F.size(f) - 1, F.lit(0)))), "\n"))

    return let(rows, lambda rows: let(F.array_max(F.transform(rows, lambda r: F.size(r))), lambda width: made(rows, width)))


def tables(cells: DataFrame, by: list[str], row: str, col: str, text: str) -> DataFrame:
    """``by..., markdown`` of each table of (row, col, text) cells; missing cells are empty."""
    cell = F.struct(F.col(col).alias("c"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    r = cells.groupBy(*by, row).agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    spread = F.transform(F.sequence(F.lit(0), F.element_at("cells", -1).c), lambda i: F.coalesce(F.get(F.filter("cells", lambda x: x.c == i), F.lit(0)).t, F.lit("")))
    g = r.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(row).alias("r"), spread.alias("t")))).alias("rows"))
    return g.select(*by, table_markdown(F.transform("rows", lambda x: x.t)).alias("markdown"))


def html_table(rows: Column) -> Column:
    """An HTML table of an array of rows of (text, colspan, rowspan, is_header) cells."""

    def cell(c: Column) -> Column:
        tag = F.when(c.is_header, "th").otherwise("td")
        span = lambda name: F.when(c[name] > 1, F.concat(F.lit(f' {name}="'), c[name].cast("string"), F.lit('"'))).otherwise("")
        return F.concat(F.lit("<"), tag, span("colspan"), span("rowspan"), F.lit(">"), escape_html(c.text), F.lit("</"), tag, F.lit(">"))

    return F.concat(F.lit("<table>\n"), F.array_join(F.transform(rows, lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, cell), ""), F.lit("</tr>"))), "\n"), F.lit("\n</table>"))


def _heading_line(t: Column) -> Column:
    """A heading's text on one line; signs at its end that would be taken for its closing ones are escaped."""
    return F.regexp_replace(F.regexp_replace(t, r"\n+", " "), r"(^|[ \t])(#+[ \t]*)$", r"$1\\$2")


def block_markdown(kind: Column, text: Column, level: Column, language: Column) -> Column:
    """Markdown of a heading, paragraph, code block, quote, rule, page break, image or formula."""
    lines = lambda t, f: F.array_join(F.transform(F.split(t, "\n", -1), f), "\n")
    safe = escape_line_starts(escape_inline(text))
    held = F.array_max(F.transform(F.regexp_extract_all(text, F.lit("`{3,}"), 0), lambda x: F.length(x)))
    fence = F.repeat(F.lit("`"), F.coalesce(held + 1, F.lit(3)))  # longer than any in the code
    return (
        F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), _heading_line(escape_inline(text))))
        .when(kind == "code", F.concat(fence, F.coalesce(language, F.lit("")), F.lit("\n"), lines(text, lambda x: F.rtrim(x)), F.lit("\n"), fence))
        .when(kind == "quote", lines(safe, lambda x: F.concat(F.lit("> "), x)))
        .when(kind == "rule", "---")
        .when(kind == "page_break", "<!-- pagebreak -->")
        .when(kind == "math", F.concat(F.lit("$$\n"), text, F.lit("\n$$")))
        .otherwise(safe)
    )


def cells_markdown(cells: Column, inner: Column) -> Column:
    """A table of an array of cells: with pipes, or as HTML where cells have spans.

    ``inner`` is the Markdown of the blocks of cells that own some, by cell.
    """
    texts = lambda rows: F.transform(rows, lambda r: F.transform(r, lambda x: F.coalesce(x.inner, escape_inline(x.cell.text))))
    tagged = lambda rows: F.transform(rows, lambda r: F.transform(r, lambda x: x.cell.withField("text", F.regexp_replace(F.coalesce(x.inner, x.cell.text), r"\n+", " "))))
    return F.when(has_spans(cells), html_table(tagged(_cell_rows(cells, inner)))).otherwise(table_markdown(texts(_cell_rows(cells, inner))))


def _stretches(values: Column, key) -> Column:
    """An array cut into runs of equal keys."""

    def cut(a: Column) -> Column:
        n = F.size(a)
        edge = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (key(F.get(a, i)) != key(F.get(a, i - 1))))
        runs = let(edge, lambda e: F.transform(e, lambda i, k: F.slice(a, i + 1, F.coalesce(F.get(e, k + 1), n) - i)))
        return F.when(n > 0, runs).otherwise(F.transform(a, lambda _: a))

    return let(values, cut)


def _cell_rows(cells: Column, inner: Column) -> Column:
    """The rows of a table: arrays of ``cell`` and, where ``inner`` has its blocks' Markdown, ``inner``, each cell met with its own by sorting."""
    kind = f"struct<key:bigint,at:int,cell:{CELL},inner:string>"
    held = F.transform(F.coalesce(F.map_entries(inner), F.array().cast("array<struct<key:bigint,value:string>>")), lambda e: F.struct(e.key.alias("key"), F.lit(-1).alias("at"), F.lit(None).alias("cell"), e.value.alias("inner")).cast(kind))
    own = F.transform(cells, lambda c, i: F.struct(cell_key(c.row, c.col).alias("key"), i.alias("at"), c.alias("cell"), F.lit(None).alias("inner")).cast(kind))
    alike = _stretches(F.sort_array(F.concat(held, own)), lambda x: x.key)
    met = F.flatten(F.transform(alike, lambda g: F.transform(F.filter(g, lambda x: x.at >= 0), lambda x: F.struct(x.cell.row.alias("row"), x["at"].alias("at"), x.cell.alias("cell"), F.get(g, F.lit(0)).inner.alias("inner")))))
    return _stretches(F.sort_array(met), lambda x: x.row)


def indented(t: Column, spaces: Column) -> Column:
    """``t`` with spaces before each line that isn't empty but the first."""
    return let(t, lambda x: F.when(F.contains(x, F.lit("\n")), F.regexp_replace(x, F.lit(r"\n(?=[^\n])"), F.concat(F.lit("\n"), spaces))).otherwise(x))


def node_markdown(b: Column) -> Column:
    """Markdown of a block, a struct of its columns, ``inner`` (its blocks' Markdown) and ``in_cells`` (that of its cells' blocks)."""
    inline = lambda x: F.when(F.size(x.runs) > 0, F.array_join(F.transform(x.runs, run_markdown), "")).otherwise(escape_inline(F.coalesce(x.text, F.lit(""))))
    return let(b, lambda x: let(inline(x), lambda t: _node_markdown(x, t)))


def _node_markdown(b: Column, runs: Column) -> Column:
    k = b.kind
    mark = F.when(b.ordered, F.concat(F.coalesce(b.number, F.lit(1)).cast("string"), F.lit("."))).otherwise("-")
    task = F.when(b.checked, "[x] ").when(~b.checked, "[ ] ").otherwise("")
    # lines of text that would be indented code, and blank ones within a text, aren't kept as they are
    safe = F.regexp_replace(escape_line_starts(runs), r"^(?: {4,}| {0,3}\t\s*)(?=\S)", "")
    lines = F.regexp_replace(safe, r"\n+", "\n")
    blocks = F.coalesce(b.inner, F.lit(""))
    bare = F.regexp_replace(blocks, r"^\n+", "")
    own = let(lines, lambda said: F.when(said == "", bare).when(blocks == "", said).otherwise(F.concat(said, blocks)))
    width = F.when(b.via == "children", F.lit(2)).otherwise(F.length(mark) + 1)
    item = F.concat(F.repeat(F.lit("  "), F.when(b.via.isNull(), b.depth).otherwise(0)), mark, F.lit(" "), task, indented(own, F.repeat(F.lit(" "), width + F.when(b.via.isNull(), 2 * b.depth).otherwise(0))))
    return (
        F.when(k == "heading", F.concat(F.repeat(F.lit("#"), b.level), F.lit(" "), _heading_line(runs)))
        .when(k == "item", item)
        .when(k == "table", cells_markdown(b.cells, b.in_cells))
        .when(k == "image", F.concat(F.lit("!["), F.coalesce(b.alt, F.lit("")), F.lit("]("), F.coalesce(b.src, F.lit("")), F.lit(")")))
        .when(k == "footnote", F.concat(F.lit("[^"), F.coalesce(b.note_id, F.lit("")), F.lit("]: "), indented(own, F.lit("    "))))
        .when(k == "quote", F.array_join(F.transform(F.split(F.when(blocks == "", safe).otherwise(own), "\n", -1), lambda x: F.concat(F.lit("> "), x)), "\n"))
        .when(k.isin("code", "rule", "page_break", "math"), block_markdown(k, F.coalesce(b.text, F.lit("")), b.level, b.language))
        .when(b.cell.isNotNull(), runs)
        .otherwise(safe)
    )


def _owned(pieces: DataFrame, by: list[str]) -> DataFrame:
    """``by..., section, parent, inner, in_cells``: the Markdown of the blocks of each owner, from theirs.

    Items of a list stand line below line, other blocks a blank line apart; the
    blocks of a cell stand side by side. An item's blocks begin with the line end
    that keeps them from its text.
    """
    kid = F.struct("ord", F.when(F.col("kind") == "item", F.col("list_no")).alias("list_no"), "piece")
    g = pieces.groupBy(*by, "section", "parent", "cell").agg(F.array_sort(F.collect_list(kid)).alias("k"))
    gap = lambda x, i: F.when((i == 0) & x.list_no.isNotNull(), "\n").when((i > 0) & (x.list_no == F.get("k", i - 1).list_no), "\n").otherwise("\n\n")
    below = F.array_join(F.transform("k", lambda x, i: F.concat(gap(x, i), x.piece)), "")
    beside = F.array_join(F.transform("k", lambda x: F.trim(x.piece)), " ")
    g = g.select(*by, "section", "parent", "cell", F.when(F.col("cell").isNull(), below).alias("below"), beside.alias("beside"))
    cells = F.map_from_entries(F.collect_list(F.when(F.col("cell").isNotNull(), F.struct("cell", "beside"))))
    return g.groupBy(*by, "section", "parent").agg(F.max("below").alias("inner"), cells.alias("in_cells"))


def markdown(nodes: DataFrame, by: list[str], nest: int | None = None) -> DataFrame:
    """``by..., markdown`` of documents in the common form (:mod:`quire.plans.nodes`).

    Header and footer come first, within their markers; blank paragraphs go, but for
    those with a note's reference; sections are kept apart by a rule. Blocks are
    rendered from the innermost to the top, a join to the owners for each of ``nest``
    levels (null: as many as there are, which is looked up).
    """
    n = nodes.where((F.col("kind") != "paragraph") | (F.trim("text") != "") | F.exists("runs", lambda r: r.note.isNotNull()))
    n = fold(n, by, node_markdown, _owned, nest)
    n = n.select(*by, "section", "region", "ord", "piece", F.when(F.col("kind") == "item", F.col("list_no")).alias("list_no"))
    outer = n.where("region <> 'body'").select(*by, "section", "region").distinct()
    edge = lambda at, sign: outer.select(*by, "section", "region", F.lit(at).cast("bigint").alias("ord"), F.concat(F.lit(f"<!-- {sign}"), "region", F.lit(" -->")).alias("piece"), F.lit(None).cast("int").alias("list_no"))
    n = n.unionByName(edge(-1, "")).unionByName(edge(1 << 62, "/")).withColumn("rank", F.when(F.col("region") == "header", 0).when(F.col("region") == "footer", 1).otherwise(2))
    w = Window.partitionBy(*by).orderBy("section", "rank", "ord")
    same = (F.lag("list_no").over(w) == F.col("list_no")) & (F.lag("section").over(w) == F.col("section")) & (F.lag("rank").over(w) == F.col("rank"))
    gap = F.when(F.row_number().over(w) == 1, "").when(same, "\n").when(F.lag("section").over(w) != F.col("section"), "\n\n---\n\n").otherwise("\n\n")
    n = n.withColumn("piece", F.concat(gap, "piece"))
    return n.groupBy(*by).agg(in_order(F.struct("section", "rank", "ord"), "piece", "").alias("markdown"))


def documents(nodes: DataFrame) -> DataFrame:
    """``doc_id, markdown`` of (doc_id, ord, kind, level, language, text) blocks; blank paragraphs go."""
    shown = nodes.where((F.col("kind") != "paragraph") | (F.trim("text") != ""))
    md = block_markdown(F.col("kind"), F.col("text"), F.col("level"), F.col("language"))
    return shown.groupBy("doc_id").agg(in_order("ord", md, _JOIN).alias("markdown"))


def list_line(depth: Column, ordered: Column, number: Column, checked: Column, text: Column) -> Column:
    mark = F.when(ordered, F.concat(number.cast("string"), F.lit("."))).otherwise(F.lit("-"))
    task = F.when(checked, "[x] ").when(~checked, "[ ] ").otherwise("")
    return F.concat(F.repeat(F.lit("  "), depth), mark, F.lit(" "), task, escape_line_starts(escape_inline(text)))


def front_matter(title: Column, author: Column, date: Column, subject: Column, description: Column, keywords: Column) -> Column:
    """Front matter in its fixed order of keys; null values and an empty list are left out."""
    pair = lambda k, v: F.concat(F.lit(f'{k}: "'), escape_yaml(v), F.lit('"'))
    words = F.when(F.size(keywords) > 0, F.concat(F.lit("keywords: ["), F.array_join(keywords, ", "), F.lit("]")))
    body = F.concat_ws("\n", pair("title", title), pair("author", author), pair("date", date), pair("subject", subject), pair("description", description), words)
    return F.concat(F.lit("---\n"), body, F.lit("\n---\n\n"))
