"""Blocks to packages: section XML, reference tables, manifest and pictures.

A block's XML is a column expression over its row. A document's reference tables
(fonts, character formats) are aggregates over its runs, a row a document, which
is joined to its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import HEADING_HEIGHTS, comment_hint, escape_xml, heading_level, let
from quire.operators.group import duplicate_entries
from quire.plans import style as styles_of
from quire.plans.nodes import FORMAT, adjacent_links, cell_key, fold, is_plain, plain_runs
from quire.plans.render import in_order
from quire.sources.package import PARAGRAPH_SPACE, SECTION_SPACE, packages

# Names of the head's space, languages of font lists, widths and paddings in hundredths of a point's units.
HEAD_SPACE = "http://www.hancom.co.kr/hwpml/2011/head"
MANIFEST_SPACE = "http://www.hancom.co.kr/hwpml/2011/packageInfo"
LANGUAGES = ("HANGUL", "LATIN", "HANJA", "JAPANESE", "OTHER", "SYMBOL", "USER")
STYLES = ("Normal", *(f"Heading {i}" for i in range(1, 7)))
CELL_WIDTH, CELL_HEIGHT = 8000, 1000
LEFT_MARGINS, LINE_SPACING = (0, 800, 400, 800, 0), 160
RULE = "─" * 20

def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def xml_text(t: Column) -> Column:
    """Escaped text without what XML can't hold; line feeds are line breaks."""
    clean = F.regexp_replace(F.coalesce(t, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]", "")
    return F.replace(F.replace(escape_xml(clean), F.lit("\r"), F.lit("&#13;")), F.lit("\n"), F.lit("<hp:lineBreak/>"))


def format_of(r: Column) -> Column:
    return F.struct(*(r[k].alias(k) for k in FORMAT))


def references(blocks: DataFrame, by: list[str]) -> DataFrame:
    """``formats, fonts`` of each document: distinct formats and fonts of its runs in the order they are first seen."""
    r = blocks.where(F.col("region") == "body").select(*by, "section", "ord", F.posexplode("runs").alias("place", "r"))
    seen = F.struct("section", "ord", "place")
    formats = r.where(~is_plain(F.col("r"))).groupBy(*by, format_of(F.col("r")).alias("f")).agg(F.min(seen).alias("seen"))
    fonts = r.where("r.font is not null").groupBy(*by, F.col("r.font").alias("font")).agg(F.min(seen).alias("seen"))
    a = formats.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("seen", "f"))), lambda x: x.f).alias("formats"))
    b = fonts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("seen", "font"))), lambda x: x.font).alias("fonts"))
    return a.join(b, by, "left")


def run_element(r: Column, formats: Column, fonts: Column) -> Column:
    number = F.coalesce(F.array_position(formats, format_of(r)), F.lit(0))
    flag = lambda k, name=None, value="true": F.when(r[k], F.lit(f' {name or k}="{value}"')).otherwise("")
    face = F.array_position(fonts, r.font) - 1
    shape = _text("<hp:charPr", flag("bold"), flag("italic"), flag("underline"), flag("strike", "strikeout"), F.when(r.superscript, ' supscript="superscript"').when(r.subscript, ' supscript="subscript"').otherwise(""), F.coalesce(_text(' color="', F.replace(r.colour, F.lit("#"), F.lit("")), '"'), F.lit("")), F.coalesce(_text(' faceNameIDRef="', F.when(face >= 0, face.cast("string")), '"'), F.lit("")), "/>")
    shape = F.when(is_plain(r.withField("code", F.lit(False))), F.lit("")).otherwise(shape)
    body = (
        F.when(r.ruby.isNotNull(), _text("<hp:ruby><hp:baseText><hp:t>", xml_text(r.text), "</hp:t></hp:baseText><hp:rubyText><hp:t>", xml_text(r.ruby), "</hp:t></hp:rubyText></hp:ruby>"))
        .when(r.note.isNotNull() & (F.coalesce(r.text, F.lit("")) == ""), _text('<hp:noteRef noteId="', escape_xml(r.note), '" type="FOOTNOTE"/>'))
        .otherwise(_text("<hp:t>", xml_text(r.text), "</hp:t>"))
    )
    return _text('<hp:run charPrIDRef="', number.cast("string"), '">', shape, body, "</hp:run>")


def runs_element(runs: Column, formats: Column, fonts: Column) -> Column:
    """Runs, those with the same link within one field."""
    link = lambda g: F.when(g.link.isNotNull(), _text('<hp:run charPrIDRef="0"><hp:fieldBegin type="HYPERLINK" command="', escape_xml(g.link), '"/></hp:run>')).otherwise("")
    close = lambda g: F.when(g.link.isNotNull(), '<hp:run charPrIDRef="0"><hp:fieldEnd type="HYPERLINK"/></hp:run>').otherwise("")
    return F.array_join(F.transform(let(runs, adjacent_links), lambda g: F.concat(link(g), F.array_join(F.transform(g.runs, lambda r: run_element(r, formats, fonts)), ""), close(g))), "")


def _paragraph(number: Column, inner: Column, shape: Column | str = "0", style: Column | None = None, numbering: Column | None = None) -> Column:
    more = lambda k, v: F.lit("") if v is None else F.coalesce(_text(f' {k}="', v, '"'), F.lit(""))
    return _text('<hp:p id="', number.cast("string"), '"', more("hp:styleIDRef", style), ' paraPrIDRef="', F.lit(shape) if isinstance(shape, str) else shape, '"', more("numPrIDRef", numbering), ">", inner, "</hp:p>")


def _table(number: Column, cells: Column, in_cells: Column) -> Column:
    width = F.greatest(F.array_max(F.transform(cells, lambda c: c.col)) + 1, F.lit(1))
    rows = F.array_distinct(F.transform(cells, lambda c: c.row))
    placed = F.transform(cells, lambda c, i: F.struct(c.alias("of"), (number + 1 + i).alias("id")))

    def cell(x: Column) -> Column:
        c = x.of
        span = _text('<hp:cellAddr colAddr="', c.col.cast("string"), '" rowAddr="', c.row.cast("string"), '"/><hp:cellSpan colSpan="', c.colspan.cast("string"), '" rowSpan="', c.rowspan.cast("string"), '"/>')
        size = _text('<hp:cellSz width="', (c.colspan * CELL_WIDTH).cast("string"), '" height="', (c.rowspan * CELL_HEIGHT).cast("string"), '"/><hp:cellMargin left="510" right="510" top="141" bottom="141"/>')
        own = _paragraph(x["id"], _text('<hp:run charPrIDRef="0"><hp:t>', xml_text(c.text), "</hp:t></hp:run>"))
        return _text("<hp:tc>", span, size, "<hp:subList>", F.coalesce(F.try_element_at(in_cells, cell_key(c.row, c.col)), own), "</hp:subList></hp:tc>")

    line = lambda n: _text(f'<hp:tr><hp:trHeight value="{CELL_HEIGHT}"/>', F.array_join(F.transform(F.filter(placed, lambda x: x.of.row == n), cell), ""), "</hp:tr>")
    head = _text('<hp:tbl rowCnt="', F.size(rows).cast("string"), '" colCnt="', width.cast("string"), '" borderFillIDRef="2" noAdjust="0"><hp:tblPr><hp:inMargin left="141" right="141" top="141" bottom="141"/></hp:tblPr>', '<hp:sz width="', (width * CELL_WIDTH).cast("string"), '" height="', (F.size(rows) * CELL_HEIGHT).cast("string"), '"/><hp:pos treatAsChar="1"/>')
    return _paragraph(number, _text('<hp:run charPrIDRef="0">', head, F.array_join(F.transform(rows, line), ""), "</hp:tbl></hp:run>"))


def block_element(b: Column) -> Column:
    """XML of a block: a struct of its columns, its first paragraph's number, the picture's entry, the document's tables, and the XML of its blocks.

    Lists are paragraphs with a property, so what an item or quote holds follows its paragraph.
    """
    runs = lambda x: F.when(F.size(x.runs) > 0, x.runs).otherwise(plain_runs(F.coalesce(x.text, F.lit(""))))
    return let(b, lambda x: let(runs_element(runs(x), x.formats, x.fonts), lambda inner: _block_element(x, inner)))


def _block_element(b: Column, inner: Column) -> Column:
    k, number = b.kind, b.first_id
    bare = lambda x: _text('<hp:run charPrIDRef="0">', x, "</hp:run>")
    level = heading_level(F.coalesce(b.level, F.lit(1))).cast("string")
    code_format = (F.size(b.formats) + 7).cast("string")
    code = _text("<!-- quire:lang:", comment_hint(F.coalesce(b.language, F.lit(""))), " -->", _paragraph(number, _text('<hp:run charPrIDRef="', code_format, '"><hp:t>', xml_text(b.text), "</hp:t></hp:run>")))
    task = F.when(b.checked, "☑ ").when(~b.checked, "☐ ").otherwise("")
    item = _paragraph(number, F.concat(F.when(task != "", bare(_text("<hp:t>", task, "</hp:t>"))).otherwise(""), inner), F.when(b.depth > 0, "3").otherwise("2"), None, F.when(b.ordered, F.lit("1")))
    below = F.coalesce(b.inner, F.lit(""))
    silent = (below != "") & (F.coalesce(b.text, F.lit("")) == "")
    said = lambda x: F.concat(F.when(silent, "").otherwise(x), below)
    return (
        F.when(k == "heading", _paragraph(number, inner, "4", level)).when(k == "code", code).when(k == "item", F.concat(item, below)).when(k == "quote", said(_paragraph(number, inner, "1")))
        .when((k == "table") & (F.size(b.cells) > 0), _table(number, b.cells, b.in_cells))
        .when(k == "image", _paragraph(number, bare(_text('<hp:pic><hp:img hp:binaryItemIDRef="', escape_xml(F.coalesce(b.entry, b.src, F.lit(""))), '" alt="', escape_xml(F.coalesce(b.alt, F.lit(""))), '"/></hp:pic>'))))
        .when(k == "rule", _paragraph(number, bare(_text("<hp:t>", RULE, "</hp:t>")))).when(k == "page_break", _paragraph(number, bare(F.lit('<hp:ctrl id="newPage"/>'))))
        .when(k == "math", _paragraph(number, bare(_text("<hp:equation>", xml_text(b.text), "</hp:equation>"))))
        .when(k == "footnote", _text('<hp:fn noteId="', escape_xml(F.coalesce(b.note_id, F.lit(""))), '">', said(_paragraph(number, inner)), "</hp:fn>"))
        .otherwise(_paragraph(number, inner))
    )


def paragraph_numbers(blocks: DataFrame, by: list[str]) -> DataFrame:
    """``first_id`` of each block: paragraphs count from 0 within a section's body, and within its header and footer; a table's cells count too."""
    held = F.when(F.col("kind") == "table", 1 + F.size("cells")).otherwise(1)
    w = Window.partitionBy(*by, "section", F.col("region") == "body").orderBy(F.desc("region"), "ord")  # header before footer
    return blocks.withColumn("first_id", F.sum(held).over(w) - held)


def page_properties(layout: Column) -> Column:
    """Page properties of a struct of size and margins; the defaults are those of A4."""
    v = lambda k: styles_of.of(layout, k).cast("string")
    return _text(
        '<hp:secPr><hp:pagePr landscape="', F.coalesce(layout["landscape"], F.lit(False)).cast("string"), '"><hp:margin left="', v("left"), '" right="', v("right"), '" top="', v("top"), '" bottom="', v("bottom"), '" header="0" footer="0" gutter="0"/>',
        '<hp:pageSize width="', v("width"), '" height="', v("height"), '"/></hp:pagePr></hp:secPr>',
    )


def _owned(pieces: DataFrame, by: list[str]) -> DataFrame:
    """``by..., section, parent, inner, in_cells``: the XML of the blocks of each owner, one behind the other."""
    g = pieces.groupBy(*by, "section", "parent", "cell").agg(in_order("ord", "piece", "").alias("xml"))
    cells = F.map_from_entries(F.collect_list(F.when(F.col("cell").isNotNull(), F.struct("cell", "xml"))))
    return g.groupBy(*by, "section", "parent").agg(F.max(F.when(F.col("cell").isNull(), F.col("xml"))).alias("inner"), cells.alias("in_cells"))


def sections(blocks: DataFrame, by: list[str], refs: DataFrame, layouts: DataFrame | None = None, nest: int | None = None) -> DataFrame:
    """``by..., section, data``: the XML of each section. ``layouts`` may give page sizes and margins by section, and the type of headers.

    Where ``refs`` has a ``style``, its page holds for sections without page properties of their own.
    """
    b = paragraph_numbers(blocks, by).join(refs.select(*by, "formats", "fonts"), by, "left")
    for c in ("formats", "fonts"):
        b = b.withColumn(c, F.coalesce(c, F.array().cast(refs.schema[c].dataType)))
    b = b if "entry" in b.columns else b.withColumn("entry", F.lit(None).cast("string"))
    x = fold(b, by, block_element, _owned, nest).withColumnRenamed("piece", "xml")
    part = lambda region: in_order(F.when(F.col("region") == region, F.col("ord")), F.when(F.col("region") == region, F.col("xml")), "")
    s = x.groupBy(*by, "section").agg(part("header").alias("header"), part("footer").alias("footer"), part("body").alias("body"))
    if layouts is not None:
        s = s.join(layouts, [*by, "section"], "left")
    for c, t in (("width", "int"), ("height", "int"), ("left", "int"), ("right", "int"), ("top", "int"), ("bottom", "int"), ("landscape", "boolean"), ("header_footer_type", "string")):
        s = s if c in s.columns else s.withColumn(c, F.lit(None).cast(t))
    if "style" in refs.columns:
        s = s.join(refs.select(*by, "style"), by, "left")
        own = F.coalesce(*styles_of.PAGE[:-1], F.col("landscape").cast("int")).isNotNull()
        s = s.withColumns({c: F.when(own, F.col(c)).otherwise(F.col("style")[c]) for c in styles_of.PAGE})
    region = lambda n: F.when(F.col(n) != "", _text(f"<hp:{n}>", F.col(n), f"</hp:{n}>")).otherwise("")
    kind = F.coalesce(_text(' type="', escape_xml(F.col("header_footer_type")), '"'), F.lit(""))
    both = F.when((F.col("header") != "") | (F.col("footer") != ""), _text("<hp:headerFooter", kind, ">", region("header"), region("footer"), "</hp:headerFooter>")).otherwise("")
    page = page_properties(F.struct("width", "height", "left", "right", "top", "bottom", "landscape"))
    head = f'<?xml version="1.0" encoding="UTF-8"?><hs:sec xmlns:hs="{SECTION_SPACE}" xmlns:hp="{PARAGRAPH_SPACE}">'
    return s.select(*by, "section", _text(head, both, page, F.col("body"), "</hs:sec>").cast("binary").alias("data"))


def header_xml(formats: Column, faces: Column, n_sections: Column, style: Column) -> Column:
    """The reference tables: fonts in seven languages, border fills, character formats (plain, those of runs, headings, code), paragraph properties, styles and a numbering.

    ``faces`` begins with the font of texts; code has that of the ``style``.
    """
    font = F.array_join(F.transform(faces, lambda f, i: _text('<hh:font id="', i.cast("string"), '" face="', escape_xml(f), '" type="TTF" isEmbedded="0"/>')), "")
    lists = F.concat(*(_text(f'<hh:fontface lang="{name}" fontCnt="', F.size(faces).cast("string"), '">', font, "</hh:fontface>") for name in LANGUAGES))

    code_font = styles_of.of(style, "code_font")

    def shape(number: Column, height: int, f: Column | None = None, bold: bool = False, font: Column | None = None) -> Column:
        on = lambda k: F.lit(bold and k == "bold") if f is None else F.coalesce(f[k], F.lit(False))
        element = lambda k, x: F.when(on(k), F.lit(x)).otherwise("")
        font = F.when(f.code, code_font).otherwise(f.font) if f is not None else font
        face = F.lit("0") if font is None else F.greatest(F.coalesce(F.array_position(faces, font) - 1, F.lit(0)), F.lit(0)).cast("string")
        colour = F.lit("#000000") if f is None else F.coalesce(f.colour, F.lit("#000000"))
        return _text('<hh:charPr id="', number.cast("string"), f'" height="{height}" textColor="', colour, '" borderFillIDRef="1"><hh:fontRef', *(x for n in LANGUAGES for x in (f' {n.lower()}="', face, '"')), "/>", element("bold", "<hh:bold/>"), element("italic", "<hh:italic/>"), element("underline", '<hh:underline type="BOTTOM"/>'), element("strike", '<hh:strikeout shape="SOLID"/>'), element("superscript", "<hh:supscript/>"), element("subscript", "<hh:subscript/>"), "</hh:charPr>")

    n = F.size(formats)
    shapes = F.concat(shape(F.lit(0), 1000), F.array_join(F.transform(formats, lambda f, i: shape(i + 1, 1000, f)), ""), *(shape(n + 1 + i, h, None, True) for i, h in enumerate(HEADING_HEIGHTS)), shape(n + 7, 1000, font=code_font))
    fills = '<hh:borderFills itemCnt="2"><hh:borderFill id="1"/><hh:borderFill id="2">' + "".join(f'<hh:{s}Border type="SOLID" width="0.12 mm" color="#000000"/>' for s in ("left", "right", "top", "bottom")) + "</hh:borderFill></hh:borderFills>"
    breaks = '<hh:breakSetting breakLatinWord="KEEP_WORD" breakNonLatinWord="KEEP_WORD" widowOrphan="false" keepWithNext="false" keepLines="false" pageBreakBefore="false" lineWrap="BREAK"/>'
    margin = lambda left: "<hh:margin>" + "".join(f'<hh:{k} value="{left if k == "left" else 0}"/>' for k in ("intent", "left", "right", "prev", "next")) + "</hh:margin>"
    before = '<hh:align horizontal="JUSTIFY" vertical="BASELINE"/><hh:heading type="NONE" idRef="0" level="0"/>' + breaks + '<hh:lineSpacing type="PERCENT" value="'
    behind = '<hh:border borderFillIDRef="1"/><hh:autoSpacing eAsianEng="false" eAsianNum="false"/></hh:paraPr>'
    spacing = lambda i: styles_of.of(style, "line_spacing").cast("string") if i == 4 else F.lit(str(LINE_SPACING))
    paragraphs = _text('<hh:paraProperties itemCnt="5">', *(x for i, left in enumerate(LEFT_MARGINS) for x in (f'<hh:paraPr id="{i}">{before}', spacing(i), f'"/>{margin(left)}{behind}')), "</hh:paraProperties>")
    styles = _text('<hh:styles itemCnt="7">', *(x for i, s in enumerate(STYLES) for x in (f'<hh:style id="{i}" type="PARA" name="{s}" engName="{s}" paraPrIDRef="{4 if i else 0}" charPrIDRef="', F.lit("0") if not i else (n + i).cast("string"), '"/>')), "</hh:styles>")
    numbering = '<hh:numberings itemCnt="1"><hh:numbering id="1" start="1"><hh:paraHead level="1" start="1" numFormat="DIGIT">^1.</hh:paraHead></hh:numbering></hh:numberings>'
    return _text(f'<?xml version="1.0" encoding="UTF-8"?><hh:head xmlns:hh="{HEAD_SPACE}" version="1.1" secCnt="', n_sections.cast("string"), '"><hh:refList><hh:fontfaces itemCnt="7">', lists, "</hh:fontfaces>", fills, '<hh:charProperties itemCnt="', (n + 8).cast("string"), '">', shapes, "</hh:charProperties>", paragraphs, styles, numbering, "</hh:refList></hh:head>")


def manifest_xml(n_sections: Column, title: Column, author: Column, entries: Column) -> Column:
    named = lambda k, v: F.when(F.coalesce(v, F.lit("")) != "", _text(f"<hp:{k}>", escape_xml(v), f"</hp:{k}>")).otherwise("")
    inner = F.concat(named("title", title), named("author", author))
    info = F.when(inner != "", _text("<hp:docInfo>", inner, "</hp:docInfo>")).otherwise("")
    items = F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n_sections, F.lit(1)) - 1), lambda i: _text('<hp:item href="section', i.cast("string"), '.xml" type="Section"/>')), "")
    stem = lambda e: F.regexp_extract(e, r"^(.+?)([.][^.]*)?$", 1)
    held = F.array_join(F.transform(entries, lambda e: _text('<hp:binData itemId="', escape_xml(stem(e)), '" file="BinData/', escape_xml(e), '" type="EMBED" compress="true"/>')), "")
    return _text(f'<?xml version="1.0" encoding="UTF-8"?><hp:HWPMLPackage xmlns:hp="{MANIFEST_SPACE}"><hp:compatibledocument version="1.1"/>', info, "<hp:contents>", items, "</hp:contents>", held, "</hp:HWPMLPackage>")


def write(blocks: DataFrame, documents: DataFrame, assets: DataFrame | None = None, layouts: DataFrame | None = None, nest: int | None = None) -> DataFrame:
    """``path, content`` of a package for each row of ``documents`` (path, title, author, and a ``style`` if there are templates).

    ``blocks`` are theirs (path and the columns of :mod:`quire.plans.nodes`),
    ``assets`` (path, ord, name, data) their pictures, ``layouts`` (path, section, ...)
    their page properties, which hold as a whole before those of the style; ``nest`` is how deep blocks are (null: looked up). Pictures are entries by base name, numbered where these
    collide; sections are numbered without gaps, and a document without blocks has an empty one.
    """
    by = ["path"]
    refs, b = references(blocks, by), blocks
    given = [c for c in ("style",) if c in documents.columns]
    if given:
        refs = documents.select(*by, "style").dropDuplicates(by).join(refs, by, "left")
    none = F.lit(None).cast(styles_of.TEMPLATE)
    style = F.col("style") if given else none
    refs = refs.withColumn("fonts", styles_of.faces(style, F.col("fonts")))
    if assets is not None:
        base = assets.select(*by, "ord", "name", "data").withColumn("base", F.regexp_extract("name", "([^/]+)$", 1))
        placed = base.join(duplicate_entries(base, by, "ord", "base"), [*by, "ord"])
        first = placed.groupBy(*by, F.col("name").alias("src")).agg(F.min_by("entry", "ord").alias("entry"))
        b = b.join(first, [*by, "src"], "left")
    s = sections(b, by, refs, layouts, nest)
    s = s.withColumn("section", F.row_number().over(Window.partitionBy(*by).orderBy("section")) - 1)  # readers stop at a gap
    parts = s.select("path", (F.col("section") + 2).alias("ord"), _text("Contents/section", F.col("section").cast("string"), ".xml").alias("name"), "data")
    count = s.groupBy("path").agg(F.count("*").cast("int").alias("n_sections"))
    d = documents.select("path", "title", "author", *given).join(count, by, "left").join(refs.drop("style"), by, "left").withColumn("n_sections", F.coalesce("n_sections", F.lit(0)))
    if assets is not None:
        d = d.join(placed.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "entry"))), lambda x: x.entry).alias("entries")), by, "left")
        parts = parts.unionByName(placed.select("path", (F.lit(1_000_000) + F.dense_rank().over(Window.partitionBy("path").orderBy("ord"))).alias("ord"), F.concat(F.lit("BinData/"), "entry").alias("name"), "data"))
    else:
        d = d.withColumn("entries", F.array().cast("array<string>"))
    formats, entries = (F.coalesce(F.col(c), F.array().cast(d.schema[c].dataType)) for c in ("formats", "entries"))
    faces = F.coalesce("fonts", styles_of.faces(style, F.lit(None).cast("array<string>")))
    lone = d.where("n_sections = 0").select("path", F.lit(2).alias("ord"), F.lit("Contents/section0.xml").alias("name"), F.lit(f'<hs:sec xmlns:hs="{SECTION_SPACE}"/>').cast("binary").alias("data"))
    head = d.select("path", F.lit(0).alias("ord"), F.lit("Contents/header.xml").alias("name"), header_xml(formats, faces, F.greatest("n_sections", F.lit(1)), style).cast("binary").alias("data"))
    listed = d.select("path", F.lit(1).alias("ord"), F.lit("Contents/content.hpf").alias("name"), manifest_xml(F.col("n_sections"), F.col("title"), F.col("author"), entries).cast("binary").alias("data"))
    return packages(parts.unionByName(lone).unionByName(head).unionByName(listed))
