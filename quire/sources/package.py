"""Packaged XML documents: entries of a ZIP archive, and paragraphs of a section.

Decoders stay small: a function opens an archive or walks one XML text and
emits flat rows; resolving, grouping and counting them is left to Spark.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.classify import CODE_HINT, PAGE_BREAKS, reader_mime
from quire.functions.text import escape_xml
from quire.operators.group import unused
from quire.sources.batches import batches as in_batches

MAX_ENTRY = 256 << 20

# The parts of a package.
MIMETYPE = "application/hwp+zip"
CONTAINER = '<?xml version="1.0" encoding="UTF-8"?><container version="1.0"><rootfiles><rootfile full-path="Contents/content.hpf" media-type="application/hwp+xml"/></rootfiles></container>'
VERSION = '<?xml version="1.0" encoding="UTF-8"?><hh:HWPCompatibleDocument xmlns:hh="http://www.hancom.co.kr/hwpml/2011/head" version="1.1"><hh:DocInfo><hh:HWPVersion Major="5" Minor="1" Micro="0" Build="0"/></hh:DocInfo></hh:HWPCompatibleDocument>'
SECTION_SPACE = "http://www.hancom.co.kr/hwpml/2011/section"
PARAGRAPH_SPACE = "http://www.hancom.co.kr/hwpml/2011/paragraph"


def entries(files: DataFrame) -> DataFrame:
    """``path, ord, name, data, error`` of the archives in ``files`` (path, content).

    What isn't an archive gives one row with its error; an entry beyond
    ``MAX_ENTRY`` gives its name and an error.
    """

    names, kinds = ("path", "ord", "name", "data", "error"), (pa.string(), pa.int32(), pa.string(), pa.binary(), pa.string())

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
                        for i, info in enumerate(x for x in z.infolist() if not x.is_dir()):
                            big = info.file_size > MAX_ENTRY
                            rows.append((path, i, info.filename, None if big else z.read(info), "FileTooLarge" if big else None))
                except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError):
                    rows = [(path, None, None, None, "Zip")]
                if rows:
                    yield list(zip(*rows, strict=True)), sum(len(r[3] or b"") for r in rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(found(batches), names, kinds)

    return files.select("path", "content").mapInArrow(run, "path string, ord int, name string, data binary, error string")


def packages(parts: DataFrame) -> DataFrame:
    """``path, content`` of archives made of ``parts`` (path, ord, name, data); the mimetype is stored first, pictures are stored."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for path, held in zip(b.column("path").to_pylist(), b.column("parts").to_pylist(), strict=True):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
                    for name, data in [("mimetype", MIMETYPE.encode()), ("META-INF/container.xml", CONTAINER.encode()), ("version.xml", VERSION.encode()), *((p["name"], p["data"]) for p in held)]:
                        info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
                        info.compress_type = zipfile.ZIP_STORED if name == "mimetype" or name.startswith("BinData/") else zipfile.ZIP_DEFLATED
                        z.writestr(info, data or b"")
                content = out.getvalue()
                yield ([path], [content]), len(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(found(batches), ("path", "content"), (pa.string(), pa.binary()))

    whole = parts.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ord", "name", "data"))).alias("parts"))
    return whole.mapInArrow(run, "path string, content binary")


#: Elements of the manifest and of the head that readers look at.
HEAD_ELEMENTS = ("title", "creator", "author", "subject", "description", "fontface", "font", "paraPr", "breakSetting")
MANIFEST_ELEMENTS = ("item",)
ELEMENT_SCHEMA = "path string, name string, ord int, up int, tag string, attributes map<string,string>, text string, error boolean"


def _elements(xml: bytes, tags: tuple[str, ...]) -> list[tuple]:
    """(ord, up, tag, attributes, text, error) of the elements of these local names, as far as the XML is well-formed.

    ``up`` is the nearest one around it that has such a name too; ``text`` what
    stands before its first child or its end.
    """
    rows: list[list] = []
    stack: list[int | None] = []  # of each open element: its row, or None
    said: int | None = None  # the row whose text goes on

    def start(tag: str, attributes: dict) -> None:
        nonlocal said
        name, said = tag.rpartition(":")[2], None
        if name in tags:
            up = next((i for i in reversed(stack) if i is not None), None)
            said = len(rows)
            rows.append([said, up, name, [(k.rpartition(":")[2], v) for k, v in {k.rpartition(":")[2]: (k, v) for k, v in attributes.items()}.values()], "", False])
        stack.append(said)

    def end(tag: str) -> None:
        nonlocal said
        stack.pop()
        said = None

    def text(t: str) -> None:
        if said is not None:
            rows[said][4] += t

    p = expat.ParserCreate()
    p.buffer_text = True
    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = start, end, text
    try:
        p.Parse(xml, True)
    except expat.ExpatError:
        rows.append([len(rows), None, "", [], "", True])
    return rows


def elements(parts: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """The elements with these local names of XML entries (path, name, data), a row each; XML that isn't well-formed ends in a row with ``error``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.bool_())
        for b in batches:
            for path, name, data in zip(*(b.column(c).to_pylist() for c in ("path", "name", "data")), strict=True):
                rows = _elements(data or b"", tags)
                columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array([name] * len(rows), pa.string()), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["path", "name", "ord", "up", "tag", "attributes", "text", "error"])

    return parts.select("path", "name", "data").mapInArrow(run, ELEMENT_SCHEMA)


def section_numbers(parts: DataFrame) -> DataFrame:
    """The sections among entries, with ``section`` from 0 as far as numbers go without a gap; names may begin in a capital."""
    n = F.regexp_extract("name", r"^Contents/[sS]ection(\d{1,2})\.xml$", 1).try_cast("int")
    found = parts.withColumn("section", n).where("section is not null")
    small = F.row_number().over(Window.partitionBy("path", "section").orderBy(F.col("name").desc(), "ord"))
    rank, known = unused(found, "rank"), unused(found, "known")
    found = found.withColumn(known, F.collect_set("section").over(Window.partitionBy("path")))
    found = found.withColumn(rank, small).where(F.col(rank) == 1).drop(rank)
    # a package may begin at section 1
    least = lambda c: F.when(F.array_contains(c, 0), 0).otherwise(1)
    whole = F.size(F.filter(known, lambda x: x < F.col("section"))) == F.col("section") - least(F.col(known))
    return found.where(whole).withColumn("section", F.col("section") - least(F.col(known))).drop(known)


def manifest_sections(parts: DataFrame) -> DataFrame:
    """The sections among entries in the order of the manifest; of packages whose manifest names none, those numbered without a gap.

    A section that the manifest names and the package doesn't have is a row with ``data`` null.
    """
    manifest = parts.where("name in ('Contents/content.hpf', 'content.hpf') and data is not null")
    first = manifest.groupBy("path").agg(F.min("name").alias("name"), F.min_by("data", "name").alias("data"))
    href = F.col("attributes")["href"]
    named = elements(first, MANIFEST_ELEMENTS).where((F.col("tag") == "item") & href.rlike("[sS]ection"))
    at = F.when(F.startswith(href, F.lit("Contents/")) | F.startswith(href, F.lit("/")), F.regexp_replace(href, "^/+", "")).otherwise(F.concat(F.lit("Contents/"), href))
    named = named.select("path", at.alias("name"), (F.row_number().over(Window.partitionBy("path").orderBy("ord")) - 1).alias("section"))
    listed = named.join(parts, ["path", "name"], "left")
    found = section_numbers(parts).join(named.select("path").distinct(), "path", "left_anti")
    return listed.select(*parts.columns, "section").unionByName(found.select(*parts.columns, "section"))


def header_parts(parts: DataFrame) -> DataFrame:
    """``path`` and, from the header entry, title, author, subject, description, faces and break settings.

    Of several titles the last one counts; faces are those of the first list; break
    settings are those of the first paragraph property with the number 0. A header
    counts as far as it is well-formed.
    """
    e = elements(parts.where("name = 'Contents/header.xml'"), HEAD_ELEMENTS).where("not error")
    a, tag = F.col("attributes"), F.col("tag")
    last = lambda *tags: F.max_by("text", F.when(tag.isin(*tags) & (F.col("text") != ""), F.col("ord")))
    at = lambda c: F.min(F.when(c, F.col("ord")))
    face = F.when((tag == "font") & (F.coalesce(a["face"], F.lit("")) != ""), F.struct("ord", "up", a["face"].alias("face")))
    setting = F.when(tag == "breakSetting", F.struct("ord", "up", "attributes"))
    h = e.groupBy("path").agg(
        last("title").alias("title"), last("creator", "author").alias("author"), last("subject").alias("subject"), last("description").alias("description"),
        at(tag == "fontface").alias("list"), at((tag == "paraPr") & (a["id"] == "0")).alias("plain"),
        F.array_sort(F.collect_list(face)).alias("fonts"), F.collect_list(setting).alias("settings"),
    )
    faces = F.transform(F.filter("fonts", lambda f: f.up == F.col("list")), lambda f: f.face)
    own = F.get(F.filter("settings", lambda s: s.up == F.col("plain")), F.lit(0)).attributes
    flag = lambda k: F.coalesce(own[k].isin("1", "true"), F.lit(False))
    breaks = F.struct(flag("widowOrphan").alias("widow_orphan"), flag("keepWithNext").alias("keep_with_next"), flag("keepLines").alias("keep_lines"), flag("pageBreakBefore").alias("page_break_before"))
    held = parts.where("name = 'Contents/header.xml'").select("path").distinct()
    out = held.join(h.select("path", "title", "author", "subject", "description", faces.alias("faces"), breaks.alias("breaks")), "path", "left")
    none = F.struct(*(F.lit(False).alias(k) for k in ("widow_orphan", "keep_with_next", "keep_lines", "page_break_before")))
    return out.withColumn("faces", F.coalesce("faces", F.array().cast("array<string>"))).withColumn("breaks", F.coalesce("breaks", none))


def binaries(parts: DataFrame) -> DataFrame:
    """``path, ord, entry, name, mime, data`` of the binary entries, named by their base names."""
    held = parts.where(F.col("name").rlike("^(Contents/)?BinData/"))
    base = F.regexp_extract("name", "([^/]+)$", 1)
    return held.select("path", "ord", F.col("name").alias("entry"), base.alias("name"), reader_mime(base).alias("mime"), "data")


_FIELDS = [
    ("kind", pa.string()), ("para", pa.int32()), ("region", pa.string()), ("parent", pa.int32()), ("cell", pa.int64()), ("nest", pa.int32()), ("via", pa.string()), ("row", pa.int32()), ("col", pa.int32()), ("colspan", pa.int32()), ("rowspan", pa.int32()), ("lst", pa.int32()), ("ordered", pa.bool_()), ("depth", pa.int32()),
    ("text", pa.string()), ("style", pa.string()), ("property", pa.int32()), ("numbering", pa.int32()), ("language", pa.string()), ("bold", pa.bool_()), ("italic", pa.bool_()), ("underline", pa.bool_()), ("strike", pa.bool_()), ("script", pa.string()), ("height", pa.int32()), ("colour", pa.string()), ("font", pa.int32()),
    ("link", pa.string()), ("ruby", pa.string()), ("ref", pa.string()), ("extra", pa.map_(pa.string(), pa.string())),
]
EVENT_SCHEMA = (
    "kind string, para int, region string, parent int, cell bigint, nest int, via string, row int, col int, colspan int, rowspan int, lst int, ordered boolean, depth int, "
    "text string, style string, property int, numbering int, language string, bold boolean, italic boolean, underline boolean, strike boolean, script string, height int, colour string, font int, "
    "link string, ruby string, ref string, extra map<string,string>"
)
_RUN = {"bold": False, "italic": False, "underline": False, "strike": False, "script": None, "height": None, "colour": None, "font": None}
#: The target of instructions that stand for characters that XML can't hold, and these.
CHARACTER = "quire-character"
_NO_XML = frozenset(map(chr, (*range(9), 0x0B, 0x0C, *range(0x0E, 0x20), 0xFFFE, 0xFFFF)))
_NOTES = ("fn", "footnote", "en", "endnote")
_HINT = re.compile(CODE_HINT)


def _number(v: str | None) -> int | None:
    return int(v) if v is not None and v.removeprefix("-").isdecimal() and v.isascii() and len(v) < 10 else None


class _Section:
    """What is known while a section's elements go by. Events are dictionaries in ``out``.

    Each event has its owner: ``parent`` is the event of the innermost open item,
    note or table (with ``cell``, row and column) that it is in, ``nest`` how many are open.
    """

    def __init__(self) -> None:
        self.out: list[dict] = []
        self.para, self.paras, self.lists = -1, 0, 0
        self.outer: list[tuple] = []  # open paragraphs
        self.paragraph: dict = {"style": None, "property": None, "numbering": None}
        self.run = dict(_RUN)
        self.in_run = self.equation = False
        self.buffer: list[str] | None = None
        self.link = self.language = self.ruby_part = None
        self.ruby: dict | None = None
        self.region, self.header_footer = "body", False
        self.grid: list[dict] = []  # open tables
        self.open_lists: list[dict] = []
        self.owners: list[dict] = []

    def put(self, kind: str, **more) -> None:
        o = self.owners[-1] if self.owners else {}
        place = {k: self.grid[-1]["cell"][k] for k in ("row", "col", "colspan", "rowspan")} if o.get("what") == "cell" and self.grid and self.grid[-1]["cell"] else {}
        self.out.append({"kind": kind, "para": self.para, "region": self.region, "parent": o.get("event"), "cell": o.get("cell"), "nest": len(self.owners), "via": o.get("via"), **place, **self.paragraph, "link": self.link} | more)

    def own(self, what: str, event: int, cell: int | None = None) -> None:
        """Open an owner; what is in an item that is in an item's list hangs there as a child."""
        below = self.owners[-1]["via"] if self.owners else None
        child = what == "item" and any(o["what"] == "item" for o in self.owners)
        self.owners.append({"what": what, "event": event, "cell": cell, "via": "children" if child or below == "children" else "blocks"})

    def leave(self, what: str) -> None:
        """Close the innermost owner of this kind and what is open in it."""
        at = next((i for i in reversed(range(len(self.owners))) if self.owners[i]["what"] == what), None)
        if at is not None:
            del self.owners[at:]

    def text(self, t: str) -> None:
        if self.ruby is not None:
            if self.ruby_part:
                self.ruby[self.ruby_part] += t
        elif self.buffer is not None:
            self.buffer.append(t)

    def instruction(self, target: str, data: str) -> None:
        """A character that XML can't hold, as :func:`run_xml` writes it."""
        if target == CHARACTER and data.isascii() and data.isdecimal() and len(data) < 6 and chr(int(data)) in _NO_XML:
            self.text(chr(int(data)))

    def comment(self, t: str) -> None:
        hint = _HINT.match(t)
        if hint:
            self.language = hint[1]

    def start(self, tag: str, attributes: dict) -> None:
        name = tag.rpartition(":")[2]
        a = {k.rpartition(":")[2]: v for k, v in attributes.items()}
        handler = getattr(self, f"start_{name}", None)
        if handler:
            handler(a)
        elif name in _NOTES:
            self.put("note", ref=a.get("id") or a.get("noteId") or "")
            self.own("note", len(self.out) - 1)

    def end(self, tag: str) -> None:
        name = tag.rpartition(":")[2]
        handler = getattr(self, f"end_{name}", None)
        if handler:
            handler()
        elif name in _NOTES:
            self.leave("note")

    def start_p(self, a: dict) -> None:
        self.outer.append((self.para, self.paragraph, self.run, self.in_run))
        self.para, self.paras = self.paras, self.paras + 1
        self.paragraph = {"style": a.get("styleIDRef"), "property": _number(a.get("paraPrIDRef")), "numbering": _number(a.get("numPrIDRef"))}
        self.put("paragraph", language=self.language)
        self.language = None

    def end_p(self) -> None:
        if self.outer:
            self.para, self.paragraph, self.run, self.in_run = self.outer.pop()

    def start_run(self, a: dict) -> None:
        self.run, self.in_run = dict(_RUN), True

    def end_run(self) -> None:
        self.in_run = False

    def start_charPr(self, a: dict) -> None:  # noqa: N802
        r = self.run
        for k in ("bold", "italic"):
            r[k] = {"1": True, "true": True, "0": False, "false": False}.get(a.get(k), r[k])
        for k, to in (("underline", "underline"), ("strikeout", "strike")):
            if k in a:
                r[to] = a[k] not in ("", "none", "0")
        if "supscript" in a:
            r["script"] = a["supscript"] if a["supscript"] in ("superscript", "subscript") else None
        if "color" in a:
            c = a["color"].lstrip("#").upper()
            r["colour"] = f"#{c}" if c not in ("", "000000") else None
        for k in ("faceNameIDRef", "hangulIDRef"):
            r["font"] = _number(a.get(k)) if _number(a.get(k)) is not None else r["font"]
        r["height"] = _number(a.get("height")) if _number(a.get("height")) is not None else r["height"]

    def start_t(self, a: dict) -> None:
        if self.ruby is None and self.in_run:
            self.buffer = []

    def end_t(self) -> None:
        if self.ruby is None and self.buffer is not None:
            t = "".join(self.buffer)
            self.put("run" if t else "blank", text=t, **self.run)
            self.buffer = None

    def start_lineBreak(self, a: dict) -> None:  # noqa: N802
        if self.buffer is not None:
            self.buffer.append("\n")

    def start_tbl(self, a: dict) -> None:
        self.put("table", extra={k: v for k, v in a.items() if k in ("rowCnt", "colCnt")})
        self.grid.append({"event": len(self.out) - 1, "row": -1, "col": -1, "cell": None})

    def end_tbl(self) -> None:
        if self.grid:
            self.end_tc()
            self.grid.pop()

    def start_inMargin(self, a: dict) -> None:  # noqa: N802
        if self.grid:
            self.put("margin", extra={k: a.get(k, "141") for k in ("left", "right", "top", "bottom")}, parent=self.grid[-1]["event"])

    def start_tr(self, a: dict) -> None:
        if self.grid:
            self.grid[-1].update(row=self.grid[-1]["row"] + 1, col=-1)

    def start_tc(self, a: dict) -> None:
        if self.grid:
            self.end_tc()
            g = self.grid[-1]
            g["row"] = max(g["row"], 0)
            g["col"] += 1
            key = g["row"] << 16 | g["col"]
            self.put("cell", parent=g["event"], cell=key, row=g["row"], col=g["col"], colspan=1, rowspan=1)
            g["cell"] = self.out[-1]
            self.own("cell", g["event"], key)

    def end_tc(self) -> None:
        if self.grid and self.grid[-1]["cell"]:
            self.grid[-1]["cell"] = None
            self.leave("cell")

    def start_cellSpan(self, a: dict) -> None:  # noqa: N802
        if self.grid and self.grid[-1]["cell"]:
            for k, to in (("colSpan", "colspan"), ("rowSpan", "rowspan")):
                if (_number(a.get(k)) or 0) >= 1:
                    self.grid[-1]["cell"][to] = _number(a[k])

    start_cellAddr = start_cellSpan  # noqa: N815

    def start_ol(self, a: dict, ordered: bool = True) -> None:
        self.lists += 1
        self.open_lists.append({"lst": self.lists, "ordered": ordered})

    def start_ul(self, a: dict) -> None:
        self.start_ol(a, False)

    def end_ol(self) -> None:
        if self.open_lists:
            self.open_lists.pop()

    end_ul = end_ol

    def start_li(self, a: dict) -> None:
        if self.open_lists:
            items = sum(o["what"] == "item" for o in self.owners)
            self.put("item", **self.open_lists[-1], depth=items)
            if items:
                self.out[-1]["via"] = "children"
            self.own("item", len(self.out) - 1)

    def end_li(self) -> None:
        self.leave("item")

    def start_equation(self, a: dict) -> None:
        self.buffer = []

    def end_equation(self) -> None:
        if "".join(self.buffer or []):
            self.put("math", text="".join(self.buffer))
        self.buffer = None

    start_eqEdit, end_eqEdit = start_equation, end_equation  # noqa: N815

    def start_fieldBegin(self, a: dict) -> None:  # noqa: N802
        if a.get("type") == "HYPERLINK" and a.get("command"):
            self.link = a["command"]

    def start_fieldEnd(self, a: dict) -> None:  # noqa: N802
        self.link = None

    def start_ruby(self, a: dict) -> None:
        self.ruby = {"base": "", "annotation": ""}

    def start_baseText(self, a: dict) -> None:  # noqa: N802
        self.ruby_part = "base"

    def start_rubyText(self, a: dict) -> None:  # noqa: N802
        self.ruby_part = "annotation"

    def end_baseText(self) -> None:  # noqa: N802
        self.ruby_part = None

    end_rubyText = end_baseText  # noqa: N815

    def end_ruby(self) -> None:
        held, self.ruby, self.ruby_part = self.ruby or {"base": "", "annotation": ""}, None, None
        if held["base"] or held["annotation"]:
            self.put("run", text=held["base"], ruby=held["annotation"] or None, **self.run)

    def start_img(self, a: dict) -> None:
        ref = a.get("binaryItemIDRef") or a.get("href") or a.get("src")
        if ref:
            self.put("image", ref=ref, text=a.get("alt", ""))

    start_picture = start_img

    def start_noteRef(self, a: dict) -> None:  # noqa: N802
        if a.get("noteId") or a.get("id"):
            self.put("reference", ref=a.get("noteId") or a.get("id"))

    def start_ctrl(self, a: dict) -> None:
        if a.get("id") in ("fn", "en") and a.get("idRef"):
            self.put("reference", ref=a["idRef"])
        elif a.get("id") in PAGE_BREAKS:
            self.put("page_break")

    def start_headerFooter(self, a: dict) -> None:  # noqa: N802
        self.header_footer = True
        self.put("header_footer", ref=a.get("type"))

    def end_headerFooter(self) -> None:  # noqa: N802
        self.header_footer, self.region = False, "body"

    def start_header(self, a: dict) -> None:
        if self.header_footer:
            self.region = "header"

    def start_footer(self, a: dict) -> None:
        if self.header_footer:
            self.region = "footer"

    def end_header(self) -> None:
        self.region = "body"

    end_footer = end_header

    def start_secPr(self, a: dict) -> None:  # noqa: N802
        self.put("layout", extra={})

    def start_pagePr(self, a: dict) -> None:  # noqa: N802
        self.put("layout", extra={"landscape": str(a.get("landscape") in ("1", "true")).lower()})

    def start_pageSize(self, a: dict) -> None:  # noqa: N802
        self.put("layout", extra={k: a[k] for k in ("width", "height") if _number(a.get(k)) is not None})

    def start_margin(self, a: dict) -> None:
        self.put("layout", extra={k: a[k] for k in ("left", "right", "top", "bottom") if _number(a.get(k)) is not None})


def section_events(xml: bytes) -> list[dict]:
    """Paragraphs, runs (those without a text as ``blank``), pictures, breaks, tables, cells, notes and layout of a section in document order, with where they stand."""
    s = _Section()
    p = expat.ParserCreate()
    p.buffer_text = True
    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler, p.CommentHandler, p.ProcessingInstructionHandler = s.start, s.end, s.text, s.comment, s.instruction
    p.Parse(xml, True)
    return s.out


def events(sections: DataFrame) -> DataFrame:
    """``path, section, ord`` and the event's columns, of (path, section, data) rows.

    A section that isn't well-formed gives one row of kind ``error``.
    """

    names, kinds = ("path", "section", "ord", *(k for k, _ in _FIELDS)), (pa.string(), pa.int32(), pa.int32(), *(t for _, t in _FIELDS))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for path, section, data in zip(*(b.column(c).to_pylist() for c in ("path", "section", "data")), strict=True):
                try:
                    rows = section_events(data or b"")
                except expat.ExpatError:
                    rows = [{"kind": "error"}]
                n = len(rows)
                yield ([path] * n, [section] * n, range(n), *([r.get(k) for r in rows] for k, _ in _FIELDS)), len(data or b"")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(found(batches), names, kinds)

    return sections.select("path", "section", "data").mapInArrow(run, "path string, section int, ord int, " + EVENT_SCHEMA)


def paragraph_xml(runs: Column, style: Column | None = None, para_property: Column | None = None, numbering: Column | None = None) -> Column:
    """A paragraph element around its runs' XML."""
    attribute = lambda k, v: F.lit("") if v is None else F.coalesce(F.concat(F.lit(f' {k}="'), v.cast("string"), F.lit('"')), F.lit(""))
    return F.concat(F.lit("<hp:p"), attribute("styleIDRef", style), attribute("paraPrIDRef", para_property), attribute("numPrIDRef", numbering), F.lit(">"), runs, F.lit("</hp:p>"))


def run_xml(text: Column, bold: Column | None = None, italic: Column | None = None, height: Column | None = None) -> Column:
    """A run; line feeds become line breaks, and characters that XML can't hold instructions with their numbers, which other readers pass over."""
    flag = lambda k, v: F.lit("") if v is None else F.coalesce(F.concat(F.lit(f' {k}="'), v.cast("int").cast("string"), F.lit('"')), F.lit(""))
    odd = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]"
    told = lambda x: F.when(x.rlike(odd), F.concat(F.lit(f"<?{CHARACTER} "), F.ascii(x).cast("string"), F.lit("?>"))).otherwise(x)
    safe = escape_xml(text)
    clean = F.when(text.rlike(odd), F.array_join(F.transform(F.split(safe, f"(?<={odd})|(?={odd})", -1), told), "")).otherwise(safe)
    body = F.replace(F.replace(clean, F.lit("\r"), F.lit("&#13;")), F.lit("\n"), F.lit("<hp:lineBreak/>"))
    return F.concat(F.lit("<hp:run><hp:charPr"), flag("bold", bold), flag("italic", italic), flag("height", height), F.lit("/><hp:t>"), body, F.lit("</hp:t></hp:run>"))


def section_xml(body: Column) -> Column:
    return F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?><hs:sec xmlns:hs="{SECTION_SPACE}" xmlns:hp="{PARAGRAPH_SPACE}">'), body, F.lit("</hs:sec>")).cast("binary")
