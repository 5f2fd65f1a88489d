"""Predicates and classifiers of text, styles, links and bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space, terminators, markers and names of the formats.
SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
ORDERED_PREFIX = r"^ *([0-9]{1,3}|[A-Za-z])[.)]([ \t]|$)"
BULLET_PREFIX = r"^[●■▶▷◆◇•·*-]([ \t]|$)"
TERMINATORS = r"()\[\]「『<《〈」』>》〉（）:：.．,，~·ㆍ；…-"
STYLE_HEADING = r"^(outline|heading|개요|제목)\s*0*([1-6])\s*$"
SAFE_URL = r"^(https?://|mailto:|tel:|ftps?://)"
LINE_START = r"^(#|>|- |\* |\+ |---|\*\*\*|___|[0-9]+\. )"
MARKER = r"^\s*<!--\s*(\S+)\s*-->\s*$"
CODE_HINT = r"^\s*\w+:lang:(\S*)\s*$"
PAGE_BREAKS = ("newPage", "pageBreak", "cnpb")
READER_MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "wmf": "image/x-wmf", "emf": "image/x-emf"}
WRITER_MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "webp": "image/webp"}
MIME_EXT = {"image/png": "png", "image/jpeg": "jpg", "image/gif": "gif", "image/bmp": "bmp", "image/webp": "webp"}
OTHER_MIME = "application/octet-stream"


def _lookup(values: dict[str, str], key: Column, default: str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key), F.lit(default))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[.]([^./]+)$", 1))


def format_kind(path: Column) -> Column:
    """``records``, ``package`` or ``markdown`` by extension; null for any other."""
    e = extension(path)
    return F.when(e == "hwp", "records").when(e == "hwpx", "package").when(e.isin("md", "markdown"), "markdown")


def is_safe_url(url: Column) -> Column:
    return F.lower(url).rlike(SAFE_URL)


def link_target(url: Column) -> Column:
    """A stored link up to its first NUL, without control characters; empty unless it has a scheme."""
    u = F.regexp_replace(F.regexp_extract(url, r"^([^\x00]*)", 1), r"[\x00-\x1F\x7F]", "")
    return F.when(u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), u).otherwise("")


def style_heading(name: Column) -> Column:
    """Heading level of a style name, or null."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(name)), STYLE_HEADING, 2), F.lit("")).cast("int")


def style_reference(ref: Column) -> Column:
    """Heading level of a style name or of a bare number from 1 to 6."""
    return F.coalesce(style_heading(ref), F.when(F.trim(ref).rlike("^[1-6]$"), F.trim(ref).cast("int")))


def shape_heading(level: Column) -> Column:
    """Heading level of a paragraph shape's outline level (from 0)."""
    return F.when(level < 7, F.least(level + 1, F.lit(6)))


def font_heading(text: Column, bold: Column, height: Column) -> Column:
    """Heading level of a short bold paragraph by its font height in hundredths of a point."""
    return F.when((F.char_length(text) < 100) & bold, F.when(height >= 1600, 1).when(height >= 1400, 2).when(height >= 1200, 3))


def regulation_heading(text: Column) -> Column:
    """1 for parts and chapters, 2 for sections and articles of a regulation; else null.

    A number stands right behind the first letter, and the name of the level
    right behind the number; then the text ends, or a terminator follows, or the
    mark of an inserted article with its number.
    """
    behind = rf"({SPACE}|[{TERMINATORS}]|의[0-9]|$)"
    t = F.regexp_replace(text, rf"^{SPACE}+", "")
    level = F.when(t.rlike(rf"^제[0-9]+[편장]{behind}"), 1).when(t.rlike(rf"^제[0-9]+[절조]{behind}"), 2)
    return F.when(F.char_length(text) < 100, level)


def list_kind(text: Column) -> Column:
    """``ordered``, ``bullet`` or null, by how a line begins."""
    return F.when(text.rlike(ORDERED_PREFIX), "ordered").when(text.rlike(BULLET_PREFIX), "bullet")


def numbered_kind(text: Column, numbering_id: Column, ordered: Column) -> Column:
    """List kind of a paragraph that may refer to a numbering (joined: ``ordered``, null if it isn't there)."""
    known = F.when(ordered, "ordered").when(~ordered, "bullet")
    return F.when(numbering_id.isNotNull(), F.coalesce(known, list_kind(text), F.lit("bullet"))).otherwise(list_kind(text))


def list_depth(paragraph_property: Column) -> Column:
    return F.when(paragraph_property >= 4, 1).when(paragraph_property == 3, 1).when(paragraph_property == 2, 0)


def magic_mime(data: Column) -> Column:
    """MIME type by a file's first bytes."""
    h = F.hex(F.substring(data, 1, 12))
    known = F.when(h.startswith("89504E47"), "image/png").when(h.startswith("FFD8FF"), "image/jpeg").when(h.startswith("474946"), "image/gif").when(h.startswith("424D"), "image/bmp")
    known = known.when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "image/webp").otherwise(OTHER_MIME)
    return F.when(F.octet_length(data) < 4, OTHER_MIME).otherwise(known)


def reader_mime(name: Column) -> Column:
    return _lookup(READER_MIME, extension(name), OTHER_MIME)


def writer_mime(name: Column) -> Column:
    return _lookup(WRITER_MIME, extension(name), OTHER_MIME)


def mime_extension(mime: Column) -> Column:
    return _lookup(MIME_EXT, mime, "bin")


def image_source(src: Column) -> Column:
    """``remote``, ``data`` or ``file``."""
    return F.when(F.lower(src).rlike("^https?://"), "remote").when(src.rlike("^data:image/[A-Za-z0-9.+-]+;base64,"), "data").otherwise("file")


def needs_line_escape(line: Column) -> Column:
    return line.rlike(LINE_START)


def comment_marker(html: Column) -> Column:
    """The lower-cased single word of an HTML comment if it is a region or page-break marker."""
    word = F.lower(F.regexp_extract(html, MARKER, 1))
    return F.when(word.isin("pagebreak", "header", "/header", "footer", "/footer"), word)


def code_language(comment: Column) -> Column:
    """The language that a comment ``tool:lang:LANGUAGE`` gives the next paragraph (empty: none named); null for other comments."""
    return F.when(comment.rlike(CODE_HINT), F.regexp_extract(comment, CODE_HINT, 1))


def heading_of(style: Column, text: Column, bold: Column, height: Column, nested: Column) -> Column:
    """Heading level of a package's paragraph: by its style, else by font, else by the wording of regulations; none in a nested scope."""
    return F.when(~nested, F.coalesce(style_reference(style), font_heading(text, bold, height), regulation_heading(text)))


def has_spans(cells: Column) -> Column:
    """Whether a table has cells over several rows or columns, which only HTML can show."""
    return F.exists(cells, lambda c: (c.colspan > 1) | (c.rowspan > 1))


def is_page_break(control: Column) -> Column:
    return control.isin(*PAGE_BREAKS)


def is_output_colour(colour: Column) -> Column:
    return colour.rlike(r"^[0-9A-Fa-f#]+$")


def numbering_is_ordered(flags: Column) -> Column:
    return flags.bitwiseAND(0xF) <= 6


def line_attribute(value: Column) -> Column:
    """Whether an underline or strike-out attribute is on."""
    return ~F.lower(value).isin("", "none", "0")


def kept_boolean(value: Column, before: Column) -> Column:
    """A bold or italic attribute; what isn't understood leaves the earlier value."""
    return F.when(F.lower(value).isin("1", "true"), True).when(F.lower(value).isin("0", "false"), False).otherwise(before)
