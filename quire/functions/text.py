"""Scalar functions: escaping, names, colours, encodings and Markdown of runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.classify import is_output_colour, is_safe_url, needs_line_escape

# Device names that no file may have, and heading heights in hundredths of a point.
DEVICES = r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])$"
HEADING_HEIGHTS = (2400, 2000, 1600, 1400, 1200, 1000)


def _replaced(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` written and computed once: what is used often isn't copied to each use."""
    return F.element_at(F.transform(F.array(value), then), 1)


def escape_inline(t: Column) -> Column:
    """A backslash before each Markdown metacharacter."""
    return F.regexp_replace(t, r"([\\`*_~\[\]])", r"\\$1")


def escape_html(t: Column) -> Column:
    return _replaced(t, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")])


def escape_xml(t: Column) -> Column:
    return _replaced(escape_html(t), [("'", "&apos;")])


def escape_yaml(t: Column) -> Column:
    return _replaced(t, [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")])


def escape_line_starts(t: Column) -> Column:
    """A backslash before each line that Markdown would take for more than text."""
    one = lambda x: F.when(needs_line_escape(x), F.concat(F.lit("\\"), x)).otherwise(x)
    return F.when(F.contains(t, F.lit("\n")), F.array_join(F.transform(F.split(t, "\n", -1), one), "\n")).otherwise(one(t))


def cell_text(t: Column) -> Column:
    """Text of a table cell on one line, pipes escaped."""
    return F.replace(F.regexp_replace(t, r"\n+", " "), F.lit("|"), F.lit("\\|"))


def asset_name(name: Column) -> Column:
    """A file name without its folders that is safe on every system; ``asset`` if nothing is left.

    Control characters and backslashes become ``_``, dots and spaces at the end
    go, and a name whose part before the last dot is a device's gets a ``_``.
    """
    base = F.regexp_extract(F.regexp_replace(name, r"(/[.]?)+$", ""), r"(?s)([^/]*)$", 1)
    n = F.regexp_replace(F.when(base.isin(".", ".."), "").otherwise(base), r"[\x00-\x1F\x7F\\]", "_")
    n = F.regexp_replace(n, r"[. ]+$", "")
    stem = F.regexp_replace(n, r"[.][^.]*$", "")
    return F.when(n == "", "asset").when(stem.rlike(DEVICES), F.concat(F.lit("_"), n)).otherwise(n)


def colour_hex(value: Column) -> Column:
    """``#RRGGBB`` of a number whose low byte is blue; black is null."""
    v = value.cast("bigint").bitwiseAND(0xFFFFFF)
    return F.when(v != 0, F.concat(F.lit("#"), F.lpad(F.hex(v), 6, "0")))


def colour_normal(colour: Column) -> Column:
    """``#RRGGBB`` in upper case of a colour attribute; empty and black are null."""
    c = F.upper(F.replace(colour, F.lit("#"), F.lit("")))
    return F.when(~c.isin("", "000000"), F.concat(F.lit("#"), c))


def base64_bytes(t: Column) -> Column:
    """Strict base64: white space and ``=`` don't count, any other foreign character gives null."""
    c = F.regexp_replace(t, r"[ \t\n\f\r=]", "")
    c = F.when(F.char_length(c) % 4 == 1, F.substring(c, F.lit(1), F.char_length(c) - 1)).otherwise(c)
    padded = F.rpad(c, F.char_length(c) + F.pmod(-F.char_length(c), F.lit(4)), "=")
    return F.when(c.rlike(r"^[A-Za-z0-9+/]*$"), F.unbase64(padded))


def utf16_text(data: Column) -> Column:
    """Text of UTF-16LE bytes; halves of pairs that stand alone become replacement characters."""
    digits = F.hex(data)
    first = lambda x: x.rlike("^..D[89AB]")
    second = lambda x: x.rlike("^..D[C-F]")
    units = F.transform(F.sequence(F.lit(0), F.floor(F.octet_length(data) / 2).cast("int") - 1), lambda i: F.substring(digits, (4 * i + 1).cast("int"), F.lit(4)))
    beside = lambda u, i, is_other: F.coalesce(is_other(F.get(u, i)), F.lit(False))
    whole = lambda u: F.transform(u, lambda x, i: F.when((first(x) & ~beside(u, i + 1, second)) | (second(x) & ~beside(u, i - 1, first)), "FDFF").otherwise(x))
    mended = F.element_at(F.transform(F.array(units), lambda u: F.unhex(F.array_join(whole(u), ""))), 1)
    return F.decode(F.when(digits.rlike("^(....)*..D[89A-F]"), mended).otherwise(data), "UTF-16LE")


def comment_hint(language: Column) -> Column:
    return F.replace(language, F.lit("--"), F.lit("-"))


def heading_level(level: Column) -> Column:
    """The level within 1 to 6; null stays null."""
    return F.when(level < 1, 1).when(level > 6, 6).otherwise(level)


def heading_height(level: Column) -> Column:
    return F.when(level.isNotNull(), F.element_at(F.array(*map(F.lit, HEADING_HEIGHTS)), heading_level(level)))


def local_name(tag: Column) -> Column:
    return F.regexp_extract(tag, r"([^:]+)$", 1)


def span_of(attribute: Column) -> Column:
    """A row or column span: at least 1, and 1 for what isn't a number."""
    return F.greatest(F.coalesce(attribute.try_cast("int"), F.lit(1)), F.lit(1))


def version(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.concat_ws(".", *(x.cast("string") for x in (a, b, c, d)))


def link(label: Column, url: Column) -> Column:
    """A Markdown link; only the label where the target isn't safe."""
    target = F.when(F.contains(url, F.lit(")")), F.concat(F.lit("<"), url, F.lit(">"))).otherwise(url)
    return F.when(is_safe_url(url), F.concat(F.lit("["), label, F.lit("]("), target, F.lit(")"))).otherwise(label)


def run_markdown(r: Column) -> Column:
    """Markdown of a run: a struct of ``text``, flags, ``colour``, ``ruby``, ``link`` and ``note``.

    The nesting is fixed: code, bold and italic, strike, underline, superscript,
    subscript, colour, ruby, link, note. Code ignores all else; empty text has
    no emphasis.
    """
    on = lambda name: F.coalesce(r.getField(name), F.lit(False))
    raw = F.coalesce(r.getField("text"), F.lit(""))
    colour, ruby, url = r.getField("colour"), r.getField("ruby"), r.getField("link")
    coloured = is_output_colour(colour)
    linked = is_safe_url(url)
    # from the outside in: what stands before the text, and behind it in the opposite order
    marks = [
        (linked, F.lit("["), F.concat(F.lit("]("), F.when(F.contains(url, F.lit(")")), F.concat(F.lit("<"), url, F.lit(">"))).otherwise(url), F.lit(")")), False),
        (ruby.isNotNull(), F.lit("<ruby>"), F.concat(F.lit("<rt>"), escape_html(ruby), F.lit("</rt></ruby>")), False),
        (coloured, F.concat(F.lit('<span style="color:'), colour, F.lit('">')), F.lit("</span>"), True),
        (on("subscript"), F.lit("<sub>"), F.lit("</sub>"), True),
        (on("superscript"), F.lit("<sup>"), F.lit("</sup>"), True),
        (on("underline"), F.lit("<u>"), F.lit("</u>"), True),
        (on("strike"), F.lit("~~"), F.lit("~~"), True),
        (on("bold"), F.lit("**"), F.lit("**"), True),
        (on("italic"), F.lit("*"), F.lit("*"), True),
    ]
    some = raw != ""
    shown = lambda m, k: F.when(m[0] & some if m[3] else m[0], m[k]).otherwise("")
    t = F.concat(*(shown(m, 1) for m in marks), escape_inline(raw), *(shown(m, 2) for m in reversed(marks)))
    t = F.when(on("code"), F.concat(F.lit("`"), raw, F.lit("`"))).otherwise(t)
    busy = reduce(Column.__or__, [on(k) for k in ("bold", "italic", "strike", "underline", "superscript", "subscript", "code")] + [r.getField(k).isNotNull() for k in ("colour", "ruby", "link", "note")])
    return F.when(~busy, escape_inline(raw)).otherwise(F.concat(t, F.coalesce(F.concat(F.lit("[^"), r.getField("note"), F.lit("]")), F.lit(""))))
