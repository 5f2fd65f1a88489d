"""Blocks owned by items, quotes, notes and cells, in all three formats."""

import io
import struct
import zipfile

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.operators import group
from quire.plans import binary_documents, nodes, package_documents, package_xml, render
from quire.sources import compound, containers, markdown, records
from tests.test_conversion import counted, deflate, para, rec


def read_markdown(spark, *texts):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    n = markdown.nodes(d).cache()
    rows = n.orderBy("doc_id", "ord").collect()
    at = {(r.doc_id, r.ord): r for r in rows}
    shown = [(r.doc_id, r.kind, r.text, at[r.doc_id, r.parent].kind if r.parent is not None else None) for r in rows]
    again = {r.doc_id: r.markdown for r in render.markdown(n, ["doc_id"]).collect()}
    return rows, shown, again


def test_items_hold_blocks(spark):
    rows, shown, again = read_markdown(spark, "- a\n  - b\n    - c\n\n      in c\n\n  in a\n- d\ncont", "5. five\n6. six\n   ```py\n   - code\n\n   more\n   ```\n8) other", "- [x] done\n- [ ] open\n\n      code in it\n-\n- ```\n  first\n  ```")
    assert [(k, t, p) for d, k, t, p in shown if d == 0] == [("item", "a", None), ("item", "b", "item"), ("item", "c", "item"), ("paragraph", "in c", "item"), ("paragraph", "in a", "item"), ("item", "d\ncont", None)]
    assert [(r.depth, r.number, r.nest, r.via) for r in rows if r.doc_id == 0] == [(0, 1, 0, None), (1, 1, 1, "blocks"), (2, 1, 2, "blocks"), (0, None, 3, "blocks"), (0, None, 1, "blocks"), (0, 2, 0, None)]
    assert [(r.kind, r.number, r.start, r.text) for r in rows if r.doc_id == 1] == [("item", 5, 5, "five"), ("item", 6, 6, "six"), ("code", None, None, "- code\n\nmore"), ("item", 8, 8, "other")]
    assert [(k, t, p) for d, k, t, p in shown if d == 2] == [("item", "done", None), ("item", "open", None), ("code", "code in it", "item"), ("item", None, None), ("item", None, None), ("code", "first", "item")]
    assert again[0] == "- a\n  - b\n    - c\n\n      in c\n\n  in a\n- d\n  cont" and again[1].startswith("5. five\n6. six\n\n   ```py\n   - code\n\n   more\n   ```\n\n8. other")


def test_quotes_and_notes_hold_blocks(spark):
    rows, shown, again = read_markdown(spark, "> - a\n> - b\n>\n> > inner\n>\n> # head", "> one\n> two\nlazy", "[^n]: first\n\n    second\n\n    - item\n\nafter")
    assert [(k, t, p) for d, k, t, p in shown if d == 0] == [("quote", None, None), ("item", "a", "quote"), ("item", "b", "quote"), ("quote", "inner", "quote"), ("heading", "head", "quote")]
    assert [(k, t, p) for d, k, t, p in shown if d == 1] == [("quote", "one\ntwo\nlazy", None)]
    assert [(k, t, p) for d, k, t, p in shown if d == 2] == [("footnote", None, None), ("paragraph", "first", "footnote"), ("paragraph", "second", "footnote"), ("item", "item", "footnote"), ("paragraph", "after", None)]
    assert again[0] == "> - a\n> - b\n> \n> > inner\n> \n> # head" and again[2] == "[^n]: first\n\n    second\n\n    - item\n\nafter"


def test_indented_code_and_paragraphs(spark):
    _, shown, _ = read_markdown(spark, "text\n    goes on\n\n    code\n\n      more\n\n\nend", "2. no list here\n\ntext\n2. nor here\n1. but here", "\t- tab")
    assert [(k, t) for d, k, t, _ in shown if d == 0] == [("paragraph", "text\n    goes on"), ("code", "code\n\n  more"), ("paragraph", "end")]
    assert [(k, t) for d, k, t, _ in shown if d == 1] == [("item", "no list here"), ("paragraph", "text\n2. nor here"), ("item", "but here")]
    assert [(k, t) for d, k, t, _ in shown if d == 2] == [("code", "- tab")]


def test_depth_is_bounded():
    rows = containers.container_rows("> " * 30 + "deep")
    assert sum(r.get("what") == "quote" for r in rows) == containers.MAX_DEPTH and rows[-1]["raw"] == "> " * 20 + "deep"


def test_cells_hold_runs(spark):
    rows, _, again = read_markdown(spark, "| **x** | [l](http://u) | `a\\|b` | plain |\n| --- | --- | --- | --- |\n| a\\*b | \\| | | [^n] |\n")
    assert [(c.row, c.col, c.text, c.owned) for c in rows[0].cells if c.owned] == [(0, 0, "**x**", True), (0, 1, "[l](http://u)", True), (0, 2, "`a|b`", True), (1, 0, "a*b", True), (1, 3, "[^n]", True)]
    assert [(r.kind, r.runs[0].bold, r.runs[0].link, r.runs[0].code, r.runs[0].note) for r in rows[1:]] == [("paragraph", True, None, False, None), ("paragraph", False, "http://u", False, None), ("paragraph", False, None, True, None), ("paragraph", False, None, False, None), ("paragraph", False, None, False, "n")]
    assert again[0] == "| **x** | [l](http://u) | `a\\|b` | plain |\n| --- | --- | --- | --- |\n| a\\*b | \\| |  | [^n] |"


def test_open_regions_come_behind_the_body(spark):
    rows, _, _ = read_markdown(spark, "one\n\n<!-- header -->\n\ntop\n\n- item\n\n  more\n\n<!-- /header -->\n\ntwo\n\n<!-- footer -->\n\nlast", "<!-- header -->\n\ntop\n\n<!-- /header -->\n\nbody")
    assert [(r.text, r.region) for r in rows if r.doc_id == 0] == [("one", "body"), ("two", "body"), ("top", "body"), ("item", "body"), ("more", "body"), ("last", "body")]
    by = {r.ord: r for r in rows if r.doc_id == 0}
    assert [by[r.parent].text for r in by.values() if r.parent is not None] == ["item"]
    assert [(r.text, r.region) for r in rows if r.doc_id == 1] == [("top", "header"), ("body", "body")]


def test_columns_of_a_users_table_stay(spark):
    d = spark.createDataFrame([(1, 1, "a", 7, 8, 9, 10), (1, 2, "b", 7, 8, 9, 10)], "k int, o int, v string, change int, sign int, last int, at int")
    assert group.islands(d, ["k"], ["o"], F.col("v")).columns == [*d.columns, "island"]
    assert group.regions(d, ["k"], ["o"], F.lit(None).cast("string")).columns == [*d.columns, "region", "moved"]
    tree = spark.createDataFrame([(1, 1, None, 5), (1, 2, 1, 5), (1, 3, 2, 5)], "k int, node int, parent int, closed int")
    assert sorted(map(tuple, nodes.descend(tree, ["k"], "node", "parent", F.col("node") == 2).collect())) == [(1, 1, 0), (1, 2, 1)]


# The generator of documents: what a text may hold, and blocks of each kind.
WORDS = st.text("abcXYZ019 가힣", min_size=1, max_size=40).map(str.strip).filter(bool)
ITEM = st.tuples(WORDS, st.lists(st.one_of(st.tuples(st.just("paragraph"), WORDS), st.tuples(st.just("code"), WORDS)), max_size=2))
LEAF = st.one_of(st.tuples(st.just("paragraph"), WORDS), st.tuples(st.just("heading"), st.integers(1, 6), WORDS), st.tuples(st.just("code"), st.text("aZ0 \n", min_size=1, max_size=60)), st.just(("rule",)))
LIST = st.tuples(st.just("list"), st.booleans(), st.integers(1, 12), st.lists(st.recursive(ITEM.map(lambda i: (*i, [])), lambda inner: st.tuples(WORDS, ITEM.map(lambda i: i[1]), st.lists(inner, max_size=2)), max_leaves=5), min_size=1, max_size=3))
TABLE = st.integers(1, 3).flatmap(lambda n: st.tuples(st.just("table"), st.lists(st.lists(st.one_of(WORDS, WORDS.map(lambda w: f"**{w}**")), min_size=n, max_size=n), min_size=1, max_size=4)))
DOCUMENT = st.lists(st.one_of(LEAF, LIST, TABLE, st.tuples(st.just("quote"), st.lists(st.one_of(LEAF, LIST), min_size=1, max_size=3))), min_size=1, max_size=7)


def lines(b):
    kind = b[0]
    if kind == "paragraph":
        return [b[1]]
    if kind == "heading":
        return ["#" * b[1] + " " + b[2]]
    if kind == "code":
        return ["```", *b[1].split("\n"), "```"]
    if kind == "rule":
        return ["---"]
    if kind == "table":
        head, *rest = ["| " + " | ".join(r) + " |" for r in b[1]]
        return [head, "|" + " --- |" * len(b[1][0]), *rest]
    if kind == "quote":
        return ["> " + x for i, c in enumerate(b[1]) for x in ([""] if i else []) + lines(c)]
    out = []
    for i, (text, blocks, inner) in enumerate(b[3]):
        mark = f"{b[2] + i}. " if b[1] else "- "
        below = [x for c in blocks for x in ["", *lines(c)]] + (["", *lines(("list", b[1], 1, inner))] if inner else [])
        out += [mark + text, *(" " * len(mark) + x if x else "" for x in below)]
    return out


@settings(max_examples=2, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(DOCUMENT, min_size=40, max_size=60))
def test_rendering_what_was_read_gives_the_same_text(spark, documents):
    texts = ["\n\n".join("\n".join(lines(b)) for b in d) for d in documents]
    once = render.markdown(markdown.nodes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), ["doc_id"]).cache()
    again = render.markdown(markdown.nodes(once, "doc_id", "markdown"), ["doc_id"])
    first, second = ({r.doc_id: r.markdown for r in d.collect()} for d in (once, again))
    assert len(first) == len(texts) and all(first.values())
    assert [(texts[k], first[k], second.get(k)) for k in first if first[k] != second.get(k)] == []
    said = lambda t: sorted(w for w in t.replace("\\", " ").replace("|", " ").replace("*", " ").replace(">", " ").split() if w.isalnum())
    assert [(t, first[k]) for k, t in enumerate(texts) if said(t) != said(first[k])] == []


# --- packages ------------------------------------------------------------------------------


def package_of(**entries):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        for name, data in entries.items():
            f.writestr(name.replace("__", "/"), data)
    return z.getvalue()


SECTION = """<s><p><run><t>a</t></run></p><p><run><noteRef noteId="n1"/></run></p>
<p><run><tbl><tr><tc><p><run><t>one </t></run><run><charPr bold="1"/><t>bold</t></run></p><p><run><pic><img binaryItemIDRef="pic" alt="x"/></pic></run></p><p><run><equation>a+b</equation></run></p></tc>
<tc><cellSpan colSpan="2"/><p><run><t>plain</t></run></p></tc></tr><tr><tc><p><run><tbl><tr><tc><p><run><t>inner</t></run></p></tc></tr></tbl></run></p></tc><tc/></tr></tbl></run></p>
<fn id="n1"><p><run><t>note one</t></run></p><p><run><t>note two</t></run></p></fn><fn id="n2"><p><run><t>solo</t></run></p></fn><en id="n3"><p/></en>
<ul><li><p><run><t>u1</t></run></p><p><run><t>u1 more</t></run></p><ul><li><p><run><t>deep</t></run></p></li></ul></li><li><p><run><pic><img binaryItemIDRef="pic" alt="z"/></pic></run></p></li></ul></s>"""


def test_what_cells_notes_and_items_of_packages_hold(spark):
    content = package_of(**{"Contents__section0.xml": SECTION, "BinData__pic.png": b"1"})
    out = package_documents.read(spark.createDataFrame([("a", content)], "path string, content binary"))
    b = out["blocks"].cache()
    rows = b.orderBy("ord").collect()
    at = {r.ord: r for r in rows}
    kind = lambda r: at[r.parent].kind if r.parent is not None else None
    assert [(r.kind, r.text, kind(r), r.cell) for r in rows] == [
        ("paragraph", "a", None, None), ("paragraph", "", None, None), ("table", None, None, None), ("paragraph", "one bold", "table", 0), ("image", None, "table", 0), ("math", "a+b", "table", 0), ("table", None, "table", 1 << 16),
        ("footnote", None, None, None), ("paragraph", "note one", "footnote", None), ("paragraph", "note two", "footnote", None), ("footnote", "solo", None, None),
        ("item", "u1", None, None), ("paragraph", "u1 more", "item", None), ("item", "deep", "item", None), ("item", "", None, None), ("image", None, "item", None),
    ]
    assert [(c.row, c.col, c.text, c.colspan, c.owned) for c in rows[2].cells] == [(0, 0, "one bold", 1, True), (0, 1, "plain", 2, False), (1, 0, "", 1, True), (1, 1, "", 1, False)]
    assert rows[1].runs[0].note == "n1" and [r.bold for r in rows[3].runs] == [False, True] and rows[4].src == "BinData/pic.png" and rows[13].via == "children"
    stats = nodes.statistics(b, ["path"], out["assets"]).first()
    assert (stats.n_blocks, stats.n_assets, stats.n_chars) == (6, 1, len("a" + "one bold" + "a+b" + "plain" + "inner" + "note one" + "note two" + "solo" + "u1" + "u1 more"))
    md = render.markdown(b, ["path"]).first().markdown
    assert "[^n1]" in md and "<td>one **bold** ![x](BinData/pic.png) $$ a+b $$</td>" in md.replace("th>", "td>") and "- u1\n\n  u1 more\n\n  - deep\n- ![z](BinData/pic.png)" in md
    made = package_xml.write(b, out["documents"], out["assets"].withColumn("name", F.col("entry")))
    back = package_documents.read(made)["blocks"].orderBy("ord").collect()
    assert [(r.kind, r.text, r.cell) for r in back[:11]] == [(r.kind, r.text, r.cell) for r in rows[:11]] and back[2].cells == rows[2].cells


@pytest.mark.parametrize(
    ("manifest", "texts", "lost", "error"),
    [
        ("<p><item href='section5.xml'/></p>", ["s5"], 0, None),
        ('<o:p xmlns:o="x"><o:item o:href="Contents/section&#53;.xml"></o:item></o:p>', ["s5"], 0, None),
        ('<p><item href="section9.xml"/><item href="Section0.xml"/></p>', ["s0"], 1, None),
        ('<p><item href="section9.xml"/></p>', [], 1, "NoSections"),
        ("<p><item href='section5.xml'/><broken", ["s5"], 0, None),
        ("<p/>", ["s0"], 0, None),
    ],
)
def test_manifests(spark, manifest, texts, lost, error):
    content = package_of(**{"Contents__content.hpf": manifest, "Contents__Section0.xml": "<s><p><run><t>s0</t></run></p></s>", "Contents__section5.xml": "<s><p><run><t>s5</t></run></p></s>"})
    out = package_documents.read(spark.createDataFrame([("a", content)], "path string, content binary"))
    assert [r.text for r in out["blocks"].collect()] == texts and out["diagnostics"].count() == lost and out["documents"].first().error == error


def test_headers(spark):
    head = "<h:head xmlns:h='u'><h:title>no</h:title><h:title>T &#44032; &amp; <b>x</b> y</h:title><d:creator xmlns:d='v'>one</d:creator><author>two</author><h:fontface><h:font face='F &amp;'/><h:font face=''/><h:font face='G'/></h:fontface><h:fontface><h:font face='no'/></h:fontface><h:paraPr id='1'><h:breakSetting keepLines='1'/></h:paraPr><h:paraPr id='0'><h:breakSetting keepWithNext='true' widowOrphan='0'/></h:paraPr>"
    files = [("whole", package_of(**{"Contents__header.xml": head + "</h:head>"})), ("cut", package_of(**{"Contents__header.xml": head})), ("none", package_of(**{"Contents__header.xml": "<h/>"}))]
    rows = {r.path: r for r in package_documents.package.header_parts(package_documents.package.entries(spark.createDataFrame(files, "path string, content binary"))).collect()}
    for k in ("whole", "cut"):
        r = rows[k]
        assert (r.title, r.author, r.subject, r.faces, r.breaks.keep_with_next, r.breaks.keep_lines) == ("T 가 & ", "two", None, ["F &", "G"], True, False)
    assert (rows["none"].title, rows["none"].faces, rows["none"].breaks.keep_with_next) == (None, [], False)


# --- binary documents -------------------------------------------------------------------------


def test_what_cells_and_notes_of_binary_documents_hold(spark):
    ctrl = lambda level, name, more=b"": rec(70, level, name + more)
    cell = lambda row: rec(71, 2, struct.pack("<HHHHH", 1, 0, row, 1, 1))
    body = para("before") + ctrl(1, b"tbl ") + rec(73, 2, bytes(8))
    body += cell(0) + para("one", 3) + rec(87, 4, b"\0\0" + counted("{a} over {b}")) + ctrl(4, b"gso ", bytes(20)) + rec(83, 5, struct.pack("<IH", 0, 4)) + para("two", 3)
    body += cell(1) + para("outer", 3) + ctrl(4, b"tbl ") + rec(73, 5, bytes(8)) + rec(71, 5, struct.pack("<HHHHH", 1, 0, 0, 1, 1)) + para("deep", 6)
    body += para("noted") + ctrl(1, b"fn  ") + rec(71, 2, bytes(6)) + para("first", 2) + ctrl(3, b"en  ") + rec(71, 4, bytes(6)) + para("nested", 4) + para("second", 2) + ctrl(1, b"fn  ") + rec(71, 2, bytes(6)) + para("plain", 2)
    body += para("boxed") + ctrl(1, b"gso ", bytes(20)) + rec(71, 2, bytes(6)) + para("in a text box", 3)
    content = compound.make_file([("FileHeader", records.header_bytes(1)), ("DocInfo", deflate(b"")), ("BodyText/Section0", deflate(body))])
    rows = binary_documents.read(spark.createDataFrame([("a", content)], "path string, content binary"))["blocks"].orderBy("ord").collect()
    at = {r.ord: r for r in rows}
    got = [(r.kind, r.text, r.note_id or r.src, r.nest, at[r.parent].kind if r.parent is not None else None, r.cell) for r in rows]
    assert sorted(got, key=str) == sorted([
        ("table", None, None, 0, None, None), ("paragraph", "before", None, 0, None, None), ("math", "\\frac{a}{b}", None, 1, "table", 0), ("image", None, "image_4.bin", 1, "table", 0), ("paragraph", "one", None, 1, "table", 0), ("paragraph", "two", None, 1, "table", 0),
        ("table", None, None, 1, "table", 1 << 16), ("paragraph", "outer", None, 1, "table", 1 << 16),
        ("footnote", None, "footnote-1", 0, None, None), ("footnote", "plain", "footnote-2", 0, None, None), ("paragraph", "noted", None, 0, None, None), ("footnote", "nested", "endnote", 1, "footnote", None), ("paragraph", "first", None, 1, "footnote", None), ("paragraph", "second", None, 1, "footnote", None),
        ("image", None, "image_0.bin", 0, None, None), ("paragraph", "boxed", None, 0, None, None),
    ], key=str)
    inner = next(r for r in rows if r.kind == "table" and r.nest == 1)
    assert [(c.text, c.owned) for c in inner.cells] == [("deep", False)] and [(c.text, c.owned) for c in rows[0].cells] == [("one two", True), ("outer", True)]
