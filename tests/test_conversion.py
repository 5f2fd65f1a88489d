"""Readers, writers and conversion against documents made by hand."""

import io
import os
import struct
import zipfile
import zlib
from xml.dom import minidom

import pytest
from pyspark.sql import functions as F

from quire.functions import text
from quire.functions.equation import to_tex
from quire.plans import binary_documents, convert, nodes, package_documents, package_xml, render
from quire.sources import compound, inline, markdown, records

# --- binary documents ----------------------------------------------------------------


def rec(tag, level, data):
    n = len(data)
    return struct.pack("<I", tag | level << 10 | min(n, 0xFFF) << 20) + (struct.pack("<I", n) if n >= 0xFFF else b"") + data


def counted(t):
    return struct.pack("<H", len(t.encode("utf-16-le")) // 2) + t.encode("utf-16-le")


def shape(face=0, height=1000, flags=0, colour=0):
    return struct.pack("<H", face).ljust(42, b"\0") + struct.pack("<iI", height, flags) + bytes(4) + struct.pack("<I", colour)


def para_shape(outline=None, numbering=0):
    return struct.pack("<I", 1 << 24 | outline << 26 if outline is not None else 0).ljust(26, b"\0") + struct.pack("<H", numbering)


def para(t, level=0, shape_id=0, style=0, refs=((0, 0),), raw=None):
    head = rec(66, level, struct.pack("<IHB", 0, shape_id, style).ljust(22, b"\0"))
    return head + rec(67, level + 1, raw if raw is not None else t.encode("utf-16-le")) + rec(68, level + 1, b"".join(struct.pack("<IH", *r) for r in refs))


def ctrl(name, more=b""):
    return rec(70, 1, name + more)


def deflate(data):
    return zlib.compress(data)[2:-4]


def summary_stream(values):
    entries, held = b"", b""
    for number, t in values:
        entries += struct.pack("<II", number, 8 + 8 * len(values) + len(held))
        held += struct.pack("<II", 30, len(t) + 1) + t.encode() + b"\0"
    return b"\xfe\xff".ljust(44, b"\0") + struct.pack("<III", 48, 0, len(values)) + entries + held


def binary_document():
    info = [rec(18, 0, struct.pack("<HH", 2, 1) + counted("png")), rec(19, 0, b"\0" + counted("Batang")), rec(19, 0, b"\0" + counted("Gulim")), rec(21, 0, shape()), rec(21, 0, shape(1, 1700, 1, 0xFF0000))]
    info += [rec(25, 0, para_shape()), rec(25, 0, para_shape(1)), rec(25, 0, para_shape(None, 1)), rec(26, 0, counted("a") + counted("Normal")), rec(26, 0, counted("b") + counted("Outline 3")), rec(28, 0, bytes(4))]
    body = para("Outline head", shape_id=1) + para("Styled", style=1) + para("Big bold", refs=((0, 1),)) + para("제1장 총칙") + para("plain and bold", refs=((0, 0), (10, 1)))
    body += para("1. first", shape_id=2) + para("2. second", shape_id=2) + para("- bullet") + para(" ")
    body += para("", raw=b"\x0b\0" + bytes(14) + "after table".encode("utf-16-le")) + ctrl(b"tbl ") + rec(73, 2, struct.pack("<IHH", 0, 2, 2))
    for r in range(2):
        for c in range(2):
            body += rec(71, 2, struct.pack("<HHHHH", 1, c, r, 1 + (r == 1 and c == 0), 0)) + para(f"cell {r}{c}", 3)
    body += para("noted") + ctrl(b"fn  ") + rec(71, 2, bytes(6)) + para("the note", 2) + para("linked") + ctrl(b"hyln", counted("http://a/b\0rest")) + ctrl(b"hyln", counted("no scheme"))
    body += para("pictured") + ctrl(b"gso ", bytes(20)) + rec(83, 2, struct.pack("<IH", 0, 1)) + para("", raw="base".encode("utf-16-le") + b"\x03\0" + bytes(14)) + ctrl(b"ruby", counted("anno")) + ctrl(b"pgbk") + ctrl(b"clbk")
    body += para("sum") + rec(87, 1, b"\0\0" + counted("{a} over {b}"))
    streams = [("FileHeader", records.header_bytes(1)), ("DocInfo", deflate(b"".join(info))), ("BodyText/Section0", deflate(body)), ("BodyText/Section1", deflate(para("second"))), ("BodyText/Section3", deflate(para("behind a gap")))]
    return compound.make_file([*streams, ("BinData/BIN0001.png", b"\x89PNG1234"), ("BinData/BIN0007.png", b"not named"), ("\x05SummaryInformation", summary_stream([(2, "Title"), (4, "Author"), (5, "k1, k2;k3")]))])


def test_binary_documents(spark):
    broken_section = compound.make_file([("FileHeader", records.header_bytes(1)), ("DocInfo", deflate(b"")), ("BodyText/Section0", b"\xff\xff"), ("BodyText/Section1", deflate(para("still here")))])
    lost = bytes(600) + rec(67, 0, "saved".encode("utf-16-le")) + b"\0\0\0" + rec(67, 0, ("long " * 900).encode("utf-16-le"))
    rows = [("ok", binary_document()), ("sealed", compound.make_file([("FileHeader", records.header_bytes(2))])), ("lost", lost), ("none", None), ("part", broken_section)]
    out = binary_documents.read(spark.createDataFrame(rows, "path string, content binary"))
    b = out["blocks"].orderBy("path", "ord").collect()
    want = [
        ("heading", 2, "Outline head"), ("heading", 3, "Styled"), ("heading", 1, "Big bold"), ("heading", 1, "제1장 총칙"), ("paragraph", None, "plain and bold"), ("item", None, "1. first"), ("item", None, "2. second"), ("item", None, "- bullet"),
        ("table", None, None), ("paragraph", None, "after table"), ("footnote", None, "the note"), ("paragraph", None, "noted"), ("paragraph", None, "http://a/b"), ("paragraph", None, "linked"), ("image", None, None), ("paragraph", None, "pictured"),
        ("paragraph", None, "base"), ("page_break", None, None), ("paragraph", None, "base"), ("math", None, "\\frac{a}{b}"), ("paragraph", None, "sum"), ("paragraph", None, "second"),
    ]
    ok = [r for r in b if r.path == "ok"]
    assert [(r.kind, r.level, r.text) for r in ok] == want
    assert [(r.ordered, r.list_no is not None, r.number) for r in ok[5:8]] == [(True, True, 1), (True, True, 2), (False, True, 1)] and ok[5].list_no == ok[6].list_no != ok[7].list_no
    assert [(r.text, r.bold, r.font, r.colour) for r in ok[4].runs] == [("plain and ", False, "Batang", None), ("bold", True, "Gulim", "#FF0000")]
    assert [(c.row, c.col, c.text, c.colspan, c.is_header) for c in ok[8].cells] == [(0, 0, "cell 00", 1, True), (0, 1, "cell 01", 1, True), (1, 0, "cell 10", 2, False), (1, 1, "cell 11", 1, False)]
    assert ok[10].note_id == "footnote-1" and ok[14].src == "image_1.bin" and ok[16].runs[0].ruby == "anno" and ok[12].runs[0].link == "http://a/b"
    assert [r.text for r in b if r.path == "lost"] == ["saved", "long " * 900] and [r.text for r in b if r.path == "part"] == ["still here"]
    documents = {r.path: r for r in out["documents"].collect()}
    assert (documents["ok"].title, documents["ok"].author, documents["ok"].keywords, documents["ok"].version, documents["ok"].error) == ("Title", "Author", ["k1", "k2", "k3"], "5.0.0.3", None)
    assert documents["sealed"].error == "DrmProtected" and documents["lost"].recovered and documents["lost"].title == "(recovered)" and documents["none"].recovered and not documents["part"].recovered
    assert [(r.path, r.name, r.resolved) for r in out["assets"].collect()] == [("ok", "image_1.bin", "image_1.png")]
    assert [(r.path, r.section) for r in out["diagnostics"].collect()] == [("part", 0)]


def test_compound_files():
    for n in (0, 1, 4095, 4096, 70_000, 7_000_000):
        streams = [("FileHeader", b"x" * 256), ("DocInfo", os.urandom(n)), ("BodyText/Section0", os.urandom(n // 2)), ("BodyText/Section1", b""), ("a/b/c", b"deep"), ("\x05Summary", b"abc")]
        assert compound.read_streams(compound.make_file(streams)) == sorted(streams)
    for bad in (b"", b"no", compound.SIGNATURE, compound.make_file([("s", os.urandom(90_000))])[:40_000]):
        with pytest.raises((ValueError, struct.error)):
            compound.read_streams(bad)


def test_lenient_texts(spark):
    cases = ["plain".encode("utf-16-le"), "é😀".encode("utf-16-le"), b"\x00\xd8a\x00", b"a\x00\x00\xdc", b"\x00\xd8", b""]
    got = [r.o for r in spark.createDataFrame([(c,) for c in cases], "d binary").select(text.utf16_text(F.col("d")).alias("o")).collect()]
    assert got == ["plain", "é😀", "�a", "a�", "�", ""]
    rows = spark.createDataFrame([(counted("abc") + b"zz",), (counted("abc")[:5],), (b"\x01",), (b"",)], "d binary").select(records.utf16_at(F.col("d"), 0).alias("t"), records.uint(F.col("d"), 0, 2).alias("n")).collect()
    assert [(r.t, r.n) for r in rows] == [("abc", 3), ("a", 3), ("", None), ("", None)]
    assert records.marked_texts("ab".encode("utf-16-le") + b"\x03\0" + bytes(14) + "cd".encode("utf-16-le") + b"\x0b\0" + bytes(14) + "ef".encode("utf-16-le") + b"\x03\0" + bytes(14)) == ["ab", "ef"]
    refs = spark.createDataFrame([(struct.pack("<IHIH", 0, 1, 9, 2),), (b"123",)], "d binary").select(records.shape_references(F.col("d")).alias("r")).collect()
    assert [[tuple(x) for x in r.r] for r in refs] == [[(0, 1), (9, 2)], []]


# --- packages ---------------------------------------------------------------------------


def test_package_sections_and_scopes(spark):
    one = b"""<s><secPr><pagePr landscape="1"><pageSize width="10" height="20"/><margin left="3"/></pagePr></secPr>
    <headerFooter type="ODD"><header><p><run><t>top</t></run></p></header><footer><p><run><t>foot</t></run></p></footer></headerFooter>
    <p styleIDRef="Heading 2"><run><t>head</t></run></p><p styleIDRef="9"><run><charPr bold="1" height="1700"/><t>tall</t></run></p><p><run><t>\xec\xa0\x9c3\xec\xa1\xb0 rule</t></run></p>
    <p styleIDRef="1"><run><t>before</t></run><ctrl id="pageBreak"/><run><t>after</t></run></p>
    <!-- any:lang:py --><p><run><t>code</t></run></p><ul><li><p><run><t>u1</t></run></p></li><li><p><run><t>u2</t></run></p></li></ul><ol><li><p><run><t>o1</t></run></p></li></ol>
    <p paraPrIDRef="3"><run><t>nested first</t></run></p><p paraPrIDRef="2" numPrIDRef="1"><run><t>top item</t></run></p><p paraPrIDRef="4"><run><t>child</t></run></p>
    <p><run><t>pre </t><tbl><tr><tc><p styleIDRef="1"><run><t>a</t></run></p><p><run><t>b</t></run></p></tc><tc/></tr></tbl><t>post</t></run></p>
    <p><run><t>see</t><noteRef noteId="n"/></run></p><fn id="n"><p><run><t>the note</t></run></p></fn><en id="e"><p/></en>
    <p><run><pic><img binaryItemIDRef="pic" alt="x"/></pic></run></p><p><run><equation>a+b</equation></run></p></s>"""
    manifest = b'<p><item href="section1.xml"/><item href="Contents/section0.xml"/><item href="other.xml"/></p>'
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        for name, data in (("Contents/content.hpf", manifest), ("Contents/section0.xml", one), ("Contents/section1.xml", b"<s><p><run><t>listed first</t></run></p></s>"), ("Contents/section2.xml", b"<broken"), ("BinData/pic.old", b"1"), ("BinData/pic.png", b"2")):
            f.writestr(name, data)
    probed = io.BytesIO()
    with zipfile.ZipFile(probed, "w") as f:
        for n in (0, 1, 3):
            f.writestr(f"Contents/section{n}.xml", b"<broken" if n == 1 else b"<s><p><run><t>t</t></run></p></s>")
    out = package_documents.read(spark.createDataFrame([("a", z.getvalue()), ("b", probed.getvalue()), ("c", b"no archive")], "path string, content binary"))
    b = [r for r in out["blocks"].orderBy("path", "section", "ord").collect()]
    assert [(r.section, r.text) for r in b if r.path == "b"] == [(0, "t")] and [(r.path, r.section) for r in out["diagnostics"].collect()] == [("b", 1)]
    assert [r.text for r in b if r.path == "a" and r.section == 0] == ["listed first"]
    inside = [r for r in b if r.path == "a" and r.section == 1 and r.parent is not None]
    got = [r for r in b if r.path == "a" and r.section == 1 and r.parent is None]
    assert [(r.kind, r.text, r.cell) for r in inside] == [("paragraph", "a", 0), ("paragraph", "b", 0)]
    assert [(r.region, r.kind, r.level, r.text) for r in got[:9]] == [
        ("header", "paragraph", None, "top"), ("footer", "paragraph", None, "foot"), ("body", "heading", 2, "head"), ("body", "heading", 1, "tall"), ("body", "heading", 2, "제3조 rule"), ("body", "paragraph", None, "before"), ("body", "page_break", None, None), ("body", "heading", 1, "after"), ("body", "code", None, "code"),
    ]
    items = [r for r in got if r.kind == "item"]
    assert [(r.text, r.depth, r.ordered, r.number) for r in items] == [("u1", 0, False, 1), ("u2", 0, False, 2), ("o1", 0, True, 1), ("nested first", 0, False, 1), ("top item", 0, False, 2), ("child", 1, False, 1)]
    assert len({r.list_no for r in items}) == 3
    rest = [r for r in got if r.kind not in ("item", "heading", "code") and r.region == "body"][2:]
    assert [(r.kind, r.text, r.note_id, r.src) for r in rest] == [("paragraph", "pre post", None, None), ("table", None, None, None), ("paragraph", "see", None, None), ("footnote", "the note", "n", None), ("image", None, None, "BinData/pic.png"), ("math", "a+b", None, None)]
    assert [(c.row, c.col, c.text) for c in rest[1].cells] == [(0, 0, "a b"), (0, 1, "")] and [r.note for r in rest[2].runs] == [None, "n"]
    s = {(r.path, r.section): r for r in out["sections"].collect()}["a", 1]
    assert (s.width, s.height, s.left, s.right, s.landscape, s.header_footer_type) == (10, 20, 3, None, True, "ODD")
    assert {r.path: r.error for r in out["documents"].collect()} == {"a": None, "b": None, "c": "Zip"}


def test_packages_are_well_formed(spark):
    run = nodes.run(text=F.lit("a\x01<&>\n\r b"), bold=F.lit(True), font=F.lit("F&"), colour=F.lit("#FF0000"))
    blocks = spark.range(1).select(F.lit("p").alias("path"), *nodes.block(ord=F.lit(0), kind=F.lit("paragraph"), runs=F.array(run, nodes.run(text=F.lit("x"), superscript=F.lit(True)))))
    documents = spark.createDataFrame([("p", "T & <t>", None), ("empty", None, None)], "path string, title string, author string")
    pictures = spark.createDataFrame([("p", 0, "a/pic.png", b"1"), ("p", 1, "b/pic.png", b"2"), ("p", 2, "pic_2.png", b"3")], "path string, ord int, name string, data binary")
    files = {r.path: zipfile.ZipFile(io.BytesIO(r.content)) for r in package_xml.write(blocks, documents, pictures).collect()}
    assert files["p"].namelist() == ["mimetype", "META-INF/container.xml", "version.xml", "Contents/header.xml", "Contents/content.hpf", "Contents/section0.xml", "BinData/pic.png", "BinData/pic_2.png", "BinData/pic_2_2.png"]
    for z in files.values():
        assert [minidom.parseString(z.read(n)) for n in z.namelist() if n.endswith(("xml", "hpf"))]
    head = minidom.parseString(files["p"].read("Contents/header.xml"))
    count = lambda t: len(head.getElementsByTagName(f"hh:{t}"))
    assert (count("fontface"), count("charPr"), count("paraPr"), count("style"), count("borderFill")) == (7, 10, 5, 7, 2)
    assert "Contents/section0.xml" in files["empty"].namelist()


# --- Markdown ----------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("md", "want"),
    [
        ("a **b** *c*", [("a ", ""), ("b", "bold"), (" ", ""), ("c", "italic")]),
        ("***x*** ~~s~~", [("x", "bold italic"), (" ", ""), ("s", "strike")]),
        ("**b *c* d**", [("b ", "bold"), ("c", "bold italic"), (" d", "bold")]),
        ("a\\*b `*c*` snake_case_word 2 * 3", [("a*b ", ""), ("*c*", "code"), (" snake_case_word 2 * 3", "")]),
        ("<u>u</u><sub>2</sub> x^2^ <sup>no</sup>", [("u", "underline"), ("2", "subscript"), (" x", ""), ("2", "superscript"), (" <sup>no</sup>", "")]),
        ("**open [no link] ![a](b)", [("**open [no link] ![a](b)", "")]),
    ],
)
def test_inline(md, want):
    assert [(r["text"], " ".join(k for k in ("bold", "italic", "strike", "underline", "superscript", "subscript", "code") if r.get(k))) for r in inline.parse(md)] == want


def test_inline_targets():
    runs = inline.parse("[l *i*](http://a/(b)) n[^1] [x](<u v>) <ruby>漢<rt>&lt;k&gt;</rt></ruby>")
    assert [(r["text"], r.get("link"), r.get("note"), r.get("ruby")) for r in runs if r["text"].strip() or r.get("note")] == [("l ", "http://a/(b)", None, None), ("i", "http://a/(b)", None, None), (" n", None, None, None), ("", None, "1", None), ("x", "u v", None, None), ("漢", None, None, "<k>")]


MARKDOWN = """# Head *one*

Under
lined
=====

Two
---

a | b
--- | ---
c | d\\|e
f |

| no | dashes |
| c | d |

````py
```
~~~
````

~~~
open
~~~

- one
  - two
- [x] four

1. a

$$
x^2
$$

[^n]: the *note*

![alt](pic.png)

<table>
<tr><th colspan="2">h</th></tr>
<tr><td>a</td><td>b</td></tr>
</table>

<div>gone</div>

<!-- header -->

head text

<!-- /header -->

***

<!-- pagebreak -->

end"""


def test_markdown_nodes_and_back(spark):
    d = spark.createDataFrame([("a", MARKDOWN), ("b", None), ("c", "")], "doc_id string, text string")
    n = markdown.nodes(d).cache()
    rows = n.orderBy("doc_id", "ord").collect()
    assert [(r.kind, r.level, r.text) for r in rows] == [
        ("heading", 1, "Head one"), ("heading", 1, "Under\nlined"), ("heading", 2, "Two"), ("table", None, None), ("paragraph", None, "| no | dashes |\n| c | d |"), ("code", None, "```\n~~~"), ("code", None, "open"), ("item", None, "one"), ("item", None, "two"), ("item", None, "four"), ("item", None, "a"),
        ("math", None, "x^2"), ("footnote", None, "the note"), ("image", None, None), ("table", None, None), ("paragraph", None, "head text"), ("rule", None, None), ("page_break", None, None), ("paragraph", None, "end"),
    ]
    assert [(c.row, c.col, c.text) for c in rows[3].cells] == [(0, 0, "a"), (0, 1, "b"), (1, 0, "c"), (1, 1, "d|e"), (2, 0, "f")]
    assert [(r.depth, r.ordered, r.number, r.checked) for r in rows[7:11]] == [(0, False, 1, None), (1, False, 1, None), (0, False, 2, True), (0, True, 1, None)] and rows[9].list_no != rows[10].list_no
    assert rows[5].language == "py" and (rows[13].src, rows[13].alt) == ("pic.png", "alt") and rows[15].region == "header" and rows[16].region == "body"
    once = render.markdown(n, ["doc_id"]).cache()
    again = render.markdown(markdown.nodes(once, "doc_id", "markdown").cache(), ["doc_id"])
    assert once.first().markdown == again.first().markdown


def test_equations():
    cases = {"{a} over {b}": "\\frac{a}{b}", "root{n}{x}": "\\sqrt[n]{x}", "sqrt{x+1}": "\\sqrt{x+1}", "2 pi r": "2 \\pi r", "left( a right)": "\\left( a \\right)", "left{ a right}": "\\left\\{ a \\right\\}", "matrix{a # b}": "\\begin{matrix}a \\\\ b\\end{matrix}", "a le b": "a \\le b", "Omega varphi": "\\Omega \\varphi", "x^{2}": "x^{2}", "{{a} over {b}} over {c}": "\\frac{\\frac{a}{b}}{c}", "a over b": "a over b", "": ""}
    assert {k: to_tex(k) for k in cases} == cases
    assert to_tex(None) is None and to_tex("{" * 50 + "x").count("x") == 1


# --- conversion -----------------------------------------------------------------------------


def test_conversion_of_a_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "doc.hwp").write_bytes(binary_document())
    (tmp_path / "in" / "text.md").write_text('---\ntitle: "T"\nkeywords: [a, b]\n---\n\n# Head\n\ntext\n')
    (tmp_path / "in" / "other.txt").write_text("ignored")
    packed = convert.to_packages(convert.scan(spark, str(tmp_path / "in")).where("kind = 'markdown'")).collect()
    (tmp_path / "in" / "made.hwpx").write_bytes(packed[0].content)
    files = convert.scan(spark, str(tmp_path / "in"))
    out = convert.to_markdown(files, front_matter=True).cache()
    by = {r.path.rpartition("/")[2]: r for r in out.collect()}
    assert set(by) == {"doc.hwp", "text.md", "made.hwpx"} and not any(r.error for r in by.values())
    assert by["text.md"].markdown == '---\ntitle: "T"\nkeywords: [a, b]\n---\n\n# Head\n\ntext' and by["made.hwpx"].markdown == "# Head\n\ntext"
    assert by["doc.hwp"].markdown.startswith('---\ntitle: "Title"\nauthor: "Author"\nkeywords: [k1, k2, k3]\n---\n\n## Outline head\n\n### Styled') and "\n\n---\n\nsecond" in by["doc.hwp"].markdown
    written = convert.write_files(out.select(F.concat(F.regexp_extract("path", "([^/]+)$", 1), F.lit(".md")).alias("name"), F.col("markdown").alias("content")), str(tmp_path / "out")).collect()
    assert {r.name for r in written} == set(os.listdir(tmp_path / "out")) == {"doc.hwp.md", "text.md.md", "made.hwpx.md"}
    names = spark.createDataFrame([("p", 0, "x/a.png", b"1"), ("p", 1, "a.png", b"2"), ("p", 2, "..", b"3")], "path string, ord int, name string, data binary")
    assert sorted((r.name, bytes(r.content)) for r in convert.asset_files(names, ["path"]).collect()) == [("a (2).png", b"2"), ("a.png", b"1"), ("asset", b"3")]
