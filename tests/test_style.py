"""Style templates, and packages written with them."""

import io
import zipfile
from xml.dom import minidom

import pytest
from pyspark.sql import functions as F

from quire.plans import convert, nodes, package_documents, package_xml, style

FULL = "page:\n  width: 59528\n  height: 84188\n  landscape: true\n  margin:\n    left: 5671\n    right: 5672\n    top: 4253\n    bottom: 4254\nfont:\n  default: \"바탕\"\n  code: D2Coding\nheading:\n  line_spacing: 200\n"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("{}", {}), ("", {}), (None, {}), ("page:\n", {}), ("unknown: 1\npage: {more: x}", {}),
        ("page:\n  width: 59528\n  margin:\n    left: 8000\nfont:\n  default: \"맑은 고딕\"\n", {"width": 59528, "left": 8000, "font": "맑은 고딕"}),
        (FULL, {"width": 59528, "height": 84188, "landscape": True, "left": 5671, "right": 5672, "top": 4253, "bottom": 4254, "font": "바탕", "code_font": "D2Coding", "line_spacing": 200}),
        ("page: {margin: {left: 0}, landscape: false}", {"left": 0, "landscape": False}), ("font: {default: yes}", {"font": "yes"}), ("page: {width: 4294967295}", {"width": 4294967295}),
    ],
)
def test_templates_have_typed_fields(text, want):
    assert style.parse(text) == dict.fromkeys(style.FIELDS) | want


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("not: [valid: yaml:", "invalid style YAML"), ("- a", "invalid style YAML"), ("a: 1\n---\nb: 2", "invalid style YAML"), ("page:\n  width: 0", "page.width must be > 0"), ("page:\n  height: 0", "page.height must be > 0"),
        ("heading:\n  line_spacing: 0", "heading.line_spacing must be > 0"), ("page: {width: -1}", "page.width has the wrong type"), ("page: {width: '1'}", "page.width has the wrong type"), ("page: {width: 1.5}", "page.width"),
        ("page: {width: 4294967296}", "page.width"), ("page: {landscape: yes}", "page.landscape"), ("page: {landscape: 1}", "page.landscape"), ("page: 7", "page.width"), ("font: {code: 7}", "font.code"),
    ],
)
def test_wrong_templates_are_errors(text, message):
    with pytest.raises(style.StyleError, match=message):
        style.parse(text)


def test_tables_of_templates(spark):
    rows = [("a", FULL.encode(), 1), ("b", b"page: {width: 0}", 1), ("c", None, 1), ("d", b"\xff", 1)]
    got = {r.path: r for r in style.templates(spark.createDataFrame(rows, "path string, content binary, error int")).collect()}
    assert got["a"].style.code_font == "D2Coding" and got["a"].error is None
    assert (got["b"].style, got["b"].error) == (None, "StyleLoad: page.width must be > 0")
    assert set(got["c"].style) == {None} and got["d"].error == "StyleLoad: invalid UTF-8"


def head_of(content):
    z = zipfile.ZipFile(io.BytesIO(content))
    head = minidom.parseString(z.read("Contents/header.xml"))
    fonts = [f.getAttribute("face") for f in head.getElementsByTagName("hh:fontface")[0].getElementsByTagName("hh:font")]
    spacing = [e.getAttribute("value") for e in head.getElementsByTagName("hh:lineSpacing")]
    shapes = [e.getElementsByTagName("hh:fontRef")[0].getAttribute("latin") for e in head.getElementsByTagName("hh:charPr")]
    return fonts, spacing, shapes


def test_a_sections_own_page_holds_as_a_whole_before_the_styles(spark):
    run = nodes.run(text=F.lit("t"), font=F.lit("Gulim"))
    code = nodes.run(text=F.lit("c"), code=F.lit(True))
    blocks = spark.createDataFrame([("p", 0), ("p", 1), ("q", 0)], "path string, section int").select("path", *nodes.block(section=F.col("section"), ord=F.lit(0), kind=F.lit("paragraph"), runs=F.array(run, code)))
    documents = spark.createDataFrame([("p", None, None), ("q", None, None), ("none", None, None)], "path string, title string, author string").withColumn("style", F.when(F.col("path") != "q", style.literal(FULL)))
    layouts = spark.createDataFrame([("p", 1, 7000)], "path string, section int, width int")
    files = package_xml.write(blocks, documents, layouts=layouts)
    pages = {(r.path, r.section): (r.width, r.height, r.landscape, r.left, r.right, r.top, r.bottom) for r in package_documents.read(files)["sections"].collect()}
    assert pages["p", 0] == (59528, 84188, True, 5671, 5672, 4253, 4254)
    assert pages["p", 1] == (7000, 84188, False, 5670, 5670, 4252, 4252)  # nothing of the style
    assert pages["q", 0] == (59528, 84188, False, 5670, 5670, 4252, 4252)
    heads = {r.path: head_of(r.content) for r in files.collect()}
    shapes = ["0", "1", "2", *"000000", "2"]  # plain, the font, inline code, headings, code
    assert heads["p"] == (["바탕", "Gulim", "D2Coding"], ["160"] * 4 + ["200"], shapes)
    assert heads["q"] == (["바탕", "Gulim", "Courier New"], ["160"] * 4 + ["180"], shapes)
    assert heads["none"][:2] == (["바탕", "D2Coding"], ["160"] * 4 + ["200"])
    assert [r.text for r in package_documents.read(files)["blocks"].collect()[0].runs] == ["t", "c"]


def test_markdown_in_a_style(spark):
    files = spark.createDataFrame([("a.md", b"# t\n\ntext")], "path string, content binary")
    made = convert.to_packages(files, style.literal("page: {height: 11}\nfont: {default: Mine}"))
    assert head_of(made.first().content)[0] == ["Mine", "Courier New"]
    page = package_documents.read(made)["sections"].first()
    assert (page.width, page.height, page.left) == (59528, 11, 5670)
    assert head_of(convert.to_packages(files).first().content)[0] == ["바탕", "Courier New"]
