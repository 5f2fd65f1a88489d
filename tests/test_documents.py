"""Document operators: literal cases, round trips and the SQL of every query."""

import io
import os
import zipfile

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire import queries
from quire.functions import classify, text
from quire.operators import group, lookups, stats
from quire.plans import render
from quire.sources import html_table, markdown, package, records

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f[:-8]} as select * from read_parquet('{SF}/{f}')")
    return con


def plain(v):
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str) == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)


def test_lists_of_all_orders_are_nested(spark):
    orders, lines = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("orders", "lineitem"))
    want = {}
    for r in lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey").collect():
        want[r.l_orderkey] = want.get(r.l_orderkey, 0) + 1
    got = {}
    for r in queries.QUERIES["package_list_nesting_whole"](spark, SF).collect():
        assert r.parent_item == 1
        got.setdefault(r.o_orderkey, []).append(r.item)
    assert {k: sorted(v) for k, v in got.items()} == {k: list(range(2, n + 2)) for k, n in want.items()}


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.SQL)


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(v,) for v in values], f"v {kind}").select(f(F.col("v")).alias("o")).collect()
    return [r.o for r in rows]


def test_literal_cases(spark):
    assert column(spark, ["1. a", "12) b", "a. c", "1234. d", "ab. e", "-x", "- x", "•", "· y", "", "1.x"], classify.list_kind) == ["ordered", "ordered", "ordered", None, None, None, "bullet", "bullet", "bullet", None, None]
    assert column(spark, ["<!-- PageBreak -->", "<!--header-->", "<!-- /Footer -->", "<!-- two words -->", "<!-- other -->"], classify.comment_marker) == ["pagebreak", "header", "/footer", None, None]
    assert column(spark, ["HTTPS://x", "javascript:x", "mailto:a", "tel:1", "//x", None], classify.is_safe_url) == [True, False, True, True, False, None]
    assert column(spark, ["http://x", "data:image/png;base64,AA", "a.png", "data:text/plain,x"], classify.image_source) == ["remote", "data", "file", "file"]
    assert column(spark, ["# a", "> b", "- c", "--- d", "12. e", "plain", "-x", ""], classify.needs_line_escape) == [True, True, True, True, True, False, False, False]
    assert column(spark, ["YQ==", "YW I\n=", "YWJj", "Y", "Y*Q=", ""], lambda c: F.decode(text.base64_bytes(c), "UTF-8")) == ["a", "ab", "abc", "", None, ""]
    assert column(spark, [0, 9, None], lambda c: text.heading_height(c), "int") == [2400, 1000, None]
    assert column(spark, ["hp:p", "p", "a:b:c"], text.local_name) == ["p", "p", "c"]
    assert column(spark, ["c--c", "a---b"], text.comment_hint) == ["c-c", "a--b"]


def test_runs(spark):
    schema = "r struct<text: string, bold: boolean, italic: boolean, strike: boolean, underline: boolean, superscript: boolean, subscript: boolean, code: boolean, colour: string, ruby: string, link: string, note: string>"
    run = lambda **k: ({n: k.get(n) for n in "text bold italic strike underline superscript subscript code colour ruby link note".split()},)
    cases = [run(text="a*b", bold=True), run(text="x", bold=True, italic=True, strike=True), run(text="", bold=True, note="1"), run(text="a`b", code=True, bold=True), run(text="x", link="https://e/(a)"), run(text="x", link="javascript:1"), run(text="x", colour="#FF0000", underline=True), run(text="x", colour="red;"), run(text="漢", ruby="<k>")]
    out = [r.o for r in spark.createDataFrame(cases, schema).select(text.run_markdown(F.col("r")).alias("o")).collect()]
    assert out == ["**a\\*b**", "~~***x***~~", "[^1]", "`a`b`", "[x](<https://e/(a)>)", "x", '<span style="color:#FF0000"><u>x</u></span>', "x", "<ruby>漢<rt>&lt;k&gt;</rt></ruby>"]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table>", [[("A", 1, 1, True), ("B", 1, 1, True)], [("1", 1, 1, False), ("2", 1, 1, False)]]),
        ("<table><tbody><tr></tr><tr><td rowspan='0' colspan=x>a&amp;b</td><td/></tr></tbody></table>", [[("a&b", 1, 1, False), ("", 1, 1, False)]]),
        ("<table><tr><td><table><tr><td>x</td></tr></table></td></tr></table>", None),
        ("<table></table>", None),
        (None, None),
    ],
)
def test_html_fragments(html, want):
    got = html_table.fragment_rows(html)
    assert (got and [[tuple(c) for c in r] for r in got]) == want


def test_markdown_blocks(spark):
    md = "# T\\*x #\n\npara one\nline two\n\n```py\ncode # x\n\n- no\n```\n> quote\n> more\n\n---\n<!-- pagebreak -->\n| a | b |\n| --- | --- |\n| 1\\|2 |  |\n\n- one\n  1. [x] two\n$$e=mc^2$$\n[^n]: note\n"
    d = spark.createDataFrame([(1, md), (2, None), (3, "")], "doc_id long, text string")
    b = markdown.blocks(d)
    rows = [(r.kind, r.level, r.language, r.text) for r in b.where("doc_id = 1").orderBy("block").collect()]
    assert [k for k, *_ in rows] == ["heading", "paragraph", "code", "quote", "rule", "marker", "table", "item", "math", "footnote"]
    assert rows[0] == ("heading", 1, None, "T*x") and rows[2] == ("code", None, "py", "code # x\n\n- no") and rows[3][3] == "quote\nmore" and rows[8][3] == "e=mc^2"
    assert b.where("doc_id <> 1").count() == 0
    assert [(r.row, r.col, r.text) for r in markdown.tables(b).orderBy("row", "col").collect()] == [(0, 0, "a"), (0, 1, "b"), (1, 0, "1|2"), (1, 1, "")]
    assert [(r.depth, r.ordered, r.checked, r.text) for r in markdown.items(b).orderBy("item").collect()] == [(0, False, None, "one"), (1, True, True, "two")]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["heading", "paragraph", "code", "quote"]), st.text("ab *_#|-`1. 가", min_size=1, max_size=20).map(str.strip).filter(bool)), min_size=1, max_size=6))
def test_render_of_parse_of_render(spark, nodes):
    """Rendering what was read gives the same text again."""
    nodes = [(k, "x" + t if k == "code" else t) for k, t in nodes]
    d = spark.createDataFrame([(1, i, k, t, 3 if k == "heading" else None, None) for i, (k, t) in enumerate(nodes)], "doc_id long, ord int, kind string, text string, level int, language string")
    once = render.documents(d)
    again = render.documents(markdown.blocks(once, "doc_id", "markdown").withColumnRenamed("block", "ord"))
    assert once.first().markdown == again.first().markdown


def test_packages(spark):
    broken = spark.createDataFrame([("a", b"not a zip"), ("b", None)], "path string, content binary")
    assert sorted((r.path, r.error) for r in package.entries(broken).collect()) == [("a", "Zip"), ("b", "Zip")]
    parts = spark.createDataFrame([("p", 0, "Contents/section0.xml", b"<s/>"), ("p", 2, "Contents/section2.xml", b"<s/>"), ("p", 1, "BinData/x.png", b"\x89PNG")], "path string, ord int, name string, data binary")
    files = package.packages(parts)
    z = zipfile.ZipFile(io.BytesIO(files.first().content))
    assert z.namelist()[0] == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
    assert [(r.section, r.name) for r in package.section_numbers(package.entries(files)).collect()] == [(0, "Contents/section0.xml")]
    bad = spark.createDataFrame([("p", 0, b"<a><b>"), ("p", 1, None)], "path string, section int, data binary")
    assert {r.kind for r in package.events(bad).collect()} == {"error"}
    xml = b'<s><p styleIDRef="1"><run><charPr bold="1" height="1600"/><t>a&amp;b<lineBreak/>c</t></run><ctrl id="cnpb"/></p><p><run><fieldBegin type="HYPERLINK" command="http://x"/><t>l</t><fieldEnd/><t>m</t></run></p><tbl><tr><tc><cellSpan colSpan="2" rowSpan="0"/><p><run><t>q</t></run></p></tc></tr></tbl></s>'
    e = [x for x in package.section_events(xml) if x["kind"] in ("run", "page_break")]
    assert [(x["kind"], x.get("text"), x["link"]) for x in e] == [("run", "a&b\nc", None), ("page_break", None, None), ("run", "l", "http://x"), ("run", "m", None), ("run", "q", None)]
    assert e[0]["bold"] and e[0]["height"] == 1600 and e[0]["style"] == "1" and (e[-1]["row"], e[-1]["col"], e[-1]["colspan"], e[-1]["rowspan"]) == (0, 0, 2, 1)


def test_records(spark):
    assert records.paragraph_text("a\tb\n".encode("utf-16le") + b"\x02\x00" + b"zz" * 7 + "é😀".encode("utf-16le") + b"\x00\xd8" + b"\x0d\x00") == "a\tb\né😀"
    big = b"y" * 5000
    d = spark.createDataFrame([("p", big)], "path string, data binary").select("path", records.record_bytes(F.lit(67), F.lit(3), F.col("data")).alias("content"))
    r = records.records(d).first()
    assert (r.tag, r.level, bytes(r.data), r.error) == (67, 3, big, None)
    cut = records.records(d.select("path", F.substring("content", F.lit(1), F.lit(50)).alias("content"))).collect()
    assert [x.error for x in cut] == ["InvalidRecord"]
    import zlib

    raw = zlib.compressobj(wbits=-15)
    assert records.inflate(raw.compress(b"x" * 99) + raw.flush()) == b"x" * 99 == records.inflate(zlib.compress(b"x" * 99))
    with pytest.raises(ValueError, match="Decompress"):
        records.inflate(b"\xff\xff")
    key, block = bytes(range(16)), bytes.fromhex("69c4e0d86a7b0430d8cdb78070b4c55a")
    got = spark.createDataFrame([(block + b"rest", key)], "d binary, k binary").select(records.decrypted(F.col("d"), F.col("k")).alias("o")).first().o
    assert bytes(got) == bytes.fromhex("00112233445566778899aabbccddeeff") + b"rest"


def test_headers_and_salvage(spark):
    head = b"HWP Document File".ljust(32, b"\0") + bytes([1, 2, 0, 5]) + bytes([0b10001, 0, 0, 0])
    rows = spark.createDataFrame([(head,), (head[:36],), (b"other" * 10,), (b"",), (None,)], "d binary").select(records.file_header(F.col("d")).alias("h")).collect()
    assert rows[0].h.version == "5.0.2.1" and rows[0].h.compressed and rows[0].h.drm and not rows[0].h.encrypted
    assert rows[1].h.version == "5.0.2.1" and not rows[1].h.compressed and [r.h for r in rows[2:]] == [None] * 3
    assert records.keystream(1, 3) == [41, 18467, 6334]  # the numbers this generator is known for
    text = "found text".encode("utf-16le")
    damaged = b"\xff" * 600 + (len(text) << 20 | 67).to_bytes(4, "little") + text + b"\xff" * 9
    assert records.salvaged_texts(damaged) == ["found text"]


def test_groups(spark):
    rows = spark.createDataFrame([(1, i, d) for i, d in enumerate([1, 0, 1, 1, 0])], "doc long, ord int, depth int")
    assert [r.parent_item for r in group.nested_items(rows, ["doc"], ["ord"], "depth").orderBy("ord").collect()] == [None, None, 2, 2, None]
    names = spark.createDataFrame([(1, i, n) for i, n in enumerate(["a.png", "a.png", ".env", ".env", "b"])], "doc long, ord int, name string")
    assert [r.unique_name for r in group.distinct_names(names, ["doc"], ["ord"], "name").orderBy("ord").collect()] == ["a.png", "a (2).png", ".env", ".env (2)", "b"]
    nodes = spark.createDataFrame([(1, 0, "body", 0, "heading", None, "한글"), (1, 0, "body", 0, "list", None, None), (1, 0, "body", 2, "paragraph", "children", "no"), (1, 0, "header", 0, "paragraph", None, "no"), (1, 1, "body", 0, "image", None, None)], "doc_id long, section int, region string, depth int, kind string, via string, text string")
    r = stats.node_statistics(nodes).first()
    assert (r.n_sections, r.n_blocks, r.n_chars) == (2, 3, 2)
    cells = spark.createDataFrame([(1, 2, 1, "b"), (1, 2, 0, "a"), (1, 20_000, 0, "z")], "doc long, row int, col int, text string")
    assert [(x.row, x.cells) for x in lookups.grid(cells, ["doc"]).orderBy("row").collect()] == [(0, []), (1, []), (2, ["a", "b"])]
