"""Queries on odd rows, and operators whose work must grow with their input alone."""

import os
import time

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire import queries, store
from quire.operators import group
from quire.plans import binary_documents, nodes, render, style
from quire.sources import batches, compound, containers, markdown, records

SF = "/root/testdata/sf0.001"


def compared(spark, name, folder, **tables):
    """Rows of a query and of its SQL on ``tables``, written to ``folder``; the others are those of ``SF``."""
    con = duckdb.connect()
    for f in os.listdir(SF):
        os.symlink(f"{SF}/{f}", folder / f) if f[:-8] not in tables else None
    for t, d in tables.items():
        d.write.parquet(str(folder / f"{t}.parquet"))
    for f in os.listdir(folder):
        at = folder / f
        con.sql(f"create view {f[:-8]} as select * from read_parquet('{at}{'/*.parquet' if at.is_dir() else ''}')")
    got, want = queries.QUERIES[name](spark, str(folder)), con.sql(queries.SQL[name])
    return sorted((tuple(r[c] for c in want.columns) for r in got.collect()), key=str), sorted(want.fetchall(), key=str)


ODD = [(0, "a\n\nb"), (1, ""), (2, None), (3, "x\x01y\x00\x0b\x0c\x1f￾￿ z"), (4, "\n"), (5, "\x07"), (6, "cr\rlf\r\n<&>\"' \t"), (7, "dup 1\ndup 2"), (7, "dup again"), (None, "no number\n"), (8, "]]> <?quire-character 7?>")]


def test_paragraphs_of_packages_keep_empty_lines_and_what_xml_cannot_hold(spark, tmp_path):
    documents = spark.createDataFrame(ODD, "doc_id long, text string")
    got, want = compared(spark, "package_paragraph_roundtrip", tmp_path, documents=documents)
    assert got == want


def test_names_of_a_large_package_are_tried_once_each(spark):
    names = [(1, i, n) for i, n in enumerate(["b.png", "b_3.png", ".env", "a", None, ".env", "a", "a_2", None, "c.d.e", "c.d.e"])]
    got = group.duplicate_entries(spark.createDataFrame(names, "doc long, ord int, name string"), ["doc"], "ord", "name").orderBy("ord").collect()
    assert [r.entry for r in got] == ["b.png", "b_3.png", ".env", "a", None, "_2.env", "a_2", "a_2_2", None, "c.d.e", "c.d_2.e"]
    many = spark.range(40_000).selectExpr("id % 2 as doc", "id as ord", "'b' || if(id = 7, '_3', '') || '.png' as name")
    got = {r.ord: r.entry for r in group.duplicate_entries(many, ["doc"], "ord", "name").collect()}  # 20,000 names took hours when each was tried against all
    assert got[0] == got[1] == "b.png" and got[7] == "b_3_2.png" and got[9] == "b_4.png" and got[3] == "b_2.png" and got[39_998] == "b_20000.png"
    assert len({(k % 2, v) for k, v in got.items()}) == 40_000


def parsed(text, known):
    try:
        return style.parse(text, known)
    except style.StyleError as e:
        return str(e)


@pytest.mark.parametrize("text", ["page: {width: 010, height: 0x1F}", "font: {default: yes, code: 'a\n\n  b'}", "page:\n  landscape: True", "page:\t{width: 1}", "x: " + "[" * 900 + "]" * 900, "[" * 90, "a: &x [*x]", "a: \x01", "<<: {font: {code: c}}", "%YAML 1.2\n---\nfont: {code: c}", "# c\n", "a: 1\n---\nb: 2", "page: {width: 1:30}", "a: *b", "a: !!python/name:os.system 1"])
def test_templates_are_read_alike_by_both_loaders(text):
    slow = (style.loaders()[0],) * 2
    assert parsed(text, style.loaders()) == parsed(text, slow)


def test_templates_are_dealt_to_all_tasks(spark):
    one = spark.range(100).selectExpr("cast(id as string) as path", "concat('page: {width: ', id, '}') as content").coalesce(1)
    out = style.templates(one)
    assert "REPARTITION_BY_COL" in out._jdf.queryExecution().toString()  # one task had all of a small file's 1,200,000 templates
    assert sorted((int(r.path), r.style and r.style.width) for r in out.collect()) == [(0, None), *((i, i) for i in range(1, 100))]


def test_cells_of_a_table_meet_their_blocks(spark):
    cells = [(1, 1, "d"), (0, 0, "a*"), (0, 1, "b|"), (1, 1, "e"), (2, 0, "f")]  # in no order, one place twice, a short row
    d = spark.createDataFrame([([(*c, 1, 1, c[0] == 0, False) for c in cells], {65537: "**x**", 99: "none"}), ([], None)], f"cells array<{nodes.CELL}>, inner map<bigint,string>")
    got = d.select(render.cells_markdown(F.col("cells"), F.col("inner")).alias("md"), render.cells_markdown(F.transform("cells", lambda c: c.withField("colspan", F.lit(2))), F.col("inner")).alias("html")).collect()
    assert got[0].md == "| a\\* | b\\| |\n| --- | --- |\n| **x** | **x** |\n| f |  |"
    assert got[0].html.count("<tr>") == 3 and got[0].html.count(">**x**</td>") == 2
    assert not got[1].md


def test_a_long_table_is_rendered_in_time(spark):
    began = time.time()
    cells = F.expr("transform(sequence(0, 7999), i -> struct(i div 2 as row, i % 2 as col, cast(i as string) as text, 1 as colspan, 1 as rowspan, i < 2 as is_header, true as owned))")
    inner = F.expr("map_from_arrays(transform(sequence(0, 3999), i -> shiftleft(cast(i as bigint), 16)), transform(sequence(0, 3999), i -> concat('*', i, '*')))")
    d = spark.range(1).select(cells.cast(f"array<{nodes.CELL}>").alias("cells"), inner.alias("inner"))
    md = d.select(render.cells_markdown(F.col("cells"), F.col("inner")).alias("md")).first().md.split("\n")
    assert len(md) == 4001 and md[0] == "| *0* | 1 |" and md[-1] == "| *3999* | 7999 |"
    assert time.time() - began < 60  # the work was in the cube of a table's rows


def binary(*sections, flags=0):
    body = [(f"BodyText/Section{n}", data) for n, data in sections]
    return compound.make_file([("FileHeader", records.header_bytes(flags)), ("DocInfo", b""), *body])


def test_rows_of_many_documents_are_a_batch():
    one = lambda i: (([str(i)], [b"x" * i]), i)
    sizes = [b.num_rows for b in batches.batches(map(one, range(25_000)), ("path", "content"), (pa.string(), pa.binary()))]
    assert sum(sizes) == 25_000 and max(sizes) <= batches.MOST_ROWS and len(sizes) < 100  # each file was a batch
    assert not list(batches.batches(iter([(([], []), 0)]), ("path", "content"), (pa.string(), pa.binary())))


def test_streams_of_binary_documents_are_opened_without_a_shuffle(spark):
    p = lambda t: b"\x42\x00\x60\x01" + bytes(22) + (len(t) * 2 << 20 | 1 << 10 | 67).to_bytes(4, "little") + t.encode("utf-16-le")
    files = [("a", binary((0, p("one")), (1, p("two")), (3, p("behind a gap")))), ("b", b"damaged"), ("c", compound.make_file([("BodyText/Section0", p("no header"))])), ("d", binary((1, p("no first")))), ("e", binary((0, p("hidden")), flags=2))]
    d = spark.createDataFrame(files, "path string, content binary")
    opened = binary_documents.contents(binary_documents.opened(d))
    assert "Exchange" not in opened._jdf.queryExecution().toString()  # all streams were joined to their headers and gone through by document
    assert sorted((r.path, r.section) for r in opened.collect()) == [("a", -1), ("a", 0), ("a", 1), ("d", -1)]
    out = binary_documents.read(d)
    assert [(r.path, r.section, r.text) for r in out["blocks"].orderBy("path", "ord").collect()] == [("a", 0, "one"), ("a", 1, "two"), ("c", 0, "no header")]  # which is searched for
    assert {r.path: (r.recovered, r.error) for r in out["documents"].collect()} == {"a": (False, None), "b": (True, None), "c": (True, None), "d": (False, None), "e": (False, "DrmProtected")}


def test_records_know_their_paragraph(spark):
    r = lambda tag, level: (tag | level << 10).to_bytes(4, "little")
    content = r(67, 0) + r(66, 0) + r(71, 1) + r(67, 2) + r(66, 2) + r(67, 3) + r(68, 1) + r(66, 0) + r(67, 1)
    got = records.records(spark.createDataFrame([("a", content)], "path string, content binary")).orderBy("rec").collect()
    assert [x.para for x in got] == [None, 1, 1, None, 4, 4, 1, 7, 7]


def test_a_single_runs_text_is_kept_once(spark):
    run = lambda t, **k: nodes.run(text=F.lit(t), **k)
    d = spark.range(1).select(F.lit("ab").alias("text"), F.array(run("ab", bold=F.lit(True))).alias("one"), F.array(run("a"), run("b")).alias("two"), F.array(run("a")).alias("other"), F.lit(None).cast(f"array<{nodes.RUN}>").alias("none"))
    cols = ("one", "two", "other", "none")
    short = d.select("text", *(nodes.without_text(F.col(c), F.col("text")).alias(c) for c in cols))
    assert short.first().one[0].text is None and short.first().one[0].bold
    assert short.select("text", *(nodes.with_text(F.col(c), F.col("text")).alias(c) for c in cols)).first() == d.first()


def test_lines_and_containers_are_rows_in_the_order_of_fields(spark):
    none = [None] * 7
    assert containers.container_rows("1. a\n\n   b\n") == [  # they were dictionaries, and each text a batch
        [0, 0, 0, None, None, None, None, "item", 1, 0, True, 1, None, None, ".", None],
        [0, 1, 1, 1, "a", None, None, None, None, *none[:6], 0], [1, 1, 1, 1, "", None, None, None, None, *none[:6], 0], [2, 1, 1, 1, "b", None, None, None, None, *none[:6], 0], [3, 1, 1, 1, "", None, None, None, None, *none[:6], 0],
    ]
    d = spark.range(3000).selectExpr("id as doc", "concat('a ', id, '\n\n- b') as text").coalesce(1)
    rows = containers.rows(d, F.col("doc"), F.col("text"))
    sizes = rows.mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in bs), "n long").collect()
    assert sum(r.n for r in sizes) == 3000 * 4 and max(r.n for r in sizes) > 1000


@pytest.mark.parametrize("text", ["Abc\n===", "a|b\n-|-\nc|d", "   x\n-", "a\n    b", "A. x\n1. y", "a\tb\n\tc", "b\n<!-- header -->\nc", "a\n$$\nx\n$$", "h1> a\n<h1>\na\n\nb"])
def test_lines_that_begin_with_a_letter_are_as_before(spark, text):
    got = markdown.blocks(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("block").collect()
    want = {"Abc\n===": ["heading"], "a|b\n-|-\nc|d": ["table"], "   x\n-": ["heading"], "A. x\n1. y": ["paragraph", "item"], "b\n<!-- header -->\nc": ["paragraph", "marker", "paragraph"], "a\n$$\nx\n$$": ["paragraph", "math"], "h1> a\n<h1>\na\n\nb": ["paragraph", "html", "paragraph", "paragraph"]}
    assert [r.kind for r in got] == want.get(text, ["paragraph"])


def test_shuffles_of_kept_tables_are_cleared_and_the_setting_stays(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    d = spark.range(100).groupBy((F.col("id") % 7).alias("k")).count()
    before = spark.conf.get(key, None)
    assert sorted(r["count"] for r in store.kept(d).collect()) == sorted(r["count"] for r in d.collect())
    assert spark.conf.get(key, None) == before
    seen = []
    real = type(d.write).parquet
    try:
        type(d.write).parquet = lambda self, *a, **k: (seen.append(spark.conf.get(key)), real(self, *a, **k))[1]
        store.kept(d)
    finally:
        type(d.write).parquet = real
    assert seen == ["true"]
