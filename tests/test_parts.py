"""The source of documents' parts: what it opens, how it deals its work, and what becomes of errors."""

import io
import os
import zipfile

import pytest

from quire.plans import convert, package_documents
from quire.sources import parts
from tests.test_blocks_in_blocks import SECTION, package_of


def damaged(content, name):
    """The package with bytes of an entry's data changed, so that reading it fails."""
    out = bytearray(content)
    z = zipfile.ZipFile(io.BytesIO(content))
    info = z.getinfo(name)
    at = info.header_offset + 30 + len(name)
    out[at : at + info.compress_size] = bytes(x ^ 255 for x in out[at : at + info.compress_size])
    return bytes(out)


@pytest.fixture
def folder(tmp_path):
    whole = package_of(**{"Contents__section0.xml": SECTION, "BinData__pic.png": b"\x89PNG 123456789"})
    (tmp_path / "a.hwpx").write_bytes(damaged(whole, "BinData/pic.png"))
    (tmp_path / "_b.HWPX").write_bytes(whole)
    (tmp_path / "c.hwpx").write_bytes(b"no archive")
    (tmp_path / "d.md").write_text("# text")
    (tmp_path / "e.hwpx").write_bytes(b"")
    (tmp_path / ".f.hwpx").write_bytes(whole)
    (tmp_path / "g.txt").write_text("other")
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "h.hwpx").write_bytes(whole)
    os.symlink(tmp_path / "_b.HWPX", tmp_path / "i.hwpx")
    return str(tmp_path)


def rows(df):
    return sorted((os.path.basename(r.path), r.name, r.error) for r in df.collect()) if df.count() else []


def test_every_part_is_a_row(spark, folder):
    for split in (1 << 20, 50):
        found = parts.scan(spark, folder, split_bytes=split)
        got = {(os.path.basename(r.path), r.name): (r.kind, r.folder, r.size, None if r.data is None else bytes(r.data), r.error) for r in found.collect()}
        names = zipfile.ZipFile(f"{folder}/_b.HWPX").namelist()
        assert set(got) == {(f, n) for f in ("a.hwpx", "_b.HWPX") for n in names} | {("c.hwpx", None), ("e.hwpx", None), ("d.md", None)}
        assert got["d.md", None] == ("markdown", "", 6, b"# text", None)
        assert got["c.hwpx", None] == got["e.hwpx", None] == ("package", "", None, None, "Zip")
        assert got["_b.HWPX", "BinData/pic.png"] == ("package", "BinData", 14, b"\x89PNG 123456789", None)
        assert got["a.hwpx", "BinData/pic.png"] == ("package", "BinData", 14, None, "Zip")
        assert got["a.hwpx", "Contents/section0.xml"][3] == got["_b.HWPX", "Contents/section0.xml"][3] is not None


def test_texts_need_no_pictures(spark, folder):
    texts = parts.scan(spark, folder).where("kind = 'package' and folder <> 'BinData' and error is null")
    plan = texts._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters: [IsNotNull(kind), IsNotNull(folder), EqualTo(kind,package), Not(EqualTo(folder,BinData))]" in plan
    assert [n for n in plan.split("\n") if n.startswith("Condition")] == [n for n in plan.split("\n") if n.startswith("Condition : isnull(error#")]  # nothing else is left for after the scan
    out = package_documents.of_entries(parts.scan(spark, folder).where("kind = 'package' and folder <> 'BinData'"))
    read = {os.path.basename(r.path): r.error for r in out["documents"].collect()}
    assert read == {"a.hwpx": None, "_b.HWPX": None, "c.hwpx": "Zip", "e.hwpx": "Zip"}  # a's picture can't be read, and isn't
    with open(f"{folder}/_b.HWPX", "rb") as f:
        files = spark.createDataFrame([("b", f.read())], "path string, content binary")
    want = [(r.kind, r.text) for r in package_documents.read(files)["blocks"].orderBy("ord").collect()]
    for name in ("a.hwpx", "_b.HWPX"):
        assert [(r.kind, r.text) for r in out["blocks"].where(f"path like '%/{name}'").orderBy("ord").collect()] == want
    assert out["assets"].count() == 0


def test_filters_rule_files_out_before_they_are_opened(spark, folder, monkeypatch):
    from pyspark.sql import datasource as ds

    at = lambda *x: ds.LessThanOrEqual(("length",), *x)
    reader = parts.PartReader(folder, 1 << 20)
    rest = list(reader.pushFilters([at(10), ds.EqualTo(("error",), "Zip"), ds.Not(ds.StringStartsWith(("name",), "BinData/")), ds.In(("kind",), ("package", "markdown"))]))
    assert rest == [ds.EqualTo(("error",), "Zip")]
    assert [os.path.basename(f[0]) for p in reader.partitions() for f in p.files] == ["c.hwpx", "d.md", "e.hwpx"]
    assert not reader._wanted(name=None) and not reader._wanted(name="BinData/x") and reader._wanted(name="x")
    big = parts.PartReader(folder, 100)
    shares = big.partitions()
    a = [f for p in shares for f in p.files if f[0].endswith("a.hwpx")]
    assert len(a) > 1 and [f[3] for f in a] == list(range(len(a))) and len(shares) > 5
    names = [r[5] for p in shares for r in big._rows(p) if r[0].endswith("a.hwpx")]
    assert sorted(names) == sorted(zipfile.ZipFile(f"{folder}/a.hwpx").namelist())


@pytest.mark.parametrize(
    ("condition", "want"),
    [
        ("name is null", 3), ("name is not null and path like '%a.hwpx'", 5), ("name like 'Contents/%' and path like '%a.hwpx'", 1), ("name not like 'Contents/%' and path like '%a.hwpx'", 4),
        ("not (size > 5)", 0), ("length < 11 and length >= 10", 1), ("kind in ('markdown')", 1), ("kind <=> 'markdown'", 1), ("not (name <=> 'BinData/pic.png') and kind = 'markdown'", 1), ("name like '%.png'", 2), ("name like '%section%'", 2), ("kind = 'records'", 0),
    ],
)
def test_pushed_filters_are_those_of_sql(spark, folder, condition, want):
    found = parts.scan(spark, folder)
    pushed = rows(found.where(condition))
    everything = spark.createDataFrame(found.collect(), parts.SCHEMA)
    assert pushed == rows(everything.where(condition))
    if "a.hwpx" not in condition and "size" not in condition:
        assert len(pushed) == want


def test_long_markdown_is_a_row_without_its_content(spark, folder, monkeypatch):
    monkeypatch.setattr(convert, "MAX_MARKDOWN", 5)
    with open(f"{folder}/short.MD", "w") as f:
        f.write("a")
    files = convert.scan(spark, folder).where("kind = 'markdown'")
    assert {os.path.basename(r.path): (r.length, r.content) for r in files.collect()} == {"d.md": (6, None), "short.MD": (1, b"a")}
    assert {os.path.basename(r.path): r.error for r in convert.check(files).collect()} == {"d.md": "FileTooLarge", "short.MD": None}


def test_an_empty_folder(spark, tmp_path):
    assert parts.scan(spark, str(tmp_path)).count() == 0
