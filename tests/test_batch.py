"""Batches of files of all formats, and what is left of them."""

import os

from pyspark.sql import functions as F

from quire.plans import convert
from tests.test_blocks_in_blocks import SECTION, package_of
from tests.test_conversion import binary_document


def test_a_batch_writes_once_and_keeps_its_outcomes(spark, tmp_path):
    rows = [
        ("in/a.hwp", "records", binary_document()), ("in/b.hwpx", "package", package_of(**{"Contents__section0.xml": SECTION, "BinData__pic.png": b"1"})), ("in/c.md", "markdown", b"# t\n\n- a\n\n  b"),
        ("in/d.hwpx", "package", b"no archive"), ("in/b.hwp", "records", binary_document()),
    ]
    files = spark.createDataFrame(rows, "path string, kind string, content binary")
    folder = str(tmp_path / "out")
    first = {r.path: r for r in convert.run_batch(files, folder).collect()}
    assert {p: (r.target, r.status, r.error, r.n_assets) for p, r in first.items()} == {
        "in/a.hwp": ("a.md", "converted", None, 1), "in/b.hwp": ("b.md", "converted", None, 1), "in/b.hwpx": ("b.md", "skipped", None, None), "in/c.md": ("c.hwpx", "converted", None, 0), "in/d.hwpx": ("d.md", "failed", "Zip", 0),
    }
    left = sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) if "_outcomes" not in d for f in names)
    assert left == ["a.assets/image_1.png", "a.md", "b.assets/image_1.png", "b.md", "c.hwpx"]  # no temporary files, nothing of what failed
    text = (tmp_path / "out" / "a.md").read_text()
    assert "![](a.assets/image_1.png)" in text and text.startswith('---\ntitle: "Title"') and len(text.encode()) == first["in/a.hwp"].bytes
    again = {r.path: r.status for r in convert.run_batch(files, folder).collect()}
    assert again == {"in/a.hwp": "skipped", "in/b.hwp": "skipped", "in/b.hwpx": "skipped", "in/c.md": "skipped", "in/d.hwpx": "failed"}
    assert {r.path: r.status for r in convert.run_batch(files.where("path = 'in/c.md'"), folder, force=True).collect()} == {"in/c.md": "converted"}
    assert convert.outcomes(spark, folder).count() == 11 and convert.outcomes(spark, str(tmp_path / "none")).count() == 0
    packed = files.where("path = 'in/b.hwpx'").withColumn("path", F.lit("in/e.hwpx"))
    assert [r.n_assets for r in convert.run_batch(packed, folder).collect()] == [1]
    assert "![x](e.assets/pic.png)" in (tmp_path / "out" / "e.md").read_text()
