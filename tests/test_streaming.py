from pyspark.sql import functions as F

from quire.sources import package
from quire.streaming import files


def test_stream_of_packages_equals_the_batch(spark, tmp_path):
    xml = package.section_xml(package.paragraph_xml(package.run_xml(F.concat(F.lit("text "), F.col("path")))))
    parts = spark.createDataFrame([("a",), ("b",)], "path string").select("path", F.lit(0).alias("ord"), F.lit("Contents/section0.xml").alias("name"), xml.alias("data"))
    for r in package.packages(parts).collect():
        (tmp_path / f"{r.path}.HWPX").write_bytes(bytes(r.content))
    (tmp_path / "c.hwpx").write_bytes(b"no archive")
    (tmp_path / "d.txt").write_text("other")
    (tmp_path / ".e.hwpx").write_bytes(b"hidden")
    batch = files.section_events(files.scan(spark, str(tmp_path))).where("kind = 'run'").select("text").collect()
    assert sorted(r.text for r in batch) == ["text a", "text b"]
    assert files.scan(spark, str(tmp_path)).count() == 3
    stream = files.section_events(files.scan(spark, str(tmp_path), streaming=True)).where("kind = 'run'").select("text")
    q = stream.writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "_state")).start()
    try:
        q.processAllAvailable()
        assert sorted(r.text for r in spark.table("arrived").collect()) == ["text a", "text b"]
    finally:
        q.stop()
