"""Packaged documents: entries to sections, events to blocks.

A section's events are regrouped by paragraph, cell, note and list item with
aggregates; breaks within a paragraph and lists are windows within a section.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.classify import heading_of, list_depth
from quire.operators.lookups import resolve_images
from quire.plans.nodes import RUN, block, number_lists, run, runs_text, spoken, with_cells
from quire.sources import package
from quire.store import kept

_PLACE = ["path", "section", "para", "split", "region", "parent", "cell", "nest", "via"]


def paragraphs(events: DataFrame, headers: DataFrame) -> DataFrame:
    """The parts of paragraphs between page breaks, with their runs, owners and heading levels."""
    w = Window.partitionBy("path", "section", "para").orderBy("ord")
    broken = (F.col("kind") == "page_break").cast("int")
    e = events.where("kind in ('paragraph', 'run', 'reference', 'page_break') and para >= 0").withColumn("split", F.sum(broken).over(w))
    e = e.withColumn("splits", F.max("split").over(Window.partitionBy("path", "section", "para")))
    as_run = run(
        text=F.coalesce("text", F.lit("")), bold=F.coalesce("bold", F.lit(False)), italic=F.coalesce("italic", F.lit(False)), underline=F.coalesce("underline", F.lit(False)), strike=F.coalesce("strike", F.lit(False)),
        superscript=F.coalesce(F.col("script") == "superscript", F.lit(False)), subscript=F.coalesce(F.col("script") == "subscript", F.lit(False)), colour=F.col("colour"), link=F.when(F.col("kind") == "run", F.col("link")), ruby=F.col("ruby"), note=F.col("ref"),
    )
    is_run = F.col("kind").isin("run", "reference")
    e = e.select(*_PLACE, "splits", "ord", "kind", "style", "property", "numbering", "language", "bold", "height", F.when(is_run, F.struct("ord", as_run.alias("run"), "font")).alias("placed"))
    tall = F.when(F.col("height") > 0, F.struct("height", -F.col("ord")))
    p = e.groupBy(*_PLACE).agg(
        F.min(F.when(F.col("kind") != "page_break", F.col("ord"))).alias("ord"), F.first("style", True).alias("style"), F.first("property", True).alias("property"), F.first("numbering", True).alias("numbering"), F.max("language").alias("language"),
        F.max("splits").alias("splits"), F.max("height").alias("height"), F.max_by(F.coalesce("bold", F.lit(False)), tall).alias("tall_bold"), F.array_sort(F.collect_list("placed")).alias("placed"),
    )
    p = p.join(headers.select("path", "faces"), "path", "left")
    runs = F.transform("placed", lambda x: x.run.withField("font", F.get("faces", x.font)))
    p = p.withColumn("runs", runs.cast(f"array<{RUN}>")).drop("placed", "faces")
    p = p.withColumn("text", runs_text(F.col("runs")))
    nested = F.col("parent").isNotNull() | (F.col("region") != "body") | (F.col("split") < F.col("splits"))
    return p.withColumn("level", heading_of(F.col("style"), F.col("text"), F.coalesce("tall_bold", F.lit(False)), F.coalesce("height", F.lit(0)), nested))


def blocks(events: DataFrame, headers: DataFrame, binaries: DataFrame) -> DataFrame:
    """The documents' blocks (:mod:`quire.plans.nodes`) in order of their events.

    Blank paragraphs go, but for those with a note's reference.
    """
    p = paragraphs(events, headers)
    says = (F.trim("text") != "") | F.exists("runs", lambda r: r.note.isNotNull())
    is_code = F.col("language").isNotNull()
    is_item = ~is_code & F.col("level").isNull() & (F.col("property") >= 2) & (F.col("region") == "body") & F.col("parent").isNull()
    kind = F.when(is_code, "code").when(F.col("level").isNotNull(), "heading").when(is_item, "item").otherwise("paragraph")
    where = {k: F.col(k) for k in ("section", "region", "ord", "parent", "cell", "nest")}

    def out(d: DataFrame, lst: Column | None = None, **columns: Column) -> DataFrame:
        return d.select("path", (F.lit(None) if lst is None else lst).cast("int").alias("lst"), *block(**where, **columns))

    plain = out(p.where(says), kind=kind, via=F.when(F.col("nest") > 0, F.col("via")), level=F.col("level"), language=F.nullif(F.col("language"), F.lit("")), text=F.col("text"), runs=F.col("runs"), depth=F.when(is_item, list_depth(F.col("property"))).otherwise(0), ordered=F.when(is_item, F.coalesce(F.col("numbering") == 1, F.lit(False))))
    seen = F.col("kind").isin("image", "math", "page_break")
    loose = out(events.where(seen), kind=F.col("kind"), via=F.when(F.col("nest") > 0, F.col("via")), src=F.when(F.col("kind") == "image", F.col("ref")), alt=F.when(F.col("kind") == "image", F.coalesce("text", F.lit(""))), text=F.when(F.col("kind") == "math", F.col("text")))
    boxes = events.where("kind in ('item', 'note', 'table')")
    boxed = out(boxes, lst=F.col("lst"), kind=F.when(F.col("kind") == "note", "footnote").otherwise(F.col("kind")), via=F.when((F.col("nest") > 0) | (F.col("via") == "children"), F.coalesce("via", F.lit("blocks"))), note_id=F.when(F.col("kind") == "note", F.col("ref")), ordered=F.col("ordered"), depth=F.coalesce("depth", F.lit(0)))
    every = kept(plain.unionByName(loose).unionByName(boxed))
    every = spoken(with_cells(every, events.where("kind = 'cell'"), ["path", "section"]), ["path", "section"])
    every = resolve_images(every, binaries.select("path", F.col("entry").alias("entry_path"), "ord"), ["path"], "entry_path")
    return number_lists(every.withColumn("via", F.when((F.col("kind") == "item") & (F.col("nest") == 0) & F.col("lst").isNotNull(), "blocks").otherwise(F.col("via"))), ["path"], same_kind=False, apart="lst")


def layouts(events: DataFrame) -> DataFrame:
    """``path, section`` and page size, orientation and margins of the sections that have page properties; the last of several values counts."""
    e = events.where("kind = 'layout'")
    last = lambda k: F.max_by(F.col("extra")[k], F.when(F.col("extra")[k].isNotNull(), F.col("ord")))
    found = e.groupBy("path", "section").agg(*(last(k).cast("int").alias(k) for k in ("width", "height", "left", "right", "top", "bottom")), F.coalesce(last("landscape") == "true", F.lit(False)).alias("landscape"), F.min(F.size("extra")).alias("least"))
    return found.where("least = 0").drop("least")


def read(files: DataFrame) -> dict[str, DataFrame]:
    """``blocks``, ``documents``, ``assets``, ``sections`` and ``diagnostics`` of (path, content) packages.

    A section that isn't well-formed, or that the manifest names and the package
    doesn't have, is left out and named in ``diagnostics``. What isn't an archive,
    and a package without a readable section, has its error in ``documents``.
    """
    return of_entries(package.entries(files))


def of_entries(entries: DataFrame) -> dict[str, DataFrame]:
    """The same of (path, ord, name, data, error) entries, as :mod:`quire.sources.parts` scans them.

    Where pictures were filtered out there, there are no assets, and the texts are the same.
    """
    parts = kept(entries.select("path", "ord", "name", "data", "error"))
    good = parts.where("error is null")
    listed = kept(package.manifest_sections(good))
    events = kept(package.events(listed.where("data is not null")))
    headers, binaries = package.header_parts(good), package.binaries(good)
    bad = parts.groupBy("path").agg(F.max(F.when(F.col("name").isNull(), F.col("error"))).alias("error"))
    lost = listed.where("data is null").select("path", "section", F.lit("SectionMissing").alias("error")).unionByName(events.where("kind = 'error'").select("path", "section", F.lit("Xml").alias("error")))
    read = listed.where("data is not null").select("path").distinct().withColumn("found", F.lit(True))
    documents = bad.join(headers, "path", "left").join(read, "path", "left")
    documents = documents.select("path", "title", "author", "subject", "description", F.coalesce("error", F.when(F.col("found").isNull(), "NoSections")).alias("error"))
    kinds = events.where("kind = 'header_footer'").groupBy("path", "section").agg(F.max_by("ref", "ord").alias("header_footer_type"))
    sections = events.select("path", "section").distinct().join(layouts(events), ["path", "section"], "left").join(kinds, ["path", "section"], "left").join(headers.select("path", "breaks"), "path", "left")
    return {"blocks": blocks(events.where("kind <> 'error'"), headers, binaries), "documents": documents, "assets": binaries, "sections": sections, "diagnostics": lost}
