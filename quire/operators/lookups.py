"""Lookups of a document's dictionaries; what a miss gives is part of each.

Dictionaries are joined on (document, ordinal or name); AQE broadcasts the
small ones and splits a hot document's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(rows: DataFrame, values: DataFrame, on: list[str], take: dict[str, str], missing: dict | None = None) -> DataFrame:
    """``rows`` with columns of the matching row of ``values``: null, or what ``missing`` says, without one.

    Keys match null-safely, so a format key with an unset part finds its entry.
    """
    r, v = rows.alias("r"), values.select(*on, *(F.col(a).alias(f"found_{b}") for a, b in take.items())).alias("v")
    condition = None
    for k in on:
        c = F.col(f"r.{k}").eqNullSafe(F.col(f"v.{k}"))
        condition = c if condition is None else condition & c
    value = lambda b: F.col(f"v.found_{b}")
    found = {b: F.coalesce(value(b), F.lit(missing[b])) if b in (missing or {}) else value(b) for b in take.values()}
    return r.join(v, condition, "left").select("r.*", *(c.alias(b) for b, c in found.items()))


def resolve_images(images: DataFrame, entries: DataFrame, by: list[str], entry: str = "path") -> DataFrame:
    """Image references (``src``) replaced by the entry whose file name has their stem; the last of several; unchanged without one."""
    stem = F.regexp_extract(entry, r"([^/]+?)(?:[.][^./]*)?$", 1)
    last = entries.groupBy(*by, stem.alias("src")).agg(F.max_by(entry, "ord").alias("last_entry"))
    r, v = images.alias("r"), last.alias("v")
    condition = F.col("r.src") == F.col("v.src")
    for k in by:
        condition &= F.col(f"r.{k}") == F.col(f"v.{k}")
    kept = [F.coalesce("v.last_entry", "r.src").alias("src") if c == "src" else F.col(f"r.{c}") for c in images.columns]
    return r.join(v, condition, "left").select(*kept)


def grid(cells: DataFrame, by: list[str], most_rows: int = 10_000) -> DataFrame:
    """``by..., row, cells`` with the texts of each row in column order; rows without cells are empty ones.

    Cells in rows from ``most_rows`` on are dropped.
    """
    c = cells.where(F.col("row") < most_rows)
    rows = c.groupBy(*by, "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda x: x.text).alias("cells"))
    known = rows.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("row", "cells"))).alias("m"), F.max("row").alias("last"))
    full = F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.struct(i.alias("row"), F.coalesce(F.try_element_at(F.col("m"), i), F.array().cast("array<string>")).alias("cells")))
    return known.select(*by, F.inline(full))


def orphans(references: DataFrame, notes: DataFrame, on: list[str]) -> DataFrame:
    """References without a note."""
    return references.join(notes.select(*on).distinct(), on, "left_anti")
