"""Connected components of an undirected graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import drop_written, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of each node in ``edges`` (a, b); a component is named by its smallest node.

    Alternates large-star and small-star steps on the edge table (each step
    links neighbours to the smallest node they see) until nothing changes, which
    takes a logarithmic number of rounds in practice. Rounds are written to the
    shared folder; a hot node is a key of a join whose other side has one row
    for it. Self-loops, repeats and nulls are ignored.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e, "edges")
    state = lambda d: tuple(d.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(20,0)"))).first())
    before = state(e)
    while before[0]:
        step = written(_small_star(_large_star(e)), "edges")
        drop_written(e)
        e, now = step, state(step)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
