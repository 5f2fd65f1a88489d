"""Merkle manifest of a dataset: a tree of SHA-256 digests over rows, and each row's proof.

Rows of a group (a language) are the leaves of the group's tree in the order of
their ids; the groups' roots are the leaves of the tree above. Digests are joined
as hexadecimal text. While a level has more than one node, each run of ``fanout``
consecutive nodes becomes the digest of the run; the last run may be shorter.

A tree is worked off in aligned blocks of ``fanout ** depth`` leaves, so a group of
any size is dealt to any number of tasks and each block climbs the same number of
levels by itself. A block is a contiguous matrix of 64 bytes a row: a level is
reshaped by the fanout and hashed row by row, and the siblings of all leaves are
index arithmetic on the levels. The tops of the blocks are the leaves of the next
round, until a group has one block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import numbered, written
from quire.llm.text_hash import text_bytes

#: Leaves of a block are at most so many.
BLOCK = 1024
_PROOF = "array<struct<place:int,others:string>>"


def field(value: Column) -> Column:
    """A field of a leaf: ``-`` for null, else the count of its UTF-8 bytes, ``:`` and its text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """Digest of a row: lower-case hexadecimal SHA-256 of its fields in turn."""
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of its proof give, level by level."""
    def step(node: Column, level: Column) -> Column:
        left = level.place * 64
        return F.sha2(F.concat(F.substring(level.others, F.lit(1), left), node, F.substring(level.others, left + 1, F.length(level.others))).cast("binary"), 256)

    return F.aggregate(proof, start, step)


def _hex(digests: list[str]) -> np.ndarray:
    return np.frombuffer("".join(digests).encode(), np.uint8).reshape(-1, 64)


def climb(leaves: np.ndarray, total: int, fanout: int, depth: int) -> list[np.ndarray]:
    """Levels of an aligned block, from its leaves to its one top node.

    ``total`` is the number of nodes that the whole level of the group has: where
    that is one, the tree ends.
    """
    levels = [leaves]
    while total > 1 and len(levels) <= depth:
        rows = levels[-1]
        whole = len(rows) // fanout
        runs = [hashlib.sha256(r).hexdigest() for r in rows[: whole * fanout].reshape(whole, 64 * fanout)]
        if whole * fanout < len(rows):
            runs.append(hashlib.sha256(rows[whole * fanout :].tobytes()).hexdigest())
        levels.append(_hex(runs))
        total = -(-total // fanout)
    return levels


def siblings(levels: list[np.ndarray], fanout: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in its run, length of the others, the others in padded bytes) of each leaf at each level below the top."""
    n, depth = len(levels[0]), len(levels) - 1
    place, size = np.zeros((n, depth), np.int32), np.zeros((n, depth), np.int32)
    others = np.zeros((n, depth, 64 * (fanout - 1)), np.uint8)
    at = np.arange(n)
    for d, rows in enumerate(levels[:-1]):
        first = at // fanout * fanout
        place[:, d] = at - first
        size[:, d] = 64 * (np.minimum(first + fanout, len(rows)) - first - 1)
        k = first[:, None] + np.arange(fanout - 1)
        k += k >= at[:, None]
        others[:, d] = rows[np.minimum(k, len(rows) - 1)].reshape(n, -1)
        at = at // fanout
    return place, size, others


def _matrix(digests: pa.ChunkedArray) -> np.ndarray:
    return text_bytes(pa.concat_arrays(digests.chunks) if digests.num_chunks else pa.array([], pa.string()))[0].reshape(-1, 64)


def _tops(fanout: int, depth: int):
    """The top of a block, as a leaf of the next round."""

    def run(key, block):
        order = np.argsort(block["pos"].to_numpy(), kind="stable")
        total = block["total"][0].as_py()
        top = climb(_matrix(block["digest"])[order], total, fanout, depth)[-1]
        return pa.table({"group": pa.array([key[0].as_py()], pa.string()), "pos": pa.array([key[1].as_py()], pa.int64()), "total": pa.array([-(-total // fanout**depth)], pa.int64()), "digest": [top.tobytes().decode()]})

    return run


def _proofs(fanout: int, depth: int, columns: list[str]):
    """The nodes of a block with their siblings, those above the block included."""

    def run(key, block, above):
        block = block.take(pa.array(np.argsort(block["pos"].to_numpy(), kind="stable")))
        n, total = block.num_rows, block["total"][0].as_py() if block.num_rows else 0
        place, size, others = siblings(climb(_matrix(block["digest"]), total, fanout, depth), fanout)
        up = above["proof"][0].as_py() if n else []
        higher = np.zeros((len(up), others.shape[2]), np.uint8)
        for i, level in enumerate(up):
            higher[i, : len(level["others"])] = np.frombuffer(level["others"].encode(), np.uint8)
        rows = lambda x: np.broadcast_to(x, (n, *x.shape))
        place = np.concatenate([place, rows(np.array([x["place"] for x in up], np.int32))], 1)
        size = np.concatenate([size, rows(np.array([len(x["others"]) for x in up], np.int32))], 1)
        others = np.concatenate([others, rows(higher)], 1)
        data = others[np.arange(others.shape[2]) < size[..., None]].tobytes()
        texts = pa.StringArray.from_buffers(size.size, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32).tobytes()), pa.py_buffer(data))
        levels = pa.StructArray.from_arrays([pa.array(place.ravel()), texts], ["place", "others"])
        proof = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * place.shape[1]), levels)
        same = {c: pa.repeat(above[c][0], n) for c in above.column_names if c not in ("group", "block", "proof")} if n else {}
        return pa.table({c: proof if c == "proof" else same[c] if c in same else block[c] for c in columns})

    return run


def _join(nodes: DataFrame, above: DataFrame, fanout: int, depth: int) -> DataFrame:
    """``nodes`` with what ``above`` (group, block, proof, ...) has of their block, proofs put together."""
    more = [f for f in above.schema if f.name not in ("group", "block", "proof")]
    kinds = {f.name: f.dataType.simpleString() for f in [*nodes.schema, *more]} | {"proof": _PROOF}
    schema = ", ".join(f"`{c}` {t}" for c, t in kinds.items())
    keyed = nodes.withColumn("block", F.expr(f"pos div {fanout**depth}"))
    return keyed.groupBy("group", "block").cogroup(above.groupBy("group", "block")).applyInArrow(_proofs(fanout, depth, list(kinds)), schema)


def _above(nodes: DataFrame, fanout: int, depth: int) -> DataFrame:
    """(group, block, root, proof): the siblings of each block's top up to the root of its group, and that root."""
    blocks = nodes.select("group", F.expr(f"pos div {fanout**depth}").alias("block"), "pos", "total", "digest")
    tops = written(blocks.groupBy("group", "block").applyInArrow(_tops(fanout, depth), "group string, pos long, total long, digest string"), "tops")
    block = F.col("pos").alias("block")
    if tops.where("total > 1").isEmpty():
        return tops.select("group", block, F.col("digest").alias("root"), F.array().cast(_PROOF).alias("proof"))
    return _join(tops, written(_above(tops, fanout, depth), "above"), fanout, depth).select("group", block, "root", "proof")


def manifest(rows: DataFrame, *, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang", order: str = "doc_id", fanout: int = 2, keep: dict[str, Column] | None = None) -> DataFrame:
    """A row for each of ``rows``: ``order``'s column, ``leaf``, ``subroot`` (of its group), ``root`` and ``proof``.

    ``proof`` has for each level up to the root the row's place in its run and the
    other digests of the run, left to right: ``fold(leaf, proof)`` is the root.
    ``keep`` adds columns computed from the row, under names of its own.

    * A null field is ``-`` and an empty text ``0:``; null groups are the first
      group, a null id comes first in its group;
    * rows that repeat an id stand by their leaves, equal rows side by side;
    * other columns than ``fields`` are ignored; no rows give no rows.
    """
    if fanout < 2:
        raise ValueError("a run needs two nodes at least")
    depth = max(d for d in range(1, 11) if fanout**d <= max(BLOCK, fanout))
    name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    more = [v.alias(f"kept_{k}") for k, v in (keep or {}).items()]
    leaves = written(rows.select(name.alias("group"), F.col(order).alias("id"), leaf(*map(F.col, fields)).alias("digest"), *more), "leaves")
    nodes = written(numbered(leaves, "group", F.asc_nulls_first("id"), "digest"), "nodes")
    above = written(_above(nodes, fanout, depth), "above")
    subroots = above.groupBy("group").agg(F.any_value("root").alias("digest"))
    heads = written(numbered(subroots.select(F.lit("").alias("group"), F.col("group").alias("name"), "digest"), "group", "name"), "subroots")
    heads = _join(heads, _above(heads, fanout, depth), fanout, depth)
    heads = heads.select(F.col("name").alias("group"), F.col("digest").alias("subroot"), "root", F.col("proof").alias("rest"))
    above = above.drop("root").join(heads, "group").select("group", "block", "subroot", "root", F.concat("proof", "rest").alias("proof"))
    out = _join(nodes, written(above, "above"), fanout, depth)
    return out.select(F.col("id").alias(order), F.col("digest").alias("leaf"), "subroot", "root", "proof", *(F.col(f"kept_{k}").alias(k) for k in keep or {}))


def tampering(rows: DataFrame, modulus: int = 7) -> DataFrame:
    """Proofs of ``rows``, checked against a copy in which every row whose id's crc32 ``modulus`` divides has one character more in ``n_chars``.

    ``folded_root`` is what the copy's leaf and the original siblings give;
    ``verified`` says if that is the root. A null ``n_chars`` stays null.
    """
    changed = F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == 0, F.lit(1)).otherwise(0)
    copy = leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars").cast("decimal(20,0)") + changed, F.col("text"))
    out = manifest(rows, keep={"copy": F.when(changed == 1, copy)})
    joined = F.array_join(F.transform("proof", lambda p: p.others), "")
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(joined.cast("binary"), 256).alias("proof_sha256"), fold(F.coalesce("copy", "leaf"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
