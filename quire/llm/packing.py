"""Packing of documents into sequences by minimum bin slack.

Token ids are cut into pieces of at most the window's length: full windows, and
a remainder for each document. What has to be arranged is a multiset of
remainder lengths below the window's, so a histogram of that many counters
describes it, however many documents there are. The plan is made from the
histogram: the longest remaining length opens a window, and a bitset
subset-sum over the remaining multiset finds the lengths that bring it closest
to capacity; walking the bitsets back gives how often each length is used. The
pattern is repeated as often as its lengths last. Where the best fill leaves
slack, a longer piece is cut to fill it and its tail goes back to the multiset.

The plan gives each rank within a length its sequence and offset; pieces look
theirs up in tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import give_back_memory, lean_batches, new_path
from quire.llm.text_hash import slices
from quire.llm.tokens import word_tokenizer


#: A pattern takes at least one part in this many of the ranks of its longest length, so the plan stays small.
BULK = 32


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """Lengths, with how often each is taken, whose sum comes closest to ``room`` from below."""
    full, bits, layers = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left:
            part = min(part, left)
            layers.append((length, part, bits))
            bits |= (bits << (length * part)) & full
            left -= part
            part *= 2
        if bits >> room & 1:
            break
    at, taken = bits.bit_length() - 1, {}
    for length, part, before in reversed(layers):
        if not before >> at & 1:
            at -= length * part
            taken[length] = taken.get(length, 0) + part
    return taken


def plan(histogram: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Segments of ranks, and the number of sequences.

    A segment is ``length, first rank, ranks, uses per sequence, first sequence,
    offset, cut, first rank of the tails``: ranks of one length that are placed
    (cut 0), or whose first ``cut`` ids are placed and whose tails become ranks
    of the length that is left.
    """
    counts = {int(x): int(histogram[x]) for x in np.flatnonzero(histogram)}
    total, used = dict(counts), dict.fromkeys(counts, 0)
    segments, sequences = [], 0

    def take(length: int, n: int) -> int:
        first = used.get(length, 0)
        used[length] = first + n
        counts[length] -= n
        if not counts[length]:
            del counts[length]
        return first

    longest = sorted(counts)
    while counts:
        while longest and longest[-1] not in counts:
            longest.pop()
        top = longest[-1]
        # A length with many ranks is filled from lengths that have enough of them to repeat the pattern.
        for scale in (counts[top] // BULK, 1):
            scale = max(1, scale)
            left = {x: c // scale for x, c in counts.items() if c >= scale}
            left[top] -= 1
            pattern = fill({x: c for x, c in left.items() if c}, capacity - top)
            pattern[top] = pattern.get(top, 0) + 1
            slack = capacity - sum(k * v for k, v in pattern.items())
            reps = min(counts[x] // k for x, k in pattern.items())
            cut = min((x for x, c in counts.items() if x > slack and c // scale > pattern.get(x, 0)), default=None) if slack else None
            if cut:
                reps = min(reps, counts[cut] // (pattern.get(cut, 0) + 1))
            if cut or not slack:
                break
        offset = 0
        for length in sorted(pattern, reverse=True):
            k = pattern[length]
            segments.append((length, take(length, k * reps), k * reps, k, sequences, offset, 0, 0))
            offset += k * length
        if cut:
            tail = cut - slack
            segments.append((cut, take(cut, reps), reps, 1, sequences, offset, slack, total.get(tail, 0)))
            total[tail] = total.get(tail, 0) + reps
            counts[tail] = counts.get(tail, 0) + reps
            if tail not in longest:
                longest = sorted({*longest, tail})
        sequences += reps
    out = np.array(segments, np.int64).reshape(-1, 8)
    return out[np.lexsort((out[:, 1], out[:, 0]))], sequences


def _encoded(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        give_back_memory()
        part, tok = TaskContext.get().partitionId(), word_tokenizer(path)
        seen, windows = np.zeros(capacity, np.int64), 0
        for batch in batches:
            for b in slices(batch, "text"):
                ids, at = tok.encode(b.column("text"))
                # the end id is put behind each text
                n = np.diff(at) + 1
                ends = np.cumsum(n)
                out = np.full(int(ends[-1]) if len(ends) else 0, end_id, np.uint32)
                keep = np.ones(len(out), bool)
                keep[ends - 1] = False
                out[keep] = ids
                width = np.uint16 if out.max(initial=0) < 1 << 16 else np.uint32
                rank, before = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
                for i, (full, rest) in enumerate(zip((n // capacity).tolist(), (n % capacity).tolist(), strict=True)):
                    rank[i], before[i] = seen[rest], windows
                    seen[rest] += 1
                    windows += full
                data = out.astype(width).tobytes()
                size = np.dtype(width).itemsize
                ids_col = pa.array([data[(e - k) * size : e * size] for e, k in zip(ends.tolist(), n.tolist(), strict=True)], pa.binary())
                columns = [b.column("doc_id"), ids_col, pa.array(n), pa.array(np.full(len(n), size)), pa.array(np.full(len(n), part)), pa.array(n % capacity), pa.array(rank), pa.array(before)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "n", "width", "part", "rest", "rank", "windows"])

    return run


_PIECE = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())]


def _placed(plan_table, sequences: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = plan_table.value
        key = seg[:, 0] << 44 | seg[:, 1]
        for b in batches:
            rows, held = [], 0
            for doc, data, n, width, rest, rank, base, window in zip(*(b.column(c).to_pylist() for c in ("doc_id", "ids", "n", "width", "rest", "rank", "rank_base", "window")), strict=True):
                ids = np.frombuffer(data, np.uint16 if width == 2 else np.uint32).astype("<u4")
                pieces = [(j * capacity, capacity, sequences + window + j, 0) for j in range(n // capacity)]
                start, length, rank = n - rest, rest, rank + base
                while length:
                    s = seg[np.searchsorted(key, length << 44 | rank, "right") - 1]
                    i, k, cut = rank - int(s[1]), int(s[3]), int(s[6])
                    size = cut or length
                    pieces.append((start, size, int(s[4]) + i // k, int(s[5]) + i % k * length))
                    start, length, rank = start + size, length - size, int(s[7]) + i
                rows += [(doc, a, m, n, q, o, ids[a : a + m].tobytes()) for a, m, q, o in pieces]
                held += len(ids)
                if held > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _PIECE, strict=True)], names=[c for c, _ in _PIECE])
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _PIECE, strict=True)], names=[c for c, _ in _PIECE])

    return run


def pack_documents(docs: DataFrame, *, tokenizer: str, capacity: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, length, doc_tokens, sequence_id, offset, ids`` of each piece.

    ``start`` counts the document's ids before the piece, ``offset`` the ids before
    it in its sequence; ``ids`` are little-endian 32-bit. Sequences are filled
    without gaps; all but the last are full.

    * null and empty texts are a document of just the end id;
    * rows that repeat an id, or have a null one, are documents of their own;
    * very long texts give many full windows; further columns are ignored;
    * an empty table gives an empty result.

    Memory: the plan has a few segments for each possible length, whatever the
    number of documents. A length that a third of the documents have is dealt
    with by ranks within (task, length).
    """
    lean_batches(docs.sparkSession)
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    path = new_path(spark, "ids")
    schema = "doc_id long, ids binary, n long, width long, part long, rest long, rank long, windows long"
    d.mapInArrow(_encoded(tokenizer, end_id, capacity), schema).write.option("compression", "zstd").parquet(path)
    encoded = spark.read.schema(schema).parquet(path)
    by_length = encoded.groupBy("part", "rest").agg(F.count("*").alias("c"), F.sum(F.floor(F.col("n") / capacity)).alias("full"))
    parts = by_length.groupBy("part").agg(F.sum("full").alias("full"))
    parts = parts.select("part", (F.sum("full").over(Window.orderBy("part")) - F.col("full")).alias("window_base"))  # a row a task
    rank_base = F.sum("c").over(Window.partitionBy("rest").orderBy("part")) - F.col("c")
    bases = by_length.select("part", "rest", "c", rank_base.alias("rank_base")).join(parts, "part")
    histogram = np.zeros(capacity, np.int64)
    for r in by_length.where("rest > 0").groupBy("rest").agg(F.sum("c").alias("c")).collect():  # fewer rows than the window has ids
        histogram[r["rest"]] = r["c"]
    segments, sequences = plan(histogram, capacity)
    table = spark.sparkContext.broadcast(segments)
    ready = encoded.join(bases.drop("c"), ["part", "rest"]).withColumn("window", F.col("windows") + F.col("window_base"))
    ready = ready.select("doc_id", "ids", "n", "width", "rest", "rank", "rank_base", "window")
    return ready.mapInArrow(_placed(table, sequences, capacity), "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


