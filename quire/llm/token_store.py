"""Token ids as binary files: documents in id order, coded in chunks of whole documents.

A file is a row of chunks. A chunk is ``QTC2``, the length and CRC-32 of its head
(u32 each), the head (deflated), and the coded blocks (:mod:`quire.llm.id_codec`).
The head holds document ids, their token counts, the ids by rank with their
shares, and each block's size and CRC-32. A chunk decodes by itself, so files are read in parallel within.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm import id_codec
from quire.llm.common import lean_batches, new_path, written
from quire.llm.text_hash import slices
from quire.llm.tokens import word_tokenizer
from quire.llm.warc import open_store

MAGIC = b"QTC2"
CHUNK_IDS = 1 << 23
#: Rows that a file holds at most, on average.
ROWS_A_FILE = 50_000
_NULL_ID = -(1 << 63)
_MANIFEST = "part long, chunk long, file string, position long, bytes long, docs long, ids long"


def pack_chunk(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, block: int) -> bytes:
    c = id_codec.encode(ids, block)
    sizes = struct.pack("<QQQQQ", len(doc_ids), c["total"], block, len(c["ids"]), len(c["words"]))
    head = zlib.compress(sizes + b"".join(np.asarray(x, t).tobytes() for x, t in ((doc_ids, "<i8"), (counts, "<u8"), (c["ids"], "<u4"), (c["shares"], "<u4"), (c["words"], "<u4"), (c["crc"], "<u4"))))
    return MAGIC + struct.pack("<II", len(head), zlib.crc32(head)) + head + c["data"]


def unpack_chunk(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, token counts, ids). Raises ValueError if anything differs from its checksum."""
    if data[:4] != MAGIC:
        raise ValueError("no chunk begins here")
    n, crc = struct.unpack_from("<II", data, 4)
    if zlib.crc32(data[12 : 12 + n]) != crc:
        raise ValueError("checksum of the chunk's head")
    head = zlib.decompress(data[12 : 12 + n])
    docs, total, block, distinct, blocks = struct.unpack_from("<QQQQQ", head)
    at, parts = 40, []
    for k, t in ((docs, "<i8"), (docs, "<u8"), (distinct, "<u4"), (distinct, "<u4"), (blocks, "<u4"), (blocks, "<u4")):
        parts.append(np.frombuffer(head, t, k, at))
        at += parts[-1].nbytes
    ids = id_codec.decode({"total": total, "block": block, "ids": parts[2], "shares": parts[3], "words": parts[4], "crc": parts[5], "data": data[12 + n :]})
    return parts[0], parts[1].astype(np.int64), ids


def _writer(folder: str, tokenizer: str, end_id: int, block: int, chunk_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, root = open_store(folder)
        name, tok = f"part-{task.partitionId():06d}.qtc", word_tokenizer(tokenizer)
        temp = f"{root}/.{name}-{task.taskAttemptId()}"
        out, rows, position, held = None, [], 0, 0
        docs, counts, ids = [], [], []

        def flush() -> None:
            nonlocal out, position, held
            if not docs:
                return
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(temp)
            data = pack_chunk(np.concatenate(docs), np.concatenate(counts), np.concatenate(ids), block)
            out.write(data)
            rows.append((task.partitionId(), len(rows), f"{folder}/{name}", position, len(data), sum(map(len, docs)), held))
            position += len(data)
            held = 0
            docs.clear(), counts.clear(), ids.clear()

        for batch in batches:
            for b in slices(batch, "text", 1 << 20):
                flat, at = tok.encode(b.column("text"))
                n = np.diff(at) + 1
                ends = np.cumsum(n)
                with_end = np.full(int(ends[-1]), end_id, np.uint32)
                keep = np.ones(len(with_end), bool)
                keep[ends - 1] = False
                with_end[keep] = flat
                docs.append(b.column("doc_id").fill_null(_NULL_ID).to_numpy())
                counts.append(n)
                ids.append(with_end)
                held += len(with_end)
                if held >= chunk_ids:
                    flush()
        flush()
        if out is not None:
            out.close()
            store.move(temp, f"{root}/{name}")
            names = [x.split()[0] for x in _MANIFEST.split(", ")]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows])

    return run


def write_tokens(docs: DataFrame, folder: str, *, tokenizer: str, end_id: int = 1, block: int = id_codec.BLOCK, chunk_ids: int = CHUNK_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts, write them in ascending id order, and return the manifest, a row a chunk.

    * null and empty texts are a document of just ``end_id``, which ends each one's ids;
    * null ids come first, rows that repeat an id stand side by side;
    * a very long text lies whole in one chunk, which is larger then;
    * an empty table gives no file and an empty manifest; further columns are ignored.

    Each task writes one file (under a temporary name, then renamed); file order
    is id order. There are as many files as shuffle partitions, and more where
    they would hold over ``ROWS_A_FILE`` rows each.
    """
    lean_batches(docs.sparkSession)
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // ROWS_A_FILE))
    d = d.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id")
    return written(d.mapInArrow(_writer(folder, tokenizer, end_id, block, chunk_ids), _MANIFEST), "token-manifest")


def list_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of a folder of token files, made from the files' own heads."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.qtc").load(folder).select(F.col("path").alias("file"), F.col("length"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, length in zip(b.column("file").to_pylist(), b.column("length").to_pylist(), strict=True):
                store, root = open_store(path)
                rows, at = [], 0
                with store.open_input_file(root) as f:
                    while at < length:
                        f.seek(at)
                        n, _ = struct.unpack("<II", f.read(12)[4:])
                        head = zlib.decompress(f.read(n))
                        docs, total, _, distinct, blocks = struct.unpack_from("<QQQQQ", head)
                        words = np.frombuffer(head, "<u4", blocks, 40 + 16 * docs + 8 * distinct)
                        size = 12 + n + 2 * int(words.sum())
                        rows.append({"part": int(root.rsplit("-", 1)[1].split(".")[0]), "chunk": len(rows), "file": path, "position": at, "bytes": size, "docs": docs, "ids": total})
                        at += size
                if rows:
                    yield pa.RecordBatch.from_pylist(rows)

    return files.mapInArrow(run, _MANIFEST)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, position, size, start in zip(*(b.column(c).to_pylist() for c in ("file", "position", "bytes", "start")), strict=True):
            store, root = open_store(path)
            with store.open_input_file(root) as f:
                f.seek(position)
                docs, counts, ids = unpack_chunk(f.read(size))
            at = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
            raw = ids.tobytes()
            step = 512
            for i in range(0, len(docs), step):
                j = min(len(docs), i + step)
                d = pa.array(docs[i:j].astype(np.int64), mask=docs[i:j] == _NULL_ID)
                texts = pa.array([raw[4 * at[k] : 4 * at[k + 1]] for k in range(i, j)], pa.binary())
                yield pa.RecordBatch.from_arrays([d, pa.array(at[i:j] + start), pa.array(counts[i:j]), texts], names=["doc_id", "start", "n_tokens", "ids"])


def read_tokens(chunks: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of each document in the chunks of a manifest.

    ``start`` counts the ids of all documents before it, ``ids`` are little-endian
    32-bit. Chunks are dealt to tasks; a checksum that differs fails the task. An
    empty manifest gives an empty result; its further columns are ignored.
    """
    spark = chunks.sparkSession
    parts = chunks.groupBy("part").agg(F.sum("ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))  # a row a file
    within = F.sum("ids").over(Window.partitionBy("part").orderBy("chunk")) - F.col("ids")
    c = chunks.withColumn("within", within).join(parts, "part").withColumn("start", F.col("base") + F.col("within"))
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return c.select("file", "position", "bytes", "start").repartition(n, "file", "position").mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids binary")


def stored_tokens(docs: DataFrame, *, tokenizer: str, end_id: int = 1, folder: str | None = None, **options) -> DataFrame:
    """Write the documents' ids and read the files back."""
    folder = folder or new_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, tokenizer=tokenizer, end_id=end_id, **options))
