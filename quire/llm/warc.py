"""WARC archives: writing with revisit records, and a splittable reader.

An archive is a ``.warc.gz`` whose every record is its own gzip member. Reading
does not need an index: a task takes a byte range, looks for the gzip magic in
it, inflates candidates, and owns the records that start inside its range (it
reads past the end to finish the last one). A member is a record if its decoded
header says so: version line, record id, a content length that fits. The next
member starts where one ends. Records as crawlers leave them are rows too:
what can't be understood of one is said in ``error``, and the others go on.

Bytes that look like a record may lie inside one, as when an archive is the
payload of a record that is stored and not deflated. So ranges are gone through
twice. First each task finds a chain of members from its range to the end of it
or beyond, and reports where that chain leaves the range. A chain inside a record
ends before that record does, so the farthest end of the chains of all ranges
before is where the first record at or behind a range's beginning starts. From
there the records are read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from base64 import b32decode, b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import lean_batches, new_path, written

MAGIC = b"\x1f\x8b\x08"
#: Bytes of a member that are inflated at first, to see whether a version line begins there.
PROBE = 512
#: Bytes beyond which a head without a blank line is no head of a record.
MAX_HEAD = 1 << 20
READ = 1 << 20
_VERSION = re.compile(rb"WARC/[0-9]+\.[0-9]+\r\n")

RECORD_SCHEMA = (
    "archive string, start long, record_id string, record_type string, target_uri string, refers_to string, "
    "digest string, payload_bytes long, payload binary, error string"
)
#: Errors of a record, and of a payload whose digest isn't the one that its header names.
DAMAGED, LENGTH, HTTP, DIGEST_FORM, DIGEST = "damaged member", "length", "http head", "digest form", "digest"
_BLANK_LINE = re.compile(rb"\r?\n\r?\n")


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; a bare path is local."""
    return fs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")


def with_revisits(rows: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Add ``payload``, ``digest`` and ``refers_to`` to (record_id, uri, content) rows.

    Rows with equal payloads of ``min_bytes`` at least refer to the one with the
    largest id (null in that one, and in shorter ones). Equal payloads are
    counted by digest before anything is joined, so a payload that a third of
    the rows share is a single row of the joined side; AQE splits the other side.
    """
    p = rows.withColumn("payload", F.coalesce(F.encode("content", "UTF-8"), F.lit(b""))).drop("content")
    p = p.withColumn("digest", F.sha1("payload"))
    long = F.length("payload") >= min_bytes
    groups = rows.select("record_id", F.coalesce(F.encode("content", "UTF-8"), F.lit(b"")).alias("payload")).where(long)
    groups = groups.select("record_id", F.sha1("payload").alias("digest")).groupBy("digest").agg(F.count("*").alias("n"), F.max("record_id").alias("kept")).where("n > 1")
    # short payloads have a key that no group has, and not all the same one
    p = p.withColumn("key", F.when(long, F.col("digest")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("record_id").cast("string"), F.col("digest")))))
    p = p.join(groups.select(F.col("digest").alias("key"), "kept"), "key", "left")
    return p.withColumn("refers_to", F.when(F.col("record_id") < F.col("kept"), F.col("kept"))).drop("key", "kept")


def _record(record_id: str, uri: str, payload: bytes | None, n_bytes: int, digest: str, refers_to: str | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http if payload is None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if payload is not None else 'revisit'}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if payload is None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _writer(folder: str, scheme: str, date: str, level: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, root = open_store(folder)
        name = f"part-{task.partitionId():06d}.warc.gz"
        temp = f"{root}/.{name}-{task.taskAttemptId()}"
        name_id = lambda x: f"urn:{scheme}:{'' if x is None else x}"
        n = size = 0
        out = None
        for b in batches:
            if out is None and b.num_rows:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(temp)
            for rid, uri, payload, digest, ref in zip(*(b.column(c).to_pylist() for c in ("record_id", "uri", "payload", "digest", "refers_to")), strict=True):
                uri = "".join(ch for ch in (uri or "") if ch not in "\r\n")
                rec = _record(name_id(rid), uri, payload if ref is None else None, len(payload), digest, None if ref is None else name_id(ref), date)
                c = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = c.compress(rec) + c.flush()
                out.write(member)
                n, size = n + 1, size + len(member)
        if out is not None:
            out.close()
            store.move(temp, f"{root}/{name}")  # a repeated attempt puts the same records under the same name
            yield pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "records": [n], "bytes": [size]})

    return write


def write_archives(rows: DataFrame, folder: str, *, scheme: str = "page", date: str = "2024-01-01T00:00:00Z", level: int = 4, min_bytes: int = 1000) -> DataFrame:
    """Write (record_id, uri, content) rows as archives into ``folder`` and return their manifest.

    A row is a record. Its payload is the content in UTF-8 (null: empty). See
    :func:`with_revisits` for what becomes a revisit record; rows that repeat an
    id with an equal payload are all responses. A null id is written as an empty
    one. An archive is written under a temporary name and renamed, so a task
    that runs twice leaves one file.
    """
    lean_batches(rows.sparkSession)
    ready = with_revisits(rows, min_bytes).select("record_id", "uri", "payload", "digest", "refers_to")
    return written(ready.mapInArrow(_writer(folder, scheme, date, level), "archive string, records long, bytes long"), "warc-manifest")


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(archive, bytes) of a folder in any store that Spark reads."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select(F.col("path").alias("archive"), F.col("length").alias("bytes"))


def _headers(block: bytes) -> tuple[dict[str, str], int]:
    """Fields of a head by name in lower case, and where it ends (-1 where no blank line ends it); lines may end in LF alone."""
    blank = _BLANK_LINE.search(block)
    lines = block[: blank.start() if blank else len(block)].decode("utf-8", "replace").splitlines()
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}, blank.end() if blank else -1


def sha1_of(digest: str | None) -> str | None:
    """The hex form of a ``sha1:`` digest in base32 or hex of either case; null for other algorithms, ValueError for what is no digest."""
    kind, _, value = (digest or "").partition(":")
    if kind.strip().lower() not in ("sha1", "sha-1"):
        return None
    value = value.strip()
    raw = bytes.fromhex(value) if len(value) == 40 else b32decode(value.upper())
    if len(raw) != 20:
        raise ValueError(f"{digest} is no SHA-1")
    return raw.hex()


def parse_record(data: bytes | None) -> dict:
    """The parts of one inflated record; ``error`` names what is wrong with it (null: nothing).

    * null data (a member that is cut off or damaged) has that error alone;
    * a record whose length isn't the one that its head says keeps what there is (``length``);
    * an HTTP block whose head has no end is all payload (``http head``), unless it
      is a revisit's or empty; its lines may end in LF, and its ``Content-Length``
      is believed of revisits alone, if it is a number (else the size is null);
    * the digest is that of the payload, or of a revisit the one it names. One that
      isn't of the form said in :func:`sha1_of` is ``digest form``; one that differs from
      the payload's is ``digest``, unless the record says that it is truncated.
    """
    row = dict.fromkeys(("record_id", "record_type", "target_uri", "refers_to", "digest", "payload_bytes", "payload", "error"))
    if data is None:
        return row | {"error": DAMAGED}
    head, at = _headers(data)
    length = head.get("content-length", "")
    whole = at >= 0 and length.isdecimal() and len(data) == at + int(length) + 4
    block = b"" if at < 0 else data[at : at + int(length)] if length.isdecimal() else data[at:]
    errors = [] if whole else [LENGTH]
    response = head.get("warc-type") != "revisit"
    payload, n_bytes = block, len(block) if response else None
    if head.get("content-type", "").lower().startswith("application/http"):
        http, body = _headers(block)
        if body >= 0:
            payload = block[body:]
        elif response and block:
            errors.append(HTTP)
        size = http.get("content-length", "")
        n_bytes = int(size) if not response and size.isdecimal() and len(size) < 19 else None
    try:
        digest = sha1_of(head.get("warc-payload-digest"))
    except ValueError:
        digest = None
        errors.append(DIGEST_FORM)
    if response:
        n_bytes, actual = len(payload), hashlib.sha1(payload).hexdigest()
        if digest not in (None, actual) and "warc-truncated" not in head:
            errors.append(DIGEST)
        digest = actual
    return row | {
        "record_id": head.get("warc-record-id", "").strip("<>"), "record_type": head.get("warc-type"), "target_uri": head.get("warc-target-uri"),
        "refers_to": head["warc-refers-to"].strip("<>") if "warc-refers-to" in head else None,
        "digest": digest, "payload_bytes": n_bytes, "payload": payload if response else None, "error": ", ".join(errors) or None,
    }


class _Range:
    """Random access to a file through a window of recent bytes."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size, self.base, self.buf = file, size, 0, b""

    def at(self, pos: int, n: int) -> bytes:
        if pos < self.base or pos + n > self.base + len(self.buf):
            self.base, want = pos, min(max(n, READ), self.size - pos)
            self.file.seek(pos)
            self.buf = self.file.read(want) if want > 0 else b""
        return self.buf[pos - self.base : pos - self.base + n]


def is_record(data: bytes) -> bool:
    """Whether an inflated member is one whole record: version line, record id, and the length that the header says."""
    if not _VERSION.match(data):
        return False
    head, at = _headers(data)
    length = head.get("content-length", "")
    return at >= 0 and "warc-record-id" in head and length.isdecimal() and len(data) == at + int(length) + 4 and data.endswith(b"\r\n\r\n")


def begins_record(src: _Range, pos: int) -> bool:
    """Whether a member at ``pos`` has the head of a record: only that is inflated of it."""
    inflate, head, at = zlib.decompressobj(31), b"", pos
    while at < src.size and not inflate.eof:
        piece = src.at(at, min(PROBE, src.size - at))
        at += len(piece)
        try:
            head += inflate.decompress(piece)
        except zlib.error:
            return False
        if not _VERSION.match(head) and (len(head) >= 16 or inflate.eof):
            return False
        fields, end = _headers(head)
        if end >= 0:
            return "warc-record-id" in fields and fields.get("content-length", "").isdecimal()
        if len(head) > MAX_HEAD:
            return False
    return False


def _member(src: _Range, pos: int) -> tuple[bytes | None, int]:
    """(inflated bytes, end) of the gzip member at ``pos``; (None, 0) if none is whole there."""
    inflate, parts, at = zlib.decompressobj(31), [], pos
    while not inflate.eof and at < src.size:
        piece = src.at(at, min(1 << 16, src.size - at))
        try:
            parts.append(inflate.decompress(piece))
        except zlib.error:
            return None, 0
        at += len(piece)
    return (b"".join(parts), at - len(inflate.unused_data)) if inflate.eof else (None, 0)


def _looks_like_record(src: _Range, pos: int) -> bool:
    try:
        return zlib.decompressobj(31).decompress(src.at(pos, min(PROBE, src.size - pos)), 16).startswith(b"WARC/")
    except zlib.error:
        return False


def first_member(src: _Range, start: int, end: int, damaged: list[int] | None = None) -> int | None:
    """The first record in [start, end) from which members follow one another up to ``end``, the end of the file, or a damaged one.

    Candidates begin with the gzip magic and are validated by their decoded heads
    before any is inflated whole. Those that are cut off or damaged are added to
    ``damaged``, as far as they come before the one that is found.
    """
    pos = start
    while pos < end:
        chunk = src.at(pos, min(READ, src.size - pos))
        hit = chunk.find(MAGIC)
        if hit < 0:
            pos += max(1, len(chunk) - len(MAGIC) + 1)
            continue
        pos += hit
        if pos >= end:
            break
        if begins_record(src, pos):
            data, at = _member(src, pos)
            if data is not None and is_record(data):
                while data is not None and at < end and src.at(at, 3) == MAGIC:
                    data, at = _member(src, at)
                if data is None or at >= src.size or src.at(at, 3) == MAGIC:
                    return pos
            elif data is None and damaged is not None:
                damaged.append(pos)
        elif damaged is not None and _looks_like_record(src, pos) and _member(src, pos)[0] is None:
            damaged.append(pos)
        pos += 1
    return None


def chain_end(file, size: int, start: int, end: int) -> int:
    """Where the chain of members that begins in [start, end) ends at or behind ``end``; 0 without such a chain."""
    src = _Range(file, size)
    pos = 0 if start == 0 and src.at(0, 3) == MAGIC else first_member(src, start, end)
    if pos is None:
        return 0
    while pos < end and src.at(pos, 3) == MAGIC:
        data, at = _member(src, pos)
        if data is None:
            break
        pos = at
    return pos


def records_of_range(file, size: int, start: int, end: int, entry: int | None = None, damaged: str = "raise") -> Iterator[tuple[int, bytes | None]]:
    """(offset, inflated bytes) of the records whose first byte lies in [start, end).

    ``entry`` is where the chain of members of the ranges before ends (0 for the
    first range); without it, or if no member begins there, the first record is
    searched. Members that have no version line are passed over. A record that
    is cut off or damaged raises ValueError; with ``damaged="row"`` it has no bytes
    (None), and the next one is searched behind its first byte.
    """
    src = _Range(file, size)
    pos: int | None = max(start, entry or 0)
    known = ((entry is not None and entry >= start) or start == 0) and src.at(pos, 3) == MAGIC
    while pos is not None and pos < min(end, size):
        if not known:
            bad: list[int] = []
            begin, pos = pos, first_member(src, pos, end, bad)
            if bad and damaged == "raise" and pos is None:
                raise ValueError(f"the record at byte {bad[0]} is cut off or damaged")
            if damaged == "row":
                yield from ((at, None) for at in bad if at >= begin)
            known = True
            continue
        data, at = _member(src, pos)
        if data is not None:
            if _VERSION.match(data):
                yield pos, data
            pos = at
            known = pos < size and src.at(pos, 3) == MAGIC
        elif damaged == "raise":
            raise ValueError(f"the record at byte {pos} is cut off or damaged")
        else:
            yield pos, None
            pos, known = pos + 1, False


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ends = []
        for path, size, lo, hi in zip(*(b.column(c).to_pylist() for c in ("archive", "bytes", "lo", "hi")), strict=True):
            store, root = open_store(path)
            with store.open_input_file(root) as file:
                ends.append(chain_end(file, size, lo, hi))
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("archive", "bytes", "lo", "hi")), pa.array(ends, pa.int64())], names=["archive", "bytes", "lo", "hi", "end"])


def _reader(with_payload: bool, damaged: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORD_SCHEMA.split(", ")]
        schema = pa.schema([(n, pa.int64() if n in ("start", "payload_bytes") else pa.binary() if n == "payload" else pa.string()) for n in names])
        for b in batches:
            for path, size, lo, hi, entry in zip(*(b.column(c).to_pylist() for c in ("archive", "bytes", "lo", "hi", "entry")), strict=True):
                store, root = open_store(path)
                rows, held = [], 0
                with store.open_input_file(root) as file:
                    for start, data in records_of_range(file, size, lo, hi, entry, damaged):
                        rec = parse_record(data) | {"archive": path, "start": start}
                        if not with_payload:
                            rec["payload"] = None
                        rows.append(rec)
                        held += len(rec["payload"] or b"") + 200
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return read


def read_archives(files: DataFrame, *, split_bytes: int = 8 << 20, payload: bool = True, damaged: str = "raise") -> DataFrame:
    """Records of the archives in ``files`` (archive, bytes), a row a record.

    Each archive is cut into ranges of ``split_bytes``; a range is a unit of
    work, so one large archive is read by many tasks. The digest of a response
    is computed from its payload, a revisit's comes from its header. What is
    wrong with a record is its ``error`` (:func:`parse_record`), and reading goes
    on; a gzip member that is cut off or damaged stops it, as records may be lost
    behind it, or with ``damaged="row"`` is a row with that error. Archives without
    records and an empty table give no rows; further columns are ignored. A
    record of any length is read whole by the task that owns it.
    """
    ranges = files.select("archive", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("lo"))
    ranges = ranges.withColumn("hi", F.least(F.col("lo") + split_bytes, F.col("bytes")))
    spark = files.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = ranges.repartition(tasks, "archive", "lo").mapInArrow(_ends, "archive string, bytes long, lo long, hi long, end long")
    before = Window.partitionBy("archive").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    ranges = ranges.withColumn("entry", F.coalesce(F.max("end").over(before), F.lit(0))).where("entry < hi")
    return ranges.repartition(tasks, "archive", "lo").mapInArrow(_reader(payload, damaged), RECORD_SCHEMA)


def page_records(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Archive (page_id, url, html) rows and read the archives back, a row a page.

    * a null html is an empty payload, a null url an empty one;
    * a null id stays null; rows that repeat an id and a payload are all
      responses, each with its own row;
    * of equal payloads that with the largest id is the response; very long ones
      are read whole;
    * further columns are ignored; an empty table gives an empty result;
    * a record that doesn't come back as it was written is an error.
    """
    folder = folder or new_path(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").alias("record_id"), F.col("url").alias("uri"), F.col("html").alias("content"))
    records = read_archives(write_archives(rows, folder), payload=False)
    number = lambda c: F.nullif(F.regexp_extract(c, r"^urn:page:(-?\d*)$", 1), F.lit("")).cast("long")
    digest = F.when(F.col("error").isNull(), F.col("digest")).otherwise(F.raise_error(F.concat(F.col("record_id"), F.lit(": "), F.col("error"))))
    return records.select(number("record_id").alias("page_id"), "payload_bytes", digest.alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"), "archive", F.col("start").alias("archive_offset"))
