import base64
import gzip
import hashlib
import io
import random

import duckdb
import pytest

import corpus_pipeline
from quire.llm import queries, warc
from quire.llm.common import new_path

SCHEMA = "page_id long, url string, html string, digest string"


def expected(rows):
    data = [(p, (h or "").encode()) for p, _, h in rows]
    out = []
    for p, b in data:
        same = [q for q, c in data if c == b and q is not None]
        kept = max(same) if len(b) >= 1000 and p is not None else p
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if kept != p else "response", kept if kept != p else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    big, other = "<p>é</p>" * 200, "x" * 2500
    rows = [(1, "http://a/", big), (9, "http://b/", big), (5, None, big), (2, "u\r\nX: y", None), (3, "", ""), (4, "u", "x" * 999), (6, "u", "x" * 999), (7, "u", other), (7, "u", other), (8, "u", "y" * 300_000), (None, "u", big)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    got = warc.page_records(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)
    assert warc.page_records(pages.limit(0)).count() == 0
    folder = new_path(spark, "w")
    rows = pages.selectExpr("page_id as record_id", "url as uri", "html as content")
    warc.write_archives(rows.repartition(2), folder)
    files = warc.list_archives(spark, folder)
    for split in (1 << 20, 300):
        records = warc.read_archives(files, split_bytes=split).collect()
        assert len(records) == 11 and len({(r.archive, r.start) for r in records}) == 11
        assert sorted(bytes(r.payload).decode() for r in records if r.record_type == "response" and len(r.payload) > 1000 and r.payload[:1] != b"x") == sorted([big, big, "y" * 300_000])


def test_each_record_belongs_to_one_range():
    rng = random.Random(1)
    noise = warc.MAGIC + b"\x00" * 7  # magic that begins no record
    members = []
    for i in range(20):
        body = f"WARC/1.1\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: 400\r\n\r\n".encode() + rng.randbytes(390 - len(noise)) + noise + b"0123456789" + b"\r\n\r\n"
        members.append(gzip.compress(body, rng.choice([0, 6])))
    data = b"".join(members)
    starts = [sum(map(len, members[:i])) for i in range(20)]
    for split in (1, 7, 100, 511, 5000, len(data)):
        found = [at for lo in range(0, len(data), split) for at, _ in warc.records_of_range(io.BytesIO(data), len(data), lo, min(len(data), lo + split))]
        assert found == starts
    with pytest.raises(ValueError, match="cut off"):
        list(warc.records_of_range(io.BytesIO(data[:-20]), len(data) - 20, 0, len(data)))


def record(i, block):
    return f"WARC/1.1\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_records_inside_records_are_not_records(spark, tmp_path):
    inner = b"".join(gzip.compress(record(100 + i, b"inner " * 60)) for i in range(12))
    talk = gzip.compress(b"WARC/ is a nice format, and WARC/1.1\r\n a line of its header")
    members = [gzip.compress(record(0, b"first")), gzip.compress(record(1, b"x" * 50 + inner + b"y" * 50), 0), talk, gzip.compress(record(2, b"last" * 2000), 0), gzip.compress(record(3, b""))]
    data, at = b"".join(members), [0]
    for m in members:
        at.append(at[-1] + len(m))
    want = [at[0], at[1], at[3], at[4]]

    def read(content, name, split):
        (tmp_path / name).write_bytes(content)
        files = spark.createDataFrame([(str(tmp_path / name), len(content))], "archive string, bytes long")
        return sorted(r.start for r in warc.read_archives(files, split_bytes=split).collect())

    for split in (50, 333, 1000, 4096, len(data)):
        assert read(data, f"{split}.warc.gz", split) == want
    assert [x - 14 for x in read(b"no member here" + data, "lead.warc.gz", 200)] == want  # a file doesn't have to begin with one
    damaged = bytearray(data)
    damaged[at[3] + 30] ^= 255
    for split in (100, len(data)):
        with pytest.raises(Exception, match="damaged"):
            read(bytes(damaged), "damaged.warc.gz", split)


def http_record(i, block, *fields, kind="response"):
    head = [f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:{i}>\r\nContent-Type: application/http; msgtype=response", *fields, f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def test_records_of_other_writers(spark, tmp_path):
    body, ok = b"<p>body</p>", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n"
    sha = hashlib.sha1(body)
    hexed, b32 = sha.hexdigest(), base64.b32encode(sha.digest()).decode()
    empty = hashlib.sha1(b"").hexdigest()
    cases = [  # record, and its digest, payload_bytes, payload, error
        (http_record(0, b"HTTP/1.1 200 OK\r\nno blank line"), (hashlib.sha1(b"HTTP/1.1 200 OK\r\nno blank line").hexdigest(), 30, b"HTTP/1.1 200 OK\r\nno blank line", "http head")),
        (http_record(1, b"HTTP/1.1 200 OK\nA: b\n\n" + body), (hexed, 11, body, None)),
        (http_record(2, ok + body, f"WARC-Payload-Digest: sha1:{hexed}"), (hexed, 11, body, None)),
        (http_record(3, ok + body, f"WARC-Payload-Digest: SHA1:{b32.lower()}"), (hexed, 11, body, None)),
        (http_record(4, ok + body[:4], f"WARC-Payload-Digest: sha1:{b32}", "WARC-Truncated: length"), (hashlib.sha1(body[:4]).hexdigest(), 4, body[:4], None)),
        (http_record(5, ok + body[:4], f"WARC-Payload-Digest: sha1:{b32}"), (hashlib.sha1(body[:4]).hexdigest(), 4, body[:4], "digest")),
        (http_record(6, b"", f"WARC-Payload-Digest: sha1:{b32}", "WARC-Refers-To: <urn:x:2>", kind="revisit"), (hexed, None, None, None)),
        (http_record(7, b"HTTP/1.1 200 OK\r\nContent-Length: x\r\n\r\n", f"WARC-Payload-Digest: sha1:{b32}", kind="revisit"), (hexed, None, None, None)),
        (http_record(8, b"HTTP/1.1 200 OK\r\nContent-Length: x\r\n\r\n" + body), (hexed, 11, body, None)),
        (http_record(9, b"HTTP/1.1 200 OK\r\nContent-Length: 7\r\n\r\n" + body), (hexed, 11, body, None)),
        (http_record(10, ok + body, "WARC-Payload-Digest: sha1:nothing"), (hexed, 11, body, "digest form")),
        (http_record(11, ok + body, "WARC-Payload-Digest: sha256:00ff"), (hexed, 11, body, None)),
        (http_record(12, b""), (empty, 0, b"", None)),
        (http_record(13, ok + body)[:-2], (hexed, 11, body, "length")),
        (b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x:14>\r\nContent-Type: application/warc-fields\r\nContent-Length: 4\r\n\r\na: b\r\n\r\n", (hashlib.sha1(b"a: b").hexdigest(), 4, b"a: b", None)),
    ]
    members = [gzip.compress(r) for r, _ in cases]
    data = b"".join(members)
    (tmp_path / "x.warc.gz").write_bytes(data)
    files = spark.createDataFrame([(str(tmp_path / "x.warc.gz"), len(data))], "archive string, bytes long")
    for split in (97, 1000, len(data)):
        got = warc.read_archives(files, split_bytes=split).orderBy("start").collect()
        assert [(r.digest, r.payload_bytes, None if r.payload is None else bytes(r.payload), r.error) for r in got] == [want for _, want in cases], split
        assert [r.record_id for r in got] == [f"urn:x:{i}" for i in range(15)]


def test_damaged_members_can_be_rows(spark, tmp_path):
    members = [gzip.compress(http_record(i, random.Random(i).randbytes(300))) for i in range(6)]
    at = [sum(map(len, members[:i])) for i in range(6)]
    data = bytearray(b"".join(members))[:-20]  # the last one is cut off
    data[at[2] + 150] ^= 255
    data[at[3] + 150] ^= 255
    (tmp_path / "y.warc.gz").write_bytes(data)
    files = spark.createDataFrame([(str(tmp_path / "y.warc.gz"), len(data))], "archive string, bytes long")
    for split in (120, 500, len(data)):
        got = warc.read_archives(files, split_bytes=split, damaged="row").orderBy("start").collect()
        assert [(r.start, r.record_id if r.error == "http head" else r.error) for r in got] == list(zip(at, ["urn:x:0", "urn:x:1", "damaged member", "damaged member", "urn:x:4", "damaged member"], strict=True)), split


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    want = con.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, sf)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.dtypes == docs.dtypes, name
        path = new_path(spark, "stage")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        after = {r.doc_id for r in docs.collect()}
        assert after and after <= before
        before = after
    assert not any("@mail" in (r.text or "") for r in docs.collect())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in pieces.collect()} == before
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == before
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
