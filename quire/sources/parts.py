"""A data source of the parts of documents in a folder, which opens no more than a query asks for.

A row is an entry of a package, or a whole file of another format. Filters on the
path, length, kind, folder, name and size are pushed to it: files that they rule out
aren't opened, and entries that they rule out aren't inflated, so a query for texts
reads no picture. Work is dealt by size: small files share a task, and the entries of
a large package are dealt to several, each of which reads the archive's directory and
its own entries.
"""

from __future__ import annotations

import os
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

MAX_ENTRY = 256 << 20
SCHEMA = "path string, length bigint, kind string, folder string, ord int, name string, size bigint, data binary, error string"
#: Formats by extension.
KINDS = {".hwp": "records", ".hwpx": "package", ".md": "markdown", ".markdown": "markdown"}
#: Columns that are known of a file before it is opened, and of an entry before it is read.
OF_FILES, OF_ENTRIES = ("path", "length", "kind"), ("folder", "name", "size")
_BATCH = 8 << 20


@dataclass
class Share(ds.InputPartition):
    """Files of a task: (path, length, kind, which share of its entries, of how many)."""

    files: list[tuple[str, int, str, int, int]]


def _test(f: ds.Filter) -> tuple[str, Callable] | None:
    """The column of a filter and the test of its value (null fails all but null tests); None for a filter that isn't known here."""
    if isinstance(f, ds.Not):
        inner = f.child
        found = _test(inner)
        if found is None:
            return None
        null = isinstance(inner, ds.EqualNullSafe | ds.IsNull | ds.IsNotNull)
        return found[0], lambda v: (null or v is not None) and not found[1](v)
    if not hasattr(f, "attribute") or len(f.attribute) != 1:
        return None
    tests = {
        ds.EqualTo: lambda v: v is not None and v == f.value, ds.EqualNullSafe: lambda v: v == f.value, ds.In: lambda v: v is not None and v in f.value,
        ds.GreaterThan: lambda v: v is not None and v > f.value, ds.GreaterThanOrEqual: lambda v: v is not None and v >= f.value,
        ds.LessThan: lambda v: v is not None and v < f.value, ds.LessThanOrEqual: lambda v: v is not None and v <= f.value,
        ds.IsNull: lambda v: v is None, ds.IsNotNull: lambda v: v is not None,
        ds.StringStartsWith: lambda v: v is not None and v.startswith(f.value), ds.StringEndsWith: lambda v: v is not None and v.endswith(f.value), ds.StringContains: lambda v: v is not None and f.value in v,
    }
    return (f.attribute[0], tests[type(f)]) if type(f) in tests else None


def listing(folder: str) -> Iterator[tuple[str, int, str]]:
    """(path, length, kind) of a folder's files of a known format by path, without hidden ones, links, and what is in folders below."""
    uri = ":/" in folder
    store, root = fs.FileSystem.from_uri(folder if uri else f"file://{os.path.abspath(folder)}")
    local = isinstance(store, fs.LocalFileSystem)
    scheme = folder.partition(":")[0] if uri and not local else "file"
    for info in sorted(store.get_file_info(fs.FileSelector(root)), key=lambda i: i.path):
        kind = KINDS.get(os.path.splitext(info.base_name)[1].lower())
        if info.type == fs.FileType.File and kind and not info.base_name.startswith(".") and not (local and os.path.islink(info.path)):
            yield (info.path if local else f"{scheme}://{info.path}"), info.size, kind


class PartReader(ds.DataSourceReader):
    def __init__(self, folder: str, split_bytes: int) -> None:
        self.folder, self.split_bytes = folder, split_bytes
        self.tests: dict[str, list[Callable]] = {}

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:  # noqa: N802
        for f in filters:
            found = _test(f)
            if found is not None and found[0] in OF_FILES + OF_ENTRIES:
                self.tests.setdefault(found[0], []).append(found[1])
            else:
                yield f

    def _wanted(self, **values) -> bool:
        return all(t(v) for name, v in values.items() for t in self.tests.get(name, ()))

    def partitions(self) -> Sequence[Share]:
        shares, held = [], 0
        for path, length, kind in listing(self.folder):
            if not self._wanted(path=path, length=length, kind=kind):
                continue
            n = max(1, -(-length // self.split_bytes)) if kind == "package" else 1
            for k in range(n):
                size = length // n
                if not shares or held + size > self.split_bytes:
                    shares, held = [*shares, Share([])], 0
                shares[-1].files.append((path, length, kind, k, n))
                held += size
        return shares or [Share([])]

    def _rows(self, share: Share) -> Iterator[tuple]:
        for path, length, kind, k, n in share.files:
            head = (path, length, kind)
            store, at = fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")
            with store.open_input_file(at) as file:
                if kind != "package":
                    if self._wanted(folder="", name=None, size=length):
                        yield (*head, "", 0, None, length, file.read(), None)
                    continue
                try:
                    archive = zipfile.ZipFile(file)
                except (zipfile.BadZipFile, EOFError, NotImplementedError, ValueError, OSError):
                    if k == 0 and self._wanted(folder="", name=None, size=None):
                        yield (*head, "", None, None, None, None, "Zip")
                    continue
                for i, info in enumerate(x for x in archive.infolist() if not x.is_dir()):
                    folder, _, _ = info.filename.rpartition("/")
                    if i % n != k or not self._wanted(folder=folder, name=info.filename, size=info.file_size):
                        continue
                    data = error = None
                    try:
                        data = archive.read(info) if info.file_size <= MAX_ENTRY else None
                        error = None if data is not None else "FileTooLarge"
                    except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError):
                        error = "Zip"
                    yield (*head, folder, i, info.filename, info.file_size, data, error)

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
        schema = pa.schema([(n, kinds[t]) for n, t in (f.split() for f in SCHEMA.split(", "))])
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for row in self._rows(partition):
            rows.append(row)
            held += len(row[7] or b"") + 200
            if held > _BATCH:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()


class DocumentParts(ds.DataSource):
    """``spark.read.format("document_parts").load(folder)``; option ``splitBytes`` is how much a task takes (128 MB)."""

    @classmethod
    def name(cls) -> str:
        return "document_parts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PartReader:
        if "path" not in self.options:
            raise ValueError("document_parts needs a folder")
        return PartReader(self.options["path"], int(self.options.get("splitBytes", 128 << 20)))


def scan(spark: SparkSession, folder: str, *, split_bytes: int = 128 << 20) -> DataFrame:
    """Parts of the documents in a folder, a row each (``SCHEMA``), by path within a task.

    ``folder`` is that of the entry ("" for whole files). A package that is no
    archive is a row with its error and neither name nor data; an entry that can't
    be read, or is beyond ``MAX_ENTRY``, is a row with an error and no data. An empty
    folder gives no rows. Pushing filters to sources in Python is a setting of the
    session that this turns on.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DocumentParts)
    return spark.read.format("document_parts").option("splitBytes", split_bytes).load(folder)
