"""Record batches of many documents' rows, as a batch has a cost of its own."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa

#: Rows and bytes at which a batch is sent on.
MOST_ROWS, MOST_BYTES = 10_000, 4 << 20


def batches(found: Iterable[tuple[Sequence[Sequence], int]], names: Sequence[str], kinds: Sequence[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """The rows of ``found``, which gives the columns of some rows and their size in bytes, in batches."""

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held, kinds, strict=True)], names=list(names))

    held: list[list] = [[] for _ in names]
    size = 0
    for columns, more in found:
        for c, values in zip(held, columns, strict=True):
            c.extend(values)
        size += more
        if len(held[0]) >= MOST_ROWS or size >= MOST_BYTES:
            yield made()
            held, size = [[] for _ in names], 0
    if held[0]:
        yield made()
