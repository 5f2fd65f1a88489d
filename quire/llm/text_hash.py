"""Word and shingle hashes of whole texts, in numpy over Arrow buffers.

A word is a run of bytes other than space, tab, line feed, vertical tab, form
feed and carriage return; A to Z count as a to z. Both concern single bytes in
UTF-8, so no text is decoded. A word is hashed eight bytes at a time, each step
mixed into the next, so equal hashes of different words are left to chance
(2**-64 a pair); very long words are hashed by BLAKE2.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown when needed."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            self.up, self.down = _powers(int(_BASE), n), _powers(pow(int(_BASE), -1, 1 << 64), n)
        return self.up, self.down


powers_of_base = _Powers()


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty."""
    texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(offsets) and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


_MASK = np.array([0] + [(1 << 8 * k) - 1 for k in range(1, 8)] + [0xFFFFFFFFFFFFFFFF], np.uint64)
_SEED = np.uint64(0x9E3779B97F4A7C15)
#: Words of more bytes than this are hashed one by one.
_LONG = 64


def span_hashes(code: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hash of the bytes of each span. ``code`` has eight bytes more than the last span's end."""
    eight = np.ndarray(len(code) - 7, "<u8", code, 0, (1,))  # the eight bytes from each place on
    size = ends - starts
    h = size.astype(np.uint64) * _SEED + np.uint64(salt)
    h = mix(h ^ (eight[starts] & _MASK[np.minimum(size, 8)]))
    at, done = np.flatnonzero((size > 8) & (size <= _LONG)), 8
    while len(at):
        left = size[at] - done
        h[at] = mix((h[at] ^ (eight[starts[at] + done] & _MASK[np.minimum(left, 8)])) + _SEED)
        at, done = at[left > 8], done + 8
    key = salt.to_bytes(8, "little")
    for i in np.flatnonzero(size > _LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(code[starts[i] : ends[i]], digest_size=8, key=key).digest(), "little")
    return h


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end, hash) of each word, and word offsets by text."""
    low = np.zeros(len(raw) + 8, np.uint8)
    np.take(_LOWER, raw, out=low[: len(raw)])
    word = ~_SPACE[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    first[inner] = word[inner]  # a text's first byte begins a word even if the text before ends in one
    starts = np.flatnonzero(first)
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    ends = np.flatnonzero(last) + 1
    return starts, ends, span_hashes(low, starts, ends), np.searchsorted(starts, offsets)


def word_hashes(texts: pa.Array, step: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, word offsets by text), worked off in runs of about ``step`` bytes."""
    raw, offsets = text_bytes(texts)
    hashes, counts, i = [], [np.zeros(1, np.int64)], 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + step, "right")) - 1)
        _, _, h, at = words_of(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        hashes.append(h)
        counts.append(np.diff(at))
        i = j
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.cumsum(np.concatenate(counts))


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of ``size`` words.

    A text with fewer words gives one shingle, the whole sequence; one without
    words gives none.
    """
    h, at = word_hashes(texts)
    n = np.diff(at)
    k = np.uint64(0xD6E8FEB86659FD93)
    if len(h) >= size:
        s = h[: len(h) - size + 1].copy()
        for j in range(1, size):
            s *= k
            s += h[j : len(h) - size + 1 + j]
        s = mix(s)
    out = []
    for i in range(len(n)):
        if n[i] >= size:
            out.append(np.unique(s[at[i] : at[i + 1] - size + 1]))
        elif n[i]:
            v = int(n[i])
            for x in h[at[i] : at[i + 1]].tolist():
                v = (v * int(k) + x) & 0xFFFFFFFFFFFFFFFF
            out.append(mix(np.array([v], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 2 << 20):
    """The batch in runs of rows of about ``max_bytes`` of text each."""
    _, offsets = text_bytes(batch.column(column))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + max_bytes, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j
