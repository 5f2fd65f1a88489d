"""Token ids of whole texts by a public tokenizer, a word at a time.

A tokenizer that splits at white space and forgets it gives a text's ids as the
ids of its words in turn. Then each distinct word is encoded once and the ids of
a text are gathered by numpy, which is several times faster than encoding every
text afresh and gives the same ids. A word is known by two independent 64-bit
hashes and its length; a batch in which the first hash alone would have taken
one word for another is encoded by the library itself.
"""

from __future__ import annotations

import os
import sys
import types

import numpy as np
import pyarrow as pa

from quire.llm.text_hash import span_hashes, text_bytes

#: Words whose ids a worker keeps from batch to batch.
MAX_CACHED_WORDS = 300_000
_WORDS_A_CALL = 400
_SECOND = 0x2545F4914F6CDD1D


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_STOP = np.isin(np.arange(256), [ord(c) for c in ".,;:!?"])
_ALPHA = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _words(raw: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end) of the pieces that a text can be cut into without a change of its ids, and the bytes to hash.

    Cuts are at white space and between an ASCII letter and one of ``.,;:!?``,
    where the pre-tokenizer cuts too. Pieces that differ in the case of ASCII
    letters are one, but for a letter before a non-ASCII byte, which may combine
    with it.
    """
    space, stop, alpha = _SPACE[raw], _STOP[raw], _ALPHA[raw]
    begin = ~space
    cut = space[:-1] | (stop[:-1] & alpha[1:]) | (alpha[:-1] & stop[1:])
    begin[1:] &= cut
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    begin[inner] = ~space[inner]
    starts = np.flatnonzero(begin)
    final = ~space
    final[:-1] &= space[1:] | begin[1:]
    ends = np.flatnonzero(final) + 1
    code = np.zeros(len(raw) + 8, np.uint8)
    if lower:
        np.take(_LOWER, raw, out=code[: len(raw)])
        before = np.flatnonzero(raw[1:] >= 128)
        code[before] = raw[before]
    else:
        code[: len(raw)] = raw
    return starts, ends, code


class _Slots:
    """Open addressing from a 64-bit key to a slot number, in numpy."""

    def __init__(self, bits: int = 12) -> None:
        self.bits, self.n = bits, 0
        self.keys, self.slots = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where it isn't there."""
        mask = (1 << self.bits) - 1
        at = (keys & np.uint64(mask)).astype(np.int64)
        out = self.slots[at]
        open_ = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        while len(open_):
            at[open_] = (at[open_] + 1) & mask
            here = at[open_]
            out[open_] = self.slots[here]
            open_ = open_[(out[open_] >= 0) & (self.keys[here] != keys[open_])]
        return out

    def add(self, keys: np.ndarray, slots: np.ndarray) -> None:
        """Put in distinct keys that aren't there."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            held = np.flatnonzero(self.slots >= 0)
            old = self.keys[held], self.slots[held]
            self.__init__(max(12, int(2 * (self.n + len(keys))).bit_length()))
            self._put(*old)
        self._put(keys, slots)

    def _put(self, keys: np.ndarray, slots: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        self.n += len(keys)
        at = (keys & np.uint64(mask)).astype(np.int64)
        while len(keys):
            free = self.slots[at] < 0
            self.slots[at[free]] = slots[free]  # of keys that meet at a free place the last one stays
            self.keys[at[free]] = keys[free]
            rest = ~(free & (self.slots[at] == slots))
            keys, slots, at = keys[rest], slots[rest], (at[rest] + 1) & mask


class WordTokenizer:
    """Ids of texts under a ``tokenizers`` file whose pre-tokenizer drops white space.

    Such a file also has to cut between letters and other marks and to lower
    the case. ``separator`` is a special token of it; it is put between words
    so that many are encoded in one call.
    """

    def __init__(self, path: str, separator: str = "<|endoftext|>") -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are what runs side by side
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.separator, self.separator_id = separator, self.model.token_to_id(separator)
        self.special = [t.content.encode() for t in self.model.get_added_tokens_decoder().values()]
        # whether the merges alone give the ids of a word of lower-case letters
        self.direct = all([t.id for t in self.model.model.tokenize(w)] == self.model.encode(w, add_special_tokens=False).ids for w in ("a", "thereof", "qxzvj"))
        self.forget()

    def forget(self) -> None:
        self.table, self.words, self.used = _Slots(), 0, 0
        self.starts, self.store = np.zeros(1 << 12, np.int32), np.zeros(1 << 16, np.uint32)
        self.second, self.hits = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.uint8)

    def _room(self, words: int, ids: int) -> None:
        while self.words + words + 1 > len(self.starts):
            self.starts, self.second, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.second, self.hits))
        while self.used + ids > len(self.store):
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])

    def _add(self, first: np.ndarray, second: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> None:
        n = len(first)
        self._room(n, len(ids))
        self.store[self.used : self.used + len(ids)] = ids
        self.starts[self.words + 1 : self.words + n + 1] = self.used + ends
        self.second[self.words : self.words + n] = second
        self.hits[self.words : self.words + n] = 0
        self.table.add(first, np.arange(self.words, self.words + n, dtype=np.int32))
        self.words, self.used = self.words + n, self.used + len(ids)

    def _shrink(self) -> None:
        """Keep the words that more than one batch had, if these are few enough."""
        kept = np.flatnonzero(self.hits[: self.words] > 1)
        if 2 * len(kept) > MAX_CACHED_WORDS:
            return self.forget()
        keys = np.zeros(self.words, np.uint64)
        held = self.table.slots >= 0
        keys[self.table.slots[held]] = self.table.keys[held]
        size = (self.starts[kept + 1] - self.starts[kept]).astype(np.int64)
        ends = np.cumsum(size)
        ids = self.store[np.repeat(self.starts[kept] - (ends - size), size) + np.arange(int(size.sum()))]
        second = self.second[kept]
        self.forget()
        self._add(keys[kept], second, ids, ends)

    def _learn(self, first: np.ndarray, second: np.ndarray, words: list[bytes]) -> None:
        """Encode words that are new. What normalizing and cutting leave as it is goes straight to the merges."""
        plain = np.array([self.direct and w.isalpha() and w.islower() and w.isascii() for w in words], bool)
        merge, ids, ends = self.model.model.tokenize, [], []
        for i in np.flatnonzero(plain).tolist():
            ids += [t.id for t in merge(words[i].decode())]
            ends.append(len(ids))
        if ends:
            self._add(first[plain], second[plain], np.array(ids, np.uint32), np.array(ends))
        if not plain.all():
            self._learn_others(first[~plain], second[~plain], [words[i] for i in np.flatnonzero(~plain).tolist()])

    def _learn_others(self, first: np.ndarray, second: np.ndarray, words: list[bytes]) -> None:
        sep = self.separator.encode()
        runs = [sep.join(words[i : i + _WORDS_A_CALL]).decode() for i in range(0, len(words), _WORDS_A_CALL)]
        parts = []
        for i in range(0, len(runs), 32):
            for e in self.model.encode_batch_fast(runs[i : i + 32], add_special_tokens=False):
                parts += [np.array(e.ids, np.uint32), np.array([self.separator_id], np.uint32)]
        ids = np.concatenate(parts)
        cut = np.flatnonzero(ids == self.separator_id)
        self._add(first, second, ids[ids != self.separator_id], cut - np.arange(len(cut)))

    def _by_library(self, data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts = [data[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        ids = [np.array(e.ids, np.uint32) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.cumsum([0] + [len(x) for x in ids])

    def _encode_some(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data = raw.tobytes()
        if b"<|" in data and any(s.lower() in data.lower() for s in self.special):
            return self._by_library(data, offsets)  # a special token's own string is among the words
        starts, ends, code = _words(raw, offsets, True)
        h, second = span_hashes(code, starts, ends), span_hashes(code, starts, ends, _SECOND)
        if self.words > MAX_CACHED_WORDS:
            self._shrink()
        slot = self.table.find(h)
        new = np.flatnonzero(slot < 0)
        if len(new):
            low = code.tobytes()
            _, where = np.unique(h[new], return_index=True)
            at = new[where]
            self._learn(h[at], second[at], [low[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            slot[new] = self.table.find(h[new])
        if not np.array_equal(self.second[slot], second):
            return self._by_library(data, offsets)
        seen = np.zeros(self.words, bool)
        seen[slot] = True
        self.hits[: self.words] += seen & (self.hits[: self.words] < 255)
        first = self.starts[slot].astype(np.int64)
        size = self.starts[slot + 1] - first
        upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
        take = np.repeat(first - upto[:-1], size)
        take += np.arange(len(take))
        return self.store[take], upto[np.searchsorted(starts, offsets)]

    def encode(self, texts: pa.Array, step: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, offsets by text); null is empty."""
        raw, offsets = text_bytes(texts)
        out, counts, i = [], [np.zeros(1, np.int64)], 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + step, "right")) - 1)
            ids, at = self._encode_some(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            out.append(ids)
            counts.append(np.diff(at))
            i = j
        return np.concatenate(out) if out else np.zeros(0, np.uint32), np.cumsum(np.concatenate(counts))


def word_tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer for ``path``, kept from task to task."""
    kept = sys.modules.setdefault("_quire_tokenizers", types.ModuleType("_quire_tokenizers")).__dict__
    if path not in kept:
        kept[path] = WordTokenizer(path)
    return kept[path]
