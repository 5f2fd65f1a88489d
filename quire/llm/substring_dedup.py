"""Substring dedup by sliding spans of sentences and of words.

Every run of ``run_sentences`` consecutive sentences is hashed (128 bits, over
64-bit hashes of its words), and so are runs of words, which needn't begin or end
with a sentence; equal hashes are brought together over all documents; words that lie in a run which isn't the
first of its kind are removed. The first is the one in the document with the
smallest id, and there the one that comes first.

Of the runs of ``passage_words - WINDOW + 1`` words, those with the smallest hash
of each ``WINDOW`` successive ones are taken (winnowing). Which ones doesn't
depend on what stands around, so each passage of ``passage_words`` words holds
one that is taken wherever it stands, and those taken leave no gap between them:
of a repeated passage at most ``WINDOW - 1`` words at either end stay. A text of
fewer than ``passage_words`` words is one run.

Sentences are found and hashed by numpy over bytes. A sentence ends behind a
word that ends in ``.``, ``!`` or ``?``, and before a line feed. Words are lower-cased
(A-Z) and white space doesn't count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import lean_batches
from quire.llm.text_hash import mix, powers_of_base, slices, text_bytes, words_of

_SALT = np.uint64(0xA0761D6478BD642F)
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Successive runs of words of which one is taken.
WINDOW = 16


def sentences(raw: np.ndarray, offsets: np.ndarray):
    """(first byte, hash, words) of each sentence, and sentence offsets by text."""
    return sentences_of(raw, offsets, *words_of(raw, offsets))


def sentences_of(raw: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, at: np.ndarray):
    """:func:`sentences` of the words of :func:`words_of`."""
    if not len(starts):
        z = np.zeros(0, np.int64)
        return z, np.zeros(0, np.uint64), z, np.zeros(len(offsets), np.int64)
    stop = np.isin(raw[ends - 1], np.frombuffer(b".!?", np.uint8))
    lines = np.concatenate([np.zeros(1, np.int64), np.cumsum(raw == 10)])
    stop[:-1] |= lines[starts[1:]] > lines[ends[:-1]]
    stop[at[1:][at[1:] > 0] - 1] = True
    last = np.flatnonzero(stop)
    first = np.concatenate([np.zeros(1, np.int64), last[:-1] + 1])
    # a sum over words, each mixed with its place in the sentence
    place = (np.arange(len(h)) - np.repeat(first, last + 1 - first)).astype(np.uint64)
    s = mix(np.add.reduceat(mix(h ^ (place * _STEP)), first))
    return starts[first], s, last + 1 - first, np.searchsorted(first, at)


def run_hashes(s: np.ndarray, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(two hashes, words) of each run of ``n`` sentences in a row."""
    if len(s) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(s) - n + 1
    a, b, w = np.zeros(m, np.uint64), np.zeros(m, np.uint64), np.zeros(m, np.int64)
    for j in range(n):
        a = a * _STEP + s[j : j + m]
        b = b * _STEP + mix(s[j : j + m] ^ _SALT)
        w += words[j : j + m]
    return mix(a), mix(b), w


def _span_hash(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of the words ``lo`` to ``hi`` of each span."""
    up, down = powers_of_base.get(len(h) + 1)
    run = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=run[1:])
    return mix((run[hi] - run[lo]) * down[lo] + (hi - lo).astype(np.uint64))


def word_runs(h: np.ndarray, at: np.ndarray, passage_words: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, word behind it, two hashes) of each run of words that is taken, and run offsets by text."""
    size = passage_words - WINDOW + 1
    whole = np.flatnonzero((np.diff(at) < passage_words) & (np.diff(at) >= max(1, min_words)))
    lo, hi = at[whole], at[whole + 1]
    m = len(h) - size + 1
    if m >= WINDOW:
        first = np.arange(m)
        value, best, reach = _span_hash(h, first, first + size), first, 1
        while reach < WINDOW:  # ``value`` is the least of ``reach`` runs, ``best`` the last of those that have it
            step = min(reach, WINDOW - reach)
            later = value[step:] <= value[:-step]
            value, best = np.where(later, value[step:], value[:-step]), np.where(later, best[step:], best[:-step])
            reach += step
        inside = np.zeros(len(h) + 1, bool)  # windows that end in the text they begin in
        for a, b in zip(at[:-1], at[1:], strict=True):
            inside[a : max(a, b - passage_words + 1)] = True
        best = best[inside[: len(best)]]
        best = best[np.diff(best, prepend=-1) != 0]
        lo, hi = np.concatenate([lo, best]), np.concatenate([hi, best + size])
        order = np.argsort(lo, kind="stable")
        lo, hi = lo[order], hi[order]
    return lo, hi, _span_hash(h, lo, hi), _span_hash(mix(h ^ _SALT), lo, hi), np.searchsorted(lo, at)


def _runs(n: int, min_words: int, passage_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                raw, offsets = text_bytes(b.column("text"))
                found = words_of(raw, offsets)
                _, s, words, at = sentences_of(raw, offsets, *found)
                h1, h2, w = run_hashes(s, words, n)
                _, _, g1, g2, part = word_runs(found[2], found[3], passage_words, min_words)
                docs, first, second = [], [], []
                for i, doc in enumerate(b.column("doc_id").to_pylist()):
                    if doc is None:
                        continue
                    lo, hi = at[i], max(at[i], at[i + 1] - n + 1)
                    keep = lo + np.flatnonzero(w[lo:hi] >= min_words)
                    keep = keep[np.unique(h1[keep], return_index=True)[1]]
                    more = part[i] + np.unique(g1[part[i] : part[i + 1]], return_index=True)[1]
                    docs.append(np.full(len(keep) + len(more), doc))
                    first += [h1[keep], g1[more]]
                    second += [h2[keep], g2[more]]
                if docs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(docs), pa.int64()), pa.array(np.concatenate(first).view(np.int64)), pa.array(np.concatenate(second).view(np.int64))], names=["doc_id", "h1", "h2"])

    return run


def covered(s: np.ndarray, words: np.ndarray, repeated: np.ndarray, n: int, min_words: int) -> np.ndarray:
    """Which of a document's sentences lie in a run that is repeated elsewhere or occurs before in it.

    ``repeated`` are first halves of the hashes of this document's own runs, which
    the join found by both halves; among these alone the first half tells them apart.
    """
    out = np.zeros(len(s), bool)
    h, _, w = run_hashes(s, words, n)
    if len(h):
        bad = np.flatnonzero(_again(h, repeated) & (w >= min_words))
        for j in range(n):
            out[bad + j] = True
    return out


def _again(h: np.ndarray, repeated: np.ndarray) -> np.ndarray:
    """Which of a document's runs are repeated elsewhere or occur before in it."""
    again = np.ones(len(h), bool)
    again[np.unique(h, return_index=True)[1]] = False
    return again | np.isin(h, repeated)


def _cleaned(n: int, min_words: int, passage_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, count, removed = [], [], []
            for b in slices(batch, "text"):
                raw, offsets = text_bytes(b.column("text"))
                found = starts, _, h, word_at = words_of(raw, offsets)
                _, s, words, at = sentences_of(raw, offsets, *found)
                run_lo, run_hi, g, _, part = word_runs(h, word_at, passage_words, min_words)
                for i, (text, repeated) in enumerate(zip(b.column("text").to_pylist(), b.column("repeated").to_pylist(), strict=True)):
                    lo, hi = at[i], at[i + 1]
                    repeated = np.array(repeated or [], np.int64).view(np.uint64)
                    bad = np.repeat(covered(s[lo:hi], words[lo:hi], repeated, n, min_words), words[lo:hi])
                    runs = part[i] + np.flatnonzero(_again(g[part[i] : part[i + 1]], repeated))
                    edge = np.zeros(len(bad) + 1, np.int64)
                    np.add.at(edge, run_lo[runs] - word_at[i], 1)
                    np.add.at(edge, run_hi[runs] - word_at[i], -1)
                    bad |= np.cumsum(edge)[:-1] > 0
                    count.append(hi - lo)
                    removed.append(int(np.logical_or.reduceat(bad, np.cumsum(words[lo:hi]) - words[lo:hi]).sum()) if len(bad) else 0)
                    if bad.any():
                        at_word = starts[word_at[i] : word_at[i + 1]] - offsets[i]
                        keep = np.ones(offsets[i + 1] - offsets[i], bool)
                        keep[at_word[0] :] = np.repeat(~bad, np.diff(at_word, append=len(keep)))
                        text = raw[offsets[i] : offsets[i + 1]][keep].tobytes().decode()
                    texts.append(text)
            names = [x for x in batch.schema.names if x not in ("text", "repeated")]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(texts, pa.string()), pa.array(count, pa.int64()), pa.array(removed, pa.int64())], names=[*names, "text", "n_sentences", "n_removed"])

    return run


def remove_repeated_spans(docs: DataFrame, *, run_sentences: int = 3, min_words: int = 0, passage_words: int = 51, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, n_sentences, n_removed`` of each row, with repeated runs of sentences and words removed.

    * every run is looked at; with ``min_words``, only those of so many words;
    * of a repeated passage of ``passage_words`` words or more (more than
      ``WINDOW``) all but ``WINDOW - 1`` words at either end are removed,
      wherever its ends cut sentences; texts of fewer words are compared whole;
    * ``n_removed`` counts the sentences that lose a word;
    * a null text stays null, an empty one empty; what is removed takes the
      white space behind it along, the rest stays as it is;
    * rows that repeat an id are one document: they don't repeat each other;
    * a row with a null id is only freed of repeats within itself;
    * further columns are ignored; an empty table gives an empty result.

    A run that a third of the documents have is one row per document and hash:
    counted with partial aggregation, then joined to one row for the hash, a
    join whose large side AQE splits.
    """
    lean_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    runs = d.mapInArrow(_runs(run_sentences, min_words, passage_words), "doc_id long, h1 long, h2 long")
    firsts = runs.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("h1", "h2", "first")
    later = runs.join(firsts, ["h1", "h2"]).where("doc_id > first").groupBy("doc_id").agg(F.collect_list("h1").alias("repeated"))
    out = d.join(later, "doc_id", "left").select("doc_id", "text", "repeated")
    return out.mapInArrow(_cleaned(run_sentences, min_words, passage_words), "doc_id long, text string, n_sentences long, n_removed long")
