"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's subwords are the runs of 2, 3 and 4 bytes of its lower-cased letters,
with a space at word breaks. Each is hashed to a row of an embedding table; a
text is the mean of its rows, and a linear softmax over it gives languages. The
table and the softmax are trained by stochastic gradient descent in numpy on a
bounded sample. A temperature, fitted on a part of the sample kept apart,
calibrates the probabilities, and the same part fixes the probability below
which a prediction is rejected.

For prediction, table and softmax are multiplied out: a text's logits are the
mean of one short row for each subword.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import lean_batches
from quire.llm.text_hash import slices, text_bytes

BUCKET_BITS = 16
ORDERS = (2, 3, 4)
UNKNOWN = "und"
#: Parts of a language whose texts are ranked apart.
RANKED_APART = 32
#: Steps of gradient descent at least.
MIN_STEPS = 500


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # logits by bucket and language
    bias: np.ndarray
    temperature: float
    threshold: float


def cleaned(texts: pa.Array) -> pa.Array:
    """Lower case, with a single space for each run of anything but letters, and at both ends."""
    t = pc.replace_substring_regex(pc.utf8_lower(texts.fill_null("")), r"[^\p{L}]+", " ")
    return pc.binary_join_element_wise("", pc.utf8_trim(t, " "), "", " ")


def subwords(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each subword, offsets by text). Bytes of each text begin and end with a space."""
    n = len(raw)
    size = np.diff(offsets)
    out, text = [], []
    owner = np.repeat(np.arange(len(size)), size)
    x = raw.astype(np.uint32)
    for k in ORDERS:
        if n < k:
            continue
        h = np.full(n - k + 1, np.uint32(2166136261 + k), np.uint32)
        for j in range(k):
            h = (h ^ x[j : n - k + 1 + j]) * np.uint32(16777619)
        h ^= h >> np.uint32(15)
        inside = owner[: n - k + 1] == owner[k - 1 :]
        out.append((h * np.uint32(0x9E3779B1) >> np.uint32(32 - BUCKET_BITS))[inside])
        text.append(owner[: n - k + 1][inside])
    if not out:
        return np.zeros(0, np.uint32), np.zeros(len(size) + 1, np.int64)
    counts = sum(np.bincount(t, minlength=len(size)) for t in text)
    order = np.argsort(np.concatenate(text), kind="stable")
    return np.concatenate(out)[order], np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])


def _examples(texts: list[str], labels: np.ndarray, piece: int, rng) -> tuple[list[np.ndarray], np.ndarray]:
    """Buckets of the pieces that the texts are cut into: whole texts, in pieces of all lengths up to ``piece`` bytes, so that short texts are learned too."""
    raw, offsets = text_bytes(cleaned(pa.array(texts, pa.string())))
    data, out, ys = raw.tobytes(), [], []
    for i, y in enumerate(labels):
        t = data[offsets[i] : offsets[i + 1]]
        at = 0
        while at < len(t):
            size = int(rng.integers(piece // 8, piece + 1))
            part = b" " + t[at : at + size].strip() + b" "
            at += size
            if len(part) > 3:
                out.append(np.frombuffer(part, np.uint8))
                ys.append(y)
    flat = np.concatenate(out) if out else np.zeros(0, np.uint8)
    ids, at = subwords(flat, np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64))
    return [ids[at[i] : at[i + 1]] for i in range(len(out))], np.array(ys, np.int64)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def train(texts: list[str], langs: list[str], *, dim: int = 16, epochs: int = 1, batch: int = 32, rate: float = 0.5, piece: int = 240, precision: float = 0.98, seed: int = 7) -> Model:
    """Fit on the texts; a fifth of them calibrates, but never all texts of a language."""
    languages = sorted(set(langs))
    rng = np.random.default_rng(seed)
    if len(languages) < 2:
        return Model(languages, np.zeros((1 << BUCKET_BITS, len(languages)), np.float32), np.zeros(len(languages), np.float32), 1.0, 0.0)
    y = np.array([languages.index(x) for x in langs])
    apart = rng.random(len(y)) < 0.2
    for k in range(len(languages)):
        apart[np.flatnonzero(y == k)[0]] &= not apart[y == k].all()
    fit, labels = _examples([t for t, a in zip(texts, apart, strict=True) if not a], y[~apart], piece, rng)
    held, held_y = _examples([t for t, a in zip(texts, apart, strict=True) if a], y[apart], piece, rng)
    emb = rng.normal(0, 0.1, (1 << BUCKET_BITS, dim)).astype(np.float32)
    out, bias = np.zeros((dim, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    out += rng.normal(0, 0.1, out.shape).astype(np.float32)
    weight = len(labels) / (len(languages) * np.maximum(np.bincount(labels, minlength=len(languages)), 1))
    epochs = max(epochs, -(-MIN_STEPS * batch // max(1, len(fit))))  # small samples are gone through more often
    steps = epochs * -(-len(fit) // batch)
    done = 0
    for _ in range(epochs):
        order = rng.permutation(len(fit))
        for i in range(0, len(order), batch):
            some = order[i : i + batch]
            ids = np.concatenate([fit[k] for k in some])
            n = np.array([len(fit[k]) for k in some])
            mean = np.add.reduceat(emb[ids], np.cumsum(n) - n, axis=0) / n[:, None]
            p = _softmax(mean @ out + bias)
            p[np.arange(len(some)), labels[some]] -= 1
            p *= (weight[labels[some]] / len(some))[:, None]
            lr = rate * (1 - done / steps)
            g = (p @ out.T) / n[:, None]
            out -= lr * (mean.T @ p)
            bias -= lr * p.sum(0)
            # a bucket's gradient is summed over its occurrences
            by = np.argsort(ids, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(ids[by]) > 0])
            emb[ids[by[first]]] -= lr * 20 * np.add.reduceat(np.repeat(g, n, axis=0)[by], first, axis=0).astype(np.float32)
            done += 1
    table = emb @ out
    temperature, threshold = 1.0, 0.0
    if held:
        z = np.stack([table[x].mean(0) for x in held]) + bias
        at = np.arange(len(held_y))
        temperature = min(np.geomspace(0.1, 5, 40), key=lambda t: -np.log(_softmax(z / t)[at, held_y] + 1e-12).sum())
        p = _softmax(z / temperature)
        conf, right = p.max(1), p.argmax(1) == held_y
        order = np.argsort(-conf)
        good = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= precision)
        threshold = float(conf[order[good[-1]]]) if len(good) else 1.0
    return Model(languages, table.astype(np.float32), bias, float(temperature), threshold)


def sample(docs: DataFrame, per_language: int, text_col: str, lang_col: str, max_rows: int = 20_000) -> tuple[list[str], list[str]]:
    """At most ``per_language`` different labelled texts of each language, those with the smallest hashes.

    Where that many of each language are more than ``max_rows``, all have an equal
    part of these (one text at least).

    Copies are brought to one row of their hash before any are counted, so a
    language of few texts in many rows keeps all of them. Hashes, not texts, are ranked.
    """
    d = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    d = d.withColumn("place", F.xxhash64("text"))
    per_language = max(1, min(per_language, max_rows // max(1, d.select("lang").distinct().count())))
    places = d.select("lang", "place").distinct()
    for part in (F.pmod("place", F.lit(RANKED_APART)), F.lit(0)):  # first within parts of a language, so none is ranked by one task
        ranked = Window.partitionBy("lang", part).orderBy("place")
        places = places.select("lang", "place").withColumn("k", F.row_number().over(ranked)).where(F.col("k") <= per_language)
    got = d.join(F.broadcast(places), ["lang", "place"]).select("lang", "k", "text").distinct().orderBy("lang", "k", "text").toArrow()
    return got["text"].to_pylist(), got["lang"].to_pylist()


def fit(docs: DataFrame, *, per_language: int = 400, max_rows: int = 20_000, text_col: str = "text", lang_col: str = "lang", **options) -> Model:
    """Train on at most ``per_language`` texts of each language of ``docs`` and ``max_rows`` in all, the sample's documented bounds.

    Null languages and texts without letters are left out; an empty table, or
    one without labelled texts, gives a model that knows no language.
    """
    return train(*sample(docs, per_language, text_col, lang_col, max_rows), **options)


def predict_texts(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and calibrated probability of each text."""
    raw, offsets = text_bytes(cleaned(texts))
    ids, at = subwords(raw, offsets)
    n = np.diff(at)
    has = (n > 0) & pc.match_substring_regex(texts.fill_null(""), r"\p{L}").to_numpy(zero_copy_only=False)
    if not model.languages:
        has[:] = False
    sums = np.zeros((len(n), max(1, len(model.languages))))
    rows = np.flatnonzero(has)
    if len(rows):
        z = np.add.reduceat(model.table[ids], at[:-1][n > 0], axis=0) if len(ids) else sums
        sums[n > 0] = z
        sums[n > 0] /= n[n > 0, None]
    p = _softmax((sums + (model.bias if model.languages else 0.0)) / model.temperature)
    best = p.argmax(1)
    return [model.languages[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)], np.where(has, p.max(1), 0.0)


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: Column | None = None) -> DataFrame:
    """``doc_id, lang_pred, score, accepted`` of each row.

    * ``und`` with score 0 where the text is null or has no letter, or nothing was
      learned; ``accepted`` is false there and where the score is below the
      model's threshold;
    * whole texts are read; equal texts have equal results; of equally likely
      languages the first in alphabetical order is taken; a null or repeated id
      is carried along; further columns are ignored; an empty table gives an
      empty result.
    """
    lean_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(**shared.value)
        for batch in batches:
            for b in slices(batch, "text", 1 << 20):
                lang, score = predict_texts(m, b.column("text"))
                yes = [x != UNKNOWN and s >= m.threshold for x, s in zip(lang, score, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(yes, pa.bool_())], names=["doc_id", "lang_pred", "score", "accepted"])

    return d.mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")
