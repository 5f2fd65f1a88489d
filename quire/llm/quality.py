"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of a text are Spark columns. On a bounded sample of labelled rows,
small boosted trees are grown over them; each path from a root to a node is a
rule, a conjunction of comparisons. A logistic regression with a lasso penalty
weighs the rules, and most weights are zero. The rules that are left are
compiled into one Spark column expression, so scoring needs no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import let

_WORD = r"[ \t\n\x0B\f\r]+"
_SYMBOLS = r"[^\p{L}\p{N}\s]+"


def statistics(text: Column) -> Column:
    """A struct of the statistics of a text; null is empty. All are defined for empty texts."""
    t = F.coalesce(text, F.lit(""))
    length = lambda c: F.char_length(c).cast("double")
    ratio = lambda a, b: a / F.greatest(b, F.lit(1.0))

    def of_words(x: Column, words: Column, lines: Column) -> Column:
        n, letters, upper = length(x), length(F.regexp_replace(x, r"[^\p{L}]+", "")), length(F.regexp_replace(x, r"[^\p{Lu}]+", ""))
        symbols = F.regexp_replace(x, r"[\p{L}\p{N}\s]+", "")
        n_words, n_lines = F.size(words).cast("double"), F.size(lines).cast("double")
        many = lambda c: F.size(F.filter(words, c)).cast("double")
        return F.struct(
            F.log1p(n).alias("log_chars"),
            F.log1p(n_words).alias("log_words"),
            ratio(letters, n_words).alias("letters_a_word"),
            ratio(letters, n).alias("letter_share"),
            ratio(upper, letters).alias("upper_share"),
            ratio(length(symbols), n).alias("symbol_share"),
            ratio(length(F.regexp_replace(symbols, r"[.,;:!?'\"-]+", "")), n_words).alias("odd_marks_a_word"),
            ratio(length(F.regexp_replace(symbols, r"[^.!?]+", "")), n_words).alias("stops_a_word"),
            ratio(length(F.regexp_replace(x, r"[^0-9]+", "")), n).alias("digit_share"),
            ratio(many(lambda w: F.length(w) == 1), n_words).alias("single_share"),
            ratio(many(lambda w: F.length(w) > 12), n_words).alias("long_share"),
            ratio(F.size(F.array_distinct(words)).cast("double"), n_words).alias("distinct_words"),
            ratio(F.size(F.array_distinct(lines)).cast("double"), n_lines).alias("distinct_lines"),
            ratio(n_words, n_lines).alias("words_a_line"),
            F.log1p(n_lines).alias("log_lines"),
        )

    return let(t, lambda x: let(F.array_remove(F.split(x, _WORD), ""), lambda w: let(F.array_remove(F.split(x, "\n+"), ""), lambda ls: of_words(x, w, ls))))


@dataclass
class Rule:
    """All of (statistic, at most / above, bound)."""

    terms: list[tuple[str, bool, float]]
    weight: float


@dataclass
class Model:
    rules: list[Rule]
    bias: float


def _tree(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, cuts: list[np.ndarray], depth: int, least: int, rows: np.ndarray, path: list, rules: list, pred: np.ndarray) -> None:
    """Grow one tree by second-order gain, collect its paths, and set its predictions."""
    value = -grad[rows].sum() / (hess[rows].sum() + 1.0)
    pred[rows] = value
    if path:
        rules.append(tuple(path))
    if depth == 0 or len(rows) < 2 * least:
        return
    best, g, h = (1e-6, None, None), grad[rows], hess[rows]
    total = g.sum() ** 2 / (h.sum() + 1.0)
    for j, c in enumerate(cuts):
        if not len(c):
            continue
        bins = np.searchsorted(c, x[rows, j], "left")  # at most c[k]: bins <= k
        n, gs, hs = (np.cumsum(np.bincount(bins, w, len(c) + 1))[:-1] for w in (None, g, h))
        gain = gs**2 / (hs + 1.0) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1.0) - total
        gain[(n < least) | (len(rows) - n < least)] = 0
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), j, float(c[k]))
    _, j, bound = best
    if j is None:
        return
    low = x[rows, j] <= bound
    _tree(x, grad, hess, cuts, depth - 1, least, rows[low], [*path, (j, True, bound)], rules, pred)
    _tree(x, grad, hess, cuts, depth - 1, least, rows[~low], [*path, (j, False, bound)], rules, pred)


def _holds(x: np.ndarray, rule: tuple) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, low, bound in rule:
        out &= (x[:, j] <= bound) == low
    return out


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty, by accelerated proximal gradient."""
    n, k = r.shape
    scale = np.sqrt((r * (1 - r.mean(0))).mean(0)) + 0.05
    z = np.hstack([r / scale, np.ones((n, 1))])
    step = 4.0 / (np.linalg.norm(z, 2) ** 2 / n)
    w = v = np.zeros(k + 1)
    t = 1.0
    w[k] = 0.0
    for _ in range(steps):
        g = z.T @ (1 / (1 + np.exp(-z @ v)) - y) / n
        new = v - step * g
        new[:k] = np.sign(new[:k]) * np.maximum(np.abs(new[:k]) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return w[:k] / scale, float(w[k])


def train(x: np.ndarray, y: np.ndarray, names: list[str], *, trees: int = 30, depth: int = 3, bins: int = 48, penalties=(0.02, 0.006, 0.002, 0.0007), seed: int = 3) -> Model:
    """Fit rules and weights to statistics ``x`` and marks ``y``; a quarter of the rows picks the penalty."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    if len(y) < 8 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Model([], float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    score, rules = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        rows = np.flatnonzero(rng.random(len(y)) < 0.7)
        own: list = []
        pred = np.zeros(len(y))
        _tree(x, p - y, p * (1 - p), cuts, depth, max(5, len(y) // 200), rows, [], own, pred)
        score += 0.3 * pred
        rules += own
    # one rule for each set of rows that hold it
    r, kept = [], []
    for rule in dict.fromkeys(rules):
        h = _holds(x, rule)
        if 0 < h.sum() < len(y):
            r.append(h)
            kept.append(rule)
    if not kept:
        return Model([], float(np.log(y.mean() / (1 - y.mean()))))
    r, first = np.unique(np.array(r), axis=0, return_index=True)
    kept, r = [kept[i] for i in first], r.T.astype(float)
    apart = rng.random(len(y)) < 0.25

    def loss(penalty: float) -> float:
        w, b = _lasso(r[~apart], y[~apart], penalty)
        p = 1 / (1 + np.exp(-(r[apart] @ w + b)))
        return float(-(np.log(np.where(y[apart] == 1, p, 1 - p) + 1e-9)).mean())

    w, b = _lasso(r, y, min(penalties, key=loss))
    return Model([Rule([(names[j], low, bound) for j, low, bound in rule], float(c)) for rule, c in zip(kept, w, strict=True) if abs(c) > 1e-6], b)


def compile_score(model: Model, stats: Column) -> Column:
    """Probability that the quality is 1, as a column over the struct of statistics."""
    z = F.lit(model.bias)
    for rule in model.rules:
        holds = None
        for name, low, bound in rule.terms:
            s = stats.getField(name)
            term = (s <= bound) if low else (s > bound)
            holds = term if holds is None else holds & term
        z = z + F.when(holds, F.lit(rule.weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-z))


def fit(docs: DataFrame, labels: DataFrame, *, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> Model:
    """Train on at most ``max_rows`` labelled rows, the sample's documented bound.

    They are chosen by a hash of their ids. Null ids and labels are left out; an
    id that is labelled twice counts with the smaller label; of rows that repeat
    an id one counts, that with the smallest statistics. Only the statistics of
    the sample come to the driver. Further columns are ignored; without labelled
    rows, or with one label only, the model is a constant.
    """
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.min("y").alias("y"))
    marks = marks.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(marks), "id")
    rows = rows.groupBy("id", "y").agg(F.min(statistics(F.col("text"))).alias("s")).orderBy("id").select("s.*", "y").toArrow()
    names = [n for n in rows.column_names if n != "y"]
    return train(np.column_stack([rows[n].to_numpy() for n in names]), rows["y"].to_numpy(), names, **options)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` of each row: predicted is 1 where the score is 0.5 at least.

    Null and empty texts have the score that their statistics (all zero) give;
    very long texts are read whole; repeated rows and null ids are carried along;
    further columns are ignored; an empty table gives an empty result.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), let(statistics(F.col(text_col)), lambda s: compile_score(model, s)).alias("score"))
    return d.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without those that score below the threshold; all their columns stay.

    A null text is judged as an empty one. Each row is judged by its text alone,
    so repeated rows stay or go together, whatever their ids and other columns.
    """
    return docs.where(let(statistics(F.col(text_col)), lambda s: compile_score(model, s)) >= threshold)
