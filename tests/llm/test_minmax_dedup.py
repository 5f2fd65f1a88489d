"""Min-max near-duplicates against all pairs."""

import random
import re

import numpy as np
import pytest

from quire.llm import minmax_dedup

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def shingles(text, size):
    words = [w for w in SPACE.split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def plain(rows, size, num, den):
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if a and b and None not in (rows[i][0], rows[j][0]) and den * both >= num * (len(a) + len(b) - both):
                parent[max(top(i), top(j), key=lambda k: rows[k][0])] = min(top(i), top(j), key=lambda k: rows[k][0])
    for i, (doc, _) in enumerate(rows):
        name = None if doc is None else min(rows[j][0] for j in range(len(rows)) if top(j) == top(i))
        yield doc, len(sets[i]), name, doc == name


def corpus(seed):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(3000)}"
    rows, k = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "é"), (None, "one"), (None, None), (8, "Ab cD"), (9, "ab\tcd")], 10
    for group in range(25):
        base = [word() for _ in range(r.choice([3, 8, 25, 120, 900]))]
        for _ in range(r.choice([1, 2, 5, 30])):
            text, edits = list(base), r.choice([0, 1, len(base) // 25, len(base) // 12])
            for _ in range(edits):
                text[r.randrange(len(text))] = word()
            rows.append((k, (" " if r.random() < 0.5 else "\n").join(text)))
            k += 1
    rows += [(k, " ".join(f"v{i}" for i in range(20_000))), (k + 1, " ".join(f"v{i}" for i in range(100, 20_100)))]  # very long
    rows += [(k + 2 + i, "a hot text of many copies") for i in range(300)] + rows[20:25]
    return rows


@pytest.mark.parametrize(("size", "num", "den"), [(2, 80, 100), (5, 80, 100)])
def test_components_are_those_of_all_pairs(make_docs, size, num, den):
    rows = corpus(size)
    got = [tuple(r) for r in minmax_dedup.near_duplicates(make_docs(rows), shingle_words=size, num=num, den=den).collect()]
    assert sorted(got, key=str) == sorted(plain(rows, size, num, den), key=str)


def test_repeated_ids_and_rows_that_stay(make_docs):
    rows = [(1, "a b c d e f"), (1, "another text altogether here"), (2, "a b c d e f"), (None, "a b c d e f"), (3, None), (2, "a b c d e f")]
    got = [tuple(r) for r in minmax_dedup.near_duplicates(make_docs(rows), shingle_words=2).collect()]
    assert sorted(got, key=str) == sorted([(1, 5, 1, True), (1, 3, 1, True), (2, 5, 1, False), (None, 5, None, True), (3, 0, 3, True), (2, 5, 1, False)], key=str)
    left = minmax_dedup.keep_first(make_docs(rows), shingle_words=2)
    assert left.columns == make_docs([]).columns
    assert sorted((r.doc_id or 0 for r in left.collect())) == [0, 1, 1, 3]


def test_no_documents(make_docs):
    assert minmax_dedup.near_duplicates(make_docs([])).count() == 0


def test_both_ends_of_a_permutation_match_as_often_as_sets_are_alike():
    rng = np.random.default_rng(1)
    low = high = 0
    for _ in range(400):
        pool = rng.integers(0, 1 << 63, 125, np.uint64) * np.uint64(2)
        a, b = np.sort(pool[:112]), np.sort(pool[13:])
        values = minmax_dedup.band_values(np.concatenate([a, b]), np.array([0, len(a)]), 1, 48)
        same = values[0] == values[1]
        low, high = low + same[::2].mean(), high + same[1::2].mean()
    like = 99 / 125
    assert abs(low / 400 - like) < 0.03 and abs(high / 400 - like) < 0.03


def test_bands_come_in_pairs(make_docs):
    with pytest.raises(ValueError, match="pairs"):
        minmax_dedup.near_duplicates(make_docs([]), bands=3)
