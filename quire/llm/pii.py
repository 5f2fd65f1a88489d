"""Personal data: patterns, and a semi-Markov conditional random field that adds to them.

Each kind has a pattern whose matches always stand. Beside them, a semi-Markov
CRF looks at the surroundings of anchors (digits, ``@``, a spelled-out "at"): it
cuts a run of tokens into segments, each outside or a whole candidate span of a
kind. A segment is scored by features of the whole span (its shape, digits,
checksum, borders, the word before it) and by the kind of the segment before it;
dynamic programming over segments of at most ``MAX_TOKENS`` tokens chooses
boundaries and kinds together. Spans that the CRF finds and that no pattern
match overlaps are added.

The CRF is trained by maximum likelihood (forward-backward over segments, plain
stochastic gradient) on sentences that a seeded generator writes, since no table
marks spans.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import lean_batches

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 14

# The patterns of the contract.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the patterns' matches; within a kind leftmost and non-overlapping.

    Every search is linear: an address is found from its ``@``, and an IP's first
    digits are taken from the start of their run, where a match begins if any does.
    """
    out, last = [], 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            i = m.start()
            while i > last and text[i - 1] in _LOCAL:
                i -= 1
            if i < m.start():
                out.append((i, m.end(), 0))
                last = m.end()
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        parts = (p.lstrip("0") for p in m.group().split("."))
        if all(len(p) < 4 and int(p or "0") <= 255 for p in parts):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                out.append((m.start(), m.end(), 3))
    return out


# --- the semi-Markov CRF -----------------------------------------------------

_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\w\s]|_")
_ANCHOR = re.compile(r"[0-9]{2,}|@|[\[(]\s*at\s*[\])]|\bat\b(?=[^.\n]{1,40}\bdot\b)", re.IGNORECASE)
_SPELLED = re.compile(r"[\[(]\s*(at|dot)\s*[\])]|\b(at|dot)\b", re.IGNORECASE)
_CUES = {"call": 0, "phone": 0, "tel": 0, "mobile": 0, "fax": 0, "mail": 1, "email": 1, "contact": 1, "write": 1, "card": 2, "visa": 2, "pay": 2, "ip": 3, "host": 3, "server": 3, "address": 3}
_REACH = 60


def shape(span: str) -> str:
    """The span with runs of digits as ``9`` and their length's class, letters as ``a``, spaces as ``_``."""
    s = _SPELLED.sub(lambda m: "\x00" if (m[1] or m[2]).lower() == "at" else "\x01", span)
    s = re.sub(r"[0-9]+", lambda m: "9" + (str(len(m[0])) if len(m[0]) < 5 else "+"), s)
    s = re.sub(r"[^\W\d_]+", "a", s)
    s = re.sub(r"\s+", "_", s).replace("\x00", "AT").replace("\x01", "DOT")
    return s[:48]


def segment_features(text: str, start: int, end: int) -> list[str]:
    """Features of a whole candidate span, before its kind is joined to them."""
    span = text[start:end]
    digits = _digits(span)
    n = len(digits)
    low = span.lower()
    before = text[start - 1] if start else " "
    after = text[end] if end < len(text) else " "
    groups = re.findall(r"[0-9]+", span)
    has_at = "@" in span or re.search(r"[\[(]\s*at\s*[\])]|\bat\b", low) is not None
    cue = next((_CUES[w] for w in reversed(re.findall(r"[a-z]+", text[max(0, start - 24) : start].lower())[-2:]) if w in _CUES), "-")
    f = [
        "bias",
        f"n{n if n < 8 else '8-9' if n < 10 else '10' if n == 10 else '11-12' if n < 13 else '13-19' if n < 20 else '20+'}",
        f"at{int(has_at)}{int('dot' in low or '.' in span)}",
        f"border{int(before.isalnum())}{int(after.isalnum())}",
        f"open{int(before in '@.-_/#:=' or (before == '.' and after.isdigit()))}{int(after in '@-_/%')}",
        f"cue{cue}",
        f"words{min(3, len(re.findall(r'[^\W\d_]+', span)))}",
        f"groups{min(6, len(groups))}",
    ]
    if n >= 12:
        f.append(f"luhn{int(luhn(digits))}{int(set(re.sub(r'[0-9]', '', span)) <= set(' -'))}")
    if len(groups) == 4 and span.count(".") == 3 and not has_at:
        f.append(f"octets{int(all(len(g) < 4 and int(g) < 256 for g in groups))}")
    if not has_at:
        f.append("shape" + shape(span))
        f.append("plain" + str(int(re.fullmatch(r"[0-9 ().+-]+", span) is not None)) + str(int("(" in span) + 2 * int(")" in span)))
    else:
        f.append("mail" + str(int(re.fullmatch(r"[A-Za-z0-9._%+-]+(@|\s*[\[(]\s*at\s*[\])]\s*|\s+at\s+)[A-Za-z0-9-]+((\.|\s*[\[(]\s*dot\s*[\])]\s*|\s+dot\s+)[A-Za-z0-9-]+)+", span, re.IGNORECASE) is not None)))
        f.append("domain" + str(int(re.search(r"(?:\.|dot[\])]?\s*)(com|org|net|edu|de|fr|es|io)$", low) is not None)))
    return f


def _candidates(text: str, tokens: list[tuple[int, int]]) -> dict[int, list[tuple[int, list[str]]]]:
    """By the token behind it: (first token, features) of the spans that could be an entity."""
    out: dict[int, list[tuple[int, list[str]]]] = {}
    good = [bool(re.match(r"[0-9(+\w]", text[s])) for s, _ in tokens]
    for i, (s, _) in enumerate(tokens):
        if not good[i]:
            continue
        signs = 0
        for j in range(i, min(len(tokens), i + MAX_TOKENS)):
            a, e = tokens[j]
            if j > i and text[tokens[j - 1][1] : a].count("\n"):
                break
            part = text[a:e]
            signs += 2 if part == "@" or part.lower() == "at" or (part.isdigit() and len(part) > 8) else part.isdigit() and len(part) > 1
            if signs >= 2 and part[-1].isalnum() and e - s >= 7:
                out.setdefault(j + 1, []).append((i, segment_features(text, s, e)))
    return out


def _windows(text: str) -> list[tuple[int, int]]:
    """Stretches of text around anchors, merged where they touch."""
    out: list[list[int]] = []
    for m in _ANCHOR.finditer(text):
        lo, hi = max(0, m.start() - _REACH), min(len(text), m.end() + _REACH)
        if out and lo <= out[-1][1]:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def _score(w: dict[str, float], kind: int, before: int, features: list[str]) -> float:
    k = KINDS[kind]
    return w.get(f"{before}>{kind}", 0.0) + sum(w.get(f"{k}|{f}", 0.0) for f in features)


def _states(before: int) -> str:
    return f"{before}>-1"


def decode(w: dict[str, float], text: str, lo: int, hi: int) -> list[tuple[int, int, int]]:
    """The best segmentation of a stretch of text: its entities (start, end, kind)."""
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text, lo, hi)]
    cand = _candidates(text, tokens)
    if not cand:
        return []
    labels = range(-1, len(KINDS))
    best: list[dict[int, tuple[float, tuple | None]]] = [{-1: (0.0, None)}]
    for j in range(1, len(tokens) + 1):
        here: dict[int, tuple[float, tuple | None]] = {}
        outside = max(((s + w.get(_states(b), 0.0), b) for b, (s, _) in best[j - 1].items()), default=None)
        if outside:
            here[-1] = (outside[0], (j - 1, outside[1]))
        for i, f in cand.get(j, ()):
            for kind in labels[1:]:
                s, b = max((s + w.get(f"{b}>{kind}", 0.0), b) for b, (s, _) in best[i].items())
                k = KINDS[kind]
                s += sum(w.get(f"{k}|{x}", 0.0) for x in f)
                if kind not in here or s > here[kind][0]:
                    here[kind] = (s, (i, b))
        best.append(here)
    out, j = [], len(tokens)
    label = max(best[j], key=lambda k: best[j][k][0])
    while j:
        i, before = best[j][label][1]
        if label >= 0:
            out.append((tokens[i][0], tokens[j - 1][1], label))
        j, label = i, before
    return out[::-1]


def _lse(xs: list[float]) -> float:
    m = max(xs)
    return m + math.log(sum(math.exp(x - m) for x in xs))


def _gradient(w: dict[str, float], text: str, gold: list[tuple[int, int, int]]) -> dict[str, float] | None:
    """Of the log-likelihood of the true segmentation, by forward-backward over segments."""
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    cand = _candidates(text, tokens)
    first, behind = {s: i for i, (s, _) in enumerate(tokens)}, {e: i + 1 for i, (_, e) in enumerate(tokens)}
    true = {}
    for s, e, kind in gold:
        if s not in first or e not in behind or not any(i == first[s] for i, _ in cand.get(behind[e], ())):
            return None
        true[behind[e]] = (first[s], kind)
    n, labels = len(tokens), range(-1, len(KINDS))
    arcs: list[list[tuple[int, int, int, float, list[str]]]] = [[] for _ in range(n + 1)]  # (from, before, kind, score, features)
    alpha: list[dict[int, float]] = [{-1: 0.0}]
    for j in range(1, n + 1):
        arcs[j] += [(j - 1, b, -1, w.get(_states(b), 0.0), []) for b in alpha[j - 1]]
        for i, f in cand.get(j, ()):
            for kind in labels[1:]:
                own = sum(w.get(f"{KINDS[kind]}|{x}", 0.0) for x in f)
                arcs[j] += [(i, b, kind, own + w.get(f"{b}>{kind}", 0.0), f) for b in alpha[i]]
        by: dict[int, list[float]] = {}
        for i, b, kind, s, _ in arcs[j]:
            by.setdefault(kind, []).append(alpha[i][b] + s)
        alpha.append({k: _lse(v) for k, v in by.items()})
    total = _lse(list(alpha[n].values()))
    beta: list[dict[int, float]] = [{} for _ in range(n)] + [dict.fromkeys(alpha[n], 0.0)]
    sums: list[dict[int, list[float]]] = [{} for _ in range(n)]
    grad: dict[str, float] = {}

    def add(kind: int, before: int, f: list[str], x: float) -> None:
        grad[f"{before}>{kind}"] = grad.get(f"{before}>{kind}", 0.0) + x
        for name in f:
            grad[f"{KINDS[kind]}|{name}"] = grad.get(f"{KINDS[kind]}|{name}", 0.0) + x

    for j in range(n, 0, -1):
        if j < n:
            beta[j] = {k: _lse(v) for k, v in sums[j].items()}
        for i, b, kind, s, f in arcs[j]:
            if kind not in beta[j]:
                continue
            sums[i].setdefault(b, []).append(s + beta[j][kind])
            p = math.exp(alpha[i][b] + s + beta[j][kind] - total)
            if p > 1e-6:
                add(kind, b, f, -p)
    before, j = -1, 0
    ends = {i: (j, k) for j, (i, k) in true.items()}
    while j < n:
        if j in ends:
            e, kind = ends[j]
            add(kind, before, next(f for i, f in cand[e] if i == j), 1.0)
            j, before = e, kind
        else:
            add(-1, before, [], 1.0)
            j, before = j + 1, -1
    return grad


def _with_luhn(rng: random.Random, n: int) -> str:
    d = "4" + "".join(rng.choice("0123456789") for _ in range(n - 2))
    return next(d + c for c in "0123456789" if luhn(d + c))


def training_sentence(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A sentence of invented words with marked entities and look-alikes."""
    word = lambda: "".join(rng.choice("abcdeéfghilmnoprstuvz") for _ in range(rng.randint(2, 9)))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    name = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    tld = lambda: rng.choice(["com", "org", "net", "edu", "de", "fr", "io"])

    def email() -> str:
        local = name() + rng.choice(["", "." + name(), "." + num(2), "_" + name()])
        at = rng.choice(["@", "@", " at ", " [at] ", "[at]", "(at)", " (at) "])
        dot = "." if "@" in at or rng.random() < 0.4 else rng.choice([" dot ", "[dot]", " [dot] ", " (dot) "])
        if at == " at ":
            dot = " dot "
        return local + at + name() + rng.choice(["", "", "-" + name(), num(1)]) + dot + tld()

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return rng.choice([f"+{rng.randint(1, 99)} ({a}) {b}-{c}", f"+1 {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"({a}){b}-{c}", f"+{num(2)}{num(9)}", f"0{num(2)} {num(4)} {num(4)}"])

    def card() -> str:
        d = _with_luhn(rng, 16)
        sep = rng.choice(["", " ", "-", ".", ""])
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def ip() -> str:
        sep = rng.choice([".", ".", ".", "[.]"])
        return sep.join(str(rng.randint(0, 255)) for _ in range(4))

    def lure() -> str:
        return rng.choice([
            f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1990, 2030)}", f"v{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 90)}",
            f"{num(2)}:{num(2)}:{num(2)}", f"{rng.randint(1, 999)},{num(3)}.{num(2)}", "".join(rng.choice("0123456789abcdef") for _ in range(40)), num(rng.randint(2, 11)), f"{num(3)} {num(2)}", f"{num(4)}-{num(4)}", f"{num(4)} - {num(4)}",
            f"{word()} at {word()}", f"{word()} at {num(2)} {word()}", f"@{word()}", f"{num(3)}-{num(2)}", f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", f"{num(4)} {num(4)} {num(4)} {num(4)}", f"{rng.randint(256, 999)}.{num(3)}.{num(3)}.{num(3)}", f"{num(1)}.{num(1)}.{num(1)}", f"{num(2)} at {num(2)}", f"{num(2)}, {num(2)}, {num(3)}, {num(4)}",
        ])

    cues = {0: ["mail", "contact", "email:"], 1: ["ip", "host", "server:"], 2: ["card", "visa:", "pay"], 3: ["call", "tel:", "phone"]}
    text, gold = "", []
    for _ in range(rng.randint(3, 7)):
        text += " ".join(word() for _ in range(rng.randint(1, 5))) + rng.choice([" ", " ", ". ", ", "])
        if rng.random() < 0.75:
            if rng.random() < 0.5:
                text += lure()
            else:
                kind = rng.randrange(4)
                if rng.random() < 0.35:
                    text += rng.choice(cues[kind]) + " "
                span = (email, ip, card, phone)[kind]()
                gold.append((len(text), len(text) + len(span), kind))
                text += span
            text += rng.choice([" ", " ", ". ", ", ", "\n"])
    return text, gold


@lru_cache(maxsize=4)
def train(sentences: int = 500, epochs: int = 2, seed: int = 11, rate: float = 0.4, decay: float = 1e-3) -> dict[str, float]:
    """Weights by name. Deterministic for a seed; made once for each set of arguments in an application."""
    rng = random.Random(seed)
    data = [training_sentence(rng) for _ in range(sentences)]
    w: dict[str, float] = {}
    for epoch in range(epochs):
        for text, gold in data:
            g = _gradient(w, text, gold)
            for name, x in (g or {}).items():
                w[name] = w.get(name, 0.0) * (1 - rate * decay) + rate / (1 + epoch) * x
        rng.shuffle(data)
    return {k: round(v, 5) for k, v in w.items() if abs(v) > 1e-4}


def all_spans(text: str | None, weights: dict[str, float]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(pattern matches, spans added by the CRF), each sorted by start, then kind."""
    text = text or ""
    base = sorted(pattern_spans(text), key=lambda x: (x[0], x[2]))
    found = [x for lo, hi in _windows(text) for x in decode(weights, text, lo, hi)]
    # stretches that matches cover: in order and apart, so one search tells whether a span meets any
    starts, ends = [], []
    for s, e, _ in base:
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return base, [x for x in found if not (i := bisect_left(starts, x[1])) or ends[i - 1] <= x[0]]


def span_string(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], x[2], x[1])))


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each stretch of overlapping spans replaced by its first one's kind."""
    out, at = [], 0
    for s, e, k in sorted(spans, key=lambda x: (x[0], -x[1])):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def find(docs: DataFrame, *, weights: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, masked`` of each row.

    Counts and ``base_sha256`` are of the patterns' matches; ``spans`` are all spans
    as ``kind:start:end`` in code points; ``masked`` is the text without them.
    Null texts are empty (and stay null in ``masked``); whole texts are read, also
    very long ones; repeated rows and null ids are carried along; of spans that
    start together the one of the kind listed first comes first. Further columns
    are ignored; an empty table gives an empty result.
    """
    lean_batches(docs.sparkSession)
    weights = weights or train()
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "masked"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                b, rows = batch.slice(lo, 256), []
                for text in b.column("text").to_pylist():
                    base, added = all_spans(text, w)
                    rows.append((*(sum(k == kind for *_, k in base) for kind in range(4)), hashlib.sha256(span_string(base).encode()).hexdigest(), span_string(base + added), None if text is None else masked(text, base + added)))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [*[pa.int64()] * 4, *[pa.string()] * 3], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], names=names)

    return d.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, masked string")


def mask_texts(docs: DataFrame, *, weights: dict[str, float] | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in the text replaced by its kind; rows and all other columns stay as they are.

    Null and empty texts stay; an empty table gives an empty result.
    """
    lean_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights or train())
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                b = batch.slice(lo, 256)
                texts = [None if t is None else masked(t, sum(all_spans(t, w), [])) for t in b.column(at).to_pylist()]
                yield b.set_column(at, b.schema.field(at).name, pa.array(texts, pa.string()))

    return docs.mapInArrow(run, docs.schema)
