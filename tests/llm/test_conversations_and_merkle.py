"""Conversation repair and the Merkle manifest against plain versions."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quire.llm import conversations, merkle

TURNS = "conv_id long, turn long, role string, text string, name string, part long, pos long, body string"


def make(spark, rows):
    return spark.createDataFrame([(*r, "x", 9, 9, "y") for r in rows], TURNS)


def plain_damage(rows):
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        f = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if f == 0:
            continue
        text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
        yield from [(c, t, "user" if f == 4 else role, text)] * (2 if f == 3 else 1)


def plain_faults(turns):
    """(fault or None) of each turn of one conversation, in order."""
    seen, out = set(), []
    for _, role, text in turns:
        body = text.strip(" \t\n\v\f\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def apply(turns, audit):
    """The turns after the edits, with roles by the grammar alone; None if they don't fit."""
    odd, out, rows = len(audit.replace("D", "")) % 2, [], iter(turns)
    for sign in audit:
        row = next(rows) if sign != "I" else (None, "", "")
        if sign == "D":
            continue
        want = "s" if odd and not out else "ua"[(len(out) - odd) % 2]
        if sign == "K" and row[1][:1] != want or sign in "RI" and want == "s":
            return None
        out.append((row[1] if sign == "K" else {"u": "user", "a": "assistant"}[want], row[2]))
    return out if next(rows, None) is None and len(out) != 1 else None


def price(audit, faults):
    at = iter(faults)
    cost = 0
    for sign in audit:
        fault = None if sign == "I" else next(at)
        if fault in ("blank", "duplicate") and sign != "D":
            return None
        cost += {"K": 0, "R": 3, "D": 4, "I": 3}[sign] + (3 if fault == "truncated" and sign != "D" else 0)
    return cost


def plain_repair(turns):
    """Least (cost, audit), over partial audits by (turns taken, state)."""
    faults = plain_faults(turns)
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    layer = {"": (0, "")}
    for i in range(len(turns) + 1):
        for _ in range(4):
            for s, (c, a) in list(layer.items()):
                for sign in "ua":
                    if to := step.get((s, sign)):
                        layer[to] = min(layer.get(to, (c + 3, a + "I")), (c + 3, a + "I"))
        if i == len(turns):
            return min(v for s, v in layer.items() if s in ("", "a"))
        after = {}
        for s, (c, a) in layer.items():
            ways = [(s, c + 4, "D")]
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] else 0
                ways += [(step.get((s, turns[i][1][:1])), c + more, "K")] + [(step.get((s, x)), c + 3 + more, "R") for x in "ua"]
            for to, cost, sign in ways:
                if to is not None:
                    after[to] = min(after.get(to, (cost, a + sign)), (cost, a + sign))
        layer = after


def order(turns):
    return sorted(turns, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1].encode())}:{r[1]}:{r[2]}".encode()).digest()))


def plain_summary(rows, names):
    groups = {c: [] for c in names}
    for c, t, role, text in rows:
        groups[c].append((t, " " if role is None else role, " " if text is None else text))
    for c, turns in groups.items():
        turns = order(turns)
        faults = plain_faults(turns)
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        cost, audit = plain_repair(turns)
        mended = "\n".join(f"{r}:{x}" for r, x in apply(turns, audit))
        yield (c, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256(mended.encode()).hexdigest())


def odd_rows(seed):
    r = random.Random(seed)
    words = ["", " ", None, "a.", "a", "b! ", "c?\n", "d", "long " * 2000 + "end.", "é.", "x.\t"]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "unknown"]
    rows = []
    for c in [None, *range(40)]:
        for t in range(r.choice([0, 1, 2, 5, 9])):
            rows.append((c, r.choice([None, t, t, t + r.randrange(3)]), r.choice(roles[:3] if r.random() < 0.8 else roles), r.choice(words)))
    for c, n in ((100, 64), (101, 65), (102, 300), (103, 4500)):  # one segment, two, several, two rounds of segments
        rows += [(c, t, r.choice(roles[:3]), f"{t}{r.choice('.!?x ')}") for t in range(n)]
    return rows + rows[:20]


def test_summary_is_the_plain_one(spark):
    rows = odd_rows(1)
    table = make(spark, rows)
    got = sorted(map(tuple, conversations.summary(table).collect()), key=str)
    assert got == sorted(plain_summary(rows, dict.fromkeys(r[0] for r in rows)), key=str)


def test_damage_and_lost_conversations(spark):
    rows = odd_rows(2) + [(k, 0, "user", "Hi.") for k in range(1000, 1100)]
    table = make(spark, rows)
    hurt = list(plain_damage(rows))
    assert sorted(map(tuple, conversations.damaged(table).collect()), key=str) == sorted(hurt, key=str)
    names = dict.fromkeys(r[0] for r in rows)
    got = sorted(map(tuple, conversations.summary(conversations.damaged(table), table).collect()), key=str)
    assert got == sorted(plain_summary(hurt, names), key=str)
    assert any(g[7] == "" and g[-1] == hashlib.sha256(b"").hexdigest() for g in got)


def test_plain_repair_is_the_least_of_all_audits():
    r = random.Random(3)
    for _ in range(60):
        turns = [(t, r.choice(["user", "assistant", "system", "tool"]), r.choice(["", f"{t}.", f"{t}", "same."])) for t in range(r.randrange(4))]
        faults, best = plain_faults(turns), None
        for n in range(len(turns), len(turns) + 5):
            for audit in map("".join, itertools.product("DIKR", repeat=n)):
                if len(audit.replace("I", "")) == len(turns) and apply(turns, audit) is not None and (cost := price(audit, faults)) is not None:
                    best = min(best or (cost, audit), (cost, audit))
        assert plain_repair(turns) == best


def test_repaired_turns_follow_the_grammar(spark):
    rows = odd_rows(4)
    table = make(spark, rows)
    out = {}
    for r in conversations.repair(table).orderBy("conv_id", "place").collect():
        out.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    digests = {r.conv_id: r.repaired_sha256 for r in conversations.summary(table).collect()}
    for c, d in digests.items():
        turns = out.get(c, [])
        assert hashlib.sha256("\n".join(turns).encode()).hexdigest() == d
        assert re.fullmatch("(s?(ua)+)?", "".join(t[0] for t in turns))


def test_no_conversations(spark):
    assert conversations.summary(make(spark, [])).count() == 0
    assert conversations.repair(make(spark, [])).count() == 0


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(leaves, fanout):
    paths, at = [[] for _ in leaves], list(range(len(leaves)))
    while len(leaves) > 1:
        for p, i in zip(paths, at, strict=True):
            s = i // fanout * fanout
            p.append((i - s, "".join(x for j, x in enumerate(leaves[s : s + fanout], s) if j != i)))
        leaves = [sha("".join(leaves[i : i + fanout])) for i in range(0, len(leaves), fanout)]
        at = [i // fanout for i in at]
    return leaves[0], paths


def plain_manifest(rows, fanout=2):
    by = {}
    for r in rows:
        by.setdefault(r["lang"], []).append((r["doc_id"], sha("".join(plain_field(r[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")))))
    names = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for n in names:
        by[n].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[n] = plain_tree([x for _, x in by[n]], fanout)
    root, above = plain_tree([trees[n][0] for n in names], fanout)
    for n, up in zip(names, above, strict=True):
        for (doc, leaf), path in zip(by[n], trees[n][1], strict=True):
            yield doc, leaf, trees[n][0], root, path + up


def odd_docs(make_docs, n=2500):
    r = random.Random(5)
    docs = make_docs([(None if i % 97 == 0 else i // 2 if i % 5 == 0 else i, r.choice([None, "", "é" * 3, "w " * 20_000 if i == 7 else f"t{i}"])) for i in range(n)])
    hot = F.when(F.crc32(F.coalesce("text", F.lit("")).cast("binary")) % 5 < 3, F.lit("en"))
    return docs.withColumn("lang", F.when(F.col("doc_id") % 11 == 0, F.lit("éé")).when(F.col("doc_id") == 13, F.lit("lone")).otherwise(hot)).withColumn("source", F.when(F.col("doc_id") % 3 == 0, F.lit("a:b"))).withColumn("n_chars", F.char_length("text").cast("long"))


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_manifest_is_the_plain_tree(make_docs, fanout):
    docs = odd_docs(make_docs)
    got = [(r.doc_id, r.leaf, r.subroot, r.root, [(p.place, p.others) for p in r.proof]) for r in merkle.manifest(docs, fanout=fanout).collect()]
    assert sorted(got, key=str) == sorted(plain_manifest(docs.collect(), fanout), key=str)


def test_tampering_is_found_where_it_was_done(make_docs):
    docs = odd_docs(make_docs, 600)
    root = merkle.manifest(docs).first()["root"]
    seen = set()
    for r in merkle.tampering(docs).collect():
        hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
        assert r.root == root and r.verified == (r.folded_root == root)
        if not hit:
            assert r.verified
        seen.add((hit, r.verified))
    assert seen == {(False, True), (True, False), (True, True)}  # a null n_chars stays null


def test_small_manifests(make_docs):
    assert merkle.tampering(make_docs([])).count() == 0
    one = merkle.manifest(make_docs([(1, "x")])).first()
    assert one.leaf == one.subroot == one.root and one.proof == []
