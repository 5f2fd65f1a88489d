"""Repair of conversations: the cheapest edits after which roles follow a grammar.

A conversation should be empty, or an optional system turn and then pairs of a user
and an assistant turn. Each turn is kept (cost 0), given another role (3) or deleted
(4, which blank and duplicate turns must be); turns without text are inserted
anywhere (3); a truncated turn that stays costs 3 more.

A recursive DuckDB query inside hash-partitioned batches finds the edits: each
recursion advances one turn for all conversations of the batch and keeps the least
cost and audit for each state of the grammar. Only a letter a turn enters it.
Long conversations are cut into segments of ``SEGMENT`` turns, walked from every
state; the same query then joins segments, ``SEGMENT`` at a time. So no batch grows
with a conversation. Audits of one cost are compared as texts, and none of them is
the head of another (its letters fix its cost), so the least audit has least parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import lean_batches, numbered, written

#: Turns, or segments, that a recursion walks in one unit.
SEGMENT = 64
#: Steps that one DuckDB query takes at most, but for the unit that it ends with.
BATCH = 20_000
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing yet, after the system's turn, after a user's turn, after an assistant's turn.
START, SYSTEM, USER, ASSISTANT = range(4)
GRAMMAR = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: What ends a conversation from each state: cost and audit.
ENDINGS = {START: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}
_SPACE = r"\x20\x09-\x0D"


def _inserted(state: int) -> list[tuple[int, int, str]]:
    """(state, cost, audit) after no, one or two inserted turns; more come back to a state at a higher cost."""
    out = [(state, 0, "")]
    while len(out) < 3:
        at, cost, audit = out[-1]
        out.append((GRAMMAR[at, "a" if at == USER else "u"], cost + INSERT, audit + "I"))
    return out


def moves() -> list[tuple[str, int, int, int, str]]:
    """(letter, state before, state after, cost, audit) of a turn with the turns inserted before it.

    Letters: ``x`` for a turn that must go, else ``s``, ``u``, ``a`` by the role's
    initial or ``o`` for another, as capitals if the turn is truncated.
    """
    best: dict[tuple[str, int, int], tuple[int, str]] = {}
    for letter in "xsuaoSUAO":
        more = TRUNCATED if letter.isupper() else 0
        for state in range(4):
            for at, cost, audit in _inserted(state):
                ways = [(at, DELETE, "D")]
                if letter != "x":
                    ways += [(GRAMMAR.get((at, letter.lower())), KEEP + more, "K")]
                    ways += [(GRAMMAR.get((at, role)), REROLE + more, "R") for role in "ua"]
                for to, price, sign in ways:
                    if to is not None:
                        k, v = (letter, state, to), (cost + price, audit + sign)
                        best[k] = min(best.get(k, v), v)
    return [(*k, *v) for k, v in best.items()]


_WALK = """
WITH RECURSIVE walk AS (
  SELECT unit, state AS origin, state, 0::BIGINT AS k, 0::BIGINT AS cost, '' AS audit FROM units, range(4) s(state) WHERE state = 0 OR NOT opening
  UNION ALL
  SELECT unit, origin, state, k, best.cost, best.audit FROM (
    SELECT w.unit, w.origin, s.after AS state, w.k + 1 AS k, min({'cost': w.cost + s.cost, 'audit': w.audit || s.audit}) AS best
    FROM walk w JOIN steps s ON s.unit = w.unit AND s.step = w.k AND s.before = w.state GROUP BY ALL)
)
SELECT u.name, u.part, origin, state, cost, audit FROM walk w JOIN units u ON w.unit = u.unit AND w.k = u.steps
"""


def _walked(steps: str, found: list[tuple]):
    """Rows of ``_WALK`` over units of (name, part, ...); ``steps`` is a query over the table ``given``."""
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
    try:
        columns = list(zip(*found, strict=True))
        given = {"unit": pa.array(range(len(found)), pa.int64()), "name": pa.array(columns[0], pa.string()), "part": pa.array(columns[1], pa.int64()), "body": pa.array(columns[2])}
        con.register("given", pa.table(given))
        con.execute("CREATE TABLE moves (letter VARCHAR, before BIGINT, after BIGINT, cost BIGINT, audit VARCHAR)")
        con.executemany("INSERT INTO moves VALUES (?, ?, ?, ?, ?)", moves())
        con.execute(f"CREATE TABLE steps AS {steps}")
        con.execute("CREATE TABLE units AS SELECT unit, name, part, part = 0 AS opening, count(DISTINCT step) AS steps FROM given JOIN steps USING (unit) GROUP BY ALL")
        out = con.execute(_WALK).fetchall()
    finally:
        con.close()
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, _TYPES, strict=True)], names=["name", "part", "origin", "state", "cost", "audit"])


_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
_WALKS = "name string, part long, origin long, state long, cost long, audit string"
#: A letter a turn.
_TURNS = "SELECT t.unit, t.step, m.before, m.after, m.cost, m.audit FROM (SELECT unit, unnest(range(length(body))) AS step, unnest(string_split(body, '')) AS letter FROM given) t JOIN moves m USING (letter)"
#: A list of walks a unit, each with its segment's place.
_SEGMENTS = "SELECT unit, b.step, b.origin AS before, b.state AS after, b.cost, b.audit FROM (SELECT unit, unnest(body) AS b FROM given)"


def _batches(steps: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("name", "part", "body")), strict=True):
                found.append(row)
                size += len(row[2])
                if size >= BATCH:
                    yield _walked(steps, found)
                    found, size = [], 0
        if found:
            yield _walked(steps, found)

    return run


def _text(value: str) -> Column:
    return F.coalesce(F.col(value).cast("string"), F.lit(" "))


def _turns(conversations: DataFrame) -> DataFrame:
    """(name, turn, role, text, digest): nulls in texts are one space; the digest tells role and text apart."""
    t = conversations.select(_name().alias("name"), F.col("turn").cast("long").alias("turn"), _text("role").alias("role"), _text("text").alias("text"))
    return t.withColumn("digest", F.unhex(F.sha2(F.concat_ws(":", F.octet_length("role").cast("string"), "role", "text").cast("binary"), 256)))


def _name() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))


def edits(conversations: DataFrame) -> DataFrame:
    """A row a conversation: ``name, gaps, blank, duplicate, truncated, illegal, cost, audit``.

    ``name`` is ``=`` and the id, or empty for null. Turns are taken by number,
    nulls first, and those of one number by role and by a digest of role and text.
    Texts of white space only are blank, also null and empty ones; a role of null is
    a space, which no grammar has; further columns are ignored; no rows give none.
    """
    t = _turns(conversations)
    t = t.select("name", "turn", "role", "digest", (~F.col("text").rlike(f"[^{_SPACE}]")).alias("blank"), F.col("text").rlike(rf"[.!?][{_SPACE}]*\z").alias("ended"))
    t = written(numbered(t, "name", F.asc_nulls_first("turn"), "role", "digest"), "turns")
    first = t.groupBy("name", "digest").agg(F.min("pos").alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    t = t.join(first, ["name", "digest"], "left").withColumn("again", ~F.col("blank") & F.coalesce(F.col("pos") > F.col("first"), F.lit(False)))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    letter = F.when(F.col("blank") | F.col("again"), "x").when(F.col("ended"), kind).otherwise(F.upper(kind))
    # A segment also gets the last turn of the one before, to look at each turn beside its neighbour.
    part = F.floor(F.col("pos") / SEGMENT)
    last = (F.pmod("pos", F.lit(SEGMENT)) == SEGMENT - 1) & (F.col("pos") + 1 < F.col("total"))
    t = t.select("name", F.explode(F.when(last, F.array(part, part + 1)).otherwise(F.array(part))).alias("part"), part.alias("home"), F.struct("pos", "turn", initial.alias("initial"), letter.alias("letter"), "blank", "again").alias("x"))
    own = F.col("part") == F.col("home")
    count = lambda c: F.sum((own & c).cast("long"))
    fault = F.col("x.letter")
    segments = t.groupBy("name", "part").agg(
        F.array_sort(F.collect_list("x")).alias("x"),
        count(F.col("x.blank")).alias("blank"),
        count(F.col("x.again")).alias("duplicate"),
        count((fault != "x") & (fault == F.upper(fault))).alias("truncated"),
        F.min("x.turn").alias("low"),
        F.max("x.turn").alias("high"),
    )
    n = F.size("x")
    beside = F.zip_with(F.slice("x", 1, n - 1), F.slice("x", 2, n - 1), lambda a, b: F.struct(F.concat(a.initial, b.initial).alias("pair"), (b.turn.isNotNull() & ~a.turn.eqNullSafe(b.turn)).alias("next")))
    segments = segments.withColumn("beside", beside).select(
        "name", "part", "blank", "duplicate", "truncated", "low", "high",
        F.size(F.filter("beside", lambda p: ~p.pair.isin("su", "ua", "au"))).cast("long").alias("illegal"),
        (F.size(F.filter("beside", lambda p: p.next)) + F.when((F.col("part") == 0) & F.col("x")[0].turn.isNotNull(), 1).otherwise(0)).alias("turns"),
        F.array_join(F.transform(F.filter("x", lambda e: e.pos >= F.col("part") * SEGMENT), lambda e: e.letter), "").alias("body"),
    )
    segments = written(segments, "segments")
    gaps = F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns"), F.lit(0))
    counts = segments.groupBy("name").agg(gaps.alias("gaps"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")))

    walks = written(segments.select("name", "part", "body").mapInArrow(_batches(_TURNS), _WALKS), "walks")
    while not walks.where("part > 0").isEmpty():
        step = F.struct(F.pmod("part", F.lit(SEGMENT)).alias("step"), "origin", "state", "cost", "audit")
        units = walks.groupBy("name", F.floor(F.col("part") / SEGMENT).alias("part")).agg(F.collect_list(step).alias("body"))
        walks = written(units.mapInArrow(_batches(_SEGMENTS), _WALKS), "walks")
    ends = F.create_map(*(F.lit(x) for s, e in ENDINGS.items() for x in (s, e[0]))), F.create_map(*(F.lit(x) for s, e in ENDINGS.items() for x in (s, e[1])))
    state = F.col("state").cast("int")
    best = walks.groupBy("name").agg(F.min(F.struct((F.col("cost") + ends[0][state]).alias("cost"), F.concat("audit", ends[1][state]).alias("audit"))).alias("best"))
    return counts.join(best.select("name", "best.cost", "best.audit"), "name")


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Repair:
    """Turns of one conversation as they come, with its edits."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.place = audit, 0, 0
        self.system = (len(audit) - audit.count("D")) % 2  # an odd number of turns begins with the system's

    def _role(self, own: str) -> str:
        place, self.place = self.place, self.place + 1
        return own if self.system and not place else ("user", "assistant")[(place - self.system) % 2]

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._role(""), ""

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        sign, self.at = self.audit[self.at], self.at + 1
        if sign != "D":
            given = self._role(role)
            yield role if sign == "K" else given, text


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """("begin", row of counts), ("turn", (role, text)) and ("end", None) of each conversation in turn."""
    now = None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("name", "opening", "role", "text", *_COUNTS)]
        for name, opening, role, text, *counts in zip(*columns, strict=True):
            if opening:
                if now:
                    yield from (("turn", t) for t in now.inserted())
                    yield "end", None
                now = _Repair(text)
                yield "begin", (name, text, *counts)
            else:
                yield from (("turn", t) for t in now.turn(role, text))
    if now:
        yield from (("turn", t) for t in now.inserted())
        yield "end", None


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for what, value in _stream(batches):
        if what == "begin":
            row, digest, first = value, hashlib.sha256(), True
        elif what == "turn":
            digest.update(("" if first else "\n").encode() + f"{value[0]}:{value[1]}".encode())
            first = False
        else:
            rows.append((*row, digest.hexdigest()))
            if len(rows) >= 4096:
                yield _record(rows, _DIGESTS)
                rows = []
    if rows:
        yield _record(rows, _DIGESTS)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for what, value in _stream(batches):
        if what == "begin":
            name, place = value[0], 0
        elif what == "turn":
            rows.append((name, place, *value))
            place, size = place + 1, size + len(value[1])
            if size >= 1 << 20 or len(rows) >= 4096:
                yield _record(rows, _REPAIRED)
                rows, size = [], 0
    if rows:
        yield _record(rows, _REPAIRED)


_DIGESTS = {"name": pa.string(), "audit": pa.string(), **dict.fromkeys(_COUNTS, pa.int64()), "repaired_sha256": pa.string()}
_REPAIRED = {"name": pa.string(), "place": pa.int64(), "role": pa.string(), "text": pa.string()}


def _record(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


def _applied(conversations: DataFrame, names: DataFrame, run, kinds: dict[str, pa.DataType]) -> DataFrame:
    """``run`` over each conversation's edits and then its turns, streamed in order."""
    plan = names.join(edits(conversations), "name", "left").select(
        "name", F.lit(True).alias("opening"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("digest"), F.coalesce("audit", F.lit("")).alias("text"), *(F.coalesce(c, F.lit(0)).alias(c) for c in _COUNTS)
    )
    none = [F.lit(None).cast("long").alias(c) for c in _COUNTS]
    both = plan.unionByName(_turns(conversations).select("name", F.lit(False).alias("opening"), "turn", "role", "digest", "text", *none))
    schema = ", ".join(f"{c} {'long' if t == pa.int64() else 'string'}" for c, t in kinds.items())
    laid = both.repartition("name").sortWithinPartitions("name", F.desc("opening"), F.asc_nulls_first("turn"), "role", "digest")
    return laid.mapInArrow(run, schema)


def _named(out: DataFrame, like: DataFrame) -> DataFrame:
    name = F.col("name")
    conv_id = F.when(name != "", F.substring(name, F.lit(2), F.length(name))).cast(like.schema["conv_id"].dataType)
    return out.select(conv_id.alias("conv_id"), *(c for c in out.columns if c != "name"))


def repair(conversations: DataFrame) -> DataFrame:
    """The repaired turns: ``conv_id, place, role, text``, places from 0.

    Turns are as :func:`edits` takes them. A conversation's turns are one stream in
    one task, with one turn and the audit in memory; conversations that keep no
    turn have no row.
    """
    lean_batches(conversations.sparkSession)
    names = conversations.select(_name().alias("name")).distinct()
    return _named(_applied(conversations, names, _repaired, _REPAIRED), conversations)


def summary(conversations: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """A row a conversation: the columns of :func:`edits` and the digest of the repaired turns.

    ``names`` (with ``conv_id``) adds conversations that have no turn left: no faults,
    no edits, the digest of an empty text. A digest is a sequence by nature, so one
    conversation's texts pass through one task, as a stream.
    """
    lean_batches(conversations.sparkSession)
    names = (names if names is not None else conversations).select(_name().alias("name")).distinct()
    out = _named(_applied(conversations, names, _digests, _DIGESTS), conversations)
    return out.select("conv_id", *_COUNTS[:-1], "cost", "audit", "repaired_sha256")


def damaged(conversations: DataFrame, modulus: int = 20) -> DataFrame:
    """Faults by the crc32 of ``conv_id:turn`` modulo ``modulus``: 0 drops a turn, 1 empties it, 2 removes its ``.!?``, 3 repeats it, 4 makes it the user's."""
    key = F.concat_ws(":", _text("conv_id"), _text("turn"))
    t = conversations.select("conv_id", "turn", _text("role").alias("role"), _text("text").alias("text"), F.pmod(F.crc32(key.cast("binary")), F.lit(modulus)).alias("fault"))
    t = t.where("fault <> 0").withColumn("text", F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    t = t.withColumn("role", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")))
    return t.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")
