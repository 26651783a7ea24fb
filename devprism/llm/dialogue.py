"""Repair of conversation structure by a rank-convergence parallel Viterbi search.

A conversation is repaired by edits of its rows: keep (0), change the role (1), delete (2), insert a row
without text (5); an unfinished row that stays costs 5 more. The cheapest edits whose role initials read
``(s?(ua)+)?`` are a shortest path through four states: nothing yet, after ``s``, after ``u``, after ``a``.

Long conversations are cut into chunks that are solved at the same time. Backward, every chunk starts from a
speculative vector of costs, that of a conversation's end. Its result is right once the vector at its end and
the one that the next chunk finds at its start differ by a constant only. Fix-up passes rerun the chunks for
which they do not, and only from their end to the first row where the new and the old vector agree up to a
constant. Vectors meet soon, since one deletion or insertion changes the phase of all that follows.

Forward, each chunk traces the least audit from every state it may be entered in, along the backward costs;
chaining the ends of these traces tells the state each chunk is entered in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from devprism.llm.common import pick
from devprism.runtime import land

Vector = tuple[int, int, int, int]
#: Costs of the edits.
RETYPE, DELETE, INSERT, UNFINISHED = 1, 2, 5, 5
#: States 0 nothing yet, 1 after s, 2 after u, 3 after a; the role each state goes on with.
FOLLOWS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ADDED = ("u", "u", "a", "u")
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
#: Costs behind the last row: nothing and a finished pair may end, the others need insertions.
END: Vector = (0, 10, 5, 0)
BLANK = r"\A[\x20\x09-\x0D]*\z"
FINISHED = r"[.!?][\x20\x09-\x0D]*\z"


@dataclass(frozen=True)
class Settings:
    #: Rows and characters of text in one chunk, at most (one row may be longer).
    rows: int = 4096
    chars: int = 1_000_000
    #: Characters of a text that may decide in which range of rows it is sorted.
    key_chars: int = 64


# --- one row -----------------------------------------------------------------------------------------
# Kinds of rows: the role's initial if it is s, u or a, else o; upper case if unfinished; x if it has to go.


def _rebased(v: Vector) -> tuple[Vector, int]:
    least = min(v)
    return tuple(c - least for c in v), least


@cache
def _edits(after: Vector, kind: str) -> tuple[Vector, tuple]:
    """Costs before a row, and per state the least edit: ``(letter, written initial or None, next state)``."""
    options: list[list[tuple[int, str, str | None, int]]] = []
    for state, follows in enumerate(FOLLOWS):
        found = [(DELETE + after[state], "D", None, state)]
        if kind != "x":
            more, role = (UNFINISHED if kind.isupper() else 0), kind.lower()
            if role in follows:
                found.append((more + after[follows[role]], "K", role, follows[role]))
            added = ADDED[state]
            found.append((RETYPE + more + after[follows[added]], "R", added, follows[added]))
        options.append(found)
    costs = [min(o)[0] for o in options]
    for _ in FOLLOWS:  # insertions before the row, until none helps
        costs = [min(c, INSERT + costs[FOLLOWS[s][ADDED[s]]]) for s, c in enumerate(costs)]
    for state, found in enumerate(options):
        target = FOLLOWS[state][ADDED[state]]
        found.append((INSERT + costs[target], "I", ADDED[state], target))
    best = tuple(min(o[1:] for o in found if o[0] == costs[state]) for state, found in enumerate(options))
    return tuple(costs), best


@cache
def _step(after: Vector, kind: str) -> tuple[Vector, int]:
    return _rebased(_edits(after, kind)[0])


# --- one chunk ---------------------------------------------------------------------------------------


def backward(kinds: str, end: Vector) -> tuple[Vector, int]:
    """Costs before the first row, less their minimum, and that minimum."""
    vector, total = _rebased(end)
    for kind in reversed(kinds):
        vector, more = _step(vector, kind)
        total += more
    return vector, total


def fix_up(kinds: str, used: Vector, start: Vector, total: int, end: Vector) -> tuple[Vector, int, int]:
    """What ``backward`` gives for ``end``, from its result for ``used``; and how many rows were redone.

    Old and new vectors are followed side by side and meet where they differ by a constant.
    """
    (old, was), (new, now) = _rebased(used), _rebased(end)
    for done, kind in enumerate(reversed(kinds)):
        if old == new:
            return start, total + now - was, done
        (old, a), (new, b) = _step(old, kind), _step(new, kind)
        was, now = was + a, now + b
    return new, now, len(kinds)


def vectors(kinds: str, end: Vector) -> list[Vector]:
    """The vector behind each row, in the order of the rows."""
    found = [_rebased(end)[0]]
    for kind in reversed(kinds):
        found.append(_step(found[-1], kind)[0])
    return found[-2::-1] if kinds else []


def trace(kinds: str, behind: list[Vector], state: int, last: bool) -> Iterator[tuple[int, str, str | None, int]]:
    """Edits ``(row, letter, written initial, state after it)`` of the least audit from ``state`` on.

    Letters differ between the edits that are possible at one place, so the least letter that still
    reaches the cheapest cost is the least audit. Behind the last row insertions finish an open pair.
    """
    for row, kind in enumerate(kinds):
        best = _edits(behind[row], kind)[1]
        while True:
            letter, written, state = best[state]
            yield row, letter, written, state
            if letter != "I":
                break
    while last and END[state]:
        written, state = ADDED[state], FOLLOWS[state][ADDED[state]]
        yield len(kinds), "I", written, state


def left_in(kinds: str, behind: list[Vector], last: bool) -> list[int]:
    """Per state in which a chunk may be entered, the state in which its trace leaves it."""
    ends = []
    for state in range(4):
        for *_, state in trace(kinds, behind, state, last):
            pass
        ends.append(state)
    return ends


# --- tables ------------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after damage, chosen by a checksum of ``conv_id:turn``; nulls are written as one space."""
    rows = pick(conversations, conv_id="bigint", turn="bigint", role="string", text="string")
    written = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.withColumn("harm", F.crc32(F.concat(written("conv_id"), F.lit(":"), written("turn"))) % 20)
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace(written("text"), "[.!?]", "")).otherwise(written("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(written("role"))
    n = F.when(F.col("harm") == 3, 2).otherwise(1)
    return rows.filter("harm <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), n.alias("n"))


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("o")


def _lines(rows: DataFrame) -> DataFrame:
    """Different rows with the number of their copies and the kind of the first copy.

    The others of a row's copies stand right behind it and are duplicates. A row is a duplicate itself if its
    role and text (by their digest) have a lower turn in the conversation; only repeated ones travel for that.
    """
    lines = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("copies"))
    lines = land(lines.withColumns({"sign": F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256), "at": F.struct(F.col("turn").isNotNull().alias("set"), "turn")}), "lines")
    said = lines.groupBy("conv_id", "sign").agg(F.min("at").alias("first"), F.count("*").alias("times")).filter("times > 1").drop("times")
    said = said.select(F.col("conv_id").alias("c"), F.col("sign").alias("s"), "first")
    both = lines.join(land(said, "said"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("sign") == F.col("s")), "left")
    blank = F.col("text").rlike(BLANK)
    fault = F.when(blank, "blank").when(F.col("at") != F.col("first"), "duplicate").when(~F.col("text").rlike(FINISHED), "truncated")
    return both.select("conv_id", "turn", "role", "text", "copies", _initial(F.col("role")).alias("initial"), F.coalesce(fault, F.lit("")).alias("fault"))


CHUNK = (
    "conv_id bigint, part int, place int, kinds string, copies array<bigint>, roles array<string>, texts array<string>, "
    "blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, "
    "turns bigint, low bigint, high bigint, extra bigint, start array<int>, total bigint"
)


class _Chunk:
    """Rows of one conversation in order, while they are read."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.kinds: list[str] = []
        self.copies: list[int] = []
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.chars = self.illegal = self.turns = 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.first = self.last = ""
        self.low = self.high = None

    def add(self, turn, role, text, copies, initial, fault) -> None:
        gone = fault in ("blank", "duplicate")
        self.kinds.append("x" if gone else initial.upper() if fault else initial)
        self.copies.append(copies)
        self.roles.append(role)
        self.texts.append("" if gone else text)
        self.chars += len(text)
        if fault:
            self.faults[fault] += 1
        self.faults["blank" if fault == "blank" else "duplicate"] += copies - 1
        self.illegal += copies - 1 + bool(self.last and self.last + initial not in LEGAL)
        self.first, self.last = self.first or initial, initial
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = (turn if self.low is None else self.low), turn

    def row(self, part: int, place: int) -> tuple:
        kinds = "".join(self.kinds)
        start, total = backward(kinds, END)
        extra = sum(self.copies) - len(self.copies)
        return (
            self.conv_id, part, place, kinds, self.copies, self.roles, self.texts, *self.faults.values(), self.illegal, self.first, self.last,
            self.turns, self.low, self.high, extra, list(start), total,
        )


def _schema(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    kinds |= {f"array<{k}>": pa.list_(v) for k, v in list(kinds.items())}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in ddl.split(", "))])


def _emit(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    schema = _schema(ddl)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _grouped(rows: Iterator[tuple], ddl: str, size: int = 1000, weight=lambda row: 0, heaviest: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Batches of result rows, none with many rows or much text."""
    held: list[tuple] = []
    heavy = 0
    for row in rows:
        held.append(row)
        heavy += weight(row)
        if len(held) >= size or heavy >= heaviest:
            yield _emit(held, ddl)
            held, heavy = [], 0
    if held:
        yield _emit(held, ddl)


def _cut(settings: Settings):
    """Chunks of sorted rows; they are numbered by partition and place, in the order of the rows."""

    def chunks(rows: Iterator[tuple]) -> Iterator[tuple]:
        from pyspark import TaskContext

        part, place, open_chunk = TaskContext.get().partitionId(), 0, None
        for conv_id, *line in rows:
            full = open_chunk is not None and (len(open_chunk.kinds) >= settings.rows or open_chunk.chars >= settings.chars)
            if open_chunk is not None and (full or open_chunk.conv_id != conv_id):
                yield open_chunk.row(part, place)
                open_chunk, place = None, place + 1
            open_chunk = open_chunk or _Chunk(conv_id)
            open_chunk.add(*line)
        if open_chunk is not None:
            yield open_chunk.row(part, place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _grouped(chunks(_records(batches)), CHUNK, weight=lambda row: sum(map(len, row[6])))

    return run


VECTORS = "conv_id bigint, part int, place int, used array<int>, start array<int>, total bigint"


def _fix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for conv_id, part, place, kinds, used, start, total, want in _records(batches):
            new, now, _ = fix_up(kinds, tuple(used), tuple(start), total, tuple(want))
            yield conv_id, part, place, list(want), list(new), now

    yield from _grouped(rows(), VECTORS)


def converged(chunks: DataFrame) -> DataFrame:
    """``(conv_id, part, place, used, start, total)`` with the right vector behind every chunk.

    ``total`` is the cost of a chunk from its end vector's least entry to its start vector's. A pass settles at
    least one more chunk of a conversation, from its end; that all vectors agree is what ends the loop.
    """
    known = chunks.select("conv_id", "part", "place", F.array(*map(F.lit, END)).alias("used"), "start", "total")
    kinds = chunks.select("part", "place", "kinds")
    after = Window.partitionBy("conv_id").orderBy("part", "place")
    while True:
        linked = known.withColumn("want", F.coalesce(F.lead("start").over(after), F.array(*map(F.lit, END))))
        linked = land(linked, "linked")
        stale = linked.filter("want <> used")
        if stale.isEmpty():
            return linked.drop("want")
        redone = stale.join(kinds, ["part", "place"]).select("conv_id", "part", "place", "kinds", "used", "start", "total", "want")
        known = linked.filter("want = used").drop("want").unionByName(redone.mapInArrow(_fix, VECTORS))


ENDS = "part int, place int, ends array<int>"


def _leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for part, place, kinds, used, final in _records(batches):
            yield part, place, left_in(kinds, vectors(kinds, tuple(used)), final)

    yield from _grouped(rows(), ENDS)


COUNTS = ("blank", "duplicate", "truncated", "illegal")
ENTRY = "conv_id bigint, part int, place int, final boolean, entered int, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which each chunk is entered; the last chunk of a conversation carries its counts."""

    def rows():
        state = None
        for conv_id, part, place, final, ends, first, last, turns, low, high, extra, start, total, *counts in _records(batches):
            if state is None:
                state, before, least, most, seen, sums = 0, "", None, None, 0, [0] * len(counts)
                cost = start[0]
            entered, state = state, ends[state]
            sums = [a + b for a, b in zip(sums, counts)]
            sums[-1] += bool(before and before + first not in LEGAL)
            before, cost = last, cost + total + DELETE * extra
            if turns:
                seen += turns - (low == most)
                least, most = (low if least is None else least), high
            gaps = 0 if least is None else most - least + 1 - seen
            yield conv_id, part, place, final, entered, gaps, *sums, cost
            if final:
                state = None

    yield from _grouped(rows(), ENTRY)


WRITTEN = "conv_id bigint, part int, place int, final boolean, audit string, repaired string"


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and repaired rows of each chunk."""

    def rows():
        for conv_id, part, place, kinds, copies, roles, texts, used, final, entered in _records(batches):
            audit, lines = [], []
            for row, letter, written, _ in trace(kinds, vectors(kinds, tuple(used)), entered, final):
                audit.append(letter)
                if letter == "I":
                    lines.append(f"{ROLES[written]}:")
                    continue
                audit.append("D" * (copies[row] - 1))
                if letter != "D":
                    lines.append(f"{roles[row] if letter == 'K' else ROLES[written]}:{texts[row]}")
            yield conv_id, part, place, final, "".join(audit), "\n".join(lines)

    yield from _grouped(rows(), WRITTEN, weight=lambda row: len(row[5]))


DIGEST = "conv_id bigint, audit string, repaired_sha256 string"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of a conversation pass in order; only the digest so far and the audit are held."""

    def rows():
        audit, digest, begun = [], sha256(), False
        for conv_id, _, _, final, letters, repaired in _records(batches):
            audit.append(letters)
            if repaired:
                digest.update(("\n" * begun + repaired).encode("utf-8", "surrogatepass"))
                begun = True
            if final:
                yield conv_id, "".join(audit), digest.hexdigest()
                audit, digest, begun = [], sha256(), False

    yield from _grouped(rows(), DIGEST, weight=lambda row: len(row[1]))


@dataclass(frozen=True)
class Repair:
    """The parts of a repaired table: chunks of rows, and per chunk its vector, entry state and results."""

    chunks: DataFrame
    vectors: DataFrame
    entries: DataFrame
    written: DataFrame


def repair(rows: DataFrame, settings: Settings = Settings()) -> Repair:
    """Repair ``rows(conv_id, turn, role, text, n)``; ``written`` has audit and repaired text chunk by chunk.

    Rows of a conversation stand by turn (nulls first), then role, then text; ``n`` is the number of copies.
    """
    keys = ["conv_id", "turn", "role", F.substring("text", 1, settings.key_chars)]
    lined = _lines(rows).repartitionByRange(*keys).sortWithinPartitions("conv_id", "turn", "role", "text")
    chunks = land(lined.mapInArrow(_cut(settings), CHUNK), "chunks")
    known = converged(chunks)
    behind = F.lead("place").over(Window.partitionBy("conv_id").orderBy("part", "place"))
    known = land(known.withColumn("final", behind.isNull()), "vectors")
    bare = known.join(chunks.select("part", "place", "kinds"), ["part", "place"])
    ends = bare.select("part", "place", "kinds", "used", "final").mapInArrow(_leave, ENDS)
    facts = chunks.select("part", "place", "first", "last", "turns", "low", "high", "extra", *COUNTS)
    steps = known.join(ends, ["part", "place"]).join(facts, ["part", "place"])
    steps = steps.select("conv_id", "part", "place", "final", "ends", "first", "last", "turns", "low", "high", "extra", "start", "total", *COUNTS)
    entries = land(steps.repartition("conv_id").sortWithinPartitions("conv_id", "part", "place").mapInArrow(_chain, ENTRY), "entries")
    whole = chunks.select("part", "place", "kinds", "copies", "roles", "texts").join(known.select("part", "place", "used"), ["part", "place"])
    whole = whole.join(entries.select("conv_id", "part", "place", "final", "entered"), ["part", "place"])
    whole = whole.select("conv_id", "part", "place", "kinds", "copies", "roles", "texts", "used", "final", "entered")
    return Repair(chunks, known, entries, whole.mapInArrow(_write, WRITTEN))


def repair_conversations(conversations: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Damage ``conversations(conv_id, turn, role, text)`` and repair them; one row per original ``conv_id``.

    Gives ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``. Nulls of role and
    text are one space, and so blank or of no known role; rows without ``conv_id`` are one conversation. Repeated
    rows are duplicates of the first. Rows of one turn stand by role and text. An empty table gives no rows, a
    conversation that lost all rows zeros. Other columns are not read.

    The digest of a conversation takes its text in order, so its chunks pass through one task one after the other,
    which holds the audit and no text; all other work on a conversation is spread over its chunks.
    """
    fixed = repair(damaged(conversations), settings)
    order = ["conv_id", "part", "place"]
    digests = fixed.written.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_digest, DIGEST)
    counts = fixed.entries.filter("final").drop("part", "place", "final", "entered").withColumnRenamed("conv_id", "c")
    found = digests.join(counts, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c").withColumnRenamed("conv_id", "c")
    every = pick(conversations, conv_id="bigint").distinct()
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    number = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", *COUNTS, "cost")]
    empty = F.lit(sha256().hexdigest())
    return out.select("conv_id", *number, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
