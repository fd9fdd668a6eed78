"""Repair of conversation structure with the fewest edits, in linear space.

A conversation is right when its roles' initials read ``(s?(ua)+)?``. Reading them is a walk over four
states: nothing yet, after ``s``, after ``u``, after ``a``. A row's edits are a word of inserts and then
one of Delete, Keep, Rerole, so words of rows are never the beginning of one another, and audits compare
word by word. An insert or rerole has only one legal role in each state, so an audit tells everything.

Hirschberg's method finds the audit: costs from the entry forward and from the exit backward, four
numbers each, meet in the middle. Of the states on cheapest walks the one with the ASCII-least audit up
to there is crossed, for which the forward pass also keeps the order of its four audits; both halves
are then solved alike. Nothing but vectors and the states found is kept.

The same goes for whole chunks of rows. A chunk is summed up by its costs and audit order from each state
to each state; chunks of one conversation are solved by these first, and then every chunk by itself, in
parallel, from its entry to its exit. So a conversation that holds a third of all rows is spread over
tasks. Only its SHA-256 has to read its rows in order: one task streams them, holding one batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlens.llm.common import stored

#: Rows of a chunk at most.
CHUNK_ROWS = 4096

# Costs of the edits, the roles they give, and what undeleted truncated rows add.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
NAMES = {2: "user", 3: "assistant"}
# States: 0 nothing yet, 1 after s, 2 after u, 3 after a. The state after the user or assistant that may follow,
# and per initial (1 s, 2 u, 3 a) the states it may follow.
FOLLOWING = (2, 2, 3, 2)
MAY_FOLLOW = {0: (), 1: (0,), 2: (0, 1, 3), 3: (2,)}
# Inserts that end a conversation left in a state.
ENDING = ("", "II", "I", "")
# Bits of a row's code beside its initial.
BLANK, CUT_SHORT, AGAIN = 4, 8, 16
BEYOND = 1 << 60

#: From each state to each state the cost and the edits (or their order among those from the same state).
Step = tuple[tuple[tuple[int, object] | None, ...], ...]


@lru_cache(None)
def row_step(code: int) -> Step:
    """What a row of this code costs between two states, with the least word of edits."""
    table: list[tuple] = []
    for entry in range(4):
        best: list[tuple[int, str] | None] = [None] * 4
        state = entry
        for inserts in range(3):
            cost, word = INSERT * inserts, "I" * inserts
            options = [(state, cost + DELETE, word + "D")]
            if not code & (BLANK | AGAIN):
                flaw = TRUNCATED if code & CUT_SHORT else 0
                options.append((FOLLOWING[state], cost + REROLE + flaw, word + "R"))
                if state in MAY_FOLLOW[code & 3]:
                    options.append((code & 3, cost + flaw, word + "K"))
            for to, total, edits in options:
                if best[to] is None or (total, edits) < best[to]:
                    best[to] = (total, edits)
            state = FOLLOWING[state]
        table.append(tuple(best))
    return tuple(table)


def forward(steps: Sequence[Step], entry: int, first: int, last: int) -> list[tuple[int, int] | None]:
    """Per state the least cost from ``entry`` over ``steps[first:last]``, and the place of its least
    audit among the four."""
    vector: list[tuple[int, int] | None] = [None] * 4
    vector[entry] = (0, 0)
    for i in range(first, last):
        step = steps[i]
        found: list[tuple | None] = [None] * 4
        for state, before in enumerate(vector):
            if before is None:
                continue
            cost, rank = before
            for to, part in enumerate(step[state]):
                if part is not None:
                    one = (cost + part[0], rank, part[1])
                    if found[to] is None or one < found[to]:
                        found[to] = one
        order = sorted(((f[1:], to) for to, f in enumerate(found) if f is not None))
        for to in range(4):
            vector[to] = None
        for rank, (_, to) in enumerate(order):
            vector[to] = (found[to][0], rank)
    return vector


def backward(steps: Sequence[Step], exit_state: int, first: int, last: int) -> list[int]:
    """Per state the least cost over ``steps[first:last]`` to ``exit_state``."""
    vector = [BEYOND] * 4
    vector[exit_state] = 0
    for i in range(last - 1, first - 1, -1):
        vector = [min((p[0] + vector[to] for to, p in enumerate(row) if p is not None), default=BEYOND) for row in steps[i]]
    return vector


def crossings(steps: Sequence[Step], entry: int, exit_state: int) -> list[int]:
    """The states after each step on the cheapest, then audit-least, walk from ``entry`` to ``exit_state``."""
    found = [exit_state] * len(steps)
    halves = [(0, len(steps), entry, exit_state)]
    while halves:
        first, last, a, b = halves.pop()
        if last - first < 2:
            continue
        middle = (first + last) // 2
        ahead, behind = forward(steps, a, first, middle), backward(steps, b, middle, last)
        crossed = min((v[0] + behind[s], v[1], s) for s, v in enumerate(ahead) if v is not None)[2]
        found[middle - 1] = crossed
        halves += [(first, middle, a, crossed), (middle, last, crossed, b)]
    return found


def edits_between(codes: bytes, entry: int, exit_state: int) -> str:
    steps = [row_step(c) for c in codes]
    states = crossings(steps, entry, exit_state)
    return "".join(step[a][b][1] for step, a, b in zip(steps, [entry, *states], states))


def summary(codes: bytes) -> list[int]:
    """A chunk as one step: from each state to each state cost and order, -1 where there is no way."""
    steps = [row_step(c) for c in codes]
    return [x for entry in range(4) for v in forward(steps, entry, 0, len(steps)) for x in (v or (-1, -1))]


def as_step(summed: list[int]) -> Step:
    parts = [None if summed[i] < 0 else (summed[i], summed[i + 1]) for i in range(0, 32, 2)]
    return tuple(tuple(parts[i : i + 4]) for i in range(0, 16, 4))


def ending(steps: Sequence[Step]) -> tuple[int, int]:
    """Cost of the whole conversation and the state its last row leaves."""
    vector = forward(steps, 0, 0, len(steps))
    return min((v[0] + INSERT * len(ENDING[s]), v[1], s) for s, v in enumerate(vector) if v is not None)[::2]


#: Codes up to which results are kept: many conversations share the short ones.
SHORT = 32


@lru_cache(1 << 14)
def edits_of_short(codes: bytes, entry: int, exit_state: int) -> str:
    return edits_between(codes, entry, exit_state)


@lru_cache(1 << 14)
def summary_of_short(codes: bytes) -> list[int]:
    return summary(codes)


# ---------------------------------------------------------------- Spark


def damage(rows: DataFrame) -> DataFrame:
    """The contract's faults by ``crc32(conv_id:turn) % 20``; nulls count as one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    given = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        said("role").alias("role"),
        said("text").alias("text"),
        (F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20).alias("fault"),
    ).filter("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return given.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def _code() -> Column:
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    whole = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    return role + F.when(blank, BLANK).otherwise(0) + F.when(whole, 0).otherwise(CUT_SHORT)


ROW = "conv_id long, chunk long, at int, turn long, letters binary, digest string, code int"


def _placed(rows: DataFrame, chunk_rows: int) -> DataFrame:
    """Every row's chunk and place in it, in order of turn (null first), role and text; stored, without texts."""
    # Rows alike in everything may be many: their place in the input parts them between ranges.
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")] + [F.asc("place")]
    given = rows.select("*", F.monotonically_increasing_id().alias("place"))
    slim = given.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", "turn", F.substring("role", 1, 1).cast("binary").alias("letters"), F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")).alias("digest"), _code().alias("code")
    )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = (TaskContext.get().partitionId() << 33) - 1
        last, at = (), 0
        for b in batches:
            chunks, places = [], []
            for conv in b.column(0).to_pylist():
                if (conv,) != last or at == chunk_rows:
                    last, at, chunk = (conv,), 0, chunk + 1
                chunks.append(chunk)
                places.append(at)
                at += 1
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(chunks, pa.int64()), pa.array(places, pa.int32()), *b.columns[1:]], names=[c.split()[0] for c in ROW.split(", ")])

    return stored(slim.mapInArrow(number, ROW), "conversation-rows")


CHUNK = (
    "conv_id long, chunk long, codes binary, step array<long>, n_blank long, n_again long, n_cut long, n_illegal long,"
    " first_letter binary, last_letter binary, first_turn long, last_turn long, least_turn long, n_turns long"
)
LEGAL = {(b"s", b"u"), (b"u", b"a"), (b"a", b"u")}


def _chunk_row(conv: int | None, chunk: int, rows: list[tuple], firsts: set[int]) -> tuple:
    """``rows`` are (at, turn, letter, code) in order."""
    codes = bytes(code if at in firsts else code | AGAIN for at, _, _, code in rows)
    turns = [t for _, t, _, _ in rows if t is not None]
    letters = [x for _, _, x, _ in rows]
    blank = sum(1 for c in codes if c & BLANK)
    again = sum(1 for c in codes if c & AGAIN and not c & BLANK)
    cut = sum(1 for c in codes if c & CUT_SHORT and not c & (BLANK | AGAIN))
    illegal = sum(1 for pair in zip(letters, letters[1:]) if pair not in LEGAL)
    step = summary_of_short(codes) if len(codes) <= SHORT else summary(codes)
    return (conv, chunk, codes, step, blank, again, cut, illegal, letters[0], letters[-1], rows[0][1], rows[-1][1], min(turns, default=None), len(set(turns)))


def _record(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split() for f in ddl.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal first ``keys`` columns, over the bounds of batches; for bounded runs."""
    key, run = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[:keys] != key:
                if run:
                    yield key, run
                key, run = row[:keys], []
            run.append(row)
    if run:
        yield key, run


def _in_batches(rows: Iterator[tuple], ddl: str, size: int = 2000) -> Iterator[pa.RecordBatch]:
    pending: list[tuple] = []
    for row in rows:
        pending.append(row)
        if len(pending) == size:
            yield _record(pending, ddl)
            pending = []
    yield _record(pending, ddl)


def _chunks(placed: DataFrame) -> DataFrame:
    """One stored row per chunk: its rows' codes, duplicates known, and the chunk as one step."""
    first = placed.groupBy("conv_id", "digest").agg(F.min(F.struct("chunk", "at")).alias("f"))
    null = lambda c, kind: F.lit(None).cast(kind).alias(c)
    marks = first.select("f.chunk", "conv_id", "f.at", F.lit(0).alias("kind"), null("turn", "long"), null("letters", "binary"), null("code", "int"))
    both = marks.union(placed.select("chunk", "conv_id", "at", F.lit(1).alias("kind"), "turn", "letters", "code"))
    dealt = both.repartition("chunk").sortWithinPartitions("chunk", "kind", "at")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for (chunk, conv), run in _groups(batches, 2):
                firsts = {r[2] for r in run if r[3] == 0}
                yield _chunk_row(conv, chunk, [(r[2], *r[4:]) for r in run if r[3] == 1], firsts)

        return _in_batches(rows(), CHUNK)

    return stored(dealt.mapInArrow(build, CHUNK), "conversation-chunks")


WAY = "conv_id long, chunk long, entry int, leave int, ending string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _ways(chunks: DataFrame) -> DataFrame:
    """Per chunk its entry and exit state; with the last chunk the conversation's figures.

    A conversation's chunks meet here, not its rows: a row in ``CHUNK_ROWS``.
    """
    slim = chunks.drop("codes").repartition("conv_id").sortWithinPartitions("conv_id", "chunk")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for (conv,), run in _groups(batches, 1):
                steps = [as_step(r[2]) for r in run]
                cost, left = ending(steps)
                states = crossings(steps, 0, left)
                blank, again, cut, illegal = (sum(r[k] for r in run) for k in range(3, 7))
                illegal += sum(1 for a, b in zip(run, run[1:]) if (a[8], b[7]) not in LEGAL)
                n_turns = sum(r[12] for r in run) - sum(1 for a, b in zip(run, run[1:]) if a[10] is not None and a[10] == b[9])
                least = [r[11] for r in run if r[11] is not None]
                gaps = run[-1][10] - min(least) + 1 - n_turns if least else 0
                for i, r in enumerate(run):
                    whole = (ENDING[left], gaps, blank, again, cut, illegal, cost) if i == len(run) - 1 else (None,) * 7
                    yield (conv, r[1], 0 if i == 0 else states[i - 1], states[i], *whole)

        return _in_batches(rows(), WAY)

    return slim.mapInArrow(solve, WAY)


EDITED = "conv_id long, chunk long, edits string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
REPAIRED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _edited(chunks: DataFrame, ways: DataFrame) -> DataFrame:
    """Every chunk's edits, each chunk by itself."""
    given = chunks.select("chunk", "codes").join(ways, "chunk").select("codes", "entry", "leave", "ending", "conv_id", "chunk", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for codes, entry, leave, end, conv, chunk, *figures in zip(*(c.to_pylist() for c in b.columns)):
                    solve = edits_of_short if len(codes) <= SHORT else edits_between
                    yield (conv, chunk, solve(codes, entry, leave) + (end or ""), *figures)

        return _in_batches(rows(), EDITED)

    return given.mapInArrow(build, EDITED)


class _Written:
    """The SHA-256 of a conversation's repaired lines, fed row by row along its audit."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.lines = audit, 0, 0, 0
        self.digest = hashlib.sha256()

    def _line(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
        self.lines += 1

    def inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.state = FOLLOWING[self.state]
            self._line(NAMES[self.state], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = {"s": 1, "u": 2, "a": 3}[role[0]]
            self._line(role, text)
        elif edit == "R":
            self.state = FOLLOWING[self.state]
            self._line(NAMES[self.state], text)


def repair(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per ``conv_id`` that has rows: ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``,
    ``audit`` and ``repaired_sha256``.

    ``rows`` has ``conv_id``, ``turn``, ``role`` and ``text``; other columns are not looked at. Rows are
    taken by turn (null first), then role and text by code point; rows alike in all three can change
    places without changing the result. Null roles and texts are one space. Rows without a ``conv_id`` are
    one conversation. An empty table gives no rows. Texts are shuffled twice: into order, and to their
    conversation's digest.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    given = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said("role"), said("text"))
    chunks = _chunks(_placed(given, chunk_rows))
    edited = stored(_edited(chunks, _ways(chunks)), "conversation-edits")
    names = [c.split()[0] for c in EDITED.split(", ")][2:]
    kinds = dict(c.split() for c in EDITED.split(", "))
    null = lambda c, kind: F.lit(None).cast(kind).alias(c)
    lines = given.select("conv_id", F.lit(1).alias("kind"), null("chunk", "long"), "turn", "role", "text", *[null(n, kinds[n]) for n in names])
    heads = edited.select("conv_id", F.lit(0).alias("kind"), "chunk", null("turn", "long"), null("role", "string"), null("text", "string"), *names)
    met = heads.union(lines).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "chunk", "turn", "role", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(conv, figures, written) -> tuple:
            written.inserts()
            return (conv, *figures, written.audit, written.digest.hexdigest())

        def out() -> Iterator[tuple]:
            key, parts, figures, written = (), [], (), None
            for b in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
                for conv, kind, _, _, role, text, edits, *found in zip(*(c.to_pylist() for c in b.columns)):
                    if (conv,) != key:
                        if written:
                            yield done(key[0], figures, written)
                        key, parts, written = (conv,), [], None
                    if kind == 0:
                        parts.append(edits)
                        figures = found
                        continue
                    if written is None:
                        written = _Written("".join(parts))
                    written.row(role, text)
            if written:
                yield done(key[0], figures, written)

        return _in_batches(out(), REPAIRED)

    return met.mapInArrow(write, REPAIRED)


def repair_all(rows: DataFrame, ids: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """:func:`repair` for every ``conv_id`` of ``ids``: those without rows have zeros and an empty audit."""
    wanted = ids.select(F.col("conv_id").cast("long").alias("wanted")).distinct()
    found = repair(rows, chunk_rows)
    joined = wanted.join(found, F.col("wanted").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(
        F.col("wanted").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256")
    )
