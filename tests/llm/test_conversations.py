import hashlib
import random
import re
import zlib

import pytest

from matchlens.llm import conversations
from matchlens.llm.queries import QUERIES

EMPTY = hashlib.sha256().hexdigest()
NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}


def damaged(rows):
    found = {}
    for conv, turn, role, text in rows:
        kept = found.setdefault(conv, [])
        role, text = (" " if v is None else v for v in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        kept += [(turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return found


def by_hand(rows):
    """All walks, row by row, with their whole audits and lines; the least per state goes on."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, flaws = set(), []
    for _, role, text in rows:
        letters = re.findall(r"[^\x20\x09-\x0D]", text)
        again = (role, text) in seen
        seen.add((role, text))
        flaws.append((not letters, bool(letters) and again, bool(letters) and not again and letters[-1] not in ".!?"))
    name = lambda state: "user" if state == 2 else "assistant"
    walks = {0: (0, "", ())}
    for (_, role, text), (blank, again, cut) in zip(rows, flaws):
        found = {}
        for state, (cost, audit, lines) in walks.items():
            for _ in range(3):
                options = [(state, cost + 3, audit + "D", lines)]
                if not blank and not again:
                    to = NEXT[state]
                    options.append((to, cost + 2 + cut, audit + "R", (*lines, f"{name(to)}:{text}")))
                    to = {"s": 1, "u": 2, "a": 3}.get(role[:1])
                    if to and (to == 1 and state == 0 or to == 2 and state != 2 or to == 3 and state == 2):
                        options.append((to, cost + cut, audit + "K", (*lines, f"{role}:{text}")))
                for to, *rest in options:
                    found[to] = min(found.get(to, rest), rest)
                state = NEXT[state]
                cost, audit, lines = cost + 2, audit + "I", (*lines, f"{name(state)}:")
        walks = found
    ends = []
    for state, (cost, audit, lines) in walks.items():
        while state in (1, 2):
            state = NEXT[state]
            cost, audit, lines = cost + 2, audit + "I", (*lines, f"{name(state)}:")
        ends.append((cost, audit, lines))
    cost, audit, lines = min(ends)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *(sum(f[k] for f in flaws) for k in range(3)), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def expected(rows):
    return {conv: by_hand(kept) for conv, kept in damaged(rows).items()}


def got(df):
    return {r[0]: tuple(r)[1:] for r in df.select("conv_id", *NAMES).collect()}


def frame(spark, rows):
    ddl = "conv_id long, turn long, role string, text string, chunk string, place string, copy string, audit string, kind string, wanted string"
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x", "x") for r in rows], ddl).repartition(5)


def random_rows(n, seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", None, "", "user", "assistant"]
    texts = ["a.", "b", "c!", "", None, "x. ", "y?\n", "\t", "é。"]
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(0, 40)):
            text = rng.choice(texts) if rng.random() < 0.5 else f"t{rng.random()}{rng.choice(['.', ''])}"
            rows.append((conv if conv > 3 else None, rng.choice([turn, turn, turn, None, 0]), rng.choice(roles), text))
    return rows


@pytest.mark.parametrize("chunk_rows", [1, 7, 4096])
def test_random_conversations_in_chunks(spark, chunk_rows):
    rows = random_rows(60, chunk_rows)
    given = frame(spark, rows)
    assert got(conversations.repair_all(conversations.damage(given), given, chunk_rows)) == expected(rows)


def test_one_conversation_that_holds_nearly_all_rows(spark):
    rng = random.Random(3)
    rows = [(9, t % 900, rng.choice(["user", "assistant", "system"]), f"m{rng.randint(0, 3000)}{rng.choice(['.', ''])}") for t in range(4000)]
    rows += [(k, 0, "user", "Hi.") for k in range(20)]
    given = frame(spark, rows)
    assert got(conversations.repair_all(conversations.damage(given), given, 128)) == expected(rows)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, None, None, None), (2, 0, "user", "long. " * 200_000), (2, 1, "assistant", "yes."), (None, 5, "system", "x."), (3, 0, "Usher", "Hi."), (3, 1, "a", "Ho.")]
    given = frame(spark, rows)
    assert got(conversations.repair_all(conversations.damage(given), given)) == expected(rows)
    assert got(conversations.repair_all(given, given))[3][5:7] == (2, "RK")


def test_without_rows(spark):
    none = frame(spark, [])
    ids = frame(spark, [(1, 0, "user", "x."), (None, 0, "user", "x.")])
    assert conversations.repair_all(none, none).count() == 0
    assert got(conversations.repair_all(none, ids)) == {1: (0, 0, 0, 0, 0, 0, "", EMPTY), None: (0, 0, 0, 0, 0, 0, "", EMPTY)}


@pytest.mark.parametrize("seed", range(4))
def test_halves_give_the_least_audit_of_all(seed):
    """Against every walk written out, on sequences short enough for it."""
    rng = random.Random(seed)
    for _ in range(60):
        codes = bytes(rng.choice([0, 1, 2, 3, 2, 3, 6, 9, 10, 11, 18]) for _ in range(rng.randint(1, 6)))
        walks = [(0, "", 0)]
        for c in codes:
            walks = [(cost + p[0], audit + p[1], to) for cost, audit, s in walks for to, p in enumerate(conversations.row_step(c)[s]) if p]
        cost, audit = min((cost + 2 * len(e := conversations.ENDING[s]), audit + e) for cost, audit, s in walks)
        steps = [conversations.row_step(c) for c in codes]
        total, left = conversations.ending(steps)
        assert (total, conversations.edits_between(codes, 0, left) + conversations.ENDING[left]) == (cost, audit)


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(QUERIES["op12_hirschberg_repair"](spark, sf)) == expected(rows)
