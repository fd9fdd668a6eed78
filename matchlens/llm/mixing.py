"""Mixing overlapping sources to target weights by a min-cost flow.

Documents are summed up by membership pattern, the set of sources that hold them. Words flow from
patterns to the sources they belong to, up to each source's target; the first use of a pattern's words
is free, each further one costs more than the one before, so repetition is spread where it is least
needed. The flow says how many words each pattern gives. Its documents are ordered by a seeded hash,
and the hash up to which documents are taken once more is found from sums over hash ranges. So the
last step is a filter on every document, with no shuffle of texts.

The driver sees one row per source and one per pattern, a catalogue's size; never documents.
"""

from __future__ import annotations

import json
from collections import deque
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlens.llm.common import WORD, stored, text_of, unused

# Weights of the sources in order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_USES = 2
#: Documents of one pattern that are ordered together when a threshold is found.
ORDERED_TOGETHER = 50_000
#: Above every seeded hash: all documents are taken.
ALL = 1 << 62


class Plan(NamedTuple):
    """Sizes and targets by source (None for null), and per pattern (JSON) the words to take."""

    sizes: dict[str | None, int]
    targets: dict[str | None, float]
    taken: dict[str, int]


def ordered_sources(sources) -> list[str | None]:
    """By code point, null last."""
    return sorted((s for s in sources if s is not None)) + ([None] if None in sources else [])


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = SHARE, most: float = MAX_USES) -> dict[str | None, float]:
    """``share`` of all words by weight; a source stops at ``most`` times its size and what it cannot
    take goes to the others by weight, until none is above."""
    order = ordered_sources(sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    left = share * sum(sizes.values())
    open_ = list(order)
    while open_:
        total = sum(weight[s] for s in open_)
        above = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not above:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in above:
            out[s] = float(most * sizes[s])
            left -= out[s]
            open_.remove(s)
    return out


def min_cost_flow(supply: dict[str, int], quota: dict[str | None, int], uses: int = MAX_USES) -> dict[str, int]:
    """Words each pattern gives, at most ``uses`` times its own; as much of the quotas as can be met,
    at the least cost, where the k-th use of a word costs k - 1.

    Costs only differ between uses, and a path never gains by taking a dearer use of one pattern back
    for a cheaper one of another that is already full, so the uses are opened one after the other and
    the flow is made greatest before the next. Each augmentation moves on to another source through
    patterns that share documents.
    """
    members = {p: json.loads(p) for p in supply}
    holders: dict[str | None, list[str]] = {}
    for p, sources in members.items():
        for s in sources:
            holders.setdefault(s, []).append(p)
    flow = {(p, s): 0 for p, sources in members.items() for s in sources}
    given = dict.fromkeys(supply, 0)
    open_quota = dict(quota)

    for use in range(1, uses + 1):
        limit = {p: use * n for p, n in supply.items()}
        for p in sorted(supply):
            while given[p] < limit[p]:
                # Breadth-first from the pattern to a source with room; back along used edges.
                came: dict[tuple, tuple | None] = {("p", p): None}
                queue, end = deque([("p", p)]), None
                while queue and end is None:
                    kind, at = node = queue.popleft()
                    if kind == "p":
                        steps = [("s", s) for s in members[at]]
                    elif open_quota[at] > 0:
                        end = node
                        break
                    else:
                        steps = [("p", q) for q in holders[at] if flow[q, at] > 0]
                    for step in steps:
                        if step not in came:
                            came[step] = node
                            queue.append(step)
                if end is None:
                    break
                path = [end]
                while came[path[-1]] is not None:
                    path.append(came[path[-1]])
                path.reverse()
                amount = min(limit[p] - given[p], open_quota[end[1]])
                for a, b in zip(path, path[1:]):
                    if a[0] == "s":
                        amount = min(amount, flow[b[1], a[1]])
                for a, b in zip(path, path[1:]):
                    if a[0] == "p":
                        flow[a[1], b[1]] += amount
                    else:
                        flow[b[1], a[1]] -= amount
                given[p] += amount
                open_quota[end[1]] -= amount
    return given


def words_in(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def pattern_of(membership: Column) -> Column:
    """The set of sources as JSON, in order, nulls kept."""
    return F.to_json(F.array_sort(F.array_distinct(membership)))


def seeded(seed: int) -> Column:
    """62 bits that order documents at random and always alike."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64("text")), 2)


def make_plan(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, uses: int = MAX_USES) -> Plan:
    """Targets and flow for ``sized`` (``pattern``, ``size``)."""
    supply = {r["pattern"]: r["n"] for r in sized.groupBy("pattern").agg(F.sum("size").alias("n")).collect()}
    sizes: dict[str | None, int] = {}
    for p, n in supply.items():
        for s in json.loads(p):
            sizes[s] = sizes.get(s, 0) + n
    goal = targets(sizes, weights, share, uses)
    return Plan(sizes, goal, min_cost_flow(supply, {s: round(t) for s, t in goal.items()}, uses))


def thresholds(sized: DataFrame, plan: Plan) -> DataFrame:
    """Per pattern: ``full`` uses of every document, and the ``below`` under which a document's seeded
    hash gives it one more, so that the words taken come nearest the plan.

    Hash ranges are summed first; only the range in which a pattern's threshold lies is ordered.
    """
    spark = sized.sparkSession
    counts = sized.groupBy("pattern").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    rows = []
    bits = max(0, (max((r["n"] for r in counts), default=0) // ORDERED_TOGETHER).bit_length())
    for r in counts:
        words, size = plan.taken[r["pattern"]], r["size"]
        full = words // size if size else 0
        rows.append((r["pattern"], full, words - full * size))
    need = spark.createDataFrame(rows, "pattern string, full long, rest long")
    span = F.shiftright("u", 62 - bits) if bits else F.lit(0).cast("long")
    ranges = sized.withColumn("span", span).groupBy("pattern", "span").agg(F.sum("size").alias("n"))
    upto = Window.partitionBy("pattern").orderBy("span")
    found = (
        ranges.withColumn("upto", F.sum("n").over(upto))
        .join(need, "pattern")
        .filter((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("n") <= F.col("rest")))
        .select("pattern", "span", (F.col("rest") - F.col("upto") + F.col("n")).alias("rest"))
    )
    inside = sized.withColumn("span", span).join(found, ["pattern", "span"]).groupBy("pattern", "u", "rest").agg(F.sum("size").alias("n"))
    run = F.sum("n").over(Window.partitionBy("pattern").orderBy("u"))
    # A hash is taken when that brings the words nearer: when half of its own still fit.
    first_out = inside.withColumn("upto", run).filter(F.col("upto") - F.col("n") / 2 > F.col("rest")).groupBy("pattern").agg(F.min("u").alias("below"))
    # Without a hash that stays out in the range, the range itself is taken whole.
    ends = found.select("pattern", F.shiftleft(F.col("span") + 1, 62 - bits).alias("end")) if bits else found.select("pattern", F.lit(ALL).alias("end"))
    return need.join(first_out, "pattern", "left").join(ends, "pattern", "left").select("pattern", "full", F.when(F.col("rest") == 0, F.lit(0)).otherwise(F.coalesce("below", "end", F.lit(ALL))).cast("long").alias("below"))


#: Patterns up to which the plan is sent to every task: a few megabytes. With more the documents are joined.
PATTERNS_SENT = 50_000


def mix(docs: DataFrame, membership: Column | None = None, seed: int = 17, weights=WEIGHTS, share: float = SHARE, uses: int = MAX_USES) -> tuple[DataFrame, list[str]]:
    """The documents with four more columns, whose names come second: ``size`` (words), the sizes and
    targets of its sources as arrays in pattern order, and ``uses`` (times the mix takes it).

    ``membership`` is an array of the sources that hold a document, by default its ``source`` alone; a
    null source is a source. A null or empty text has size 0 and is taken as often as its hash says,
    which adds no words. Rows alike in ``doc_id`` and text share a hash and are taken alike, so a
    source may miss its target by as much as such a group holds. An empty table gives no rows.
    """
    spark = docs.sparkSession
    own = [unused(docs, n) for n in ("mix_size", "mix_sizes", "mix_targets", "mix_uses")]
    pattern, u, full, below = (unused(docs, n) for n in ("mix_pattern", "mix_hash", "mix_full", "mix_below"))
    membership = F.array("source") if membership is None else membership
    size = words_in(text_of())
    sized = stored(docs.select(pattern_of(membership).alias("pattern"), size.alias("size"), seeded(seed).alias("u")), "sizes")
    plan = make_plan(sized, weights, share, uses)
    limits = thresholds(sized, plan).collect()
    rows = [(r["pattern"], [plan.sizes[s] for s in json.loads(r["pattern"])], [plan.targets[s] for s in json.loads(r["pattern"])], r["full"], r["below"]) for r in limits]
    by_pattern = spark.createDataFrame(rows, f"`{pattern}` string, `{own[1]}` array<long>, `{own[2]}` array<double>, `{full}` long, `{below}` long")
    # The plan came from the driver, so its size is known: up to the bound it is sent to every task, and no text moves.
    by_pattern = F.broadcast(by_pattern) if len(rows) <= PATTERNS_SENT else by_pattern
    joined = docs.withColumns({pattern: pattern_of(membership), u: seeded(seed), own[0]: size}).join(by_pattern, pattern)
    taken = F.col(full) + (F.col(u) < F.col(below)).cast("long")
    return joined.withColumn(own[3], taken).drop(pattern, u, full, below), own


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is used, with the columns of ``docs``."""
    found, (_, _, _, uses) = mix(docs, **options)
    kept = found.filter(F.col(uses) > 0).withColumn(uses, F.explode(F.sequence(F.lit(1).cast("long"), F.col(uses))))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
