"""Targets, flow and selection against plain loops."""

import itertools
import json
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from matchlens.llm import mixing, queries

from .conftest import documents


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets_stop_at_twice_the_size():
    sizes = {"b": 100, "a": 1000, "c": 1000, None: 50}
    got = mixing.targets(sizes)
    assert got["b"] <= 200 and got[None] <= 100
    assert sum(got.values()) == pytest.approx(1.5 * 2150)
    # Weights 3, 1, 2, 3 for a, b, c, null; b and null are full, the rest is shared 3 to 2.
    open_ = [s for s in sizes if got[s] < 2 * sizes[s]]
    assert open_ == ["a", "c"] and got["a"] / got["c"] == pytest.approx(1.5)


def best_cost(supply, quota, uses):
    """Greatest flow and its least cost by trying every integer routing."""
    routes = [(p, s) for p in supply for s in json.loads(p)]
    best = (0, 0)
    for amounts in itertools.product(*[range(min(uses * supply[p], quota[s]) + 1) for p, s in routes]):
        given, got = defaultdict(int), defaultdict(int)
        for (p, s), n in zip(routes, amounts):
            given[p] += n
            got[s] += n
        if all(given[p] <= uses * supply[p] for p in supply) and all(got[s] <= quota[s] for s in quota):
            best = max(best, (sum(amounts), -sum(max(0, given[p] - supply[p]) for p in supply)))
    return best


def test_flow_is_greatest_and_cheapest():
    rng = random.Random(1)
    for _ in range(25):
        supply = {p: rng.randint(0, 3) for p in ('["a"]', '["a","b"]', '["b"]')}
        quota = {"a": rng.randint(0, 5), "b": rng.randint(0, 5)}
        given = mixing.min_cost_flow(supply, quota, 2)
        cost = sum(max(0, given[p] - supply[p]) for p in supply)
        assert (sum(given.values()), -cost) == best_cost(supply, quota, 2)


def check(rows, got, tolerance):
    """Sizes, targets and closeness for documents with one source each."""
    by_source = defaultdict(int)
    for _, source, text in rows:
        by_source[source] += size(text)
    goal = mixing.targets(dict(by_source))
    taken = defaultdict(int)
    assert len(got) == len(rows)
    texts = {(i, s): t for i, s, t in rows}
    for r in got:
        n = size(texts[r.doc_id, r.source])
        assert r.size == n and r.source_size == by_source[r.source]
        assert r.target == pytest.approx(goal[r.source])
        assert r.taken in (0, n, 2 * n)
        taken[r.source] += r.taken
    for s, g in goal.items():
        assert abs(taken[s] - g) <= tolerance[s], (s, taken[s], g)


def named(df, docs):
    """The query's rows with their sources."""
    return df.join(docs.select("doc_id", "source"), "doc_id").collect()


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    run = queries.QUERIES["op7_flow_mixing"]
    largest = defaultdict(int)
    for _, s, t in rows:
        largest[s] = max(largest[s], size(t))
    check(rows, named(run(spark, sf), docs), largest)
    assert sorted(map(tuple, run(spark, sf).collect())) == sorted(map(tuple, run(spark, sf).collect()))


def test_range_sums_give_the_same_choice(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plain, own = mixing.mix(docs)
    monkeypatch.setattr(mixing, "ORDERED_TOGETHER", 1)
    ranged, _ = mixing.mix(docs)
    assert sorted(map(tuple, plain.select("doc_id", own[3]).collect())) == sorted(map(tuple, ranged.select("doc_id", own[3]).collect()))


def test_overlapping_sources(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(1, 30), rng.choice([["a"], ["a", "b"], ["b", "a"], ["c", None], ["b"]])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, homes array<string>")
    found, (n, sizes, goals, uses) = mixing.mix(docs, F.col("homes"))
    got = found.collect()
    assert len(got) == 400 and found.columns[:3] == docs.columns
    plan = mixing.make_plan(found.select(mixing.pattern_of(F.col("homes")).alias("pattern"), F.col(n).alias("size")))
    by_pattern = defaultdict(int)
    for r in got:
        assert 0 <= r[uses] <= 2 and len(r[goals]) == len(set(r.homes))
        by_pattern[json.dumps(sorted(r.homes, key=lambda s: (s is None, s)), separators=(",", ":"))] += r[n] * r[uses]
    for p, words in plan.taken.items():
        assert abs(by_pattern[p] - words) <= 30


def test_odd_rows(spark):
    rows = [(1, "a", None), (2, None, "three words here"), (2, None, "three words here"), (None, "a", "x y"), (4, "a", ""), (5, "b", "w " * 50)]
    docs = documents(spark, [(i, t) for i, _, t in rows]).drop("source")
    docs = spark.createDataFrame([(*r.asDict().values(), s) for r, (_, s, _) in zip(docs.collect(), rows)], docs.schema.add("source", "string"))
    docs = docs.withColumnRenamed("kept", "mix_uses")
    found, own = mixing.mix(docs)
    assert found.columns == [*docs.columns, *own] and found.count() == 6
    twice = mixing.mixed_documents(docs)
    assert twice.columns == docs.columns
    assert twice.count() == sum(r[own[3]] for r in found.collect())
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


def test_no_text_is_shuffled(spark, sf):
    mixed = mixing.mixed_documents(spark.read.parquet(f"{sf}/documents.parquet"))
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan
