"""Links and groups against all pairs."""

import math
import re

import numpy as np
import pytest
import xxhash

from matchlens.llm import embedding_neighbours, queries, simhash
from matchlens.llm.components import components, local_roots

from .conftest import ODD_ROWS, documents


def groups(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 400, (2, 300))
    chain = [(i, i + 1) for i in range(1000, 1060)]
    links = [*zip(a.tolist(), b.tolist()), *chain, (2000, 2000), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    whole = [(x, y) for x, y in links if x is not None]
    want = groups(1100, [p for p in whole if p[0] < 1100])
    assert got == {n: want[n] for x, y in whole if x != y for n in (x, y)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert local_roots(400, a, b).tolist() == groups(400, zip(a.tolist(), b.tolist()))


# ---------------------------------------------------------------- vectors


def linked_vectors(rows):
    """vec_id -> (n_links, component_id) by all pairs; rows of (vec_id, vector, label)."""

    def sound(r):
        return r[0] is not None and r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])

    good = [sound(r) for r in rows]
    links = []
    for i, r in enumerate(rows):
        for j in range(i):
            s = rows[j]
            if good[i] and good[j] and r[2] == s[2] and len(r[1]) == len(s[1]):
                x, y = np.array(r[1], float), np.array(s[1], float)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.98:
                    links.append((i, j))
    root = groups(len(rows), links)
    n = np.bincount(np.array(links, int).ravel(), minlength=len(rows)) if links else [0] * len(rows)
    first = {k: min((rows[i][0] for i in range(len(rows)) if root[i] == k and rows[i][0] is not None), default=None) for k in set(root)}
    return sorted(((r[0], int(n[i]), first[root[i]], first[root[i]] == r[0] or r[0] is None) for i, r in enumerate(rows)), key=str)


def found_vectors(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=str)


def test_vectors_whole_table(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = linked_vectors(rows)
    assert found_vectors(queries.QUERIES["op5_hyperplane_links"](spark, sf)) == want


@pytest.mark.parametrize("tile", [3, 2000])
def test_vectors_odd_rows(spark, tile):
    rng = np.random.default_rng(2)
    middle = rng.standard_normal(8)
    near = [(i, (middle + 0.07 * rng.standard_normal(8)).tolist(), 1) for i in range(40)]
    far = [(100 + i, rng.standard_normal(8).tolist(), i % 2) for i in range(60)]
    odd = [(200, None, 1), (201, [0.0] * 8, 1), (202, [1.0, None, *[0.0] * 6], 1), (203, [float("nan")] + [1.0] * 7, 1), (204, [float("inf")] + [1.0] * 7, 1),
           (205, middle.tolist(), None), (None, middle.tolist(), 1), (206, [], 1), (207, [1.0, 2.0], 1), (208, [2.0, 4.0], 1), (3, near[3][1], 1), (209, (1e200 * middle).tolist(), 1)]
    rows = [*near, *far, *odd]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, label int, class string, code string")
    want = linked_vectors([(i, [x / 1e200 for x in v] if i == 209 else v, label) for i, v, label in rows])
    assert found_vectors(embedding_neighbours.near_duplicates(df, tile=tile)) == want
    assert embedding_neighbours.near_duplicates(df.limit(0)).count() == 0


# ---------------------------------------------------------------- fingerprints


def fingerprint_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def grouped_documents(rows):
    fps = [fingerprint_by_hand(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    root = groups(len(rows), links)
    first = {k: min((rows[i][0] for i in range(len(rows)) if root[i] == k and rows[i][0] is not None), default=None) for k in set(root)}
    return sorted(((rows[i][0], f"{fps[i]:016x}", first[root[i]]) for i in range(len(rows))), key=str)


def found_documents(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def test_fingerprints_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = grouped_documents(rows)
    assert found_documents(queries.QUERIES["op8_segment_popcounts"](spark, sf)) == want
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted({w[2] for w in want})


def test_fingerprints_odd_rows(spark):
    docs = documents(spark, ODD_ROWS)
    want = grouped_documents(ODD_ROWS)
    assert found_documents(simhash.near_duplicates(docs)) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted({w[2] for w in want}, key=str)
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    assert simhash.keep_one(documents(spark, [])).count() == 0


@pytest.mark.parametrize("tile", [5, 4096])
def test_links_find_every_pair(spark, tile):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, 60, np.uint64)
    fps = [*base.tolist(), 0, 2**64 - 1]
    for b in base[:25].tolist():
        for _ in range(12):
            flips = rng.choice(64, rng.integers(1, 6), replace=False)
            fps.append(b ^ sum(1 << int(f) for f in flips))
    fps = sorted(set(fps))
    want = groups(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    got = [(r.a, r.b) for r in simhash.links(df, tile=tile).collect()]
    place = {simhash._signed(f): i for i, f in enumerate(fps)}
    assert groups(len(fps), [(place[a], place[b]) for a, b in got]) == want
