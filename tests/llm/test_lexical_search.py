import math
import re
from collections import Counter

import numpy as np

from matchlens.llm import lexical_search
from matchlens.llm.queries import QUERIES

from .conftest import ODD_ROWS, documents

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(TERM, (text or "").translate(ASCII))


def by_hand(docs, items, k=10):
    """Every document scored for every item."""
    counted = [(doc_id, Counter(terms(text))) for doc_id, text in docs]
    counted = [(doc_id, c, c.total()) for doc_id, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    made = []
    for item_id, text in items:
        found = []
        for doc_id, c, n in counted:
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, doc_id is None, doc_id))
        made += [(item_id, r, doc_id, -score) for r, (score, _, doc_id) in enumerate(sorted(found, key=lambda f: f[:2] + (f[2] or 0,))[:k], 1)]
    return sorted(made, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def items_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "item_id long, text string, item string, rank string, doc_id string")


def test_odd_rows(spark):
    docs = ODD_ROWS + [(20 + i, f"Alpha beta{i % 3} gamma, Ünï-code {'delta ' * i}") for i in range(40)] + [(70, "tie one"), (69, "tie one"), (70, "tie one")]
    items = [(1, "ALPHA delta delta beta1"), (1, "ALPHA delta delta beta1"), (None, "tie"), (2, None), (3, ""), (4, "- . -"), (5, "word same one Ünï"), (6, "nowhere")]
    assert got(lexical_search.rank(documents(spark, docs).repartition(3), items_frame(spark, items))) == by_hand(docs, items)


def test_empty_tables(spark):
    docs, items = documents(spark, [(1, "a b")]), items_frame(spark, [(1, "a")])
    assert got(lexical_search.rank(docs.limit(0), items)) == []
    assert got(lexical_search.rank(docs, items.limit(0))) == []
    assert got(lexical_search.rank(documents(spark, [(1, None), (2, "")]), items)) == []


def test_several_passes_small_segments_and_blocks(spark, sf, monkeypatch):
    monkeypatch.setattr(lexical_search, "ITEM_ENTRIES", 700)
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert got(lexical_search.rank(documents(spark, docs).repartition(4), items_frame(spark, items), k=3)) == by_hand(docs, items, 3)


def test_whole_table(spark, sf):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(c, "text").collect()] for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert got(QUERIES["op13_geometric_blocks"](spark, sf)) == by_hand(docs, items)


def index_of(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    asked = lexical_search.item_terms(spark.read.parquet(f"{sf}/benchmark.parquet"))
    wanted = lexical_search.Wanted.of(asked.select("item", "terms", "times").collect())
    found = lexical_search.vectors(docs, wanted)
    n_docs, n_terms = found.selectExpr("count(*)", "sum(n)").first()
    weight = lexical_search.weights(n_docs, lexical_search.holding_documents(found, len(wanted.numbers)))
    return wanted, weight, lexical_search.build(found, wanted, weight, n_docs, n_terms)


def test_summaries_are_the_blocks_maxima_and_bound_every_document(spark, sf):
    wanted, weight, index = index_of(spark, sf)
    columns = [wanted.columns(h) for h in wanted.holders()]
    n_blocks = n_lists = 0
    for row in index.limit(2).collect():
        segment = lexical_search.Segment(row.asDict(), len(weight), columns)
        for t, (sizes, members, summary) in segment.lists.items():
            assert sorted(members.tolist()) == np.flatnonzero(segment.table[:, t]).tolist()
            for docs, top in zip(np.split(members, np.cumsum(sizes)[:-1]), summary):
                assert (segment.table[np.ix_(docs, columns[t])].max(axis=0) == top).all()
                n_blocks += 1
            n_lists += 1
    assert n_blocks > n_lists


def test_blocks_are_skipped_and_nothing_is_lost(spark, sf):
    """Fewer documents are scored than the items' lists hold; the results are the same as without skipping."""
    wanted, weight, index = index_of(spark, sf)
    columns = [wanted.columns(h) for h in wanted.holders()]
    segments = [lexical_search.Segment(r.asDict(), len(weight), columns) for r in index.collect()]
    scored = all_of = 0
    for place, (_, ids, times) in enumerate(wanted.items):
        best = lexical_search.Best(len(wanted.items), 10)
        factors = np.zeros(len(weight))
        factors[ids] = weight[ids] * times
        everything = []
        for segment in segments:
            opened = segment.reaching
            taken: list[np.ndarray] = []
            segment.reaching = lambda *a, opened=opened, taken=taken: taken.append(opened(*a)) or taken[-1]
            segment.search(place, ids, factors, columns, best)
            segment.reaching = opened
            scored += len(np.unique(np.concatenate(taken))) if taken else 0
            score = segment.table @ factors
            all_of += int((score > 0).sum())
            everything += [(-int(s), int(d)) for s, d in zip(score, segment.doc_ids) if s > 0]
        score, _, doc_id = best.rows[place]
        assert [(-s, d) for s, d in zip(score.tolist(), doc_id.tolist())] == sorted(everything)[:10]
    assert scored < all_of


def test_stored_segments_are_packed(spark):
    docs = documents(spark, [(i, f"alpha beta{i} gamma{i % 7}") for i in range(300)]).repartition(1)
    wanted = lexical_search.Wanted.of([(0, [b"alpha", *(f"beta{i}".encode() for i in range(300))], [1] * 301)])
    index = lexical_search.build(lexical_search.vectors(docs, wanted), wanted, np.ones(301), 300, 900)
    (row,) = index.collect()
    whole = lexical_search.Segment({c: row[c] for c in index.columns}, 301, [wanted.columns(h) for h in wanted.holders()])
    size, members, summaries = whole.lists[0]
    assert size.sum() == 300 and sorted(members.tolist()) == list(range(300))
    assert len(row["summaries"]) < summaries.nbytes / 2
