"""Scores against plain loops, and against held-out labels."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from matchlens.llm import context_trees, queries, quality_classifier

from .conftest import ODD_ROWS, documents


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower(text)), None]


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


class Tree:
    """Context-tree weighting with explicit nodes, over strings of context bytes, newest first."""

    def __init__(self):
        self.counts = {}

    def see(self, context, bit):
        for d in range(len(context) + 1):
            self.counts.setdefault(context[:d], [0, 0])[bit] += 1

    def kt(self, node):
        a, b = self.counts[node]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(self, node, depth):
        if len(node) == depth:
            return self.kt(node)
        below = sum(self.weighted(n, depth) for n in self.counts if len(n) == len(node) + 1 and n[:-1] == node)
        return np.logaddexp(self.kt(node), below) - math.log(2)

    def one(self, context):
        """From the definition: how much one more 1 after ``context`` multiplies the root's weight."""
        before = self.weighted(b"", len(context)) if self.counts else 0.0
        self.see(context, 1)
        after = self.weighted(b"", len(context))
        for d in range(len(context) + 1):
            self.counts[context[:d]][1] -= 1
            if self.counts[context[:d]] == [0, 0]:
                del self.counts[context[:d]]
        return math.exp(after - before)


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 7, 123.5, 1e6, 1e12])
    assert context_trees.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-10)


def decisions(text):
    """(context, place, bit) of every decision in a text and its end."""
    depth = context_trees.DEPTH
    data = bytes(depth) + lower(text).encode() + b"\0"
    for i in range(depth, len(data)):
        for k in range(8):
            yield data[i - depth : i][::-1], (data[i] | 256) >> 8 - k, data[i] >> 7 - k & 1


def trees_by_hand(texts):
    trees = {}
    for t in texts:
        for context, place, bit in decisions(t):
            trees.setdefault(place, Tree()).see(context, bit)
    return trees


def log10_by_hand(trees, text):
    known = {}

    def one(place, context):
        if (place, context) not in known:
            known[place, context] = trees[place].one(context) if place in trees else 0.5
        return known[place, context]

    return sum(math.log10(one(place, c) if bit else 1 - one(place, c)) for c, place, bit in decisions(text))


def check_scores(rows, got, model=True):
    learning = [t for i, t in rows if not held_out(i)]
    c = Counter(x for t in learning for x in tokens(t))
    n, v = sum(c.values()), len(c)
    want = {}
    for i, t in rows:
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens(t))
        want.setdefault((i, held_out(i), len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n), []).append(base)
    found = {}
    for r in got:
        found.setdefault((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens), []).append(r.base_score)
    assert found.keys() == want.keys()
    for k, v in want.items():
        assert sorted(found[k]) == pytest.approx(sorted(v), rel=1e-9)


def test_scores_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.QUERIES["op4_context_trees"](spark, sf).collect()
    check_scores(docs, got)
    out = [r for r in got if r.held_out]
    # 0.4 MB to learn from: the bytes before tell much more than the frequency of a byte alone.
    assert 1 < np.mean([r.bits_per_byte for r in out]) < 3.5


def test_scores_odd_rows(spark):
    rows = [r for r in ODD_ROWS if r[0] not in (7, 8, 9)] + [(i, "A word or " + "xyz"[i % 3] * 2) for i in range(20, 50)]
    assert any(held_out(i) for i, _ in rows)
    got = context_trees.score(documents(spark, rows)).collect()
    check_scores(rows, got)
    trees = trees_by_hand([t for i, t in rows if not held_out(i)])
    texts = dict(rows)
    for r in got[:9]:
        assert r.score == pytest.approx(log10_by_hand(trees, texts[r.doc_id]), rel=1e-5)
    assert context_trees.score(documents(spark, [])).count() == 0


def auc(score, label):
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(score))
    ranks[order] = np.arange(1, len(score) + 1)
    for s in np.unique(score):
        ranks[score == s] = ranks[score == s].mean()
    p = label.sum()
    return (ranks[label == 1].sum() - p * (p + 1) / 2) / (p * (len(label) - p))


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.QUERIES["op9_fourier_quality"](spark, sf).collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    out = [(r.score, quality[r.doc_id], r.predicted) for r in got if r.held_out and quality.get(r.doc_id) is not None]
    score, label, predicted = (np.array(x) for x in zip(*out))
    print("AUC", auc(score, label), "accuracy", (predicted == label).mean(), "constant", label.mean())
    assert auc(score, label) > 0.9 and (predicted == label).mean() > label.mean()
    assert predicted[label == 1].mean() > 0.97


def test_classifier_odd_rows(spark):
    docs = documents(spark, ODD_ROWS)
    labels = spark.createDataFrame([(1, 0, "x"), (2, 1, "x"), (5, None, "x"), (None, 1, "x"), (6, 1, "x"), (9, 7, "x")], "doc_id long, quality int, score string")
    got = quality_classifier.classify(docs, labels).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted((i for i, _ in ODD_ROWS), key=str)
    none = quality_classifier.classify(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality_classifier.classify(documents(spark, []), labels).count() == 0


def test_isotonic_is_the_best_monotone_fit():
    n, p = np.array([2.0, 1, 3, 1]), np.array([1.0, 1, 0, 1])
    assert quality_classifier.isotonic(n, p) == pytest.approx([1 / 3, 1 / 3, 1 / 3, 1])
