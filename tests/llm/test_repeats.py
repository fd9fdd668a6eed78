"""Repeated passages against all strings of all documents."""

import hashlib
import random

import numpy as np
import pytest

from matchlens.llm import queries, repeats

from .conftest import ODD_ROWS, documents


def by_hand(rows):
    """Sorted (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    data = [(float("inf") if i is None else i, i, (t or "").encode()) for i, t in rows]
    first = {}
    for order, _, t in data:
        for k in range(len(t) - 49):
            s = t[k : k + 50]
            first[s] = min(first.get(s, order), order)
    out = []
    for order, i, t in data:
        gone = bytearray(len(t))
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < order:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = by_hand(rows)
    assert found(queries.QUERIES["op6_run_length_index"](spark, sf)) == want
    assert sum(w[2] for w in want) > 1000


def corpus(rng):
    words = ["".join(rng.choices("abcdé", k=rng.randint(1, 7))) for _ in range(40)]
    line = " ".join(rng.choices(words, k=30))
    rows = []
    for i in range(60):
        text = " ".join(rng.choices(words, k=rng.randint(0, 60)))
        a = rng.randint(0, len(line) - 1)
        rows.append((rng.randint(0, 40), text[: rng.randint(0, 80)] + line[a : a + rng.randint(30, 120)] + text[80:]))
    rows += [(50, "a" * 300), (51, "a" * 200), (52, "b" * 49), (53, "b" * 50), (54, "b" * 50), (55, "abc" * 60), (56, "cab" * 60), (57, None), (None, line), (None, line)]
    return rows


@pytest.mark.parametrize("hot, block", [(30_000, 8 << 20), (3, 500), (1, 3000)])
def test_small_corpora(spark, monkeypatch, hot, block):
    for name, value in (("HOT", hot), ("BLOCK_BYTES", block), ("PASSAGES_TOGETHER", 20 * block), ("ANCHORS_TOGETHER", 50), ("SLICE", 700)):
        monkeypatch.setattr(repeats, name, value)
    rows = corpus(random.Random(hot))
    assert found(repeats.remove_repeats(documents(spark, rows), with_text=False)) == by_hand(rows)


def test_odd_rows(spark):
    assert found(repeats.remove_repeats(documents(spark, ODD_ROWS))) == by_hand(ODD_ROWS)
    docs = documents(spark, [*ODD_ROWS, (20, "x" + ODD_ROWS[9][1][:300] + "yz")])
    left = repeats.without_repeats(docs)
    assert left.columns == docs.columns and left.count() == len(ODD_ROWS) + 1
    assert left.filter("doc_id = 20").first().text == "xyz"
    assert repeats.remove_repeats(documents(spark, [])).count() == 0


def test_index_streams_the_text():
    """Runs, LF steps and sampled run ends belong to the text's suffix array."""
    rng = np.random.default_rng(0)
    count, lengths = 40, rng.integers(50, 85, 40)
    base = rng.integers(97, 100, 200).astype(np.uint8)
    frames = np.full((count, repeats.FRAME), 255, np.uint8)
    for i, n in enumerate(lengths):
        a = rng.integers(0, 100)
        frames[i, :n] = base[a : a + n]
    text = b"".join(bytes(f[f != 255] + 1) + b"\0" for f in frames)
    ends = np.cumsum(lengths + 1) - 1
    number = np.repeat(np.arange(count), lengths + 1)
    data = np.frombuffer(text, np.uint8)
    order, _ = repeats.suffix_order(data, ends[number], number)
    want = sorted(range(len(text)), key=lambda p: (text[p : ends[number[p]] + 1], number[p]))
    assert order.tolist() == want
    index = repeats.build_index(data, ends[number], number, np.arange(count) + 5)
    assert index.sample.tolist() == order[np.r_[index.begin[1:], len(order)] - 1].tolist()
    assert len(index.begin) < len(order) / 2
    least = repeats.match_masks(frames, np.arange(count) + 5)
    strings = [bytes(f[f != 255]) for f in frames]
    for i, s in enumerate(strings):
        for k in range(len(s) - 49):
            assert least[i, k] == min(j for j, t in enumerate(strings) if s[k : k + 50] in t) + 5


def test_anchors_fill_their_buckets_alike():
    """A bucket's size is what one task holds, so none may be many times the others'."""
    text = np.random.default_rng(3).integers(97, 123, 400_000).astype(np.uint8)
    anchors, _ = repeats.passages_of(text)
    sizes = np.bincount(repeats._bucket(anchors, 5), minlength=32)
    assert sizes.max() < 1.3 * sizes.mean()


def test_only_passages_that_may_meet_are_indexed(monkeypatch):
    """Passages that have no more than the anchor in common stay out; all others are matched."""
    rng = np.random.default_rng(4)
    frames = rng.integers(97, 123, (60, repeats.FRAME)).astype(np.uint8)
    frames[:, repeats.REACH : repeats.REACH + repeats.GRAM] = frames[0, repeats.REACH : repeats.REACH + repeats.GRAM]
    sides = [(0, 1, 17, 67), (2, 3, 34, 84), (4, 5, 0, 50), (6, 7, 10, 84)]
    for a, b, low, high in sides:
        frames[b, low:high] = frames[a, low:high]
    frames[[4, 8], 70:] = 255
    frames[[9], :12] = 255
    documents = np.arange(60) + 5
    indexed, whole = [], repeats.match_masks
    monkeypatch.setattr(repeats, "match_masks", lambda f, d: indexed.append(len(f)) or whole(f, d))
    least = repeats.strings_met(frames, documents, True)
    assert indexed == [8]
    for i, f in enumerate(frames):
        for k in range(repeats.STRINGS):
            s = f[k : k + 50]
            want = repeats.LAST if (s == 255).any() else min(5 + j for j, o in enumerate(frames) if (o[k : k + 50] == s).all())
            assert least[i, k] == want


def test_texts_are_neither_stored_nor_dealt_with_the_spans(spark, monkeypatch):
    """What goes on to the join is as long as the spans, however long the texts are."""
    line = "".join(map(chr, np.random.default_rng(5).integers(97, 123, 5000)))
    rows = [(1, line), (2, "é" + line[:2000] + "ü" + line[2500:] + "end"), (2, "é" + line[:2000] + "ü" + line[2500:] + "end"), (3, None), (4, "\u4e2d" * 20 + line[7:])]
    kept, whole = [], repeats.stored
    monkeypatch.setattr(repeats, "stored", lambda df, name: kept.append(whole(df, name)) or kept[-1])
    left = sorted(((r.doc_id, r.text, r.n_chars) for r in repeats.without_repeats(documents(spark, rows)).collect()), key=str)
    assert left == [(1, line, 5000), (2, "éüend", 5), (2, "éüend", 5), (3, None, 0), (4, "\u4e2d" * 20, 20)]
    assert "text" not in str(kept[-1].schema) and all(len(str(r)) < 500 for r in kept[-1].collect())


def test_equal_passages_are_sent_once_and_not_stored(spark, monkeypatch):
    """Copies in many blocks cost hashes; bytes come from the smallest document, and only where passages differ."""
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 1000)
    rng = np.random.default_rng(6)
    line = "".join(map(chr, rng.integers(97, 123, 2000)))
    rows = [(i, line) for i in range(12)] + [(20, line[:900] + "-" + line[901:]), (21, "".join(map(chr, rng.integers(97, 123, 2000))))]
    sent, kept, whole, store = [], [], repeats.mask_rows, repeats.stored
    monkeypatch.setattr(repeats, "mask_rows", lambda p: sent.append(p) or whole(p))
    monkeypatch.setattr(repeats, "stored", lambda df, name: kept.append(df.columns) or store(df, name))
    assert found(repeats.remove_repeats(documents(spark, rows))) == by_hand(rows)
    # About the changed byte passages differ from the line's; all others are alone or equal.
    assert 0 < sum(r.n for r in sent[0].collect()) < 30
    assert not any("passages" in columns for columns in kept)
