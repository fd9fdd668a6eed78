"""Context trees with more nodes than a table of 2**22 places tells apart."""

import zlib

import numpy as np
import pytest

from matchlens.llm import context_trees

from .conftest import documents


def decisions(texts):
    """Context (newest byte lowest), place and bit of every decision, and the text each is of."""
    out = []
    for i, t in enumerate(texts):
        line = np.frombuffer(bytes(4) + t.encode() + b"\0", np.uint8).astype(np.int64)
        context = sum(line[3 - k : len(line) - 1 - k] << 8 * k for k in range(4))
        byte = line[4:] | 256
        out += [np.stack([context, byte >> 8 - k, byte >> 7 - k & 1, np.full(len(byte), i)]) for k in range(8)]
    return np.concatenate(out, axis=1)


def scores_by_hand(learning, asked):
    context, place, bit, _ = decisions(learning)
    new, at, one, text = decisions(asked)
    keys = [(context & (1 << 8 * d) - 1) << 8 | place for d in range(5)]
    levels, below = [], None
    for d in range(4, -1, -1):
        node, which = np.unique(keys[d], return_inverse=True)
        n, ones = np.bincount(which), np.bincount(which, bit)
        weighted = kt = context_trees.log_kt(n - ones, ones)
        share = np.ones(len(node))
        if below is not None:
            up = (below[0] >> 8 & (1 << 8 * d) - 1) << 8 | below[0] & 255
            weighted = np.logaddexp(kt, np.bincount(np.searchsorted(node, up), below[1], len(node))) - np.log(2)
            share = np.exp(kt - np.log(2) - weighted)
        below = node, weighted
        levels.append((d, node, share, (ones + 0.5) / (n + 1)))
    p = np.full(len(new), 0.5)
    for d, node, share, estimate in levels:
        key = (new & (1 << 8 * d) - 1) << 8 | at
        i = np.minimum(np.searchsorted(node, key), len(node) - 1)
        p = np.where(node[i] == key, share[i] * estimate[i] + (1 - share[i]) * p, 0.5)
    return np.bincount(text, np.log10(np.where(one == 1, p, 1 - p)))


def test_every_context_has_its_own_nodes(spark):
    rng = np.random.default_rng(6)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789()[]{}!?.,;:-+=_/~", np.uint8)
    half = ["".join(map(chr, rng.choice(letters, 25_000))) for _ in range(12)]
    texts = {i: half[i % 12] + half[(i + 1) % 12][:5_000] for i in range(24)}
    learning = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10]
    got = {r.doc_id: r.score for r in context_trees.score(documents(spark, list(texts.items()))).collect()}
    assert got == pytest.approx(dict(zip(texts, scores_by_hand(learning, list(texts.values())))), rel=1e-9)
