"""An anchor with more passages than ``HOT`` inside one block."""

import numpy as np

from matchlens.llm import repeats

from .conftest import documents
from .test_repeats import by_hand


def test_anchor_is_hot_in_one_block(spark):
    rng = np.random.default_rng(9)
    line = rng.integers(97, 123, 400_000).astype(np.uint8)
    at, hashes, _, _ = repeats.anchors_in(line)
    # Of a long text's grams the one with the least hash is the anchor of nearly all strings it is in.
    gram = line[at[hashes.argmin()] :][: repeats.GRAM].tobytes().decode()
    lines = ["".join(map(chr, row)) + gram for row in rng.integers(97, 123, (33_000, 36))]
    rows = [(1, "".join(lines[:17_000])), (2, "".join(lines[16_000:])), (3, "few"), (4, gram * 8), (5, gram * 8)]
    docs = documents(spark, rows).coalesce(1)
    blocks, _ = repeats.store_blocks(docs)
    assert blocks.select("block").distinct().count() == 1
    codes = repeats.code_rows(repeats.anchor_rows(blocks, 0)).collect()
    assert any(2 in bytes(r.codes) for r in codes) and sum(r.shared for r in codes) > repeats.STRINGS * repeats.HOT
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in repeats.remove_repeats(docs).collect()}
    assert got == {i: (n, gone) for i, n, gone, *_ in by_hand(rows)}
