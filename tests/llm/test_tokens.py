"""Tokens, packing and id files against the library itself."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from matchlens.llm import id_files, packing, postings, queries, token_counts
from matchlens.llm.pretokens import PieceMemo, split, vocabulary_path

from .conftest import ODD_ROWS, documents

LIBRARY = Tokenizer.from_file(vocabulary_path())


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("'strevmld \n\t1²é.　\x85\x1c_-中A"), max_size=30))
def test_split_is_the_library_s(text):
    assert split(text) == [text[a:b] for _, (a, b) in LIBRARY.pre_tokenizer.pre_tokenize_str(text)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_memo_gives_the_library_s_ids(texts):
    memo = PieceMemo(vocabulary_path(), limit=20)
    texts = [*texts, "<|endoftext|> and more", "\U0003fffd"]
    assert [np.frombuffer(b, "<u2").tolist() for b in memo.ids(texts)] == [ids_of(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 40), max_size=12))
def test_plan_fills_sequences_without_gaps(counts):
    plan = packing.plan_slots(counts, 32)
    bins = defaultdict(list)
    for length, count in counts.items():
        rows = sorted((s for s in plan if s.length == length), key=lambda s: s.first)
        for rank in range(count):
            s = [r for r in rows if r.first <= rank][-1]
            k = rank - s.first
            bins[s.sequence + k // s.per].append((s.offset + k % s.per * length, length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 32
    total = sum(k * v for k, v in counts.items())
    assert total / 32 <= len(bins) <= max(1, 2 * total / 32 + 1)


def check_packing(rows, placed):
    """Every piece is right, and sequences have neither gaps nor overlaps."""
    want = defaultdict(list)
    for doc, text in rows:
        ids = [*ids_of(text), 0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc].append((piece, a, b - a, crc(ids[a:b])))
    got, sequences = defaultdict(list), defaultdict(list)
    for r in placed:
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert {k: sorted(v) for k, v in want.items()} == {k: sorted(v) for k, v in got.items()}
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    return len(sequences), sum(r.length for r in placed)


def test_packing_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    n, tokens = check_packing(rows, queries.QUERIES["op2_best_fit_packing"](spark, sf).collect())
    assert n <= 1.02 * -(-tokens // 2048) + 1


def test_packing_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_TOGETHER", 2)
    check_packing(ODD_ROWS, packing.pack(documents(spark, ODD_ROWS)).collect())
    assert "ids" not in packing.pack(documents(spark, ODD_ROWS), with_ids=False).columns
    assert packing.pack(documents(spark, [])).count() == 0


def test_id_files_whole_table(spark, sf):
    want, at = {}, 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        ids = [*ids_of(r.text), 0]
        want[r.doc_id] = (at, len(ids), crc(ids))
        at += len(ids)
    got = queries.QUERIES["op10_perfect_hash_ids"](spark, sf).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want and len(got) == len(want)


def test_id_files_odd_rows(spark, tmp_path):
    files = id_files.write_id_files(documents(spark, ODD_ROWS), str(tmp_path / "ids"), shard_bytes=200)
    keys = [(None, 0), (None, 1), (1, 0), (2, 0), (5, 0), (5, 1), (6, 0), (7, 0), (8, 0), (9, 0)]
    asked = spark.createDataFrame([*keys, *keys, (5, 2), (77, 0)], "doc_id long, copy long")
    got = {(r.doc_id, r.copy): (r.start, r.n_tokens, r.ids_crc32) for r in files.records(asked).collect()}
    assert set(got) == set(keys)
    texts = dict(ODD_ROWS)
    at = 0
    for key in keys:
        ids = [*ids_of(texts[key[0]]), 0]
        assert got[key] == (at, len(ids), crc(ids))
        assert files.ids(*key).tolist() == ids
        at += len(ids)
    assert files.ids(77) is None and files.ids(5, 2) is None
    empty = id_files.write_id_files(documents(spark, []), str(tmp_path / "none"))
    assert empty.records(asked).count() == 0


@pytest.mark.parametrize("n", [0, 1, 50, 3000])
def test_perfect_hash_is_minimal(n):
    rng = np.random.default_rng(n)
    h1, h2 = rng.integers(0, 2**64, (2, n), np.uint64)
    levels, number, left = id_files.build_levels(h1, h2)
    assert sorted(number.tolist()) == list(range(n))
    packed = np.stack([h1[left], h2[left]], 1).tobytes()
    assert id_files.find_numbers(h1, h2, levels, packed).tolist() == number.tolist()


def test_perfect_hash_lists_what_levels_cannot_part(monkeypatch):
    monkeypatch.setattr(id_files, "LEVELS", 1)
    h1, h2 = np.random.default_rng(1).integers(0, 2**64, (2, 500), np.uint64)
    levels, number, left = id_files.build_levels(h1, h2)
    packed = np.stack([h1[left], h2[left]], 1).tobytes()
    assert len(left) and id_files.find_numbers(h1, h2, levels, packed).tolist() == number.tolist()


def test_payload_is_raw_ids(spark, tmp_path):
    id_files.write_shards(documents(spark, [(2, "two words"), (1, "one")]), str(tmp_path / "raw"))
    content = id_files.shard_files(spark, str(tmp_path / "raw")).filter(F.col("length") > 40).first().content
    want = [*ids_of("one"), 0, *ids_of("two words"), 0]
    assert np.frombuffer(bytes(content[: 2 * len(want)]), "<u2").tolist() == want


def test_token_counts_whole_table(spark, sf):
    want = {r.doc_id: (len(r.text.encode()), len(ids_of(r.text))) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.QUERIES["op1_token_counts"](spark, sf).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == want and len(got) == len(want)
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)


def test_token_counts_odd_rows(spark, monkeypatch):
    rows = [*ODD_ROWS, (10, "<|endoftext|>"), (11, "\U0003fffd new"), (12, "ab " * 700)]
    want = sorted(((i, len((t or "").encode()), len(ids_of(t))) for i, t in rows), key=str)
    for block, pending in ((1 << 24, 4_000_000), (100, 3)):
        monkeypatch.setattr(postings, "BLOCK_BYTES", block)
        monkeypatch.setattr(postings, "PENDING", pending)
        got = token_counts.token_counts(documents(spark, rows)).collect()
        assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=str) == want
    assert token_counts.token_counts(documents(spark, [])).count() == 0
