"""Quality rules against a plain loop."""

import base64
import random
import re

import zstandard

from matchlens.llm import quality_rules, queries

from .conftest import ODD_ROWS, documents


def by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    repeats = sum(x in lines[:i] for i, x in enumerate(lines))
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeats, len(covered), failed)


def row(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)


def test_whole_table(spark, sf):
    got = {r.doc_id: r for r in queries.QUERIES["op3_compression_bands"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    bands = quality_rules.Bands()
    press = zstandard.ZstdCompressor(level=3, write_content_size=False)
    for d in docs:
        assert row(got[d.doc_id]) == by_hand(d.text)
        data = d.text.encode()
        ratio = len(press.compress(data)) / len(data)
        low, high = next((a, b) for n, a, b in bands.whole if len(data) < n)
        pieces = [data[i : i + 2048] for i in range(0, len(data), 2048)]
        odd = [not 0.46 <= len(press.compress(p)) / len(p) <= 0.75 for p in pieces if len(p) >= 1024]
        assert got[d.doc_id].kept == (not by_hand(d.text)[-1] and low <= ratio <= high and 2 * sum(odd) <= len(odd))


def test_odd_rows(spark):
    rows = [r for r in ODD_ROWS if r[0] != 8]
    got = quality_rules.quality_stats(documents(spark, rows)).collect()
    assert sorted(map(row, got)) == sorted(by_hand(t) for _, t in rows)
    assert quality_rules.quality_stats(documents(spark, [])).count() == 0


def test_bands_reject_repetition_and_noise(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 8))) for _ in range(3000)]
    prose = " ".join(rng.choices(words, k=1500))
    noise = " ".join(base64.b85encode(rng.randbytes(40)).decode() for _ in range(300))
    shuffled = ["error at line", "retry the job", "ok done now", "wait for it"]
    stuck = " ".join(rng.choice(shuffled) + f" {i % 7}" for i in range(900))
    docs = documents(spark, [(1, prose), (2, noise), (3, stuck)])
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert [r.doc_id for r in kept.collect()] == [1]
