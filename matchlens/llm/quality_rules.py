"""Quality rules: word and line statistics, and bands on how far zstandard shrinks a text.

Repetitive text shrinks too far and noise (keys, base64, dumps) hardly at all. Both are seen in the
ratio of compressed to plain bytes, of the whole text and of its fixed chunks. The whole-text limits
depend on the length, since a short text gives the compressor little to refer back to; chunks are
all of one size and share one band. The longer a text, the more it can refer back to, so the lowest ratio
of a text over ``piece_bytes`` is asked of its pieces of that size together. The limits are for scripts
of about one byte a letter: a text mostly in another alphabet is judged with one byte for each of its
letters (:func:`one_byte_letters`).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from matchlens.llm.common import corpus, text_of, unused


class Bands(NamedTuple):
    """Limits of the compression rule.

    ``whole``: (text bytes below which the row holds, lowest ratio, highest ratio), ascending.
    ``chunk``: lowest and highest ratio of a chunk of ``chunk_bytes``; a text fails when over
    ``chunk_share`` of its chunks lie outside. A last chunk shorter than half is not judged.
    ``piece_bytes``: size of the pieces in which a longer text must reach its lowest ratio.
    """

    level: int = 3
    whole: tuple[tuple[float, float, float], ...] = (
        (1_000, 0.48, 0.90),
        (2_000, 0.44, 0.75),
        (4_000, 0.42, 0.70),
        (16_000, 0.39, 0.70),
        (float("inf"), 0.36, 0.70),
    )
    chunk_bytes: int = 2_048
    chunk: tuple[float, float] = (0.46, 0.75)
    chunk_share: float = 0.5
    piece_bytes: int = 128 << 10


MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = re.compile(r"[#*$%&|<>]")
# Fixed value: from the East Asian radicals on, scripts whose signs stand for more than a letter.
NO_ALPHABET = re.compile("[\u2E80-\U0010FFFF]")
BETWEEN_WORDS = re.compile(r"[\x20\x09-\x0D]+")

STATS = StructType(
    [StructField(c, LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [StructField("base_failed", BooleanType())]
    + [StructField(c, DoubleType()) for c in ("whole_ratio", "chunks_outside")]
    + [StructField("kept", BooleanType())]
)


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of three found at least twice, the first such window included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    k = len(number)
    pairs = ids[:-1] * k + ids[1:]
    if k**3 >= 2**63:
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    _, which, times = np.unique(pairs[:-1] * k + ids[2:], return_inverse=True, return_counts=True)
    again = times[which] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= again
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if BETWEEN_WORDS.sub("", line)]
    return len(lines) - len(set(lines))


@cache
def _compressor(level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False)


def one_byte_letters(text: str) -> bytes:
    """The UTF-8 bytes; but where most characters besides blanks are not ASCII, and those and the ASCII ones
    come to 256 kinds at most, a byte for each kind. Texts in syllables or ideographs stay as they are."""
    data = text.encode()
    ascii_ = len(text.encode("ascii", "ignore"))
    if 2 * (len(text) - ascii_) <= len(BETWEEN_WORDS.sub("", text)):
        return data
    if 2 * len(NO_ALPHABET.findall(text)) > len(text) - ascii_:
        return data
    others = [c for c in dict.fromkeys(text) if ord(c) > 127]
    free = [b for b in range(256) if b > 127 or chr(b) not in text]
    if len(others) > len(free):
        return data
    return text.translate({ord(c): chr(b) for c, b in zip(others, reversed(free))}).encode("latin-1")


def compression(data: bytes, bands: Bands) -> tuple[float | None, float | None, bool]:
    """Ratio of the whole text, share of chunks outside their band, and whether both pass."""
    if not data:
        return None, None, False
    press = _compressor(bands.level).compress
    whole = len(press(data)) / len(data)
    low, high = next((a, b) for below, a, b in bands.whole if len(data) < below)
    in_pieces = whole
    if len(data) > bands.piece_bytes:
        # Pieces of equal size, none much shorter than the others.
        n = -(-len(data) // bands.piece_bytes)
        cuts = [len(data) * i // n for i in range(n + 1)]
        in_pieces = sum(len(press(data[a:b])) for a, b in zip(cuts, cuts[1:])) / len(data)
    size = bands.chunk_bytes
    chunks = [data[i : i + size] for i in range(0, len(data), size)]
    chunks = [c for c in chunks if 2 * len(c) >= size]
    outside = sum(not bands.chunk[0] <= len(press(c)) / len(c) <= bands.chunk[1] for c in chunks)
    share = outside / len(chunks) if chunks else 0.0
    return whole, share, low <= in_pieces and whole <= high and share <= bands.chunk_share


def document_stats(text: str, bands: Bands) -> tuple:
    data = text.encode()
    words = data.split()
    n_words, repeats = len(words), repeat_words(words)
    failed = n_words < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n_words
    whole, outside, fits = compression(one_byte_letters(text), bands)
    return (
        n_words,
        len(BETWEEN_WORDS.sub("", text)),
        len(SYMBOLS.findall(text)),
        duplicate_lines(text),
        repeats,
        failed,
        whole,
        outside,
        fits and not failed,
    )


def _stats_udf(bands: Bands):
    def stats(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([document_stats(t, bands) for t in batch], columns=STATS.names)

    return F.pandas_udf(stats, STATS)


def quality_stats(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """One row per document: ``doc_id``, the statistics, ``base_failed`` and ``kept``.

    One pass, no shuffle. A null or empty text has no words, no ratio, and fails. Rows with the same
    ``doc_id`` or text are judged one by one; an empty table gives no rows.
    """
    found = corpus(docs).select("doc_id", _stats_udf(bands)("text").alias("s"))
    return found.select("doc_id", "s.*")


def keep_good(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The documents that pass, with all their columns."""
    name = unused(docs, "quality_verdict")
    judged = docs.withColumn(name, _stats_udf(bands)(text_of("text")))
    return judged.filter(F.col(name)["kept"]).select(*[F.col(f"`{c}`") for c in docs.columns])
