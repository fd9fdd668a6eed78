"""A quality classifier: ridge regression on random Fourier features, with isotonic calibration.

Cosines of random projections of a document's statistics approximate a Gaussian kernel over them, so a
linear fit on the cosines is a kernel fit whose size does not grow with the documents. Tasks sum the
normal equations over their labelled documents; Spark sums the tasks' row by row; the driver solves
one small system. Labelled scores are then counted in fixed bins and made monotone.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlens.llm.common import corpus, stored
from matchlens.llm.context_trees import fold

FOLDS = 3
HELD_OUT = 1
FEATURES = 384
SEED = 9
RIDGE = 1e-4
BINS = 4096

STATS = (
    "log_bytes", "log_words", "log_lines", "mean_word", "std_word", "longest_word", "distinct_words", "commonest_word",
    "letters", "upper", "digits", "blanks", "marks", "symbols", "other", "non_ascii", "repeated_lines", "repeated_words",
    "mean_line", "sentence_ends", "one_letter_words", "words_with_symbols", "ratio", "adler_spread", "links", "entropy",
)
_ASCII = np.zeros(256, np.uint8)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b".,;:!?'\"()-", b"#*$%&|<>@~^_=+/\\[]{}`"), 1):
    _ASCII[np.frombuffer(_chars, np.uint8)] = _k
_ASCII[128:] = 7
_SYMBOL = re.compile(rb"[#*$%&|<>]")
_LINK = re.compile(rb"https?://|www\.|[\w.]+@[\w.]+")
_END = re.compile(rb"[.!?][\"')\]]?\s")


def text_stats(text: str) -> list[float]:
    """The statistics named in ``STATS``; all zero for an empty text."""
    data = text.encode()
    n = len(data)
    if not n:
        return [0.0] * len(STATS)
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    w, k = max(1, len(words)), max(1, len(lines))
    codes = np.frombuffer(data, np.uint8)
    histogram = np.bincount(codes, minlength=256)
    kinds = np.bincount(_ASCII, histogram, 8) / n
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    counts: dict[bytes, int] = {}
    for x in words:
        counts[x] = counts.get(x, 0) + 1
    pairs = len(set(zip(words, words[1:])))
    share = histogram[histogram > 0] / n
    press = zstandard.ZstdCompressor(level=1, write_content_size=False)
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), lengths.mean(), lengths.std(), np.log1p(lengths.max()),
        len(counts) / w, max(counts.values(), default=0) / w, kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], kinds[0], kinds[7],
        1 - len(set(lines)) / k, 1 - pairs / max(1, len(words) - 1) if len(words) > 1 else 0.0,
        np.log1p(n / k), len(_END.findall(data)) / w, float((lengths == 1).sum()) / w, len(_SYMBOL.findall(data)) / w,
        len(press.compress(data)) / n, len(zlib.compress(data[::2], 1)) / n, len(_LINK.findall(data)) / w, float(-(share * np.log2(share)).sum()),
    ]


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    steps: np.ndarray
    levels: np.ndarray


def projection(width: int, features: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """Directions and phases for a Gaussian kernel as wide as the typical distance of two points."""
    rng = np.random.default_rng(SEED)
    return rng.standard_normal((width, features)) / np.sqrt(width), rng.uniform(0, 2 * np.pi, features)


def fourier(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random Fourier features, the standardized statistics themselves, and a constant."""
    x = np.clip((stats - mean) / scale, -8, 8)
    directions, phases = projection(x.shape[1])
    return np.hstack([np.cos(x @ directions + phases) * np.sqrt(2 / FEATURES), x / np.sqrt(FEATURES), np.ones((len(x), 1))])


def described(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fold`` and ``stats`` of every document."""

    @F.pandas_udf("array<double>")
    def stats(texts: pd.Series) -> pd.Series:
        return pd.Series([text_stats(t) for t in texts])

    return corpus(docs).select("doc_id", fold(FOLDS).alias("fold"), stats("text").alias("stats"))


def isotonic(total: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Nondecreasing levels closest to the shares ``positive / total``, weighted by ``total``."""
    blocks: list[list[float]] = []
    for n, p in zip(total.tolist(), positive.tolist()):
        blocks.append([n, p, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n, p, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n, blocks[-1][1] + p, blocks[-1][2] + k]
    return np.repeat([p / n for n, p, _ in blocks], [int(k) for *_, k in blocks])


def fit(labelled: DataFrame) -> Model:
    """Fit on ``stats`` and ``y`` (0 or 1) of every labelled row. Without rows the model says 0.5."""
    width = len(STATS)
    sums = [f(F.col("stats")[i]) for i in range(width) for f in (F.avg, F.stddev_pop)]
    row = labelled.agg(*sums).first()
    mean = np.array([x or 0.0 for x in row[0::2]])
    scale = np.array([x if x and x > 1e-9 else 1.0 for x in row[1::2]])
    size = FEATURES + width + 1

    def equations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size + 1))
        for b in batches:
            if len(b):
                z = fourier(np.stack(b["stats"]), mean, scale)
                total += z.T @ np.hstack([z, b["y"].to_numpy(np.float64)[:, None]])
        yield pd.DataFrame({"i": np.arange(size), "sums": [r.tobytes() for r in total]})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(r) for r in rows["sums"]], axis=0)
        return pd.DataFrame({"i": rows["i"].iloc[:1], "sums": [total.tobytes()]})

    schema = "i long, sums binary"
    parts = labelled.select("stats", "y").mapInPandas(equations, schema)
    rows = parts.groupBy("i").applyInPandas(add, schema).collect()
    system = np.zeros((size, size + 1))
    for r in rows:
        system[r["i"]] = np.frombuffer(r["sums"])
    n = system[-1, -2]
    if not n:
        return Model(mean, scale, np.zeros(size), np.array([0.0]), np.array([0.5]))
    penalty = np.full(size, RIDGE * n)
    penalty[-1] = 0
    weights = np.linalg.solve(system[:, :-1] + np.diag(penalty + 1e-9), system[:, -1])

    raw = Model(mean, scale, weights, np.zeros(0), np.zeros(0))
    scored = _raw_scores(labelled, raw)
    place = F.least(F.greatest(F.floor((F.col("raw") + 0.5) / 2 * BINS), F.lit(0)), F.lit(BINS - 1))
    bins = scored.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.sum("y").alias("p"), F.avg("raw").alias("at")).orderBy("bin").collect()
    levels = isotonic(np.array([r["n"] for r in bins], float), np.array([r["p"] for r in bins], float))
    return Model(mean, scale, weights, np.array([r["at"] for r in bins]), levels)


def _raw_scores(rows: DataFrame, model: Model) -> DataFrame:
    @F.pandas_udf("double")
    def raw(stats: pd.Series) -> pd.Series:
        return pd.Series(fourier(np.stack(stats), model.mean, model.scale) @ model.weights if len(stats) else [], dtype="float64")

    return rows.withColumn("raw", raw("stats"))


def calibrated(raw: np.ndarray, model: Model) -> np.ndarray:
    """Between the bins' levels by line, so scores keep their order within a level's neighbours."""
    return np.clip(np.interp(raw, model.steps, model.levels), 0.0, 1.0)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``score`` and ``predicted``.

    Learns from labelled documents that are not held out, all of them; a null label, a label other than
    0 or 1, or a null id teaches nothing, and a document labelled twice counts twice. A null text is an
    empty one and has a score. Repeated rows are scored each; empty tables give no rows, or the score
    0.5 where there is nothing to learn from.
    """
    known = stored(described(docs), "statistics")
    taught = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).filter("y in (0, 1)")
    labelled = stored(known.filter(F.col("fold") != HELD_OUT).join(taught, "doc_id").select("stats", "y"), "labelled")
    model = fit(labelled)

    @F.pandas_udf("double")
    def final(stats: pd.Series) -> pd.Series:
        return pd.Series(calibrated(fourier(np.stack(stats), model.mean, model.scale) @ model.weights, model) if len(stats) else [], dtype="float64")

    scored = known.select("doc_id", (F.col("fold") == HELD_OUT).alias("held_out"), final("stats").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
