"""SimHash near-duplicates by counts of set bits per segment.

A fingerprint maps to the numbers of set bits in its two-bit segments. Flipping one bit moves that
point by one, so the Manhattan distance of two points is at most the Hamming distance of their
fingerprints. The segments are dealt into three parts: among at most four (five) differing bits, one
part holds at most one, so in that part the points are the same or neighbours on the integer grid. Each
fingerprint is at home in its cell of each part's grid and probes the cells one step above; of two
neighbours, one probes the other's home. Pairs that meet are verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlens.llm.common import LOWER, corpus, stored, text_of, unused
from matchlens.llm.components import components, local_roots

SHINGLE = 4
SEED = 42
MAX_BITS = 4
SEGMENTS = 32
#: First segment of each part, and the end.
PARTS = (0, 11, 22, 32)
#: Homes in one cell that one task compares; a cell with more is cut into tiles.
TILE = 4096
#: Pairs that are compared at once.
AT_ONCE = 4_000_000


# ---------------------------------------------------------------- fingerprints


def fingerprint(text: str) -> int:
    """Bit set where over half of the shingles' hashes have it; 0 without words."""
    words = text.encode().translate(LOWER).split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    hash_of = xxhash.xxh64_intdigest
    n = len(words) - SHINGLE + 1
    hashes = np.fromiter((hash_of(line[a:b], SEED) for a, b in zip(starts.tolist(), ends[SHINGLE - 1 :].tolist())), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 65_536):
        bits = np.unpackbits(hashes[i : i + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(rows: DataFrame) -> DataFrame:
    """The columns of ``rows`` with ``fp`` (64 bits as a signed long) in place of ``text``."""

    @F.pandas_udf("long")
    def read(texts: pd.Series) -> pd.Series:
        return pd.Series([_signed(fingerprint(t)) for t in texts], dtype="int64")

    return rows.withColumn("fp", read("text")).drop("text")


# ---------------------------------------------------------------- grid join


def segment_counts(fps: np.ndarray) -> np.ndarray:
    """Set bits of each two-bit segment, one row per fingerprint."""
    bits = np.unpackbits(np.ascontiguousarray(fps, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits[:, 0::2] + bits[:, 1::2]


def cells(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(cell, index of the fingerprint, whether at home), for each part's home and each step above."""
    counts = segment_counts(fps).astype(np.int64)
    everyone = np.arange(len(fps))
    for part, (first, end) in enumerate(zip(PARTS, PARTS[1:])):
        unit = 3 ** np.arange(end - first)
        home = (counts[:, first:end] * unit).sum(axis=1) * 3 + part
        yield home, everyone, True
        for k in range(end - first):
            can = np.flatnonzero(counts[:, first + k] < 2)
            yield home[can] + 3 * unit[k], can, False


def _grid_rows(fps: DataFrame, probes: bool) -> DataFrame:
    """``cell``, ``fp``, ``home``: where each fingerprint is at home and, if asked, where it probes."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column(0).to_numpy().view(np.uint64)
            for cell, at, home in cells(values):
                if home or probes:
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(values[at].view(np.int64)), pa.array(np.full(len(at), home))], names=["cell", "fp", "home"])

    return fps.select("fp").mapInArrow(spread, "cell long, fp long, home boolean")


def links_in(cell: np.ndarray, fps: np.ndarray, home: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among rows sorted by cell, homes first in each: as (fingerprint, smallest one reached)
    for every linked fingerprint of a chunk, so a dense group costs its size and not its square."""
    n = len(cell)
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    size = np.diff(np.r_[first, n])
    homes = np.add.reduceat(home.astype(np.int64), first)
    group = np.repeat(np.arange(len(first)), size)
    # Row r meets the homes of its cell that stand before it (a home), or all of them (a probe).
    meets = np.where(home, np.arange(n) - first[group], homes[group])
    upto = np.cumsum(meets)
    begin = 0
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + AT_ONCE, "right")))
        count = meets[begin:end]
        rows = np.repeat(np.arange(begin, end), count)
        other = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[group[begin:end]], count)
        near = np.bitwise_count(fps[rows] ^ fps[other]) <= max_bits
        near &= fps[rows] != fps[other]
        if near.any():
            ends = np.concatenate([fps[rows[near]], fps[other[near]]])
            nodes, place = np.unique(ends, return_inverse=True)
            half = len(place) // 2
            root = local_roots(len(nodes), place[:half], place[half:])
            apart = root != np.arange(len(nodes))
            yield nodes[apart], nodes[root[apart]]
        begin = end


def links(fps: DataFrame, max_bits: int = MAX_BITS, tile: int = TILE) -> DataFrame:
    """``a``, ``b``: links that connect all distinct fingerprints (``fp``) within ``max_bits``.

    A cell with more than ``tile`` homes becomes tiles by hash: homes of tile i and probes of tile j
    meet in (i, j), so any number of fingerprints in one cell is compared in bounded groups.
    """
    if max_bits > 5:
        raise ValueError("three parts find all pairs within five bits only")
    homes = _grid_rows(fps, probes=False).groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > tile)
    rows = _grid_rows(fps, probes=True).join(homes.withColumn("m", F.ceil(F.col("n") / tile).cast("int")).drop("n"), "cell", "left")
    many = F.coalesce("m", F.lit(1))
    own = F.pmod(F.xxhash64("fp"), many).cast("int")
    every = F.explode(F.sequence(F.lit(0), many - 1))
    # A home is also a probe of its own cell where the cell is cut; both tiles are then named.
    plain = rows.filter("m is null").select("cell", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp", "home")
    cut = rows.filter("m is not null")
    cut_homes = cut.filter("home").select("cell", own.alias("i"), every.alias("j"), "fp", F.lit(True).alias("home"))
    cut_probes = cut.select("cell", every.alias("i"), own.alias("j"), "fp", F.lit(False).alias("home"))
    dealt = plain.unionByName(cut_homes).unionByName(cut_probes).repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", F.col("home").desc())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(parts: list[np.ndarray], upto: int) -> Iterator[pa.RecordBatch]:
            cell, fp, home = (p[:upto] for p in parts)
            for a, b in links_in(cell, fp.view(np.uint64), home, max_bits):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        held: list[np.ndarray] | None = None
        number = 0
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(k).to_numpy().astype(np.int64) for k in range(3)], 1)
            new = np.r_[last is None or (keys[0] != last).any(), (keys[1:] != keys[:-1]).any(axis=1)]
            group = number + np.cumsum(new)
            number, last = int(group[-1]), keys[-1]
            parts = [group, b.column(3).to_numpy(), b.column(4).to_numpy(zero_copy_only=False)]
            held = parts if held is None else [np.concatenate(x) for x in zip(held, parts)]
            # The last group may go on in the next batch.
            whole = int(np.searchsorted(held[0], held[0][-1]))
            if whole:
                yield from linked(held, whole)
                held = [x[whole:] for x in held]
        if held is not None:
            yield from linked(held, len(held[0]))

    return dealt.mapInArrow(compare, "a long, b long")


# ---------------------------------------------------------------- groups


def _groups(own: DataFrame, max_bits: int) -> DataFrame:
    """``fp``, ``root`` (of its component) and ``component_id`` for the fingerprints of ``own``.

    Equal fingerprints are one node from the start, so thousands of copies cost one.
    """
    nodes = stored(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    found = components(links(nodes, max_bits))
    reached = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = reached.groupBy("root").agg(F.min("first").alias("component_id"))
    return reached.join(smallest, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``, the
    smallest ``doc_id`` reachable over links.

    A null text is an empty one; texts without words share fingerprint 0. Null ids are never the
    smallest; a group of them alone has a null ``component_id``. Repeated rows are returned each; an
    empty table gives no rows.
    """
    own = stored(fingerprints(corpus(docs)), "fingerprints")
    return own.join(_groups(own, max_bits), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def row_key() -> Column:
    """128 bits that name a row by its ``doc_id`` and ``text``."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(" "), text_of()))


def keep_one(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each group, with all its columns: the smallest ``doc_id``, nulls last, and of
    several rows with that id and text any one."""
    key = unused(docs, "row_key")
    own = stored(fingerprints(corpus(docs).withColumn(key, row_key())), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", key))
    kept = own.join(_groups(own, max_bits), "fp").groupBy("root").agg(first.alias("first")).select(F.col("first")[key].alias(key))
    chosen = docs.withColumn(key, row_key()).join(kept, key, "left_semi").dropDuplicates([key])
    return chosen.select(*[F.col(f"`{c}`") for c in docs.columns])
