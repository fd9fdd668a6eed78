"""Best-fit packing of token sequences, planned on the histogram of lengths.

Only the counts per length reach the driver: at most ``capacity`` numbers, however large the corpus.
Best fit runs over runs of equal bins instead of single documents and gives, per length, which ranks
go to which run of sequences. Pieces then find their place by their rank within their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlens.llm.common import corpus, stored
from matchlens.llm.pretokens import piece_memo, vocabulary_path

CAPACITY = 2048
#: Pieces of one length that are ranked together; a length with more is split by hash.
RANKED_TOGETHER = 100_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Slots(NamedTuple):
    """Ranks from ``first`` on (up to the next row of the length) lie ``per`` to a sequence, from
    sequence ``sequence`` on, the first of each at ``offset``."""

    length: int
    first: int
    sequence: int
    offset: int
    per: int


def plan_slots(counts: dict[int, int], capacity: int) -> list[Slots]:
    """Best fit, longest first, over counts.

    Equal bins are kept as runs of sequence numbers by the room left in them. A length takes the runs
    with the least sufficient room; every run is taken whole but for the last, which is cut in at most
    three. So a length adds three runs at most, a run meets at most about sqrt(2 * capacity) lengths,
    and the plan has at most 3 * capacity * sqrt(2 * capacity) rows for any number of documents.
    """
    rooms: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    plan: list[Slots] = []
    used = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        for room in range(length, capacity + 1):
            if not left:
                break
            if room == capacity:
                bins = -(-left // (capacity // length))
                rooms[room].append((used, bins))
                used += bins
            per = room // length
            while left and rooms[room]:
                first, bins = rooms[room].pop()
                whole = min(bins, left // per)
                if whole:
                    plan.append(Slots(length, rank, first, capacity - room, per))
                    rooms[room - per * length].append((first, whole))
                    rank, left = rank + whole * per, left - whole * per
                first, bins = first + whole, bins - whole
                if bins and left and left < per:
                    plan.append(Slots(length, rank, first, capacity - room, left))
                    rooms[room - left * length].append((first, 1))
                    first, bins, left = first + 1, bins - 1, 0
                if bins:
                    rooms[room].append((first, bins))
    return plan


def encoded_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """Token pieces of every document: ids by the vocabulary's library, then ``end_id``.

    A document over ``capacity`` is cut into full pieces, but for its first, which takes the rest.
    ``ids``, which may be left out, holds little-endian unsigned 16-bit numbers.
    """
    schema = PIECES + (", ids binary" if with_ids else "")
    names = [p.split()[0] for p in schema.split(", ")]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = piece_memo(vocabulary)
        end = end_id.to_bytes(2, "little")
        for batch in batches:
            rows: list[tuple] = []
            texts = batch.column(1).to_pylist()
            for doc, ids in zip(batch.column(0).to_pylist(), memo.ids(texts)):
                ids += end
                n = len(ids) // 2
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    part = ids[2 * a : 2 * b]
                    crc = zlib.crc32(np.frombuffer(part, "<u2").astype("<u4").tobytes())
                    rows.append((doc, piece, a, b - a, crc, part) if with_ids else (doc, piece, a, b - a, crc))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = zip(*rows) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return corpus(docs).mapInArrow(encode, schema)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset``. ``pieces`` should be a stored table: it is read thrice.

    The rank of a piece within its length is its rank within a hash part of the length plus what the
    parts before hold, so a length that most pieces share is still spread over tasks.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_slots(counts, capacity)
    parts = -(-max(counts.values(), default=1) // RANKED_TOGETHER)
    part = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(parts)).cast("int")

    pieces = pieces.withColumn("part", part)
    per_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        pieces.withColumn("rank", F.row_number().over(within).cast("long") - 1)
        .join(base, ["length", "part"])
        .withColumn("rank", F.col("rank") + F.col("base"))
    )
    rows = spark.createDataFrame(plan, "length long, first long, sequence long, at long, per long")
    slots = rows.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "sequence", "at", "per"))).alias("slots"))
    # The plan's size is bounded by the capacity alone; see plan_slots.
    placed = ranked.join(F.broadcast(slots), "length").withColumn(
        "slot", F.expr("element_at(filter(slots, s -> s.first <= rank), -1)")
    )
    step = F.col("rank") - F.col("slot.first")
    return placed.select(
        *[c for c in pieces.columns if c != "part"],
        (F.col("slot.sequence") + F.floor(step / F.col("slot.per"))).alias("sequence_id"),
        (F.col("slot.at") + F.pmod(step, F.col("slot.per")) * F.col("length")).alias("offset"),
    )


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """One row per piece: its document, place in the document, ids if wanted, checksum, sequence and offset.

    A null or empty text is the end id alone. Repeated rows are packed each; rows alike in all of
    ``doc_id``, piece and ids may swap places. An empty table gives no rows. Very long texts become
    many pieces. The pieces are stored once in the shared folder.
    """
    pieces = stored(encoded_pieces(docs, vocabulary or vocabulary_path(), capacity, end_id, with_ids), "pieces")
    return place(pieces, capacity)
