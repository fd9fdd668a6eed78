"""Frequencies of terms per document, kept as postings of document blocks.

A block is some megabytes of documents in the order a task meets them. Per block there is one row per
distinct term with the documents that hold it, so a term that every document holds costs one row per
block, not per document. A document is named by its slot: the block's number and its place in it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text bytes after which a block is closed.
BLOCK_BYTES = 16 << 20
#: Bits of a slot for the place in the block; a block is closed before they run out.
PLACE_BITS = 16
#: Bits of a slot for the number of the block in its task.
BLOCK_BITS = 20
#: Rows per Arrow batch sent on.
ROWS = 50_000
#: Entries a task sums up before it sends partial sums on.
PENDING = 1_000_000

POSTINGS = (
    "term binary, block long, places binary, times binary, n_flagged long,"
    " doc_id long, slot long, n_bytes long, n_terms long, value double, flag boolean"
)

#: For each text its terms and a value that is carried along.
Splitter = Callable[[list[str]], "Iterator[tuple[list[bytes] | list[str], float | None]]"]


class _Numbering(dict):
    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def _batches(n: int) -> Iterator[slice]:
    return (slice(a, min(a + ROWS, n)) for a in range(0, n, ROWS))


def _pack(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column whose row ``i`` is ``flat[ends[i]:ends[i + 1]]``."""
    size = flat.itemsize
    begin = int(ends[0])
    offsets = ((ends - begin) * size).astype(np.int32)
    data = np.ascontiguousarray(flat[begin : int(ends[-1])])
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


class _Block:
    def __init__(self, number: int):
        self.number = number
        self.numbering = _Numbering()
        self.terms: list[np.ndarray] = []
        self.docs: list[tuple] = []
        self.size = 0

    def add(self, doc_id: int | None, n_bytes: int, terms, value: float | None, flag: bool) -> None:
        place = len(self.docs)
        self.docs.append((doc_id, self.number << PLACE_BITS | place, n_bytes, len(terms), value, flag))
        if terms:
            ids = np.fromiter(map(self.numbering.__getitem__, terms), np.int64, len(terms))
            self.terms.append(ids << PLACE_BITS | place)
        self.size += n_bytes

    def rows(self) -> Iterator[pa.RecordBatch]:
        """The postings, then a row per document. Times over 255 are several entries."""
        kinds = [pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()]
        names = [c.split()[0] for c in POSTINGS.split(", ")]

        def batch(n: int, given: dict[str, pa.Array]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([given[c] if c in given else pa.nulls(n, k) for c, k in zip(names, kinds)], names=names)

        if self.terms:
            keys, times = np.unique(np.concatenate(self.terms), return_counts=True)
            again = (times + 254) // 255
            keys = np.repeat(keys, again)
            last = np.cumsum(again) - 1
            capped = np.full(len(keys), 255, np.uint8)
            capped[last] = times - 255 * (again - 1)
            places = (keys & (1 << PLACE_BITS) - 1).astype("<u2")
            ends = np.searchsorted(keys >> PLACE_BITS, np.arange(len(self.numbering) + 1))
            flags = np.fromiter((d[-1] for d in self.docs), np.int64, len(self.docs))
            flagged = np.add.reduceat(flags[places] * capped, ends[:-1])
            terms = list(self.numbering)
            for part in _batches(len(terms)):
                bounds = ends[part.start : part.stop + 1]
                words = [t if isinstance(t, bytes) else t.encode() for t in terms[part]]
                n = len(words)
                yield batch(n, {"term": pa.array(words, pa.binary()), "block": pa.array(np.full(n, self.number)), "places": _pack(places, bounds), "times": _pack(capped, bounds), "n_flagged": pa.array(flagged[part])})
        for part in _batches(len(self.docs)):
            columns = list(zip(*self.docs[part]))
            yield batch(len(columns[0]), {c: pa.array(v, k) for c, k, v in zip(names[5:], kinds[5:], columns)})


def postings(docs: DataFrame, splitter: Callable[[], Splitter], flag=None, block_bytes: int | None = None) -> DataFrame:
    """Rows of two kinds: postings (``term`` set) and documents (``slot`` set).

    ``docs`` has ``doc_id`` and ``text``. ``splitter`` makes the function that splits a text, in the
    worker. Blocks close at ``block_bytes``, by default ``BLOCK_BYTES``. ``flag`` is a boolean column of
    the documents to carry along. Tasks take their documents in order of id and text, so a task that is
    run again names them alike.
    """
    flag = F.lit(False) if flag is None else flag
    most = block_bytes or BLOCK_BYTES
    ordered = docs.select("doc_id", "text", flag.alias("flag")).sortWithinPartitions("doc_id", "text")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter()
        first = TaskContext.get().partitionId() << BLOCK_BITS
        block = _Block(first)
        for b in (b.slice(i, 1_000) for b in batches for i in range(0, b.num_rows, 1_000)):
            texts = b.column(1).to_pylist()
            for doc_id, text, flagged, found in zip(b.column(0).to_pylist(), texts, b.column(2).to_pylist(), split(texts)):
                block.add(doc_id, len(text.encode()), *found, flagged)
                if block.size >= most or len(block.docs) == 1 << PLACE_BITS:
                    yield from block.rows()
                    block = _Block(block.number + 1)
        yield from block.rows()

    return ordered.mapInArrow(build, POSTINGS)


def block_rows(number: int, docs: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """The rows of one block of at most ``1 << PLACE_BITS`` documents: id, bytes, terms, value and flag."""
    block = _Block(number)
    for doc in docs:
        block.add(*doc)
    return block.rows()


def flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """A binary column's bytes as one array, and the entries in each row."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    entries = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(kind) if data is not None else np.zeros(0, kind)
    return entries, np.diff(offsets) // np.dtype(kind).itemsize


class SlotSums:
    """Sums per slot, handed on as partial sums when many are pending."""

    def __init__(self, columns: int):
        self.columns = columns
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.pending = 0

    def add(self, block: np.ndarray, places: pa.Array, times: pa.Array, *values: np.ndarray) -> None:
        """Add ``times * value`` of each posting row to its documents."""
        at, each = flat(places, "<u2")
        count, _ = flat(times, "u1")
        slots = np.repeat(block << PLACE_BITS, each) | at
        self.parts.append((slots, *[np.repeat(v, each) * count for v in values]))
        self.pending += len(slots)
        if self.pending > PENDING:
            self._merge()

    def _merge(self) -> None:
        slots, which = np.unique(np.concatenate([p[0] for p in self.parts]), return_inverse=True)
        sums = [np.bincount(which, np.concatenate([p[k + 1] for p in self.parts]), len(slots)) for k in range(self.columns)]
        self.parts = [(slots, *sums)]
        self.pending = len(slots)

    def full(self) -> bool:
        return self.pending > PENDING // 2

    def take(self) -> pa.RecordBatch:
        """One row per block: its places, and their sums one array after the other."""
        if not self.parts:
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), *[pa.array([], pa.binary())] * 2], names=["block", "places", "sums"])
        self._merge()
        slots, *sums = self.parts[0]
        self.parts, self.pending = [], 0
        blocks, first = np.unique(slots >> PLACE_BITS, return_index=True)
        ends = [*first[1:].tolist(), len(slots)]
        places = (slots & (1 << PLACE_BITS) - 1).astype("<u2")
        each = list(zip(first.tolist(), ends))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(blocks),
                pa.array([places[a:b].tobytes() for a, b in each], pa.binary()),
                pa.array([b"".join(s[a:b].astype("<f8").tobytes() for s in sums) for a, b in each], pa.binary()),
            ],
            names=["block", "places", "sums"],
        )


DOCUMENT = "doc_id long, slot long, n_bytes long, n_terms long, value double, flag boolean"
PARTIAL = "block long, places binary, sums binary"


def documents_of(rows: DataFrame) -> DataFrame:
    """The rows of :func:`postings` that stand for documents, with their ``block``."""
    names = [c.split()[0] for c in DOCUMENT.split(", ")]
    return rows.filter("slot is not null").select(F.shiftright("slot", PLACE_BITS).alias("block"), *names)


def totals(rows: DataFrame, columns: int) -> DataFrame:
    """Documents with ``sum0``, ``sum1``, ...: from rows that are documents (``slot`` set) or partial sums
    (``places`` set), all of a block meeting in one task."""
    names = [c.split()[0] for c in DOCUMENT.split(", ")]

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros((columns, 1 << PLACE_BITS))
        partial = group.filter(group["places"].is_valid())
        for places, sums in zip(partial["places"].to_pylist(), partial["sums"].to_pylist()):
            at = np.frombuffer(places, "<u2")
            total[:, at] += np.frombuffer(sums, "<f8").reshape(columns, -1)
        docs = group.filter(group["slot"].is_valid()).select(names)
        at = docs["slot"].to_numpy() & (1 << PLACE_BITS) - 1
        for k in range(columns):
            docs = docs.append_column(f"sum{k}", pa.array(total[k, at]))
        return docs

    schema = DOCUMENT + "".join(f", sum{k} double" for k in range(columns))
    return rows.groupBy("block").applyInArrow(add, schema)
