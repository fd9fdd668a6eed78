"""Ranked lexical search over posting lists cut into blocks of similar documents.

The index serves a set of items (queries). Documents are taken in segments of a bounded size. In a
segment each term has a posting list, and each list is clustered by itself: some of its documents lead,
every other joins the leader it is most similar to, by inner product of random projections of the weighted
vectors. A cluster is a block. A block keeps, per term that some item asks for together with the list's
term, the largest impact of its documents (the coordinatewise maximum). The inner product of that summary
with an item is an exact upper bound of the item's score in the block: integers below 2**53 in doubles.

Searching goes through an item's lists from the one that can add most. Lists whose bounds together cannot
reach the item's tenth score are not opened, and of an opened one only blocks whose bound reaches it are
scored. A block whose bound equals the tenth score is scored, as a smaller ``doc_id`` may be in it. So
nothing that belongs into the result is left out, whatever the blocks look like.

A segment is scored for all items by one task; a task keeps the best rows of each item, and only those are
shuffled. A segment's arrays, mostly zeros, are stored compressed and unpacked one segment at a time, since
Spark hands a task many rows at once. Texts are read once per block of items and never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlens.llm.common import corpus, stored, text_of

#: Distinct (item, term) entries searched for in one pass over the documents; more items take more passes.
ITEM_ENTRIES = 1 << 17
#: Documents of a segment at most, and documents times terms at most.
SEGMENT_DOCS = 1024
SEGMENT_CELLS = 1 << 23
#: Documents per block aimed at.
BLOCK_DOCS = 64
#: Directions of the projection that tells which documents are similar, and its seed.
DIRECTIONS = 48
SEED = 13
#: Parts in which the tasks' best rows of one item are thinned out before they meet.
PARTS = 32

# ASCII letters (A-Z to a-z), digits and all bytes beyond ASCII make up terms.
_TERM_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
# Fixed values of the score: scale of the logarithm, of the share, and the length weights in hundredths.
LOG_SCALE, SHARE_SCALE, TF_SCALE, NORM_SCALE, LENGTH_SHARE = 1000, 1_000_000_000, 1000, 8, 75

VECTOR = "doc_id long, n long, terms binary, times binary"
SEGMENT = "doc_ids binary, nulls binary, widths binary, terms binary, shares binary, lists binary, blocks binary, sizes binary, members binary, summaries binary"
BEST = "item long, score long, doc_id long"


def terms_of(text: str) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return text.encode().translate(_TERM_BYTES).split()


@dataclass(frozen=True)
class Wanted:
    """Items of one pass: their terms' numbers, and per item the terms and how often it has them."""

    numbers: dict[bytes, int]
    items: list[tuple[int, np.ndarray, np.ndarray]]

    @staticmethod
    def of(rows) -> Wanted:
        numbers: dict[bytes, int] = {}
        items = []
        for item, terms, times in rows:
            ids = [numbers.setdefault(bytes(t), len(numbers)) for t in terms]
            items.append((item, np.asarray(ids, np.int64), np.asarray(times, np.float64)))
        return Wanted(numbers, items)

    def holders(self) -> list[np.ndarray]:
        """Per term the places of the items that have it."""
        found: list[list[int]] = [[] for _ in self.numbers]
        for place, (_, ids, _) in enumerate(self.items):
            for t in ids.tolist():
                found[t].append(place)
        return [np.asarray(f, np.int64) for f in found]

    def columns(self, places: np.ndarray) -> np.ndarray:
        """The terms, ascending, that any of these items has."""
        return np.unique(np.concatenate([self.items[p][1] for p in places.tolist()]))


def item_terms(items: DataFrame) -> DataFrame:
    """``item`` (a number per row), ``item_id``, and its distinct ``terms`` with their ``times``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [dict(zip(*np.unique(np.asarray(t, object), return_counts=True))) if (t := terms_of(text)) else {} for text in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([list(f) for f in found], pa.list_(pa.binary())), pa.array([[int(v) for v in f.values()] for f in found], pa.list_(pa.int64()))],
                names=["item", "item_id", "terms", "times"],
            )

    given = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), text_of().alias("text"))
    return stored(given.mapInArrow(count, "item long, item_id long, terms array<binary>, times array<long>"), "search-items")


def vectors(docs: DataFrame, wanted: Wanted) -> DataFrame:
    """Per document with a term its number of terms, and the wanted ones with how often each occurs."""
    numbers = docs.sparkSession.sparkContext.broadcast(wanted.numbers)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = numbers.value.get
        for b in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                terms = terms_of(text)
                if terms:
                    ids = np.fromiter(map(number, terms, repeat(-1)), np.int64, len(terms))
                    ids, times = np.unique(ids[ids >= 0], return_counts=True)
                    rows.append((doc_id, len(terms), ids.astype("<u4").tobytes(), times.astype("<u4").tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            columns = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "n", "terms", "times"])

    return stored(corpus(docs).mapInArrow(count, VECTOR), "search-vectors")


def holding_documents(found: DataFrame, n_terms: int) -> np.ndarray:
    """Per term the number of documents that hold it: one row per task and term, summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for b in batches:
            ids = np.frombuffer(b"".join(b.column(0).to_pylist()), "<u4")
            total += np.bincount(ids, minlength=n_terms)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "df"])

    rows = found.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(n_terms, np.int64)
    for term, n in rows:
        df[term] = n
    return df


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.asarray([math.floor(LOG_SCALE * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.float64)


def shares(n: np.ndarray, times: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The part of a term's impact that depends on the document, in whole numbers."""
    m = 100 - LENGTH_SHARE + (LENGTH_SHARE * n * n_docs) // n_terms
    return (SHARE_SCALE * times) // (TF_SCALE * times + NORM_SCALE * m)


def build(found: DataFrame, wanted: Wanted, weight: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """The index: one stored row per segment."""
    width = len(wanted.numbers)
    most = max(16, min(SEGMENT_DOCS, SEGMENT_CELLS // max(width, 1)))
    given = found.sparkSession.sparkContext.broadcast((wanted, weight))

    def segment(rows: list[tuple], columns: list[np.ndarray], directions: np.ndarray) -> dict[str, bytes]:
        n = len(rows)
        widths = np.asarray([len(r[2]) // 4 for r in rows])
        of = np.repeat(np.arange(n), widths)
        terms = np.frombuffer(b"".join(r[2] for r in rows), "<u4").astype(np.int64)
        times = np.frombuffer(b"".join(r[3] for r in rows), "<u4").astype(np.int64)
        values = shares(np.asarray([r[1] for r in rows], np.int64)[of], times, n_docs, n_terms).astype("<u4")
        table = np.zeros((n, width), np.uint32)
        table[of, terms] = values
        near = table.astype(np.float32) @ (weight.astype(np.float32)[:, None] * directions)
        near /= np.maximum(np.linalg.norm(near, axis=1, keepdims=True), 1e-30)
        alike = near @ near.T
        by_term = np.argsort(terms, kind="stable")
        lists, first = np.unique(terms[by_term], return_index=True)
        blocks, sizes, members, summaries = [], [], [], []
        for t, docs in zip(lists.tolist(), np.split(of[by_term], first[1:])):
            k = -(-len(docs) // BLOCK_DOCS)
            if k > 1:
                leaders = docs[np.arange(k) * len(docs) // k]
                joined = alike[np.ix_(docs, leaders)].argmax(1)
                docs = docs[np.argsort(joined, kind="stable")]
                size = np.bincount(joined, minlength=k)
                size = size[size > 0]
            else:
                size = np.asarray([len(docs)])
            blocks.append(len(size))
            sizes.append(size)
            members.append(docs)
            summaries.append(np.maximum.reduceat(table[np.ix_(docs, columns[t])], np.cumsum(size) - size, axis=0).ravel())
        parts = {
            "doc_ids": np.asarray([r[0] or 0 for r in rows], "<i8"),
            "nulls": np.asarray([r[0] is None for r in rows], "u1"),
            "widths": widths.astype("<u4"),
            "terms": terms.astype("<u4"),
            "shares": values,
            "lists": lists.astype("<u4"),
            "blocks": np.asarray(blocks, "<u4"),
            "sizes": np.concatenate(sizes).astype("<u4"),
            "members": np.concatenate(members).astype("<u4"),
            "summaries": np.concatenate(summaries).astype("<u4"),
        }
        pack = zstandard.ZstdCompressor(level=1).compress
        return {c: pack(a.tobytes()) for c, a in parts.items()}

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, _ = given.value
        columns = [wanted.columns(h) for h in wanted.holders()]
        directions = np.random.default_rng(SEED).choice(np.float32([-1, 1]), (width, DIRECTIONS))
        rows: list[tuple] = []

        def row() -> pa.RecordBatch:
            made = segment(rows, columns, directions)
            return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in made.values()], names=list(made))

        for b in batches:
            for one in zip(*(c.to_pylist() for c in b.columns)):
                rows.append(one)
                if len(rows) == most:
                    yield row()
                    rows = []
        if rows:
            yield row()

    return stored(found.filter(F.octet_length("terms") > 0).mapInArrow(gather, SEGMENT), "search-index")


class Best:
    """The ``k`` best documents of each item: highest score first, then smallest ``doc_id``, null last."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.rows: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3] * n_items
        self.least = np.ones(n_items)

    def add(self, place: int, *found: np.ndarray) -> None:
        score, null, doc_id = (np.concatenate(p) for p in zip(self.rows[place], found))
        order = np.lexsort((doc_id, null, -score))[: self.k]
        self.rows[place] = (score[order], null[order], doc_id[order])
        if len(order) == self.k:
            self.least[place] = max(score[order[-1]], 1)


class Segment:
    """One stored row of the index, ready to be searched."""

    def __init__(self, row: dict[str, bytes], width: int, columns: list[np.ndarray]):
        unpack = zstandard.ZstdDecompressor().decompress
        take = lambda c, kind: np.frombuffer(unpack(row[c]), kind).astype(np.int64)
        self.doc_ids, self.nulls = take("doc_ids", "<i8"), take("nulls", "u1")
        n = len(self.doc_ids)
        self.table = np.zeros((n, width), np.uint32)
        self.table[np.repeat(np.arange(n), take("widths", "<u4")), take("terms", "<u4")] = np.frombuffer(unpack(row["shares"]), "<u4")
        self.top = self.table.max(axis=0, initial=0).astype(np.float64)
        sizes, members = take("sizes", "<u4"), take("members", "<u4")
        summaries = np.frombuffer(unpack(row["summaries"]), "<u4")
        self.lists: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        block = posting = cell = 0
        for t, n_blocks in zip(take("lists", "<u4").tolist(), take("blocks", "<u4").tolist()):
            size = sizes[block : block + n_blocks]
            wide = len(columns[t])
            self.lists[t] = (size, members[posting : posting + size.sum()], summaries[cell : cell + n_blocks * wide].reshape(n_blocks, wide))
            block, posting, cell = block + n_blocks, posting + int(size.sum()), cell + n_blocks * wide

    def reaching(self, t: int, columns: np.ndarray, factors: np.ndarray, least: float) -> np.ndarray:
        """Documents of the list's blocks whose bound is not below ``least``."""
        size, members, summary = self.lists[t]
        bound = summary @ factors[columns]
        return members[np.repeat(bound >= least, size)]

    def search(self, place: int, ids: np.ndarray, factors: np.ndarray, columns: list[np.ndarray], best: Best) -> None:
        """Add this segment's documents that may be among the item's best; ``factors`` is by term."""
        most = self.top[ids] * factors[ids]
        order = np.argsort(-most, kind="stable")
        rest = np.cumsum(most[order][::-1])[::-1]
        seen = np.zeros(len(self.doc_ids), bool)
        for t, still in zip(ids[order].tolist(), rest.tolist()):
            if still < best.least[place]:
                break
            if t not in self.lists:
                continue
            docs = self.reaching(t, columns[t], factors, best.least[place])
            docs = docs[~seen[docs]]
            if not len(docs):
                continue
            seen[docs] = True
            score = (self.table[np.ix_(docs, ids)] @ factors[ids]).astype(np.int64)
            docs, score = docs[score >= best.least[place]], score[score >= best.least[place]]
            if len(docs):
                best.add(place, score, self.nulls[docs], self.doc_ids[docs])


def search(index: DataFrame, wanted: Wanted, weight: np.ndarray, k: int) -> DataFrame:
    """``item``, ``score`` and ``doc_id`` of each task's best documents."""
    given = index.sparkSession.sparkContext.broadcast((wanted, weight))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weight = given.value
        columns = [wanted.columns(h) for h in wanted.holders()]
        best = Best(len(wanted.items), k)
        factors = np.zeros(len(weight))
        for b in batches:
            for i in range(b.num_rows):
                segment = Segment({c: b.column(c)[i].as_buffer() for c in b.schema.names}, len(weight), columns)
                for place, (_, ids, times) in enumerate(wanted.items):
                    factors[ids] = weight[ids] * times
                    segment.search(place, ids, factors, columns, best)
                    factors[ids] = 0
        for (item, _, _), (score, null, doc_id) in zip(wanted.items, best.rows):
            if len(score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(score), item)), pa.array(score), pa.array(doc_id, mask=null.astype(bool))],
                    names=["item", "score", "doc_id"],
                )

    return index.mapInArrow(find, BEST)


def rank(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id`` and ``score`` of each item's ``k`` best documents above score 0.

    ``docs`` has ``doc_id`` and ``text``, ``items`` has ``item_id`` and ``text``; other columns are not
    looked at. A null text has no terms. A document without a term counts nowhere; an item without one,
    an empty table of items or of documents give no rows. Repeated documents are ranked each, equal scores
    by ``doc_id`` with null last. Repeated items and items without a number are answered row by row.
    Items come in passes of about ``ITEM_ENTRIES`` entries by hash, so what a pass sends to the driver and
    to the tasks is bounded by that and by the longest single item.
    """
    asked = item_terms(items)
    entries = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    passes = -(-entries // ITEM_ENTRIES)
    made = []
    for p in range(passes):
        part = asked.filter((F.size("terms") > 0) & (F.pmod(F.xxhash64("item"), F.lit(passes)) == p))
        wanted = Wanted.of(part.select("item", "terms", "times").collect())
        found = vectors(docs, wanted)
        n_docs, n_terms = found.agg(F.count("*"), F.sum("n")).first()
        if n_docs and wanted.items:
            weight = weights(n_docs, holding_documents(found, len(wanted.numbers)))
            made.append(search(build(found, wanted, weight, n_docs, n_terms), wanted, weight, k))
    best = docs.sparkSession.createDataFrame([], BEST)
    for m in made:
        best = best.union(m)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = F.pmod(F.xxhash64("doc_id", "score"), F.lit(PARTS))
    thinned = best.withColumn("rank", F.row_number().over(Window.partitionBy("item", part).orderBy(*order))).filter(F.col("rank") <= k)
    ranked = thinned.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
