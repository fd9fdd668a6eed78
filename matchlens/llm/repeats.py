"""Removal of long passages that a document with a smaller id already has.

A byte goes when a string of ``LENGTH`` bytes over it also starts in a document with a smaller id. The
corpus is taken apart so that every two equal strings of that length meet in one bounded task:

1. Blocks. The documents are stored once, some megabytes to a block, bucketed by block, so that the
   later steps move only small tables to them.
2. Anchors. Of the 16-byte grams in a string the one with the least hash is its anchor; equal strings
   have equal anchors. An occurrence of an anchor has a passage: the strings whose anchor it is, at most
   34 bytes on either side. Each block tells the hashes of its distinct anchors and passages, with the
   smallest document of each passage, and learns of each whether a smaller document has the very same one
   (all its strings go), else whether other passages have its anchor. Only those go on.
3. Passages. They are sent with their bytes, equal ones from the smallest document alone, and meet by
   anchor. An anchor that too many passages share is taken string by string instead; those meet
   by their own hash, and as wholes. A row holds what a block has for many anchors, so that rows stay
   long as blocks grow in number.
4. Index. The distinct passages of an anchor are repetitive. Their Burrows-Wheeler transform is kept as
   runs, with the suffix position sampled at every run's end, and the intervals of rows that start with
   the same ``LENGTH`` bytes with the smallest document in each. Every passage is streamed through the
   runs from its end, one LF step per byte; the row it reaches says how long a match starts there and
   whether a smaller document has it.
5. Marks. Blocks get one bit per passage and string back, find their passages once more, unite the
   marked strings and cut them out. Passages are moved once and stored nowhere else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlens.llm.common import corpus, fresh_path, stored, unused
from matchlens.llm.simhash import row_key

LENGTH = 50
GRAM = 16
#: Bytes on either side of an anchor that a string of ``LENGTH`` bytes with it can reach.
REACH = LENGTH - GRAM
FRAME = 2 * REACH + GRAM
STRINGS = REACH + 1
#: Never a byte of UTF-8: parts documents, and fills passages beyond a document's ends.
NONE = 0xFF
#: Text bytes after which a block is closed.
BLOCK_BYTES = 4 << 20
#: Bytes looked at together when anchors are chosen.
SLICE = 1 << 20
#: Passages that are cut out and hashed together.
FRAMES_AT_ONCE = 20_000
#: Passages whose hashes, and bytes of passages that, should meet in one task.
ANCHORS_TOGETHER = 1_000_000
PASSAGES_TOGETHER = 32 << 20
#: Bytes of passages that are indexed together, and tasks up to which such lots are dealt one by one.
INDEXED_TOGETHER = 1 << 18
LOTS = 256
#: Passages of one anchor, distinct in the corpus, beyond which its strings go their own ways.
HOT = 30_000
#: Stands for a null id, and for no document.
LAST = np.iinfo(np.int64).max

ANCHOR_ROWS = "bucket long, block long, anchors binary, passages binary, firsts binary"
CODE_ROWS = "bucket long, block long, codes binary, shared long"
PASSAGE_ROWS = "bucket long, block long, passages binary, firsts binary, n long"
MASK_ROWS = "block long, bucket long, masks binary"
#: What a block learns of a passage: no other has its anchor; others do; too many do; a smaller document has it.
ALONE, SHARED, CROWDED, COVERED = range(4)


# ---------------------------------------------------------------- anchors


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as one number."""
    x = data.astype(np.uint64)
    for step in (1, 2, 4):
        x = x[:-step] | x[step:] << np.uint64(8 * step)
    return x


def _extreme(x: np.ndarray, width: int, pick) -> np.ndarray:
    """Least or greatest of every ``width`` neighbours."""
    span = 1
    while 2 * span <= width:
        x = pick(x[:-span], x[span:])
        span *= 2
    return pick(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def anchors_in(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of all strings in ``data``, and the first and last string
    whose anchor each is, counted from ``REACH`` bytes before it. ``NONE`` bytes part documents."""
    found = []
    for begin in range(0, len(data), SLICE):
        end = min(begin + SLICE, len(data))
        low, high = max(0, begin - REACH), min(len(data), end + LENGTH)
        part = data[low:high]
        if len(part) < LENGTH:
            continue
        eight = words_at(part)
        gram = mixed(eight[:-8] ^ mixed(eight[8:]))
        whole = np.cumsum(np.r_[0, part == NONE])
        whole = whole[LENGTH:] == whole[:-LENGTH]
        least = _extreme(gram, STRINGS, np.minimum)
        least[~whole] = 0
        edge = np.zeros(REACH, np.uint64)
        greatest = _extreme(np.r_[edge, least, edge], STRINGS, np.maximum)
        chosen = np.flatnonzero((greatest == gram) & (gram > 0))
        chosen = chosen[(chosen >= begin - low) & (chosen < end - low)]
        own = sliding_window_view(np.r_[edge, least, edge], STRINGS)[chosen] == gram[chosen][:, None]
        first, last = own.argmax(axis=1), REACH - own[:, ::-1].argmax(axis=1)
        found.append((chosen + low, gram[chosen], first.astype(np.uint8), last.astype(np.uint8)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.uint8)
    return tuple(np.concatenate(x) for x in zip(*found))


def passages_at(data: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The frame of ``FRAME`` bytes about each anchor, ``NONE`` outside strings ``first`` to ``last``."""
    pad = np.full(FRAME, NONE, np.uint8)
    place = np.arange(FRAME, dtype=np.uint8)
    around = sliding_window_view(np.r_[pad, data, pad], FRAME)
    frames = np.empty((len(at), FRAME), np.uint8)
    for i in range(0, len(at), FRAMES_AT_ONCE):
        part = slice(i, i + FRAMES_AT_ONCE)
        frame = around[at[part] + FRAME - REACH]
        frame[(place < first[part, None]) | (place >= last[part, None] + np.uint8(LENGTH))] = NONE
        frames[part] = frame
    return frames


def _as_records(frames: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(frames).view(f"V{FRAME}").ravel()


def _frame_hash(frames: np.ndarray) -> np.ndarray:
    out = np.zeros(len(frames), np.uint64)
    for i in range(0, len(frames), FRAMES_AT_ONCE):
        part = frames[i : i + FRAMES_AT_ONCE]
        wide = np.zeros((len(part), -(-FRAME // 8) * 8), np.uint8)
        wide[:, :FRAME] = part
        for column in wide.view(np.uint64).T:
            out[i : i + len(part)] = mixed(out[i : i + len(part)] ^ column)
    return out


# ---------------------------------------------------------------- index


class RunIndex(NamedTuple):
    """A run-compressed Burrows-Wheeler transform of passages.

    Row j lies in run r = ``run[j]``, which counts the run heads up to j; ``begin[r]`` is its first row, and
    the LF step takes j to ``target[r] + j - begin[r]``. ``sample[r]`` is the text position of the run's last
    row. ``interval[j]`` numbers the intervals of rows that start with the same ``LENGTH`` bytes, ``least`` is
    the smallest document in each, ``LAST`` where fewer bytes follow.
    """

    begin: np.ndarray
    run: np.ndarray
    symbol: np.ndarray
    target: np.ndarray
    sample: np.ndarray
    interval: np.ndarray
    least: np.ndarray


def suffix_order(text: np.ndarray, end: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array, and ranks by the first 32 symbols, of passages in a row.

    ``text`` has 0 where a passage ends; ``end`` is the position of that 0 for every position, ``number``
    the passage. Suffixes that are equal up to their ends are ordered by passage. Ranks double from
    eight symbols on.
    """
    n = len(text)
    left = (end - np.arange(n)).astype(np.uint8)
    padded = np.r_[text, np.zeros(8, np.uint8)]
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | np.where(left > k, padded[k : n + k], 0).astype(np.uint64)
    passages = int(number[-1]) + 1 if n else 0
    span, at_32 = 8, None
    while True:
        order = np.argsort(key).astype(np.int32)
        key = key[order]
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(np.r_[False, key[1:] != key[:-1]], dtype=np.int32) if n else 0
        if span == 32:
            at_32 = rank
        if span > 32 and (not n or rank[order[-1]] == n - 1):
            return order, at_32
        # What ends within the span is told apart by its passage, the rest by the next span.
        del key, order
        second = np.full(n, n, np.int32)
        second[: max(0, n - span)] = rank[span:]
        second += passages
        second = np.where(left < span, number, second)
        key = rank.astype(np.uint64)
        key <<= np.uint64(32)
        key |= second.astype(np.uint64)
        span *= 2


def _upto(heads: np.ndarray) -> np.ndarray:
    """Of every row the number of the head that it lies behind."""
    return np.cumsum(heads, dtype=np.int32) - np.int32(1)


def build_index(text: np.ndarray, end: np.ndarray, number: np.ndarray, documents: np.ndarray) -> RunIndex:
    """Index of passages; ``documents`` holds the smallest document of each."""
    order, rank = suffix_order(text, end, number)
    n = len(order)
    before = text[order - 1]
    starts = np.r_[True, before[1:] != before[:-1]]
    begin = np.flatnonzero(starts).astype(np.int32)
    symbol = before[begin]
    length = np.diff(np.r_[begin, n])
    # Rows that start with a symbol come in the order of the rows that it stands before.
    by_symbol = np.argsort(symbol, kind="stable")
    target = np.empty(len(begin), np.int32)
    target[by_symbol] = np.cumsum(length[by_symbol]) - length[by_symbol]
    sample = order[begin + length - 1]

    long = end[order] - order >= LENGTH
    shift = LENGTH - 32
    second = rank[np.minimum(order + shift, n - 1)]
    same = long[1:] & long[:-1] & (rank[order[1:]] == rank[order[:-1]]) & (second[1:] == second[:-1])
    heads = np.r_[True, ~same]
    of_row = np.where(long, documents[number[order]], LAST)
    least = np.minimum.reduceat(of_row, np.flatnonzero(heads))
    return RunIndex(begin, _upto(starts), symbol, target, sample, _upto(heads), least)


def stream(index: RunIndex, count: int, lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Walks all passages backwards together, a byte at a time.

    Yields how many bytes lie behind, the passages still walking, and for each the smallest document that
    has the next ``LENGTH`` bytes (``LAST`` if there are fewer). A passage's end is the row of its number.
    """
    walking = np.arange(count)
    row = np.arange(count, dtype=np.int32)
    onward = index.target - index.begin
    # The shortest passages have walked to their beginnings first.
    ending = np.bincount(lengths, minlength=1)
    for step in range(1, int(lengths.max(initial=0)) + 1):
        if ending[step - 1]:
            walking_on = lengths[walking] >= step
            walking, row = walking[walking_on], row[walking_on]
        row += onward[index.run[row]]
        if step >= LENGTH:
            yield step, walking, index.least[index.interval[row]]


def string_starts(frames: np.ndarray) -> np.ndarray:
    """Which of its ``STRINGS`` strings each frame has whole."""
    inside = np.cumsum(np.c_[np.zeros(len(frames), np.int16), frames != NONE], axis=1, dtype=np.int16)
    return inside[:, LENGTH:] - inside[:, :-LENGTH] == LENGTH


def may_meet(frames: np.ndarray) -> np.ndarray:
    """Which of the distinct frames can have a string in common with another one.

    A string holds its anchor and at least ``REACH // 2`` bytes before or after it; frames with a common
    string have the same anchor and the same bytes on that side.
    """
    found = np.zeros(len(frames), bool)
    for low, high in ((REACH - REACH // 2, REACH + GRAM), (REACH, REACH + GRAM + REACH // 2)):
        side = np.zeros((len(frames), -(-(high - low) // 8) * 8), np.uint8)
        side[:, : high - low] = frames[:, low:high]
        key = np.zeros(len(frames), np.uint64)
        for column in side.view(np.uint64).T:
            key = mixed(key ^ column)
        order = np.argsort(key)
        equal = key[order[1:]] == key[order[:-1]]
        found[order[1:][equal]] = True
        found[order[:-1][equal]] = True
    return found


def strings_met(frames: np.ndarray, documents: np.ndarray, anchored: bool) -> np.ndarray:
    """For distinct frames with their smallest documents: per frame, the smallest document that has each of
    its strings, as ``match_masks`` says; frames that are not ``anchored`` are strings on their own."""
    # A passage that shares no side of its anchor, or a string on its own, meets none but its equals.
    least = np.where(string_starts(frames), documents[:, None], LAST)
    if anchored:
        several = np.flatnonzero(may_meet(frames))
        if len(several):
            least[several] = match_masks(frames[several], documents[several])
    return least


def match_masks(frames: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """For distinct frames with their smallest documents: per frame, the smallest document that has each
    of its ``STRINGS`` strings, ``LAST`` where the frame has no whole string; sorted as given."""
    inside = frames != NONE
    first = inside.argmax(axis=1)
    lengths = inside.sum(axis=1)
    count = len(frames)
    ends = np.cumsum(lengths + 1) - 1
    text = np.zeros(int(ends[-1]) + 1 if count else 0, np.uint8)
    number = np.repeat(np.arange(count, dtype=np.int32), lengths + 1)
    filled = np.ones(len(text), bool)
    filled[ends] = False
    # Symbols are bytes plus one: no byte of UTF-8 is 0xFF, and 0 marks the ends.
    text[filled] = frames[inside] + 1
    index = build_index(text, ends[number], number, documents)
    least = np.full((count, STRINGS), LAST)
    for step, walking, smallest in stream(index, count, lengths):
        least[walking, first[walking] + lengths[walking] - step] = smallest
    return least


# ---------------------------------------------------------------- blocks


def _bits(amount: float) -> int:
    return max(0, int(np.ceil(np.log2(max(1.0, amount)))))


def store_blocks(docs: DataFrame) -> tuple[DataFrame, int]:
    """Documents with their ``block``, bucketed by it, and the text bytes there are."""
    spark = docs.sparkSession
    names = ["doc", "row_key", "text"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 24, 0
        for b in batches:
            lengths = np.diff(np.frombuffer(b.column(2).buffers()[1], np.int32)[b.column(2).offset : b.column(2).offset + b.num_rows + 1]) if b.num_rows else []
            blocks = []
            for n in lengths:
                blocks.append(block)
                size += int(n) + 1
                if size >= BLOCK_BYTES:
                    block, size = block + 1, 0
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), *b.columns], names=["block", *names])

    doc = F.coalesce("doc_id", F.lit(LAST)).alias("doc")
    rows = corpus(docs).select(doc, row_key().alias("row_key"), "text").mapInArrow(number, "block long, doc long, row_key string, text string")
    path = fresh_path(spark, "blocks")
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows.write.option("compression", "zstd").option("path", path).bucketBy(buckets, "block").saveAsTable(name)
    table = spark.table(name)
    return table, table.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0


class Block:
    """The texts of a block in one array, parted by ``NONE``."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values(["doc", "row_key"], kind="stable")
        self.order = rows["doc"].to_numpy(np.int64)
        self.keys = rows["row_key"]
        texts = [t.encode() for t in rows["text"]]
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.cumsum(self.lengths + 1) - (self.lengths + 1)
        sep = bytes([NONE])
        self.data = np.frombuffer(sep.join(texts) + sep, np.uint8)

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1


def _planes(x: np.ndarray, width: int) -> np.ndarray:
    """The lower ``width`` bytes of each number, plane by plane, which compresses sorted or close ones better."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)


def _from_planes(raw: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(width, -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, :width] = planes.T
    return wide.view("<u8").ravel()


def _ids_out(documents: np.ndarray) -> bytes:
    """Documents by their distance from the smallest."""
    least = documents.min(keepdims=True).astype("<i8")
    return squeezed(least, _planes(documents.astype("<i8").view("<u8") - least.view("<u8"), 8))


def _ids_in(data: bytes) -> np.ndarray:
    raw = unsqueezed(data)
    return (_from_planes(raw[8:], 8) + np.frombuffer(raw, "<u8", 1)).view("<i8")


@cache
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """One of each per worker; making them takes longer than a small row does."""
    return zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays one after the other, compressed before they are stored and shuffled."""
    return _zstd()[0].compress(b"".join(a.tobytes() for a in arrays))


def unsqueezed(data: bytes) -> bytes:
    return _zstd()[1].decompress(data)


def _cuts(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal numbers in a sorted array."""
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
    for a, b in zip(first, [*first[1:], len(bucket)]):
        yield int(bucket[a]), slice(int(a), int(b))


def _bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def spread(hashes: np.ndarray) -> np.ndarray:
    """Hashes of anchors that fill all buckets alike: an anchor's own, the least of many, is small."""
    return mixed(hashes)


class Passages(NamedTuple):
    """The occurrences of anchors in a block: position, first and last string, number of its passage.
    Passages are distinct and ordered by anchor; ``hashes`` are theirs, ``one`` is the first occurrence."""

    at: np.ndarray
    first: np.ndarray
    last: np.ndarray
    which: np.ndarray
    hashes: np.ndarray
    one: np.ndarray


def passages_of(data: np.ndarray) -> tuple[np.ndarray, Passages]:
    """The anchors of a block's distinct passages, ascending, and the passages."""
    at, hashes, first, last = anchors_in(data)
    hashes = spread(hashes)
    frames = [np.zeros(0, np.uint64)]
    for i in range(0, len(at), FRAMES_AT_ONCE):
        part = slice(i, i + FRAMES_AT_ONCE)
        low, high = max(0, int(at[i]) - FRAME), int(at[part][-1]) + FRAME
        frames.append(_frame_hash(passages_at(data[low:high], at[part] - low, first[part], last[part])))
    frames = np.concatenate(frames)
    order = np.lexsort([frames, hashes])
    hashes, frames = hashes[order], frames[order]
    new = np.ones(len(order), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (frames[1:] != frames[:-1])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return hashes[new], Passages(at, first, last, which, frames[new], order[new])


def anchor_rows(blocks: DataFrame, bits: int) -> DataFrame:
    """Per block and bucket the distinct passages: 32 bits of their anchors (more would only keep a few of
    different anchors from being sent), all of their hashes and their smallest documents."""

    def find(rows: pd.DataFrame) -> pd.DataFrame:
        block = Block(rows)
        anchors, found = passages_of(block.data)
        documents = block.order[block.owner(found.at[found.one])]
        number = int(rows["block"].iloc[0])
        rest = (anchors << np.uint64(bits)) >> np.uint64(32)
        out = [(k, number, squeezed(_planes(rest[s], 4)), found.hashes[s].astype("<u8").tobytes(), _ids_out(documents[s])) for k, s in _cuts(_bucket(anchors, bits))]
        return pd.DataFrame(out, columns=[c.split()[0] for c in ANCHOR_ROWS.split(", ")])

    return blocks.groupBy("block").applyInPandas(find, ANCHOR_ROWS)


def code_rows(anchors: DataFrame) -> DataFrame:
    """Per passage a block told of, in order, what it learns: ``ALONE``, ``SHARED``, ``CROWDED`` or ``COVERED``."""

    def judge(rows: pd.DataFrame) -> pd.DataFrame:
        found = [_from_planes(unsqueezed(a), 4) for a in rows["anchors"]]
        ends = np.cumsum([len(f) for f in found])
        anchor, passage = np.concatenate(found), np.frombuffer(b"".join(rows["passages"]), "<u8")
        documents = np.concatenate([_ids_in(d) for d in rows["firsts"]])
        order = np.lexsort([passage, anchor])
        anchor, passage, documents = anchor[order], passage[order], documents[order]
        heads = np.r_[True, anchor[1:] != anchor[:-1]]
        new = heads | np.r_[True, passage[1:] != passage[:-1]]
        least = np.minimum.reduceat(documents, np.flatnonzero(new))[np.cumsum(new) - 1]
        several = np.add.reduceat(new.astype(np.int64), np.flatnonzero(heads))[np.cumsum(heads) - 1]
        code = np.empty(len(order), np.uint8)
        code[order] = np.select([documents > least, several > HOT, several > 1], [COVERED, CROWDED, SHARED], ALONE)
        weight = np.where(code == CROWDED, STRINGS, code == SHARED)
        parts, weights = np.split(code, ends[:-1]), np.split(weight, ends[:-1])
        return pd.DataFrame({"bucket": rows["bucket"], "block": rows["block"], "codes": [p.tobytes() for p in parts], "shared": [int(w.sum()) for w in weights]})

    return anchors.groupBy("bucket").applyInPandas(judge, CODE_ROWS)


class Sent(NamedTuple):
    """What a block sends: ``frames`` with their smallest ``documents``, in the order of their buckets ``home``.
    Every whole passage, or string of a crowded one, that asks has the number of the ``passage``, its ``strings`` as
    bits, the ``record`` that stands for it, and is ``later`` if that is of a smaller document."""

    home: np.ndarray
    frames: np.ndarray
    documents: np.ndarray
    passage: np.ndarray
    strings: np.ndarray
    record: np.ndarray
    later: np.ndarray


def sent_by(block: Block, anchors: np.ndarray, found: Passages, code: np.ndarray, bits: int) -> Sent:
    warm, hot = np.flatnonzero(code == SHARED), np.flatnonzero(code == CROWDED)
    first, last = found.first[found.one], found.last[found.one]
    passage, strings, asked = [warm], [np.stack([first[warm], last[warm]], 1)], [np.full(len(warm), (1 << STRINGS) - 1, np.uint64)]
    for k in range(STRINGS):
        whole = hot[(first[hot] <= k) & (k <= last[hot])]
        passage.append(whole)
        strings.append(np.full((len(whole), 2), k, np.uint8))
        asked.append(np.full(len(whole), 1 << k, np.uint64))
    passage, strings, asked = np.concatenate(passage), np.concatenate(strings), np.concatenate(asked)
    places = found.at[found.one[passage]]
    frames = passages_at(block.data, places, strings[:, 0], strings[:, 1])
    bucket = _bucket(anchors[passage], bits)
    # Strings on their own have buckets below zero, by their hash.
    bucket[len(warm) :] = -1 - _bucket(_frame_hash(frames[len(warm) :]), bits)
    own = block.order[block.owner(places)]
    records, one, which = np.unique(_as_records(frames), return_index=True, return_inverse=True)
    smallest = np.full(len(records), LAST)
    np.minimum.at(smallest, which, own)
    by_bucket = np.argsort(bucket[one], kind="stable")
    place = np.empty(len(records), np.int64)
    place[by_bucket] = np.arange(len(records))
    return Sent(bucket[one][by_bucket], frames[one[by_bucket]], smallest[by_bucket], passage, asked, place[which], own > smallest[which])


def _codes_of(codes: pd.DataFrame) -> np.ndarray:
    return np.concatenate([np.frombuffer(c, np.uint8) for c in codes.sort_values("bucket")["codes"]])


def passage_rows(blocks: DataFrame, codes: DataFrame, bits: int) -> DataFrame:
    """The passages a block sends to a bucket, with the smallest document of each."""

    def collect(rows: pd.DataFrame, codes: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(codes) and codes["shared"].any():
            block = Block(rows)
            sent = sent_by(block, *passages_of(block.data), _codes_of(codes), bits)
            number = int(rows["block"].iloc[0])
            out = [(k, number, squeezed(sent.frames[s]), _ids_out(sent.documents[s]), s.stop - s.start) for k, s in _cuts(sent.home)]
        return pd.DataFrame(out, columns=[c.split()[0] for c in PASSAGE_ROWS.split(", ")])

    return blocks.groupBy("block").cogroup(codes.groupBy("block")).applyInPandas(collect, PASSAGE_ROWS)


def _lots(frames: np.ndarray, anchored: bool) -> Iterator[np.ndarray]:
    """Which frames are indexed together: those with one anchor, or else equal ones, are."""
    bits = _bits(len(frames) * FRAME / INDEXED_TOGETHER)
    if anchored:
        first, second = np.ascontiguousarray(frames[:, REACH : REACH + GRAM]).view("<u8").T
        lot = _bucket(mixed(first ^ mixed(second)), bits)
    else:
        # The upper bits told the task.
        lot = _bucket(mixed(_frame_hash(frames)), bits)
    order = np.argsort(lot, kind="stable")
    for _, s in _cuts(lot[order]):
        yield order[s]


def mask_rows(passages: DataFrame) -> DataFrame:
    """Per passage a block sent, in order, which of its strings a smaller document has."""

    def index(rows: pd.DataFrame) -> pd.DataFrame:
        frames = np.frombuffer(b"".join(map(unsqueezed, rows["passages"])), np.uint8).reshape(-1, FRAME)
        documents = np.concatenate([_ids_in(d) for d in rows["firsts"]])
        anchored = rows["bucket"].iloc[0] >= 0
        masks = np.zeros(len(frames), np.uint64)
        for lot in _lots(frames, anchored):
            own = documents[lot]
            records, first, which = np.unique(_as_records(frames[lot]), return_index=True, return_inverse=True)
            smallest = np.full(len(first), LAST)
            np.minimum.at(smallest, which, own)
            least = strings_met(frames[lot[first]], smallest, anchored)
            for k in range(STRINGS):
                masks[lot] |= (least[which, k] < own).astype(np.uint64) << np.uint64(k)
        parts = np.split(masks, np.cumsum(rows["n"].to_numpy())[:-1])
        return pd.DataFrame({"block": rows["block"], "bucket": rows["bucket"], "masks": [squeezed(m.astype("<u8")) for m in parts]})

    return passages.groupBy("bucket").applyInPandas(index, MASK_ROWS)


def _covered(block: Block, marks: pd.DataFrame, bits: int) -> np.ndarray:
    """Which bytes of the block's array go."""
    begins = np.zeros(len(block.data) + 1, bool)
    codes = marks[marks["codes"].notna()]
    if len(codes):
        code = _codes_of(codes)
        anchors, found = passages_of(block.data)
        every = np.uint64((1 << STRINGS) - 1)
        gone = np.where(code == COVERED, every, np.uint64(0))
        if ((code == SHARED) | (code == CROWDED)).any():
            sent = sent_by(block, anchors, found, code, bits)
            masks = np.concatenate([np.frombuffer(unsqueezed(m), "<u8") for m in marks[marks["masks"].notna()].sort_values("bucket")["masks"]])
            np.bitwise_or.at(gone, sent.passage, np.where(sent.later, every, masks[sent.record]) & sent.strings)
        # A later document with a passage that the block met before has all its strings from there.
        owner = block.owner(found.at)
        later = block.order[owner] > block.order[owner[found.one]][found.which]
        gone = np.where(later, every, gone[found.which])
        for k in range(STRINGS):
            go = (found.first <= k) & (k <= found.last) & (gone >> np.uint64(k) & np.uint64(1)).astype(bool)
            begins[found.at[go] - REACH + k] = True
    upto = np.cumsum(begins)
    return upto[:-1] - np.r_[np.zeros(min(LENGTH, len(block.data)), upto.dtype), upto[: max(0, len(block.data) - LENGTH)]] > 0


def cut_rows(blocks: DataFrame, marks: DataFrame, bits: int, with_text: bool) -> DataFrame:
    schema = "doc_id long, row_key string, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema += ", spans array<struct<begin:long,end:long>>, kept binary" if with_text else ""

    def cut(rows: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({c.split()[0].split(":")[0]: [] for c in ("doc_id", "row_key", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(("spans", "kept") if with_text else ()))})
        block = Block(rows)
        covered = _covered(block, marks, bits)
        out = []
        for start, n in zip(block.starts.tolist(), block.lengths.tolist()):
            gone, text = covered[start : start + n], block.data[start : start + n]
            edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
            kept = text[~gone].tobytes()
            row = (n, int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest())
            out.append(row + (([{"begin": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()], kept) if with_text else ()))
        found = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", *(("spans", "kept") if with_text else ())])
        found.insert(0, "doc_id", pd.arrays.IntegerArray(block.order, block.order == LAST))
        found.insert(1, "row_key", block.keys.to_numpy())
        return found

    return blocks.groupBy("block").cogroup(marks.groupBy("block")).applyInPandas(cut, schema)


# ---------------------------------------------------------------- use


def remove_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """One row per document: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, its
    ``row_key`` and, if asked, the ``spans`` removed and the bytes ``kept``.

    Strings are judged on the input and never cross documents. A null text is an empty one and a text
    under 50 bytes loses nothing. A null ``doc_id`` counts as larger than all others; equal ids are not
    smaller than one another, so rows with one id keep what they share. An empty table gives no rows.
    """
    blocks, size = store_blocks(docs)
    bits = _bits(size / 18 / ANCHORS_TOGETHER)
    codes = stored(code_rows(anchor_rows(blocks, bits)), "codes")
    size = (codes.agg(F.sum("shared")).first()[0] or 0) * FRAME
    told, bits = codes.select("block", "bucket", "codes", "shared"), _bits(max(size / PASSAGES_TOGETHER, min(size / INDEXED_TOGETHER, LOTS)))
    masks = mask_rows(passage_rows(blocks, told, bits))
    marks = told.drop("shared").unionByName(masks, allowMissingColumns=True)
    return cut_rows(blocks, marks, bits, with_text)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with what is left of their texts, all other columns as they are.

    A character that was cut into is dropped. ``n_chars``, where there is such a column, is counted anew.
    """
    key, cuts, left = unused(docs, "row_key"), unused(docs, "cuts"), unused(docs, "kept_text")
    edges = F.flatten(F.transform("spans", lambda s: F.array(s["begin"], s["end"])))
    # Only spans are stored and dealt anew; texts move in the join alone.
    found = stored(remove_repeats(docs).filter("n_removed > 0").select(F.col("row_key").alias(key), edges.alias(cuts)), "cuts")
    joined = docs.withColumn(key, row_key()).join(found.dropDuplicates([key]), key, "left")
    joined = joined.withColumn(left, left_over(F.when(F.col(cuts).isNotNull(), F.col("text")), F.col(cuts)))
    text = F.coalesce(F.col(left), F.col("text"))
    new = {"text": text} | ({"n_chars": F.when(F.col(left).isNull(), F.col("n_chars")).otherwise(F.length(left)).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return joined.select(*[(new[c].alias(c) if c in new else F.col(f"`{c}`")) for c in docs.columns])


def left_over(text: Column, cuts: Column) -> Column:
    """Texts without the bytes from each odd edge to the next, and without parts of characters that were cut into."""

    def cut(t: str | None, edges: np.ndarray | None) -> str | None:
        if t is None or edges is None:
            return None
        data = t.encode()
        edges = [0, *edges.tolist(), len(data)]
        return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])).decode("utf-8", "ignore")

    @F.pandas_udf("string")
    def read(text: pd.Series, cuts: pd.Series) -> pd.Series:
        return pd.Series([cut(t, e) for t, e in zip(text, cuts)], dtype=object)

    return read(text, cuts)
