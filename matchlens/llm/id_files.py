"""Token-id files with a minimal perfect hash index.

Files. Documents in ascending ``doc_id`` order, cut into shards by size, one file per shard:

    ids of document 0, end id, ids of document 1, end id, ...     little-endian unsigned 16-bit
    footer: per document doc_id (int64), null flag (uint8), number of ids (uint32), as three arrays
    footer length in bytes (8 bytes, big-endian), end id

Spark's text writer writes them, with the end id as the line separator and a document's ids as the
line. So they go to any store Spark can write to, and only finished tasks' files are ever seen.

Index. A document's key is its ``doc_id`` and its number among equal ones. Keys fall into segments by
hash; each segment has a minimal perfect hash (levels of bit arrays, in which a key takes the first
bit that it has to itself) that numbers its keys without gaps, and arrays by that number: a 32-bit
fingerprint, the shard, the offset and the number of ids. A lookup reads one segment row, tests one
bit per level, and rejects a key whose fingerprint differs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchlens.llm.common import corpus, fresh_path
from matchlens.llm.pretokens import piece_memo, vocabulary_path

#: Text bytes a shard should hold.
SHARD_BYTES = 16 << 20
#: Keys a segment of the index should hold.
SEGMENT_KEYS = 100_000
#: Bits per key still unplaced, on each level.
GAMMA = 2
#: Levels after which the keys left are listed in the segment.
LEVELS = 24

WIDTH = 2
ENTRY = 13
TAIL = 8 + WIDTH
RECORD_KEY = ["doc_id", "copy"]
SEGMENT = "segment int, n long, levels array<binary>, left binary, fingerprints binary, shards binary, offsets binary, lengths binary"


# ---------------------------------------------------------------- files


def write_shards(docs: DataFrame, path: str, vocabulary: str | None = None, shard_bytes: int = SHARD_BYTES) -> None:
    """Encode every document and write the shard files below ``path``.

    The texts are shuffled once, by ranges of ``doc_id``, and encoded where they are written. Null
    ``doc_id`` first; equal ones by text. A null or empty text is the end id alone. Each task streams.
    """
    vocabulary = vocabulary or vocabulary_path()
    rows = corpus(docs)
    total = rows.agg(F.sum(F.octet_length("text") + 2 * ENTRY)).first()[0] or 0
    by = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    # Equal doc_ids may meet a shard's bound: range cuts fall between (doc_id, text hash) pairs.
    dealt = rows.repartitionByRange(max(1, -(-total // shard_bytes)), *by).sortWithinPartitions(*by, "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = piece_memo(vocabulary, WIDTH)
        ids_of: list[np.ndarray] = []
        nulls: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            encoded = memo.ids(batch.column(1).to_pylist())
            keys = batch.column(0)
            nulls.append(keys.is_null().to_numpy(zero_copy_only=False).astype(np.uint8))
            ids_of.append(keys.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
            lengths.append(np.fromiter((len(e) // WIDTH + 1 for e in encoded), "<u4", len(encoded)))
            yield pa.RecordBatch.from_arrays([pa.array(encoded, pa.binary())], names=["line"])
        footer = b"".join(np.concatenate(part).tobytes() if part else b"" for part in (ids_of, nulls, lengths))
        yield pa.RecordBatch.from_arrays([pa.array([footer + len(footer).to_bytes(8, "big")], pa.binary())], names=["line"])

    lines = dealt.mapInArrow(encode, "line binary").select(F.col("line").cast("string").alias("value"))
    lines.write.option("lineSep", "\0" * WIDTH).option("maxRecordsPerFile", 0).text(path)


def shard_files(spark: SparkSession, path: str) -> DataFrame:
    """``shard`` (its number in file order), ``length`` and ``content`` of every file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("int").alias("shard"), "length", "content")


def _footers(files: DataFrame) -> DataFrame:
    """``shard`` and ``footer``; only the footers leave the JVM."""
    size = F.conv(F.hex(F.substring("content", -TAIL, 8)), 16, 10).cast("int")
    return files.select("shard", F.col("content").substr(F.col("length").cast("int") - TAIL - size + 1, size).alias("footer"))


def parse_footer(footer: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_id, null flag and number of ids of a shard's documents, in order."""
    n = len(footer) // ENTRY
    return (
        np.frombuffer(footer, "<i8", n),
        np.frombuffer(footer, np.uint8, n, 8 * n).astype(bool),
        np.frombuffer(footer, "<u4", n, 9 * n),
    )


def _copies(ids: np.ndarray, null: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of equal keys."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.int64)
    new = np.r_[True, (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])]
    at = np.flatnonzero(new)
    return np.arange(n) - np.repeat(at, np.diff(np.r_[at, n]))


ENTRY_ROW = "doc_id long, copy long, shard int, offset long, n_tokens long"


def list_documents(spark: SparkSession, path: str, listed_path: str) -> DataFrame:
    """Write and return one row per document, from the footers: ``doc_id``, ``copy``, ``shard``,
    ``offset`` (ids before it in its shard) and ``n_tokens`` (end id included)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, footer in zip(batch["shard"], batch["footer"]):
                ids, null, lengths = parse_footer(footer)
                long = lengths.astype(np.int64)
                doc_id = pd.arrays.IntegerArray(ids.astype(np.int64), null.copy())
                yield pd.DataFrame({"doc_id": doc_id, "copy": _copies(ids, null), "shard": shard, "offset": np.cumsum(long) - long, "n_tokens": long})

    _footers(shard_files(spark, path)).mapInPandas(read, ENTRY_ROW).write.parquet(listed_path)
    return spark.read.schema(ENTRY_ROW).parquet(listed_path)


def numbered(found: DataFrame) -> DataFrame:
    """Copies of a key in several shards: their numbers go on. At most one row per key and shard meets."""
    runs = found.groupBy("doc_id", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("doc_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    later = runs.withColumn("before", F.sum("n").over(before)).filter("before > 0").select(F.col("doc_id").alias("k"), F.col("shard").alias("s"), "before")
    joined = found.join(later, F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("shard") == F.col("s")), "left")
    return joined.select("doc_id", (F.col("copy") + F.coalesce("before", F.lit(0))).alias("copy"), "shard", "offset", "n_tokens")


def shard_starts(listed: DataFrame) -> DataFrame:
    """``shard`` and ``shard_start``, the ids in the shards before. One row per file is ordered."""
    per_file = listed.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return per_file.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))


def payload_checksums(spark: SparkSession, path: str) -> DataFrame:
    """``shard``, ``offset`` and ``ids_crc32`` (of the ids as unsigned 32-bit) of every record, from
    the payload bytes of the files; no payload is shuffled."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, content in zip(batch["shard"], batch["content"]):
                size = int.from_bytes(content[-TAIL:-WIDTH], "big")
                lengths = parse_footer(content[len(content) - TAIL - size : len(content) - TAIL])[2].astype(np.int64)
                at = np.cumsum(lengths) - lengths
                sums = [
                    zlib.crc32(np.frombuffer(content, f"<u{WIDTH}", n, WIDTH * a).astype("<u4").tobytes())
                    for a, n in zip(at.tolist(), lengths.tolist())
                ]
                yield pd.DataFrame({"shard": np.int32(shard), "offset": at, "ids_crc32": np.asarray(sums, np.int64)})

    return shard_files(spark, path).select("shard", "content").mapInPandas(read, "shard int, offset long, ids_crc32 long")


# ---------------------------------------------------------------- index


def _hashed(df: DataFrame, segments: int) -> DataFrame:
    """Adds the two hashes of the key and its segment."""
    key = [F.coalesce("doc_id", F.lit(0)), "copy", F.col("doc_id").isNull()]
    return df.withColumn("h1", F.xxhash64(*key)).withColumn("h2", F.xxhash64(F.lit(7), *key)).withColumn("segment", F.pmod(F.col("h1"), F.lit(segments)).cast("int"))


def _position(h1: np.ndarray, h2: np.ndarray, level: int, bits: int) -> np.ndarray:
    x = h1 + h2 * np.uint64(2 * level + 1)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x % np.uint64(bits)


def build_levels(h1: np.ndarray, h2: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Bit arrays, each key's number, and the keys (by position) that no level could place.

    Keys are numbered by level and bit; the rest follow in order of their hashes.
    """
    number = np.zeros(len(h1), np.int64)
    left = np.arange(len(h1))
    levels: list[bytes] = []
    done = 0
    for level in range(LEVELS):
        if not len(left):
            break
        bits = max(64, GAMMA * len(left))
        at = _position(h1[left], h2[left], level, bits).astype(np.int64)
        alone = np.bincount(at, minlength=bits) == 1
        levels.append(np.packbits(alone, bitorder="little").tobytes())
        rank = np.cumsum(alone) - 1
        fits = alone[at]
        number[left[fits]] = done + rank[at[fits]]
        done += int(fits.sum())
        left = left[~fits]
    left = left[np.lexsort((h2[left], h1[left]))]
    number[left] = done + np.arange(len(left))
    return levels, number, left


def find_numbers(h1: np.ndarray, h2: np.ndarray, levels: list[bytes], left: bytes) -> np.ndarray:
    """Each key's number, or -1. A key that was never put in may get a number: compare fingerprints."""
    number = np.full(len(h1), -1, np.int64)
    open_ = np.arange(len(h1))
    done, size = 0, None
    total = sum(int(np.unpackbits(np.frombuffer(x, np.uint8)).sum()) for x in levels) + len(left) // 16
    for level, raw in enumerate(levels):
        flags = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")
        size = max(64, GAMMA * (total - done))
        at = _position(h1[open_], h2[open_], level, size).astype(np.int64)
        rank = np.cumsum(flags) - 1
        hit = flags[at].astype(bool)
        number[open_[hit]] = done + rank[at[hit]]
        open_ = open_[~hit]
        done += int(flags.sum())
    rest = np.frombuffer(left, np.uint64).reshape(-1, 2)
    for k, (a, b) in enumerate(rest.tolist()):
        number[open_[(h1[open_] == a) & (h2[open_] == b)]] = done + k
    return number


def build_index(listed: DataFrame, index_path: str, segment_keys: int = SEGMENT_KEYS) -> int:
    """Index every listed document; returns the number of segments."""
    segments = max(1, -(-listed.count() // segment_keys))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        h1, h2 = (rows[c].to_numpy(np.int64).view(np.uint64) for c in ("h1", "h2"))
        levels, number, left = build_levels(h1, h2)
        order = np.argsort(number)
        column = lambda name, kind: rows[name].to_numpy()[order].astype(kind).tobytes()
        return pd.DataFrame(
            {
                "segment": [rows["segment"].iloc[0]],
                "n": [len(rows)],
                "levels": [levels],
                "left": [np.stack([h1[left], h2[left]], 1).tobytes()],
                "fingerprints": [(h2[order] >> np.uint64(32)).astype("<u4").tobytes()],
                "shards": [column("shard", "<i4")],
                "offsets": [column("offset", "<i8")],
                "lengths": [column("n_tokens", "<i8")],
            }
        )

    _hashed(numbered(listed), segments).select("segment", "h1", "h2", "shard", "offset", "n_tokens").groupBy("segment").applyInPandas(build, SEGMENT).write.parquet(index_path)
    return segments


def lookup(spark: SparkSession, index_path: str, segments: int, keys: DataFrame) -> DataFrame:
    """``doc_id``, ``copy``, ``shard``, ``offset`` and ``n_tokens`` of the distinct keys that the index
    holds. Keys meet their segment's row; a segment holds a bounded number of keys."""
    index = spark.read.schema(SEGMENT).parquet(index_path)
    asked = _hashed(keys.select(*RECORD_KEY).distinct(), segments)

    def find(rows: pd.DataFrame, segment: pd.DataFrame) -> pd.DataFrame:
        names = ["doc_id", "copy", "shard", "offset", "n_tokens"]
        if segment.empty or rows.empty:
            return pd.DataFrame({c: [] for c in names})
        s = segment.iloc[0]
        h1, h2 = (rows[c].to_numpy(np.int64).view(np.uint64) for c in ("h1", "h2"))
        number = find_numbers(h1, h2, list(s["levels"]), s["left"])
        marks = np.frombuffer(s["fingerprints"], "<u4")
        known = (number >= 0) & (marks[np.maximum(number, 0)] == (h2 >> np.uint64(32)).astype("<u4"))
        at = number[known]
        out = rows.loc[known, ["doc", "none", "copy"]].reset_index(drop=True)
        out.insert(0, "doc_id", pd.arrays.IntegerArray(out.pop("doc").to_numpy(np.int64), out.pop("none").to_numpy(bool)))
        return out.assign(shard=np.frombuffer(s["shards"], "<i4")[at], offset=np.frombuffer(s["offsets"], "<i8")[at], n_tokens=np.frombuffer(s["lengths"], "<i8")[at])

    return (
        asked.select(F.coalesce("doc_id", F.lit(0)).alias("doc"), F.col("doc_id").isNull().alias("none"), "copy", "h1", "h2", "segment")
        .groupBy("segment")
        .cogroup(index.groupBy("segment"))
        .applyInPandas(find, "doc_id long, copy long, shard int, offset long, n_tokens long")
    )


# ---------------------------------------------------------------- use


class IdFiles:
    """Written files and their index."""

    def __init__(self, path: str, index_path: str, listed: DataFrame, segments: int):
        self.spark, self.path, self.index_path, self.listed, self.segments = listed.sparkSession, path, index_path, listed, segments

    def find(self, keys: DataFrame) -> DataFrame:
        return lookup(self.spark, self.index_path, self.segments, keys)

    def records(self, keys: DataFrame) -> DataFrame:
        """Per distinct key that the index holds: ``start`` (ids of all documents before it),
        ``n_tokens`` and ``ids_crc32``, the last from the payload that the index points to."""
        found = self.find(keys).join(shard_starts(self.listed), "shard")
        sums = payload_checksums(self.spark, self.path)
        return found.join(sums, ["shard", "offset"]).select(
            *RECORD_KEY, (F.col("shard_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"
        )

    def ids(self, doc_id: int | None, copy: int = 0) -> np.ndarray | None:
        """The ids of one document (end id included), from one index row and one file."""
        key = self.spark.createDataFrame([(doc_id, copy)], "doc_id long, copy long")
        hashed = _hashed(key, self.segments).first()
        row = self.spark.read.schema(SEGMENT).parquet(self.index_path).filter(F.col("segment") == hashed["segment"]).first()
        if row is None:
            return None
        h1, h2 = (np.array([hashed[c]], np.int64).view(np.uint64) for c in ("h1", "h2"))
        number = int(find_numbers(h1, h2, row["levels"], row["left"])[0])
        if number < 0 or np.frombuffer(row["fingerprints"], "<u4")[number] != int(h2[0]) >> 32:
            return None
        shard, at, n = (int(np.frombuffer(row[c], k)[number]) for c, k in (("shards", "<i4"), ("offsets", "<i8"), ("lengths", "<i8")))
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", f"part-{shard:05d}-*").load(self.path)
        cut = files.select(F.col("content").substr(F.lit(WIDTH * at + 1), F.lit(WIDTH * n)).alias("ids")).first()
        return np.frombuffer(cut["ids"], f"<u{WIDTH}")


def write_id_files(docs: DataFrame, path: str | None = None, vocabulary: str | None = None, shard_bytes: int = SHARD_BYTES) -> IdFiles:
    """Write the files and the index below ``path``, by default a new place in the shared folder.

    Rows that share a ``doc_id`` are kept as copies 0, 1, ... in order of their texts' hashes; an
    empty table gives files without documents.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "ids")
    write_shards(docs, f"{path}/files", vocabulary, shard_bytes)
    listed = list_documents(spark, f"{path}/files", f"{path}/documents")
    return IdFiles(f"{path}/files", f"{path}/index", listed, build_index(listed, f"{path}/index"))
