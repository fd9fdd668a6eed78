"""WARC archives of web pages, and a two-level capture index to read them by.

Archives. Every record is a gzip member of its own. Spark's text writer writes them, with an empty member as
the line separator: any reader of multi-member gzip reads the files, they go to any store that Spark
can write to, and only finished tasks' files are seen. A payload that a page with a larger number has too is
not written again: a revisit record names that page and keeps the digest and the HTTP headers.

Index. One line per capture: the URL's key with its host reversed (``org,example,www)/path``), the date, and where
the record lies. Lines are sorted over all files by one range shuffle and compressed in blocks of
``BLOCK_LINES``, members again. The directory has one row per block: its first and last key, file, offset
and length. A lookup finds the files by their key ranges, the blocks by binary search in the file's part
of the directory, the lines by binary search in the block, and reads the records' byte ranges.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlens.llm.common import fresh_path, stored, text_of

#: Payload bytes from which an equal payload is not written again.
REVISIT_BYTES = 1000
#: Payload bytes an archive file should hold.
ARCHIVE_BYTES = 16 << 20
#: Lines of an index block, and of an index file.
BLOCK_LINES = 3000
INDEX_LINES = 150_000
#: Parts in which the rows of one digest meet its largest page.
PARTS = 64

# An empty gzip member, the record formats' words, and the date of records that have none.
SEPARATOR = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def member(content: bytes) -> bytes:
    """``content`` as one gzip member, the same on every run."""
    made = zlib.compressobj(6, zlib.DEFLATED, 31)
    return made.compress(content) + made.flush()


def members(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each member that is followed by the separator."""
    start = 0
    while start < len(content):
        end = content.find(SEPARATOR, start)
        while True:
            stream = zlib.decompressobj(31)
            found = stream.decompress(content[start:end])
            if stream.eof:
                break
            # The separator's bytes inside a member: the member goes on.
            end = content.find(SEPARATOR, end + 1)
        yield start, end - start, found
        start = end + len(SEPARATOR)


def expand(content: bytes) -> bytes:
    return zlib.decompress(content, 31)


def quoted(url: str) -> str:
    """``url`` on one line without blanks."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


_URL = re.compile(r"(?s)(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::(\d*))?(.*)")


def capture_key(url: str | None) -> str:
    """The key under which captures of a URL are sorted: reversed host, port if any, then the rest as it is.
    A URL without a host is kept whole behind the bracket; a null one is the bracket alone."""
    if url is None:
        return ")"
    url = quoted(url)
    found = _URL.fullmatch(url)
    if not found or not found[1]:
        return ")" + url
    host, port, rest = found.groups()
    name = ",".join(reversed(host.lower().rstrip(".").split(".")))
    return name + (f":{port}" if port and port not in ("80", "443") else "") + ")" + (rest if rest.startswith("/") else "/" + rest)


def _record(kind: str, page_id: int | None, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE), *headers, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_of(urn: str | None) -> int | None:
    number = urn[len("<urn:page:") : -1] if urn else ""
    return int(number) if number else None


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, leader: int | None) -> bytes:
    """The page's record: a response, or a revisit of page ``leader``."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    headers = [("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()), ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        headers.insert(0, ("WARC-Target-URI", quoted(url)))
    if leader is None:
        return _record("response", page_id, headers, http + payload)
    return _record("revisit", page_id, [*headers, ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(leader))], http)


def info_record() -> bytes:
    return _record("warcinfo", None, [("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


# ---------------------------------------------------------------- writing


def _write_members(lines: DataFrame, path: str, per_file: int = 0) -> None:
    """Write the binary column ``line`` of each row, a member, and the separator after it."""
    writer = lines.select(F.col("line").cast("string").alias("value")).write
    writer.option("lineSep", SEPARATOR.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", per_file).text(path)


def _leaders(given: DataFrame) -> DataFrame:
    """``digest``, ``part`` and ``leader`` of payloads that several pages have, stored: how much it is, is known
    when it is joined. A digest that a third of the pages have meets its pages in ``PARTS`` parts."""
    part = F.pmod(F.xxhash64("page_id"), F.lit(PARTS))
    some = given.filter(F.col("size") >= REVISIT_BYTES).groupBy("digest", part.alias("part")).agg(F.max("page_id").alias("m"), F.count("*").alias("n"))
    whole = some.groupBy("digest").agg(F.max("m").alias("leader"), F.sum("n").alias("n")).filter("n > 1 and leader is not null")
    return stored(some.select("digest", "part").join(whole.select("digest", "leader"), "digest"), "archive-leaders")


@dataclass(frozen=True)
class Archives:
    """Written archives below ``path``."""

    spark: SparkSession
    path: str

    def files(self) -> DataFrame:
        return files_of(self.spark, self.path)


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """``file`` and ``content`` of the files below ``path``."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return read.select(F.substring_index("path", "/", -1).alias("file"), "content")


def write_archives(pages: DataFrame, path: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> Archives:
    """One record per row of ``pages`` (``page_id``, ``url``, ``html``; other columns are not looked at).

    A null or empty html is an empty payload. Of rows with an equal payload of ``REVISIT_BYTES`` or more,
    those with the largest ``page_id`` are responses (repeated rows of one page all are), the others,
    pages without a number among them, revisit it; payloads of pages without numbers only are all
    responses. A null url has no target header. An empty table gives files without page records. Pages are
    not shuffled unless the list of repeated payloads is too long for Spark to send to every task.
    """
    spark = pages.sparkSession
    path = path or fresh_path(spark, "archives")
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of("html").cast("binary").alias("payload"))
    given = given.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    leaders = _leaders(given.select("page_id", "digest", "size"))
    n, total = given.agg(F.count("*"), F.sum("size")).first()
    per_file = max(1, archive_bytes * n // max(total or 0, 1))
    part = F.pmod(F.xxhash64("page_id"), F.lit(PARTS))
    joined = given.withColumn("part", part).join(leaders, ["digest", "part"], "left")
    visited = F.when((F.col("size") >= REVISIT_BYTES) & ~F.col("page_id").eqNullSafe(F.col("leader")), F.col("leader"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written = 0
        for b in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            lines = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                # Every file begins with a record about itself.
                if written % (per_file + 1) == 0:
                    lines.append(member(info_record()))
                    written += 1
                lines.append(member(page_record(*row)))
                written += 1
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary())], names=["line"])

    records = joined.select("page_id", "url", "payload", "digest", visited.alias("leader")).mapInArrow(build, "line binary")
    _write_members(records, path, per_file + 1)
    return Archives(spark, path)


# ---------------------------------------------------------------- index


def _rows(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in ddl.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


CAPTURE = "key string, line string"
DIRECTORY = "file string, offset long, length long, first_key string, last_key string, n long"


def _captures(archives: Archives) -> DataFrame:
    """An index line per page record, from the archives themselves."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                lines = []
                name = b.column(0)[i].as_py()
                for offset, length, record in members(b.column(1)[i].as_py()):
                    headers, _ = parsed(record)
                    if headers["warc-type"] == "warcinfo":
                        continue
                    url = headers.get("warc-target-uri")
                    told = {"url": url, "id": headers["warc-record-id"], "type": headers["warc-type"], "digest": headers["warc-payload-digest"], "length": length, "offset": offset, "filename": name}
                    key = capture_key(url)
                    lines.append((key, f"{key} {headers['warc-date']} {json.dumps(told)}"))
                yield _rows(lines, CAPTURE)

    return archives.files().mapInArrow(read, CAPTURE)


@dataclass(frozen=True)
class CaptureIndex:
    """Index files below ``path``; ``directory`` has a row per block, ``bounds`` (file, first and last key) a row
    per file."""

    archives: Archives
    path: str
    directory: DataFrame
    bounds: list[tuple[str, str, str]]

    def find(self, urls: DataFrame) -> DataFrame:
        """``key``, ``file``, ``offset`` and ``length`` of every capture of the URLs in column ``url``, each once."""
        bounds = self.bounds

        def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lasts = [b[2] for b in bounds]
            for b in batches:
                rows = []
                for url in b.column(0).to_pylist():
                    key = capture_key(url)
                    at = bisect.bisect_left(lasts, key)
                    while at < len(bounds) and bounds[at][1] <= key:
                        rows.append((bounds[at][0], key))
                        at += 1
                yield _rows(rows, "file string, key string")

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            name, blocks = None, []
            for b in batches:
                rows = []
                for file, kind, key, last_key, offset, length in zip(*(c.to_pylist() for c in b.columns)):
                    if file != name:
                        name, blocks = file, []
                    if kind == 0:
                        blocks.append((last_key, key, offset, length))
                        continue
                    at = bisect.bisect_left(blocks, key, key=lambda x: x[0])
                    while at < len(blocks) and blocks[at][1] <= key:
                        rows.append((file, blocks[at][2], blocks[at][3], key))
                        at += 1
                yield _rows(rows, WANTED)

        def lines(block: bytes, keys: list[str]) -> Iterator[tuple]:
            held = block.decode().split("\n")
            for key in keys:
                at = bisect.bisect_left(held, key + " ")
                while at < len(held) and held[at].startswith(key + " "):
                    told = json.loads(held[at].split(" ", 2)[2])
                    yield key, told["filename"], told["offset"], told["length"]
                    at += 1

        asked = urls.select(F.col("url").cast("string").alias("url")).distinct().mapInArrow(locate, "file string, key string").distinct()
        null = lambda c, kind: F.lit(None).cast(kind).alias(c)
        blocks = self.directory.select("file", F.lit(0).alias("kind"), F.col("first_key").alias("key"), "last_key", "offset", "length")
        keys = asked.select("file", F.lit(1).alias("kind"), "key", null("last_key", "string"), null("offset", "long"), null("length", "long"))
        met = blocks.union(keys).repartition("file").sortWithinPartitions("file", "kind", "offset", "key")
        wanted = met.mapInArrow(search, WANTED)
        return read_ranges(files_of(self.archives.spark, self.path), wanted, lines, "key string, file string, offset long, length long")

    def records(self, urls: DataFrame) -> DataFrame:
        """The captures of the URLs, read: ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``."""

        def page(record: bytes, _: list[str]) -> Iterator[tuple]:
            headers, block = parsed(record)
            http, _, payload = block.partition(b"\r\n\r\n")
            if headers["warc-type"] == "response":
                size, digest = len(payload), hashlib.sha1(payload).hexdigest()
            else:
                size = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
                digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
            yield _page_of(headers["warc-record-id"]), size, digest, headers["warc-type"], _page_of(headers.get("warc-refers-to"))

        wanted = self.find(urls).select("file", "offset", "length", "key")
        return read_ranges(self.archives.files(), wanted, page, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")

    def fetch(self, url: str | None) -> list[tuple[dict[str, str], bytes]]:
        """Headers and block of each capture of one URL: range reads of its blocks and of its records only."""
        key, spark, found = capture_key(url), self.archives.spark, []
        files = [name for name, first, last in self.bounds if first <= key <= last]
        blocks = self.directory.filter(F.col("file").isin(files) & (F.col("first_key") <= key) & (F.col("last_key") >= key)).orderBy("file", "offset").collect() if files else []
        for block in blocks:
            held = expand(_range(spark, f"{self.path}/{block['file']}", block["offset"], block["length"])).decode().split("\n")
            for line in held[bisect.bisect_left(held, key + " ") :]:
                if not line.startswith(key + " "):
                    break
                told = json.loads(line.split(" ", 2)[2])
                found.append(parsed(expand(_range(spark, f"{self.archives.path}/{told['filename']}", told["offset"], told["length"]))))
        return found


WANTED = "file string, offset long, length long, key string"


def read_ranges(files: DataFrame, wanted: DataFrame, parse: Callable[[bytes, list[str]], Iterator[tuple]], ddl: str) -> DataFrame:
    """The rows that ``parse`` makes of each wanted member and of all keys it is wanted for.

    A file meets the ranges wanted of it; a task holds one file and goes through them in order.
    """
    null = lambda c, kind: F.lit(None).cast(kind).alias(c)
    contents = files.select("file", null("offset", "long"), null("length", "long"), null("key", "string"), "content")
    ranges = wanted.select(*[c.split()[0] for c in WANTED.split(", ")], null("content", "binary"))
    met = contents.union(ranges).repartition("file").sortWithinPartitions("file", "offset", "key")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content, at, keys = b"", (None, 0, 0), []
        for b in batches:
            rows: list[tuple] = []
            for i, (file, offset, length, key) in enumerate(zip(*(b.column(c).to_pylist() for c in range(4)))):
                if offset is None or (file, offset, length) != at:
                    if keys:
                        rows += parse(expand(content[at[1] : at[1] + at[2]]), keys)
                    keys = []
                    if offset is None:
                        content = b.column(4)[i].as_py()
                        continue
                    at = (file, offset, length)
                keys.append(key)
            yield _rows(rows, ddl)
        if keys:
            yield _rows(list(parse(expand(content[at[1] : at[1] + at[2]]), keys)), ddl)

    return met.mapInArrow(read, ddl)


def _range(spark: SparkSession, path: str, offset: int, length: int) -> bytes:
    """Bytes of a file, by seeking in Spark's file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    try:
        stream.seek(offset)
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))
    finally:
        stream.close()


def build_index(archives: Archives, path: str | None = None, block_lines: int = BLOCK_LINES, index_lines: int = INDEX_LINES) -> CaptureIndex:
    """Index every page record of the archives. Equal keys may fill several blocks and files."""
    path = path or fresh_path(archives.spark, "captures")
    captures = stored(_captures(archives), "capture-lines")
    n = max(1, -(-captures.count() // index_lines))
    dealt = captures.repartitionByRange(n, "key", "line").sortWithinPartitions("key", "line")

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        for b in batches:
            for line in b.column(0).to_pylist():
                held.append(line)
                if len(held) == block_lines:
                    yield _rows([(member("\n".join(held).encode()),)], "line binary")
                    held = []
        if held:
            yield _rows([(member("\n".join(held).encode()),)], "line binary")

    def list_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rows = []
                for offset, length, content in members(b.column(1)[i].as_py()):
                    lines = content.decode().split("\n")
                    rows.append((b.column(0)[i].as_py(), offset, length, lines[0].split(" ", 1)[0], lines[-1].split(" ", 1)[0], len(lines)))
                yield _rows(rows, DIRECTORY)

    _write_members(dealt.select("line").mapInArrow(block, "line binary"), path)
    directory = stored(files_of(archives.spark, path).mapInArrow(list_blocks, DIRECTORY), "capture-directory")
    per_file = directory.groupBy("file").agg(F.min("first_key").alias("a"), F.max("last_key").alias("b")).orderBy("a", "b")
    return CaptureIndex(archives, path, directory, [tuple(r) for r in per_file.collect()])
