"""Tables of which every version is whole: rows in buckets, and a manifest per version.

Rows lie in buckets by a hash of some key columns, a folder per bucket and write. A manifest names the folders
that make up a version; it is one small file, created only if it is not there yet, and that is
the commit. A merge reads and writes the buckets that its new rows touch and no others. A reader takes the
newest manifest and sees that version to the end, whatever is written meanwhile; a merge that fails before its
commit leaves folders that no manifest names. :meth:`VersionedTable.vacuum` removes them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from matchlens.session import shared_dir

BUCKET = "_bucket"
#: Times a merge is tried where others commit first.
TRIES = 5

Merge = Callable[[DataFrame, DataFrame], DataFrame]


class Conflict(RuntimeError):
    """Others committed first every time."""


@dataclass(frozen=True)
class Manifest:
    """One version: per bucket its folders, the last batch of each job, and whatever a job notes."""

    version: int = 0
    live: dict[int, list[str]] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)
    notes: dict[str, str] = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps({"version": self.version, "live": self.live, "batches": self.batches, "notes": self.notes})

    @staticmethod
    def parse(text: str) -> Manifest:
        made = json.loads(text)
        return Manifest(made["version"], {int(k): v for k, v in made["live"].items()}, made["batches"], made["notes"])


class VersionedTable:
    """Rows of ``schema`` at ``path``, bucketed by ``by``. Schema, keys and number of buckets are fixed when the
    table is made; choose so many buckets that one fits a task."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, by: list[str], buckets: int = 64):
        self.spark, self.path, self.by, self.buckets = spark, path.rstrip("/"), list(by), buckets
        # Anything may be missing in a file, elements of lists too.
        self.schema = StructType.fromDDL(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema))

    # --- files, by Spark's own file system --------------------------------------------------------

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _names(self, path: str) -> list[str]:
        fs, where = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []

    def _read_text(self, path: str) -> str:
        fs, where = self._fs(path)
        stream = fs.open(where)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _create(self, path: str, text: str) -> bool:
        """Write a file that must not exist yet."""
        fs, where = self._fs(path)
        try:
            stream = fs.create(where, False)
        except Exception as err:  # noqa: BLE001
            if "AlreadyExists" not in str(err) and "already exists" not in str(err):
                raise
            return False
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    # --- versions ---------------------------------------------------------------------------------

    def _manifest_path(self, version: int) -> str:
        return f"{self.path}/manifests/{version:010d}.json"

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names(f"{self.path}/manifests") if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest whole version (a manifest that is being written is not one yet), or the one asked for."""
        for v in [version] if version is not None else reversed(self.versions()):
            try:
                return Manifest.parse(self._read_text(self._manifest_path(v)))
            except json.JSONDecodeError:
                if version is not None:
                    raise
        return Manifest()

    def read(self, version: int | None = None, only: set[int] | None = None) -> DataFrame:
        """Rows of a version, of some buckets if told; nothing else is listed or opened."""
        live = self.manifest(version).live
        return self._rows(live, only)

    def _rows(self, live: dict[int, list[str]], only: set[int] | None = None) -> DataFrame:
        folders = [f"{self.path}/{f}" for b, fs in sorted(live.items()) if only is None or b in only for f in fs]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def touched(self, *rows: DataFrame) -> set[int]:
        """Buckets of these rows' keys: at most ``buckets`` numbers reach the driver."""
        found: set[int] = set()
        for df in rows:
            found |= {r[0] for r in df.select(self.bucket().alias("b")).distinct().collect()}
        return found

    def changed(self, since: int, until: int) -> set[int]:
        """Buckets that are not the same in two versions."""
        a, b = self.manifest(since).live, self.manifest(until).live
        return {k for k in a.keys() | b.keys() if a.get(k) != b.get(k)}

    # --- writing ----------------------------------------------------------------------------------

    def merge(self, new: DataFrame, how: Merge, *, touch: DataFrame | None = None, batch: tuple[str, int] | None = None, notes: dict[str, str] | None = None, based_on: int | None = None) -> Manifest:
        """Replace the touched buckets by ``how(their old rows, new)`` and commit.

        ``touch`` has keys of further rows that may change or go. ``batch`` names a job and its batch: one that is
        already in the table, or an older one, changes nothing. If another writer commits first, the merge is
        done again on its version, unless ``new`` is only right ``based_on`` a version.
        """
        staged = f"{shared_dir(self.spark)}/merge-{uuid.uuid4().hex}"
        new.write.parquet(staged)
        new = self.spark.read.schema(new.schema).parquet(staged)
        buckets = self.touched(*([new] if touch is None else [new, touch]))
        for _ in range(TRIES):
            before = self.manifest()
            if batch and before.batches.get(batch[0], -1) >= batch[1]:
                return before
            if based_on not in (None, before.version):
                raise Conflict(f"{self.path}: version {before.version} in place of {based_on}")
            made = self._write(how(self._rows(before.live, buckets), new))
            live = {b: f for b, f in before.live.items() if b not in buckets} | made
            after = Manifest(before.version + 1, live, before.batches | (dict([batch]) if batch else {}), before.notes | (notes or {}))
            if self._commit(after):
                return after
        raise Conflict(f"{self.path}: {TRIES} versions came first")

    def replace_all(self, rows: DataFrame, notes: dict[str, str] | None = None) -> Manifest:
        """Write a version of these rows only."""
        before = self.manifest()
        after = Manifest(before.version + 1, self._write(rows), before.batches, before.notes | (notes or {}))
        if not self._commit(after):
            raise Conflict(f"{self.path}: version {after.version} came first")
        return after

    def _write(self, rows: DataFrame) -> dict[int, list[str]]:
        folder = f"data/{uuid.uuid4().hex}"
        placed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]).withColumn(BUCKET, self.bucket())
        placed.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        found = [n for n in self._names(f"{self.path}/{folder}") if n.startswith(f"{BUCKET}=")]
        return {int(n.split("=")[1]): [f"{folder}/{n}"] for n in found}

    def _commit(self, manifest: Manifest) -> bool:
        return self._create(self._manifest_path(manifest.version), manifest.text())

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove folders that none of the last ``keep`` versions names. No merge may run meanwhile."""
        versions = self.versions()
        named = {f.split("/")[1] for v in versions[-keep:] for fs in self.manifest(v).live.values() for f in fs}
        gone = [n for n in self._names(f"{self.path}/data") if n not in named]
        for name in gone:
            fs, where = self._fs(f"{self.path}/data/{name}")
            fs.delete(where, True)
        for v in versions[:-keep]:
            fs, where = self._fs(self._manifest_path(v))
            fs.delete(where, False)
        return gone
