"""Near-duplicate vectors by random hyperplanes.

The side of a random hyperplane on which two vectors at angle t fall differs with probability t / pi.
A table hashes a vector to its sides of some hyperplanes; vectors that share a hash in any table and
their label are compared exactly. The number of tables follows from the number of hyperplanes so that
a pair at the threshold is missed with probability ``MISS`` at most.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlens.llm.common import stored
from matchlens.llm.components import components, local_roots

THRESHOLD = 0.98
MISS = 1e-7
SEED = 20_240_601
#: Vectors of a bucket that one task compares with as many others; larger buckets are cut into tiles.
TILE = 2_000
CODE = "class long, label int, width int, table int, code long"


def shape(largest: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """Hyperplanes per table, a few more than it takes to tell ``largest`` vectors apart, and tables."""
    planes = min(32, max(8, math.ceil(math.log2(max(largest, 1) + 1)) + 3))
    together = (1 - math.acos(threshold) / math.pi) ** planes
    return planes, math.ceil(math.log(miss) / math.log1p(-together))


@functools.cache
def hyperplanes(width: int, planes: int, tables: int) -> np.ndarray:
    """Normals, one per column; those of the first tables do not depend on how many follow."""
    return np.random.default_rng([SEED, width]).standard_normal((planes * tables, width)).T


def hash_codes(unit: np.ndarray, planes: int, tables: int) -> np.ndarray:
    """One code per vector (row) and table (column); the same hyperplanes for vectors of one width."""
    normals = hyperplanes(unit.shape[1], planes, tables)
    sides = (unit @ normals >= 0).reshape(len(unit), tables, planes)
    return sides.astype(np.int64) @ (1 << np.arange(planes, dtype=np.int64))


def unit_rows(vectors) -> np.ndarray:
    """The vectors, of one width, in double precision and of length one."""
    x = np.asarray(vectors, np.float64) if isinstance(vectors, np.ndarray) and vectors.ndim == 2 else np.stack([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(vector: str = "embedding"):
    """Whether a vector has a direction: not null, not empty, all components finite, not all zero."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def codes(classes: DataFrame, planes: int, tables: int) -> DataFrame:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for width, rows in batch.groupby("width"):
                for i in range(0, len(rows), 2_000):
                    part = rows.iloc[i : i + 2_000]
                    found = hash_codes(unit_rows(part["embedding"]), planes, tables)
                    yield pd.DataFrame(
                        {
                            "class": np.repeat(part["class"].to_numpy(), tables),
                            "label": np.repeat(part["label"].to_numpy(), tables),
                            "width": np.int32(width),
                            "table": np.tile(np.arange(tables, dtype=np.int32), len(part)),
                            "code": found.ravel(),
                        }
                    )

    return classes.select("class", "label", "width", "embedding").mapInPandas(read, CODE)


#: Rows of a bucket up to which its pairs are listed together with those of other buckets.
SMALL = 32
FOUND = "class long, n long, root long"


def _close_pairs(group: np.ndarray, left: np.ndarray, right: np.ndarray, unit: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``a``, ``b`` of one group, sorted together, on different sides or both on both, within ``threshold``."""
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[first, len(group)])
    a_all, b_all = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    small = np.repeat(size <= SMALL, size)
    for step in range(1, SMALL):
        a = np.flatnonzero(small[:-step] & (group[step:] == group[:-step]))
        if not len(a):
            break
        b = a + step
        a, b = (x[left[a] & right[b] | left[b] & right[a]] for x in (a, b))
        for k in range(0, len(a), 20_000):
            close = np.einsum("ij,ij->i", unit[a[k : k + 20_000]], unit[b[k : k + 20_000]]) >= threshold
            a_all.append(a[k : k + 20_000][close])
            b_all.append(b[k : k + 20_000][close])
    for begin, n in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist()):
        rows = np.arange(begin, begin + n)
        at_left, at_right = rows[left[rows]], rows[right[rows]]
        for k in range(0, len(at_left), 1_000):
            part = at_left[k : k + 1_000]
            x, y = np.nonzero(unit[part] @ unit[at_right].T >= threshold)
            x, y = part[x], at_right[y]
            # Rows on both sides meet twice.
            once = (x < y) | ~(left[y] & right[x])
            once &= x != y
            a_all.append(x[once])
            b_all.append(y[once])
    return np.concatenate(a_all), np.concatenate(b_all)


def _found(rows: dict[str, np.ndarray], unit: np.ndarray, threshold: float, planes: int) -> tuple[np.ndarray, ...]:
    """``class``, ``n`` and ``root`` of the linked rows of whole groups of one width."""
    a, b = _close_pairs(rows["group"], rows["left"], rows["right"], unit, threshold)
    linked = np.unique(np.concatenate([a, b]))
    # A pair counts in the first table it shares; its link is the same in every one.
    first, table = np.ones(len(a), bool), rows["table"][a]
    most = int(table.max(initial=0))
    if most:
        code = hash_codes(unit[linked], planes, most)
        x, y = np.searchsorted(linked, a), np.searchsorted(linked, b)
        for k in range(most):
            first &= (k >= table) | (code[x, k] != code[y, k])
    n = np.bincount(a[first], rows["copies"][b[first]], len(unit)) + np.bincount(b[first], rows["copies"][a[first]], len(unit))
    root = local_roots(len(unit), a, b)
    return rows["class"][linked], n[linked].astype(np.int64), rows["class"][root[linked]]


def compared(met: DataFrame, bucket: list[str], threshold: float, planes: int) -> DataFrame:
    """Counts and links of the rows of each group of ``bucket``, ``i`` and ``j``.

    Most groups are a few rows. They are not handed over one by one: a task's rows are sorted by group,
    and all whole groups of an Arrow batch are compared together.
    """
    keys = [*bucket, "i", "j"]
    dealt = met.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "class", "copies", "at_left", "at_right", "embedding")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(table: pa.Table) -> Iterator[pa.RecordBatch]:
            wide = table["width"].to_numpy()
            for width in np.unique(wide):
                part = table.filter(pa.array(wide == width))
                unit = unit_rows(part["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
                rows = {n: part[n].to_numpy() for n in ("group", "table", "class", "copies")} | {n: part[f"at_{n}"].to_numpy() for n in ("left", "right")}
                for begin, end in _chunks(rows["group"]):
                    found = _found({n: v[begin:end] for n, v in rows.items()}, unit[begin:end], threshold, planes)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["class", "n", "root"])

        held, last, number = None, None, 0
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(k).to_numpy().astype(np.int64) for k in keys], 1)
            new = np.r_[last is None or (key[0] != last).any(), (key[1:] != key[:-1]).any(axis=1)]
            group = number + np.cumsum(new)
            number, last = int(group[-1]), key[-1]
            own = pa.Table.from_batches([b]).append_column("group", pa.array(group))
            held = own if held is None else pa.concat_tables([held, own])
            # The last group may go on in the next batch.
            whole = int(np.searchsorted(held["group"].to_numpy(), number))
            if whole:
                yield from linked(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None:
            yield from linked(held)

    return dealt.mapInArrow(compare, FOUND)


def _chunks(group: np.ndarray, rows: int = 4_000) -> Iterator[tuple[int, int]]:
    """Bounds of whole groups that hold about ``rows`` together."""
    begin = 0
    while begin < len(group):
        end = int(np.searchsorted(group, group[min(begin + rows, len(group)) - 1], "right"))
        yield begin, end
        begin = end


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links`` (other vectors with its label within ``threshold``),
    ``component_id`` (smallest ``vec_id`` it reaches over links) and ``kept`` (that is itself).

    Equal vectors of one label are one class that is compared once. Vectors of different widths have
    no cosine. A vector that is null, empty, zero or not finite, or whose label or ``vec_id`` is null,
    links with nothing. Repeated rows are returned each and are links of one another. An empty table
    gives no rows. Counts and links are summed where vectors meet; pairs are never sent on.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), "embedding")
    joins = usable() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    alone = rows.filter(~joins).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    able = rows.filter(joins)
    classes = stored(
        able.groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies")).select(
            F.monotonically_increasing_id().alias("class"), "label", "embedding", F.size("embedding").alias("width"), "first", "copies"
        ),
        "classes",
    )
    largest = classes.groupBy("label", "width").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    planes, tables = shape(largest, threshold)

    bucket = ["label", "width", "table", "code"]
    hashed = stored(codes(classes, planes, tables), "codes")
    shared = hashed.groupBy(bucket).agg(F.count("*").alias("size")).filter("size > 1")
    met = hashed.join(shared, bucket).withColumn("m", F.ceil(F.col("size") / tile).cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64("class"), "m").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    tiles = met.select(
        *bucket, "class", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        (F.col("own") <= F.col("other")).alias("at_left"), (F.col("own") >= F.col("other")).alias("at_right"),
    )
    with_vectors = tiles.join(classes.select("class", "embedding", "copies"), "class")
    found = stored(compared(with_vectors, bucket, threshold, planes), "found")

    links = found.groupBy("class").agg(F.sum("n").alias("n"))
    reached = components(found.select(F.col("class").alias("a"), F.col("root").alias("b")))
    named = classes.join(reached, classes["class"] == reached["node"], "left").withColumn("root", F.coalesce("root", "class"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    described = named.join(smallest, "root").join(links, "class", "left").select(
        "label", "embedding", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id"
    )
    out = able.join(described, ["label", "embedding"]).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return out.unionByName(alone)
