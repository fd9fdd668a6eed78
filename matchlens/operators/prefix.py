"""Running counts over long ordered groups, without putting a whole group in one task.

The group is cut into chunks by a coarse value of its ordering column. Each chunk is numbered on
its own; chunk totals, of which there are few, give each chunk its starting offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_by_chunk(
    df: DataFrame,
    keys: list[str],
    chunk: Column,
    order: list[str],
    counters: dict[str, str],
    seq: str | None = None,
) -> DataFrame:
    """Add ``seq`` (1-based position) and, per counter, the sum over all *earlier* rows.

    ``counters`` maps a new column to the numeric column it accumulates. ``chunk`` must not
    decrease along ``order``.
    """
    cut = [*keys, "_chunk"]
    local = Window.partitionBy(*cut).orderBy(*order)
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    chunks = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)

    marked = df.withColumn("_chunk", chunk)
    totals = marked.groupBy(*cut).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(src).alias(f"_t_{c}") for c, src in counters.items()]
    )
    starts = totals.select(
        *cut,
        F.coalesce(F.sum("_n").over(chunks), F.lit(0)).alias("_n0"),
        *[F.coalesce(F.sum(f"_t_{c}").over(chunks), F.lit(0)).alias(f"_o_{c}") for c in counters],
    )
    numbered = marked.withColumn("_rn", F.row_number().over(local))
    for c, src in counters.items():
        numbered = numbered.withColumn(c, F.coalesce(F.sum(src).over(before), F.lit(0)))
    out = numbered.join(starts, cut)
    if seq:
        out = out.withColumn(seq, F.col("_rn") + F.col("_n0"))
    for c in counters:
        out = out.withColumn(c, F.col(c) + F.col(f"_o_{c}"))
    return out.drop("_chunk", "_rn", "_n0", *[f"_o_{c}" for c in counters])
