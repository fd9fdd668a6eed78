"""Ordering and top-k: nulls last in both directions, one total order, per season."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clamp_limit(limit: int, top: int) -> int:
    return max(1, min(int(limit), top))


def check_choice(value: str, allowed, what: str) -> str:
    if value not in allowed:
        raise ValueError(f"unknown {what} {value!r}; valid: {sorted(allowed)}")
    return value


def directed(col: Column | str, order: str | None = "desc", default: str = "desc") -> Column:
    """Sort key in the asked direction; nulls come last either way."""
    wanted = (order or default).lower()
    wanted = wanted if wanted in ("asc", "desc") else default
    col = F.col(col) if isinstance(col, str) else col
    return col.desc_nulls_last() if wanted == "desc" else col.asc_nulls_last()


def top_per(
    df: DataFrame, by: list[str], order: list[Column], limit: int, offset: int = 0, rank: str = "rank"
) -> DataFrame:
    """Rows ``offset < rank <= offset + limit`` within each group of ``by``.

    Catalyst turns the ``row_number() <= k`` filter into a per-task group limit before the shuffle,
    so at most k rows per group and task travel.
    """
    pos = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    out = df.withColumn(rank, pos).filter(F.col(rank) <= offset + limit)
    return out.filter(F.col(rank) > offset) if offset else out
