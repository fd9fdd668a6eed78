"""Loads as merges: the stored rows and the new ones give the rows to store.

Functions on frames return the merged rows; those on a :class:`~matchlens.sources.versioned.VersionedTable` give
the merge the buckets that it touches, and commit.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlens.sources.versioned import Manifest, VersionedTable

KEEP_NEW, KEEP_OLD, TAKE_NEW = "new or old", "old or new", "new"


def latest(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row per key: the last by ``order``. A map-side aggregate, so repeats never pile up."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, str] | None = None) -> DataFrame:
    """Merge by key. Columns of ``new`` win; ``rules`` may say to keep an old value instead.

    ``new or old`` keeps the old value where the new one is missing, ``old or new`` fills only
    gaps. Columns absent from ``new`` are kept.
    """
    rules = rules or {}
    a, b = old.withColumn("_old", F.lit(True)).alias("a"), new.withColumn("_new", F.lit(True)).alias("b")
    both = a.join(b, keys, "full_outer")
    cols = []
    for c in old.columns:
        if c in keys:
            cols.append(F.col(c))
        elif c not in new.columns:
            cols.append(F.col(f"a.{c}").alias(c))
        else:
            rule = rules.get(c, TAKE_NEW)
            fresh, kept = F.col(f"b.{c}"), F.col(f"a.{c}")
            value = {
                TAKE_NEW: F.when(F.col("_new"), fresh).otherwise(kept),
                KEEP_NEW: F.coalesce(fresh, kept),
                KEEP_OLD: F.coalesce(kept, fresh),
            }[rule]
            cols.append(value.alias(c))
    return both.select(*cols)


def replace_keys(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Everything stored for the keys of ``new`` gives way to ``new``."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def prune(merged: DataFrame, feed: DataFrame, scope: list[str], keys: list[str]) -> DataFrame:
    """Drop rows of the scopes the feed covers that the feed no longer lists."""
    covered = merged.join(feed.select(*scope).distinct(), scope, "left_semi").join(feed.select(*keys).distinct(), keys, "left_semi")
    return merged.join(feed.select(*scope).distinct(), scope, "left_anti").unionByName(covered)


def keep_real_time(new: Column, old: Column, unset: Column) -> Column:
    """A published time replaces the stored one; a missing one never does."""
    return F.when(unset & old.isNotNull(), old).otherwise(new)


def refresh_forward(old: DataFrame, new: DataFrame, keys: list[str], day: str, today: str, last: str) -> DataFrame:
    """Rows from ``today`` to ``last`` are replaced; older ones, and those without a day, are frozen and
    win over new ones."""
    frozen = old.filter(~F.coalesce(F.col(day).between(today, last), F.lit(False)))
    there = frozen.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return frozen.unionByName(new.join(there, same, "left_anti"), allowMissingColumns=True)


def snapshot_ranks(old: DataFrame, teams: DataFrame, season: int, as_of: str) -> DataFrame:
    """Record today's ranks of every ranked team; a second run of the day replaces the first."""
    now = teams.filter("rpi_rank is not null or avca_rank is not null").select(
        F.lit(season).alias("season"), F.lit(as_of).cast("date").alias("as_of"), F.col("id").alias("team_id"), "rpi_rank", "rpi_record", "avca_rank")
    return upsert(old, now, ["season", "as_of", "team_id"])


def archive_polls(old: DataFrame, polls: DataFrame) -> DataFrame:
    """Fill poll ranks of past days (``season``, ``as_of``, ``slug_no``, ``team_id``, ``avca_rank``).

    One poll counts per day, the first by ``slug_no``; other ranks of the day stay.
    """
    first = polls.groupBy("season", "as_of").agg(F.min("slug_no").alias("slug_no"))
    ranks = polls.join(first, ["season", "as_of", "slug_no"]).groupBy("season", "as_of", "team_id").agg(F.min("avca_rank").alias("avca_rank"))
    return upsert(old, ranks, ["season", "as_of", "team_id"])


def changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Load report: how many rows were inserted, updated, left."""
    both = old.select(*keys, F.lit(1).alias("_o")).join(new.select(*keys, F.lit(1).alias("_n")), keys, "full_outer")
    return both.agg(
        F.count(F.when(F.col("_o").isNull(), 1)).alias("inserted"), F.count(F.when(F.col("_o").isNotNull() & F.col("_n").isNotNull(), 1)).alias("updated"),
        F.count(F.when(F.col("_n").isNull(), 1)).alias("untouched"))


def replace_stored(table: VersionedTable, new: DataFrame, keys: list[str]) -> Manifest:
    """:func:`replace_keys` on a table bucketed by some of the keys."""
    return _bucketed(table, keys).merge(new, lambda old, rows: replace_keys(old, rows, keys))


def upsert_and_prune(table: VersionedTable, feed: DataFrame, scope: list[str], keys: list[str], rules: dict[str, str] | None = None) -> Manifest:
    """:func:`upsert`, then :func:`prune`, on a table bucketed by the feed's scope: scopes that the feed
    does not cover are neither read nor written, but for those that share a bucket."""
    return _bucketed(table, scope).merge(feed, lambda old, rows: prune(upsert(old, rows, keys, rules), rows, scope, keys))


def refresh_days(table: VersionedTable, new: DataFrame, keys: list[str], day: str, today: str, last: str, batch: tuple[str, int] | None = None) -> Manifest:
    """:func:`refresh_forward` on a table bucketed by ``day``, which is one of the keys: buckets of the days from
    ``today`` to ``last`` and of the feed's days."""
    if day not in keys:
        raise ValueError(f"{day} has to be one of the keys {keys}")
    listed = F.transform(F.sequence(F.lit(today).cast("date"), F.lit(last).cast("date")), lambda d: d.cast("string"))
    days = table.spark.range(1).select(F.explode(listed).alias(day))
    how = lambda old, rows: refresh_forward(old, rows, keys, day, today, last).select(*old.columns)
    return _bucketed(table, [day]).merge(new, how, touch=days, batch=batch)


def _bucketed(table: VersionedTable, keys: list[str]) -> VersionedTable:
    if not set(table.by) <= set(keys):
        raise ValueError(f"{table.path} is bucketed by {table.by}, not by some of {keys}")
    return table
