"""Monday-to-Sunday weeks, numbered from each season's first one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlens.tables import Tables, one_season


def text_day(col: str | Column) -> Column:
    """The date at the start of a text timestamp; NULL for other text and impossible dates."""
    col = F.col(col) if isinstance(col, str) else col
    return F.when(col.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.try_to_date(F.substring(col, 1, 10), "yyyy-MM-dd"))


def _numbered(dated: DataFrame) -> DataFrame:
    parsed = dated.withColumn("game_date", text_day("raw_date")).drop("raw_date")
    placed = parsed.withColumn("week_monday", F.date_trunc("week", "game_date").cast("date"))
    # One row per season, so the broadcast is bounded by the number of years played.
    first = placed.groupBy("season").agg(F.min("week_monday").alias("_first"))
    return placed.join(first, "season").select(
        "contest_id", "season", "game_date", "week_monday",
        (F.floor(F.datediff("week_monday", "_first") / 7) + 1).cast("int").alias("week_number"),
    )


def played_weeks(t: Tables) -> DataFrame:
    return _numbered(t.contests.select("contest_id", "season", F.col("date").alias("raw_date")))


def contest_weeks(t: Tables, season: int | None = None) -> DataFrame:
    """Weeks over played and scheduled games; scheduled rows carry no contest id."""
    played = one_season(t.contests, season).select("contest_id", "season", F.col("date").alias("raw_date"))
    planned = one_season(t.schedule, season).select(
        F.lit(None).cast("string").alias("contest_id"), "season", F.col("date").alias("raw_date")
    )
    return _numbered(played.unionByName(planned))


def contest_week_ids(t: Tables, season: int | None = None) -> DataFrame:
    return contest_weeks(t, season).filter(F.col("contest_id").isNotNull()).select(
        "contest_id", "week_number", "week_monday", "game_date"
    )


def list_weeks(t: Tables, season: int | None = None) -> DataFrame:
    weeks = contest_weeks(t, season).groupBy("season", "week_number").agg(
        F.min("week_monday").alias("start"), F.count("contest_id").alias("contest_count")
    )
    return weeks.withColumn("end", F.date_add("start", 6))


def list_seasons(t: Tables) -> DataFrame:
    return t.contests.select("season").distinct().orderBy(F.desc("season"))
