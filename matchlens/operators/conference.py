"""Season-aware conference membership."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlens.tables import Tables


def team_seasons(t: Tables) -> DataFrame:
    """One row per (team, season) with the conference the team belonged to that season."""
    teams = t.teams.select(
        F.col("id").alias("team_id"), F.col("name").alias("team"), F.col("short_name").alias("team_short"),
        F.col("conference_id").alias("_current"), "rpi_rank", "rpi_record", "avca_rank",
    )
    conf = t.conferences.select(
        F.col("id").alias("conference_id"), F.col("name").alias("conference"),
        F.col("short_name").alias("conference_short"),
    )
    return (
        t.team_season_ids.select("team_id", "season", F.col("conference_id").alias("_then"))
        .join(teams, "team_id")
        .withColumn("conference_id", F.coalesce("_then", "_current"))
        .join(conf, "conference_id", "left")
        .drop("_then", "_current")
    )


def with_conference(df: DataFrame, t: Tables, team: str = "team_id", season: str = "season") -> DataFrame:
    """Add ``team``, ``team_short``, ``conference_id``, ``conference`` and ``conference_short``.

    A team without an entry for the season keeps its current conference; an unknown team keeps the
    row with null labels.
    """
    teams = t.teams.select(
        F.col("id").alias(team), F.col("name").alias("team"), F.col("short_name").alias("team_short"),
        F.col("conference_id").alias("_current"),
    )
    then = t.team_season_ids.select(
        F.col("team_id").alias(team), F.col("season").alias(season), F.col("conference_id").alias("_then")
    )
    conf = t.conferences.select(
        F.col("id").alias("conference_id"), F.col("name").alias("conference"),
        F.col("short_name").alias("conference_short"),
    )
    return (
        df.join(teams, team, "left")
        .join(then, [team, season], "left")
        .withColumn("conference_id", F.coalesce("_then", "_current"))
        .drop("_then", "_current")
        .join(conf, "conference_id", "left")
    )


def conferences_in_season(t: Tables, season: int | None = None) -> DataFrame:
    """Conferences with at least one member, per season."""
    from matchlens.tables import one_season

    present = one_season(team_seasons(t), season).select("season", "conference_id").distinct()
    return present.join(
        t.conferences.select(F.col("id").alias("conference_id"), "name", "short_name"), "conference_id"
    ).select("season", F.col("conference_id").alias("id"), "name", "short_name")
