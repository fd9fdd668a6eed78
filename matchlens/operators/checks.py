"""Comparing sources, and finding what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlens.operators.totals import season_totals
from matchlens.tables import COUNTERS, Tables, one_season

COMPARED = ("sp", *COUNTERS)


def both_sources(t: Tables, season: int | None = None) -> DataFrame:
    """Derived and second-source season lines side by side."""
    ours = season_totals(t.player_game_stats, season).select("player_id", "season", F.lit(True).alias("_d"), *[F.col(c).alias(f"d_{c}") for c in COMPARED])
    theirs = one_season(t.player_season_stats_scraped, season).select("player_id", "season", F.lit(True).alias("_s"), *[F.col(c).alias(f"s_{c}") for c in COMPARED])
    return ours.join(theirs, ["player_id", "season"], "full_outer")


def reconcile(t: Tables, season: int | None = None, tolerance: float = 0.5) -> DataFrame:
    """Fields in which the two sources differ by more than ``tolerance``."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    fields = F.array(*[F.struct(F.lit(c).alias("field"), zero(f"d_{c}").alias("derived"), zero(f"s_{c}").alias("scraped")) for c in COMPARED])
    off = F.filter(fields, lambda x: F.abs(x["derived"] - x["scraped"]) > tolerance)
    return both_sources(t, season).filter("_d and _s").select("player_id", "season", F.explode(off).alias("x")).select("player_id", "season", "x.*")


def reconcile_summary(t: Tables, season: int | None = None, tolerance: float = 0.5) -> DataFrame:
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    off = F.lit(False)
    for c in COMPARED:
        off = off | (F.abs(zero(f"d_{c}") - zero(f"s_{c}")) > tolerance)
    d, s = F.col("_d").isNotNull(), F.col("_s").isNotNull()
    n = lambda cond: F.count(F.when(cond, 1))
    return both_sources(t, season).groupBy("season").agg(
        n(d).alias("derived_players"), n(s).alias("scraped_players"), n(d & s).alias("compared"), n(d & s & ~off).alias("matching"),
        n(d & s & off).alias("discrepancies"), n(s & ~d).alias("only_scraped"), n(d & ~s).alias("only_derived"))


def only_in_one(t: Tables, season: int | None = None) -> DataFrame:
    """Players only one source knows."""
    a = season_totals(t.player_game_stats, season).select("player_id", "season")
    b = one_season(t.player_season_stats_scraped, season).select("player_id", "season")
    keys = ["player_id", "season"]
    return a.join(b, keys, "left_anti").withColumn("only_in", F.lit("derived")).unionByName(
        b.join(a, keys, "left_anti").withColumn("only_in", F.lit("scraped")))


def missing_pbp(t: Tables, since: str | None = None, season: int | None = None) -> DataFrame:
    """Contests with set scores but no play-by-play, optionally since a day."""
    games = one_season(t.contests, season).filter(F.col("set_scores").isNotNull())
    games = games if since is None else games.filter(F.col("date") >= since)
    return games.join(t.pbp_events.select("contest_id").distinct(), "contest_id", "left_anti").select("contest_id", "season", "date")


def unfilled_contests(t: Tables, season: int | None = None) -> DataFrame:
    """Contests lacking a date, a team or a result."""
    gap = F.lit(False)
    for c in ("date", "home_team_id", "away_team_id", "home_sets_won", "away_sets_won"):
        gap = gap | F.col(c).isNull()
    return one_season(t.contests, season).filter(gap).select("contest_id", "season")


def orphans(t: Tables) -> DataFrame:
    """Box-score lines whose player or contest does not exist."""
    box = t.player_game_stats.select("contest_id", "player_id", "season")
    people = t.players.select(F.col("id").alias("player_id"), "season")
    return box.join(people, ["player_id", "season"], "left_anti").withColumn("missing", F.lit("player")).unionByName(
        box.join(t.contests.select("contest_id"), "contest_id", "left_anti").withColumn("missing", F.lit("contest")))
