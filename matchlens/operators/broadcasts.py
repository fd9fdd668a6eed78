"""Listings of several feeds to the matches they show."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlens.constants import GENERIC_NETWORK, SPECIFIC_NETWORKS
from matchlens.functions.networks import with_network
from matchlens.functions.text import strip_rank_prefix
from matchlens.operators.entities import resolve_team
from matchlens.operators.schedule import day_of
from matchlens.sources.merge import refresh_days, refresh_forward
from matchlens.sources.versioned import Manifest, VersionedTable
from matchlens.tables import Tables

GAME = ["season", "game_date", "team_a_id", "team_b_id"]
KEY = [*GAME, "network"]


def match_days(t: Tables, first: str, last: str) -> DataFrame:
    """Distinct (season, day, pair) of played and scheduled matches within a window."""
    ordered = lambda a, b: (F.least(a, b).alias("team_a_id"), F.greatest(a, b).alias("team_b_id"))
    done = t.contests.filter("home_team_id is not null and away_team_id is not null and date is not null").select(
        "season", day_of("date").alias("game_date"), *ordered("home_team_id", "away_team_id"))
    plan = t.schedule.filter("opponent_team_id is not null").select("season", F.col("date").alias("game_date"), *ordered("team_id", "opponent_team_id"))
    return done.unionByName(plan).filter(F.col("game_date").between(first, last)).distinct()


def resolve_listings(feeds: DataFrame, t: Tables) -> DataFrame:
    """Listings with both teams and a network, the pair in order of id; others are left out."""
    for side in ("a", "b"):
        feeds = feeds.withColumn(f"_clean_{side}", strip_rank_prefix(f"team_{side}"))
        feeds = resolve_team(feeds, t, f"_clean_{side}", f"_{side}", by_slug=True, short_first=True)
    feeds = with_network(feeds, "network_raw")
    return feeds.filter("_a is not null and _b is not null and _a <> _b and network is not null").withColumns(
        {"team_a_id": F.least("_a", "_b"), "team_b_id": F.greatest("_a", "_b")}
    ).drop("_a", "_b", "_clean_a", "_clean_b", "team_a", "team_b")


def attach_dated(listings: DataFrame, days: DataFrame) -> DataFrame:
    """A dated listing belongs to a match of its pair at most one day off, by equi-join on the day."""
    near = listings.withColumn("_d", F.try_to_date("date", "yyyy-MM-dd")).filter("_d is not null").withColumn("_o", F.explode(F.array(F.lit(0), F.lit(-1), F.lit(1))))
    near = near.withColumn("game_date", F.date_format(F.date_add("_d", F.col("_o")), "yyyy-MM-dd")).drop("_d", "_o")
    return near.join(days, GAME, "left_semi")


def _days_of_pair(days: DataFrame, today: str) -> DataFrame:
    """Per pair its only day, its only day around today, and all its days: no more than the window has."""
    near = F.abs(F.datediff(F.try_to_date("game_date", "yyyy-MM-dd"), F.lit(today).cast("date"))) <= 1
    return days.groupBy("season", "team_a_id", "team_b_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min("game_date").alias("_only"),
        F.count(F.when(near, 1)).alias("_near"), F.min(F.when(near, F.col("game_date"))).alias("_today"), F.collect_set("game_date").alias("_days"))


def _undated_day() -> Column:
    return F.when(F.col("_n") == 1, F.col("_only")).when(F.col("is_live") & (F.col("_near") == 1), F.col("_today"))


def attach_undated(listings: DataFrame, days: DataFrame, today: str) -> DataFrame:
    """An undated listing belongs to its pair's only match in the window, or — when on air now — to
    the only one within a day of today."""
    rows = listings.join(_days_of_pair(days, today), ["season", "team_a_id", "team_b_id"])
    return rows.withColumn("game_date", _undated_day()).filter("game_date is not null").drop("_n", "_only", "_near", "_today", "_days")


def attach(listings: DataFrame, days: DataFrame, today: str) -> DataFrame:
    """Dated and undated listings with their matches, by one join on the pair."""
    day = F.try_to_date("date", "yyyy-MM-dd")
    around = F.transform(F.array(F.lit(0), F.lit(-1), F.lit(1)), lambda o: F.date_format(F.date_add(day, o), "yyyy-MM-dd"))
    theirs = F.when(F.col("date").isNull(), F.array(_undated_day())).otherwise(F.array_intersect(around, "_days"))
    rows = listings.join(_days_of_pair(days, today), ["season", "team_a_id", "team_b_id"])
    return rows.withColumn("game_date", F.explode(theirs)).filter("game_date is not null").drop("_n", "_only", "_near", "_today", "_days")


def one_per_network(attached: DataFrame) -> DataFrame:
    """One row per match and network. The first source wins; a live airing upgrades it, and the
    first known channel number is kept. Plain aggregates, so repeats combine before the shuffle."""
    turn = F.struct("source_rank", "feed_no")
    first = F.struct("source", "network_raw", "start_utc", "is_live", "logo_key")
    rows = attached.groupBy(*KEY).agg(
        F.min_by(first, turn).alias("f"), F.max("is_live").alias("any_live"),
        F.min_by("start_utc", F.when(F.col("is_live"), turn)).alias("live_start"),
        F.min_by("channel_no", F.when(F.coalesce("channel_no", F.lit("")) != "", turn)).alias("channel_no"))
    start = F.when(F.col("any_live") & ~F.col("f.is_live"), F.coalesce("live_start", "f.start_utc")).otherwise(F.col("f.start_utc"))
    return rows.select(*KEY, F.col("f.logo_key").alias("logo_key"), F.col("f.source").alias("source"), F.col("any_live").alias("is_live"),
                       F.col("f.network_raw").alias("raw_channel"), "channel_no", start.alias("start_utc"))


def drop_generic(rows: DataFrame) -> DataFrame:
    """The generic label goes where a label of the same app names the match's airing."""
    named = F.max(F.col("network").isin(*SPECIFIC_NETWORKS).cast("int")).over(Window.partitionBy(*GAME))
    return rows.withColumn("_named", named).filter((F.col("network") != GENERIC_NETWORK) | (F.col("_named") == 0)).drop("_named")


def listed_broadcasts(feeds: DataFrame, t: Tables, today: str, days_back: int = 3, days_ahead: int = 10) -> DataFrame:
    """Feeds to rows of ``broadcasts`` for the matches around ``today``."""
    ref = date.fromisoformat(today)
    first, last = (ref - timedelta(days=days_back)).isoformat(), (ref + timedelta(days=days_ahead)).isoformat()
    days = match_days(t, first, last)
    return drop_generic(one_per_network(attach(resolve_listings(feeds, t), days, today)))


def refresh_broadcasts(old: DataFrame, feeds: DataFrame, t: Tables, today: str, days_back: int = 3, days_ahead: int = 10) -> DataFrame:
    """Stored broadcasts after an ingest: today and later anew, the past frozen."""
    last = (date.fromisoformat(today) + timedelta(days=days_ahead)).isoformat()
    return refresh_forward(old, listed_broadcasts(feeds, t, today, days_back, days_ahead), KEY, "game_date", today, last)


def refresh_stored_broadcasts(table: VersionedTable, feeds: DataFrame, t: Tables, today: str, days_back: int = 3, days_ahead: int = 10) -> Manifest:
    """The same on a table bucketed by ``game_date``: only buckets of days to come, or of the feeds' days, change."""
    last = (date.fromisoformat(today) + timedelta(days=days_ahead)).isoformat()
    return refresh_days(table, listed_broadcasts(feeds, t, today, days_back, days_ahead), KEY, "game_date", today, last)
