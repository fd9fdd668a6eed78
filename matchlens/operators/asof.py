"""Ranks as they stood on the day of a match, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlens.operators.conference import with_conference
from matchlens.operators.ranking import check_choice, top_per
from matchlens.operators.weeks import text_day
from matchlens.tables import Tables, one_season


def ranks_as_of(t: Tables, days: DataFrame) -> DataFrame:
    """For each (season, team_id, day), the newest snapshot with ``as_of <= day``.

    The snapshot is taken as a whole: a newer one without a poll rank hides an older poll rank.
    Days are reduced to distinct ones first, so a team's ordered group holds at most its days and
    its snapshots, however many matches refer to them.
    """
    asked = days.select("season", "team_id", "day").filter(F.col("day").isNotNull()).distinct()
    known = t.ranking_snapshots.select(
        "season", "team_id", F.col("as_of").alias("day"), F.lit(0).alias("kind"),
        F.struct(F.col("rpi_rank").alias("rpi"), F.col("avca_rank").alias("avca")).alias("snap"),
    )
    line = asked.withColumn("kind", F.lit(1)).unionByName(known, allowMissingColumns=True)
    back = Window.partitionBy("season", "team_id").orderBy("day", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return (
        line.withColumn("seen", F.last("snap", ignorenulls=True).over(back))
        .filter("kind = 1")
        .select("season", "team_id", "day", F.col("seen.rpi").alias("rpi"), F.col("seen.avca").alias("avca"))
    )


def decided_matches(t: Tables, season: int | None = None) -> DataFrame:
    """Winner, loser, score and day of every decided match."""
    home = F.col("home_sets_won") > F.col("away_sets_won")
    pick = lambda a, b: F.when(home, F.col(a)).otherwise(F.col(b))
    return (
        one_season(t.contests, season)
        .filter(F.col("home_team_id").isNotNull() & F.col("away_team_id").isNotNull() & (F.col("home_sets_won") != F.col("away_sets_won")))
        .select(
            "season", "contest_id", text_day("date").alias("day"),
            pick("home_team_id", "away_team_id").alias("winner_id"), pick("away_team_id", "home_team_id").alias("loser_id"),
            F.concat(pick("home_sets_won", "away_sets_won").cast("string"), F.lit("-"),
                     pick("away_sets_won", "home_sets_won").cast("string")).alias("score"),
        )
    )


def _both(matches: DataFrame) -> DataFrame:
    return matches.select("season", "day", F.explode(F.array("winner_id", "loser_id")).alias("team_id"))


def _with_ranks(matches: DataFrame, ranks: DataFrame, who: str) -> DataFrame:
    side = ranks.select(
        "season", "day", F.col("team_id").alias(f"{who}_id"), F.col("rpi").alias(f"{who}_rpi"), F.col("avca").alias(f"{who}_avca")
    )
    return matches.join(side, ["season", "day", f"{who}_id"], "left")


def quality_wins(
    t: Tables, season: int | None = None, poll: str = "avca", threshold: int = 25, conference: Column | None = None,
    team_id: int | None = None,
) -> DataFrame:
    """One row per win over an opponent ranked within ``threshold`` on that day."""
    check_choice(poll, ("avca", "rpi"), "poll")
    matches = decided_matches(t, season)
    if team_id is not None:
        matches = matches.filter(F.col("winner_id") == team_id)
    ranks = ranks_as_of(t, matches.select("season", "day", F.col("loser_id").alias("team_id")))
    wins = _with_ranks(matches, ranks, "loser").withColumn("rank_at_time", F.col(f"loser_{poll}"))
    wins = wins.filter(F.col("rank_at_time") <= max(1, int(threshold))).withColumn("team_id", F.col("winner_id"))
    wins = with_conference(wins, t)
    if conference is not None:
        wins = wins.filter(conference)
    opp = t.teams.select(F.col("id").alias("loser_id"), F.col("name").alias("opponent"), F.col("short_name").alias("opponent_short"))
    return wins.join(opp, "loser_id", "left").select(
        "season", "team_id", "team", "team_short", "conference", "conference_short", F.col("loser_id").alias("opponent_id"),
        "opponent", "opponent_short", "rank_at_time", F.lit(poll).alias("poll"), F.col("day").alias("date"), "score", "contest_id",
    )


def quality_win_counts(t: Tables, season: int | None = None, limit: int | None = None, **args) -> DataFrame:
    """Teams by number of quality wins, with their best one."""
    wins = quality_wins(t, season, **args)
    best = F.min(F.struct("rank_at_time", "date", "contest_id", "opponent"))
    counts = wins.groupBy("season", "team_id", "team", "team_short", "conference").agg(
        F.count(F.lit(1)).alias("quality_wins"), best.alias("b")
    ).select("season", "team_id", "team", "team_short", "conference", "quality_wins",
             F.col("b.rank_at_time").alias("best_rank"), F.col("b.opponent").alias("best_opponent"))
    if limit is None:
        return counts
    return top_per(counts, ["season"], [F.desc("quality_wins"), F.col("team"), F.col("team_id")], limit)


def biggest_upsets(
    t: Tables, season: int | None = None, poll: str = "avca", threshold: int = 25, min_gap: int = 1,
    conference: Column | None = None, team_id: int | None = None, limit: int = 10,
) -> DataFrame:
    """Matches won by the worse-ranked side at the time, largest gap first, per season."""
    check_choice(poll, ("avca", "rpi"), "poll")
    matches = decided_matches(t, season)
    if team_id is not None:
        matches = matches.filter(F.col("winner_id") == team_id)
    ranks = ranks_as_of(t, _both(matches))
    rows = _with_ranks(_with_ranks(matches, ranks, "winner"), ranks, "loser").withColumn(
        "gap", F.col("winner_rpi") - F.col("loser_rpi")
    )
    if poll == "avca":
        rows = rows.filter(
            (F.col("loser_avca") <= max(1, int(threshold)))
            & (F.col("winner_avca").isNull() | (F.col("winner_avca") > F.col("loser_avca")))
        )
    else:
        rows = rows.filter(F.col("gap") >= max(1, int(min_gap)))
    if conference is not None:
        rows = with_conference(rows.withColumn("team_id", F.col("winner_id")), t).filter(conference)
    order = [
        F.col("gap").isNull(), F.desc_nulls_last("gap"), F.coalesce("loser_avca", F.lit(999)),
        F.coalesce(F.col("day").cast("string"), F.lit("")), F.col("contest_id"),
    ]
    best = top_per(rows, ["season"], order, limit)
    for who in ("winner", "loser"):
        names = t.teams.select(F.col("id").alias(f"{who}_id"), F.col("name").alias(who))
        best = best.join(names, f"{who}_id", "left")
    return best.select(
        "season", "rank", "winner_id", "winner", "loser_id", "loser", "winner_rpi", "winner_avca", "loser_rpi", "loser_avca",
        "gap", F.lit(poll).alias("poll"), F.col("day").alias("date"), "score", "contest_id",
    )
