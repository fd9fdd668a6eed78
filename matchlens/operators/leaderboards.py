"""Player rankings by season or week: single stats, weighted points, match highs, qualifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlens.functions.numbers import round_to
from matchlens.constants import (
    GAME_STATS, LEADER_COMPONENTS, QUALIFIER_QUANTILE, QUALIFIERS, SEASON_STATS,
)
from matchlens.functions.predicates import contains, roster_filters
from matchlens.operators.conference import with_conference
from matchlens.operators.ranking import check_choice, directed, top_per
from matchlens.operators.totals import fantasy_points, ratio, season_totals, week_totals
from matchlens.tables import Tables, one_season


def roster(t: Tables, season: int | None = None) -> DataFrame:
    """Players with team and season conference."""
    players = one_season(t.players, season).select(
        F.col("id").alias("player_id"), "season", "team_id", "ncaa_player_id", "name", "number", "position",
        "class_year", "height_inches", "hometown", "high_school",
    )
    return with_conference(players, t)


def _lines(t: Tables, scope: str, season: int | None, week: int | None) -> DataFrame:
    check_choice(scope, ("season", "week"), "scope")
    if scope == "season":
        return season_totals(t.player_game_stats, season).drop("team_id")
    return week_totals(t, season, week)


def _keys(scope: str) -> list[str]:
    return ["season"] if scope == "season" else ["season", "week_number"]


def player_leaderboard(
    t: Tables, stat: str = "kills", scope: str = "season", season: int | None = None, week: int | None = None,
    conference_id: int | None = None, position: str | None = None, class_year: str | None = None,
    team_id: int | None = None, min_sets: float = 0, min_attacks: float = 0, limit: int = 50, offset: int = 0,
) -> DataFrame:
    """The best players by ``stat`` within each season, or each week of it."""
    check_choice(stat, SEASON_STATS, "stat")
    rows = _lines(t, scope, season, week)
    if min_sets:
        rows = rows.filter(F.col("sp") >= min_sets)
    if min_attacks:
        rows = rows.filter(F.col("total_attacks") >= min_attacks)
    rows = rows.join(roster(t, season), ["player_id", "season"])
    if position:
        rows = rows.filter(contains("position", position))
    if class_year:
        rows = rows.filter(F.col("class_year") == class_year)
    if team_id is not None:
        rows = rows.filter(F.col("team_id") == team_id)
    if conference_id is not None:
        rows = rows.filter(F.col("conference_id") == conference_id)
    rows = rows.withColumn("value", F.col(stat))
    order = [directed("value"), F.col("player_id")]
    return top_per(rows, _keys(scope), order, limit, offset).select(
        *_keys(scope), "rank", "player_id", "name", "team_id", "team", "conference", "position", "class_year",
        "height_inches", F.col("gp").alias("games"), F.col("sp").alias("sets"), "value",
        *[F.col(c).alias(f"c_{c}") for c in LEADER_COMPONENTS],
    )


def leaderboard(
    t: Tables, stat: str = "kills", season: int | None = None, min_sets: float = 0, limit: int = 25,
    order: str = "desc", **filters,
) -> DataFrame:
    """Season leaders with roster filters; ``rec_net`` is receptions less reception errors."""
    check_choice(stat, (*SEASON_STATS, "rec_net"), "stat")
    zero = F.lit(0.0)
    value = F.coalesce("retatt", zero) - F.coalesce("rerr", zero) if stat == "rec_net" else F.col(stat)
    rows = season_totals(t.player_game_stats, season).drop("team_id").withColumn("value", value)
    if min_sets:
        rows = rows.filter(F.col("sp") >= float(min_sets))
    rows = rows.join(roster(t, season).filter(roster_filters(**filters)), ["player_id", "season"])
    keys = [directed("value", order), F.col("player_id")]
    return top_per(rows, ["season"], keys, limit).select(
        "season", "rank", "player_id", F.col("name").alias("player"), "team", "conference", "class_year", "position",
        "hometown", "high_school", F.col("gp").alias("games"), F.col("sp").alias("sets"),
        F.col("retatt").alias("receptions"), F.col("rerr").alias("reception_errors"), F.lit(stat).alias("stat"), "value",
    )


def fantasy_leaderboard(
    t: Tables, scope: str = "season", season: int | None = None, week: int | None = None,
    conference_id: int | None = None, position: str | None = None, q: str | None = None, min_sets: float = 0,
    limit: int = 50, offset: int = 0, weights: dict[str, float] | None = None,
) -> DataFrame:
    """Players by weighted points within each season or week."""
    rows = _lines(t, scope, season, week)
    if min_sets:
        rows = rows.filter(F.col("sp") >= min_sets)
    rows = rows.withColumn("value", fantasy_points(weights)).join(roster(t, season), ["player_id", "season"])
    if position:
        rows = rows.filter(contains("position", position))
    if conference_id is not None:
        rows = rows.filter(F.col("conference_id") == conference_id)
    if q and q.strip():
        text = q.strip()
        rows = rows.filter(contains("name", text) | contains("team", text) | contains("team_short", text))
    order = [directed("value"), F.col("player_id")]
    return top_per(rows, _keys(scope), order, limit, offset).select(
        *_keys(scope), "rank", "player_id", "name", "team", "conference", "position", F.col("gp").alias("games"),
        F.col("sp").alias("sets"), round_to("value", 2).alias("value"),
    )


def adaptive_qualifier(
    t: Tables, stat: str, scope: str = "season", season: int | None = None, week: int | None = None,
    by_position: bool = False, conference_id: int | None = None,
) -> DataFrame | None:
    """Sample floor of a rate board per season (or week); None for counting stats.

    The anchor is the 75th-percentile number of matches; the floor grows with it and never exceeds
    the largest sample in the field.
    """
    if stat not in QUALIFIERS:
        return None
    by, rate, floor = QUALIFIERS[stat]
    rows = _lines(t, scope, season, week).filter(F.col("gp") > 0)
    keys = _keys(scope)
    if by_position or conference_id is not None:
        rows = rows.join(roster(t, season), ["player_id", "season"])
        if conference_id is not None:
            rows = rows.filter(F.col("conference_id") == conference_id)
        if by_position:
            keys = [*keys, "position"]
    cap = F.col("total_attacks") if by == "attacks" else F.col("sp")
    field = rows.groupBy(*keys).agg(
        F.expr(f"percentile_disc({QUALIFIER_QUANTILE}) within group (order by gp)").cast("int").alias("anchor"),
        F.max(cap).cast("int").alias("cap"),
    )
    wanted = F.greatest(F.lit(floor), F.bround(F.lit(rate) * F.col("anchor"), 0).cast("int"))
    return field.select(
        *keys, F.lit(stat).alias("stat"), F.lit(by).alias("by"), "anchor",
        F.when(F.coalesce("cap", F.lit(0)) > 0, F.least(wanted, F.col("cap"))).otherwise(wanted).alias("min"),
    )


def game_highs(
    t: Tables, stat: str = "kills", season: int | None = None, conference: Column | None = None,
    team_id: int | None = None, position: Column | None = None, limit: int = 25,
) -> DataFrame:
    """The largest single-match values, per season, with opponent and day.

    The top k are picked before the opponent is looked up, unless a filter needs the roster first.
    """
    check_choice(stat, GAME_STATS, "stat")
    zero = F.lit(0.0)
    value = F.coalesce("block_solos", zero) + F.coalesce("block_assists", zero) if stat == "total_blocks" else F.col(stat)
    rows = one_season(t.player_game_stats, season).select(
        "season", "contest_id", "player_id", F.col("team_id").alias("side_id"), "sets", value.alias("value")
    ).filter(F.col("value").isNotNull())
    people = roster(t, season)
    filtered = conference is not None or team_id is not None or position is not None
    if filtered:
        for keep in (conference, position, F.col("team_id") == team_id if team_id is not None else None):
            people = people if keep is None else people.filter(keep)
        rows = rows.join(people, ["player_id", "season"])
    order = [directed("value"), F.col("contest_id"), F.col("player_id")]
    best = top_per(rows, ["season"], order, limit)
    if not filtered:
        best = best.join(people, ["player_id", "season"])
    games = t.contests.select("contest_id", "date", "home_team_id", "away_team_id")
    names = t.teams.select(F.col("id").alias("_opp"), F.col("name").alias("opponent"))
    return (
        best.join(games, "contest_id", "left")
        .withColumn("_opp", F.when(F.col("side_id") == F.col("away_team_id"), F.col("home_team_id")).otherwise(F.col("away_team_id")))
        .join(names, "_opp", "left")
        .select("season", "rank", F.col("name").alias("player"), "team", "conference", "position", "opponent",
                F.substring("date", 1, 10).alias("date"), "sets", F.lit(stat).alias("stat"), "value")
    )


def double_doubles(t: Tables, season: int | None = None, people_filter: Column | None = None, limit: int = 25) -> DataFrame:
    """Players by number of matches with ten or more in two, and in three, of five categories."""
    zero = F.lit(0.0)
    blocks = F.coalesce("block_solos", zero) + F.coalesce("block_assists", zero)
    big = [F.col(c) >= 10 for c in ("kills", "assists", "digs", "aces")] + [blocks >= 10]
    n = sum((F.when(c, 1).otherwise(0) for c in big[1:]), F.when(big[0], 1).otherwise(0))
    counts = one_season(t.player_game_stats, season).select("player_id", "season", n.alias("n")).groupBy(
        "player_id", "season"
    ).agg(
        F.sum(F.when(F.col("n") >= 2, 1).otherwise(0)).alias("double_doubles"),
        F.sum(F.when(F.col("n") >= 3, 1).otherwise(0)).alias("triple_doubles"),
    ).filter("double_doubles > 0")
    people = roster(t, season)
    if people_filter is not None:
        people = people.filter(people_filter)
    rows = counts.join(people, ["player_id", "season"])
    order = [F.desc("double_doubles"), F.desc("triple_doubles"), F.col("player_id")]
    return top_per(rows, ["season"], order, limit).select(
        "season", "rank", "player_id", F.col("name").alias("player"), "team", "conference", "position",
        "double_doubles", "triple_doubles",
    )


__all__ = [
    "adaptive_qualifier", "double_doubles", "fantasy_leaderboard", "game_highs", "leaderboard",
    "player_leaderboard", "ratio", "roster",
]
