"""Box-score sums per player, per match side and per team."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlens.functions.numbers import round_to
from matchlens.constants import FANTASY_WEIGHTS, WEIGHT_LIMIT
from matchlens.operators.conference import with_conference
from matchlens.operators.ranking import check_choice, directed, top_per
from matchlens.operators.weeks import contest_week_ids
from matchlens.tables import COUNTERS, Tables, one_season

RATES = {
    "kills_per_set": "kills", "assists_per_set": "assists", "aces_per_set": "aces",
    "digs_per_set": "digs", "blocks_per_set": "total_blocks", "pts_per_set": "pts",
}


def ratio(num: Column | str, den: Column | str) -> Column:
    """``num / den``, NULL when the denominator is zero or missing."""
    num = F.col(num) if isinstance(num, str) else num
    den = F.col(den) if isinstance(den, str) else den
    return F.try_divide(num, den)


def with_rates(df: DataFrame) -> DataFrame:
    df = df.withColumn("total_blocks", F.col("block_solos") + F.col("block_assists"))
    hit = F.when(F.col("total_attacks") > 0, (F.col("kills") - F.col("errors")) / F.col("total_attacks"))
    return df.withColumns({"hit_pct": hit} | {r: ratio(base, "sp") for r, base in RATES.items()})


def season_totals(box: DataFrame, season: int | None = None) -> DataFrame:
    """One line per (player, season). A counter never recorded stays NULL.

    Matches are counted once each, also where a box line was given twice.
    """
    sums = one_season(box, season).groupBy("player_id", "season").agg(
        F.max("team_id").alias("team_id"),
        F.count_distinct("contest_id").alias("gp"),
        F.sum("sets").alias("sp"),
        *[F.sum(c).alias(c) for c in COUNTERS],
    )
    return with_rates(sums)


def week_totals(t: Tables, season: int | None = None, week: int | None = None) -> DataFrame:
    """One line per (player, season, week). Missing counters count as zero here."""
    weeks = contest_week_ids(t, season).select("contest_id", "week_number")
    if week is not None:
        weeks = weeks.filter(F.col("week_number") == week)
    zero = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0.0))).alias(c)
    sums = (
        one_season(t.player_game_stats, season)
        .join(weeks, "contest_id")
        .groupBy("player_id", "season", "week_number")
        .agg(F.count_distinct("contest_id").alias("gp"), zero("sets").alias("sp"), *[zero(c) for c in COUNTERS])
    )
    sums = sums.withColumn("total_blocks", F.col("block_solos") + F.col("block_assists"))
    return sums.withColumns(
        {"hit_pct": ratio(F.col("kills") - F.col("errors"), "total_attacks")}
        | {r: ratio(base, "sp") for r, base in RATES.items()}
    )


def resolve_weights(**overrides: float | None) -> dict[str, float]:
    """Default weights with overrides, each held within ±10."""
    weights = dict(FANTASY_WEIGHTS)
    for stat, w in overrides.items():
        if w is not None and stat in weights:
            weights[stat] = max(-WEIGHT_LIMIT, min(WEIGHT_LIMIT, float(w)))
    return weights


def fantasy_points(weights: dict[str, float] | None = None) -> Column:
    """Weighted sum of counters; unknown counters add nothing and zero weights drop out."""
    points = F.lit(0.0)
    for stat, w in (weights or FANTASY_WEIGHTS).items():
        if w and stat in FANTASY_WEIGHTS:
            points = points + F.lit(float(w)) * F.coalesce(F.col(stat), F.lit(0.0))
    return points


def match_sides(box: DataFrame, season: int | None = None) -> DataFrame:
    """Counter sums per (season, contest, team): the grain shared by all team aggregates."""
    return one_season(box, season).groupBy("season", "contest_id", "team_id").agg(
        *[F.sum(c).alias(c) for c in COUNTERS]
    )


def team_totals(t: Tables, season: int | None = None) -> DataFrame:
    """Per (season, team): matches and NULL-preserving sums."""
    return match_sides(t.player_game_stats, season).groupBy("season", "team_id").agg(
        F.count("contest_id").alias("games"), *[F.sum(c).alias(c) for c in COUNTERS]
    )


def official_blocks() -> Column:
    """Team blocks: an assisted block is shared, so it counts half."""
    return F.col("block_solos") + F.col("block_assists") / 2.0


def team_stats(
    t: Tables, season: int | None = None, conference: Column | None = None, team_id: int | None = None,
    sort_by: str = "kills", order: str = "desc", limit: int = 25,
) -> DataFrame:
    """Team sums ranked by one of them, per season."""
    from matchlens.constants import TEAM_SORTS

    check_choice(sort_by, TEAM_SORTS, "sort_by")
    sums = team_totals(t, season)
    if team_id is not None:
        sums = sums.filter(F.col("team_id") == team_id)
    rows = with_conference(sums, t).filter(F.col("team").isNotNull())
    if conference is not None:
        rows = rows.filter(conference)
    rows = rows.withColumns(
        {"total_blocks": official_blocks(), "hit_pct": ratio(F.col("kills") - F.col("errors"), "total_attacks")}
    )
    return top_per(rows, ["season"], [directed(sort_by, order), F.col("team_id")], limit).select(
        "season", "rank", "team_id", "team", "conference", "games", "kills", "assists", "aces", "digs",
        "total_blocks", "pts", "errors", "total_attacks", round_to("hit_pct", 3).alias("hit_pct"),
    )


def team_stat_lines(
    t: Tables, season: int | None = None, by_week: bool = False, weights: dict[str, float] | None = None,
    limit: int = 400, offset: int = 0,
) -> DataFrame:
    """Team lines with fantasy points, by season or by (season, week); missing counters are zero."""
    keys = ["season", "week_number"] if by_week else ["season"]
    sides = match_sides(t.player_game_stats, season)
    if by_week:
        sides = sides.join(contest_week_ids(t, season).select("contest_id", "week_number"), "contest_id")
    sums = sides.groupBy(*keys, "team_id").agg(
        F.count("contest_id").alias("games"),
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in COUNTERS],
    )
    rows = with_conference(sums, t).filter(F.col("team").isNotNull()).withColumns(
        {"total_blocks": official_blocks(), "fantasy_points": round_to(fantasy_points(weights), 2)}
    )
    order = [directed("fantasy_points"), F.col("team_id")]
    return top_per(rows, keys, order, limit, offset).select(
        *keys, "rank", "team_id", "team", "team_short", "conference", "games", "kills", "assists",
        "aces", "digs", "total_blocks", "pts", "fantasy_points",
    )


def opponent_sums(t: Tables, season: int | None = None) -> DataFrame:
    """Per match side, what the other side(s) did: the contest's total less the side's own.

    For any number of sides this equals summing over the other sides, without a self-join. A sum is
    NULL when no other side recorded the counter.
    """
    sides = match_sides(t.player_game_stats, season).select(
        "season", "contest_id", "team_id", "kills", "errors", "total_attacks"
    )
    match = Window.partitionBy("contest_id", "season")
    cols = {"n_sides": F.count("team_id").over(match)}
    for c in ("kills", "errors", "total_attacks"):
        own = F.coalesce(F.col(c), F.lit(0.0))
        others = F.count(c).over(match) - F.col(c).isNotNull().cast("int")
        cols[f"opp_{c}"] = F.when(others > 0, F.sum(c).over(match) - own)
    return sides.withColumns(cols)


def team_defense_totals(t: Tables, season: int | None = None) -> DataFrame:
    faced = opponent_sums(t, season).filter("n_sides > 1")
    return faced.groupBy("season", "team_id").agg(
        F.count("contest_id").alias("games"), F.sum("opp_kills").alias("opp_kills"),
        F.sum("opp_errors").alias("opp_errors"), F.sum("opp_total_attacks").alias("opp_total_attacks"),
    )


def team_defense(
    t: Tables, season: int | None = None, conference: Column | None = None, sort_by: str = "opp_hit_pct",
    min_games: int = 1, limit: int = 25, order: str = "asc",
) -> DataFrame:
    """Opponents' hitting against each team, best defence first."""
    from matchlens.constants import DEFENSE_SORTS

    check_choice(sort_by, DEFENSE_SORTS, "sort_by")
    rows = with_conference(team_defense_totals(t, season), t).filter(
        F.col("team").isNotNull() & (F.col("games") >= max(1, int(min_games)))
    )
    if conference is not None:
        rows = rows.filter(conference)
    rows = rows.withColumn("opp_hit_pct", ratio(F.col("opp_kills") - F.col("opp_errors"), "opp_total_attacks"))
    return top_per(rows, ["season"], [directed(sort_by, order, "asc"), F.col("team_id")], limit).select(
        "season", "rank", "team_id", "team", "conference", "games", "opp_kills", "opp_errors",
        "opp_total_attacks", round_to("opp_hit_pct", 3).alias("opp_hit_pct"),
    )
