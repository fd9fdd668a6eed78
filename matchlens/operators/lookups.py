"""Searches, lists, player cards and other lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlens.functions.numbers import round_to
from matchlens.functions.predicates import contains, roster_filters
from matchlens.operators.conference import team_seasons
from matchlens.operators.leaderboards import roster
from matchlens.operators.people import height_text
from matchlens.operators.prefix import running_by_chunk
from matchlens.operators.ranking import directed, top_per
from matchlens.operators.totals import season_totals
from matchlens.tables import Tables, one_season


def search_players(
    t: Tables, season: int | None = None, sort_by: str = "name", limit: int = 20, order: str = "desc", **filters
) -> DataFrame:
    """Players by name and roster attributes, alphabetically or by height."""
    rows = roster(t, season).filter(roster_filters(**filters))
    keys = [directed("height_inches", order)] if sort_by == "height" else []
    return top_per(rows, ["season"], [*keys, F.col("name"), F.col("player_id")], limit).select(
        "player_id", "season", "rank", F.col("name").alias("player"), "team_id", "team", "conference", "position", "class_year",
        "number", "height_inches", height_text("height_inches").alias("height"), "hometown", "high_school",
    )


def list_teams(t: Tables, query: str | None = None, conference: Column | None = None, state: str | None = None) -> DataFrame:
    """Teams by name, short name or alias, with their current conference."""
    conf = t.conferences.select(F.col("id").alias("conference_id"), F.col("name").alias("conference"), F.col("short_name").alias("conference_short"))
    rows = t.teams.join(conf, "conference_id", "left")
    if query:
        rows = rows.filter(contains("name", query) | contains("short_name", query) | F.exists("aliases", lambda a: contains(a, query)))
    if conference is not None:
        rows = rows.filter(conference)
    if state:
        rows = rows.filter(F.col("state") == state)
    return rows.select("id", F.col("name").alias("team"), "short_name", "conference", "aliases")


def list_contests(t: Tables, season: int | None = None, limit: int = 200, offset: int = 0) -> DataFrame:
    """A page of each season's contests, by contest id."""
    rows = one_season(t.contests, season).select("season", "contest_id", "date", "home_team_id", "away_team_id", "home_sets_won", "away_sets_won")
    names = t.teams.select("id", "name")
    page = top_per(rows, ["season"], [F.col("contest_id")], limit, offset, rank="place")
    for side in ("home", "away"):
        page = page.join(names.select(F.col("id").alias(f"{side}_team_id"), F.col("name").alias(side)), f"{side}_team_id", "left")
    return page


def search(t: Tables, q: str, season: int | None = None, limit: int = 20) -> DataFrame:
    """Players and teams whose name contains ``q``, per season and kind."""
    who = one_season(t.players, season).filter(contains("name", q)).select(
        "season", F.lit("player").alias("kind"), F.col("id").cast("bigint").alias("id"), "name"
    )
    what = one_season(team_seasons(t), season).filter(contains("team", q) | contains("team_short", q)).select(
        "season", F.lit("team").alias("kind"), F.col("team_id").cast("bigint").alias("id"), F.col("team").alias("name")
    )
    return top_per(who.unionByName(what), ["season", "kind"], [F.col("name"), F.col("id")], limit)


def player_cards(t: Tables, season: int | None = None, pbp: DataFrame | None = None) -> DataFrame:
    """Bio, season line, starts from the second source and play-by-play line of every player."""
    started = one_season(t.player_season_stats_scraped, season).select("player_id", "season", F.col("gs").cast("int").alias("gs"))
    out = (
        roster(t, season)
        .join(season_totals(t.player_game_stats, season).drop("team_id"), ["player_id", "season"], "left")
        .join(started, ["player_id", "season"], "left")
    )
    return out if pbp is None else out.join(pbp, ["player_id", "season"], "left")


def favorite_contests(t: Tables) -> DataFrame:
    """Per (user, season), the matches their favourite players appeared in."""
    liked = t.favorites.filter("entity_type = 'player'").select("user_id", "season", F.col("entity_id").alias("player_id"))
    return liked.join(t.player_game_stats.select("player_id", "season", "contest_id"), ["player_id", "season"]).select(
        "user_id", "season", "contest_id"
    ).distinct()


def favorite_teams(t: Tables) -> DataFrame:
    """Per (user, season), the teams of their favourite players."""
    liked = t.favorites.filter("entity_type = 'player'").select("user_id", F.col("season").alias("liked_season"), F.col("entity_id").alias("player_id"))
    people = t.players.select(F.col("id").alias("player_id"), "team_id")
    return liked.join(people, "player_id").select("user_id", F.col("liked_season").alias("season"), "team_id").distinct()


def signups_by_day(t: Tables) -> DataFrame:
    """New accounts per day without gaps, and the running total."""
    daily = t.users.filter(F.col("created_at").isNotNull()).groupBy(F.to_date("created_at").alias("date")).agg(F.count(F.lit(1)).alias("new"))
    # Years first, then the days of each, so that one far-off date makes no endless array.
    span = daily.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    years = span.select("a", "b", F.explode(F.sequence(F.year("a"), F.year("b"))).alias("y"))
    first, last = F.greatest("a", F.make_date("y", F.lit(1), F.lit(1))), F.least("b", F.make_date("y", F.lit(12), F.lit(31)))
    days = years.select(F.explode(F.sequence(first, last)).alias("date"))
    out = days.join(daily, "date", "left").withColumn("new", F.coalesce("new", F.lit(0)))
    running = running_by_chunk(out, [], F.year("date"), ["date"], {"_before": "new"})
    return running.select("date", "new", (F.col("_before") + F.col("new")).alias("cumulative"))


def game_log(t: Tables, season: int | None = None) -> DataFrame:
    """Every player's matches with date, week, opponent, points and play-by-play counts."""
    from matchlens.operators.rally import player_pbp
    from matchlens.operators.totals import fantasy_points
    from matchlens.operators.weeks import contest_week_ids

    games = one_season(t.contests, season).select("contest_id", "date", "home_team_id", "away_team_id")
    weeks = contest_week_ids(t, season).select("contest_id", "week_number")
    pbp = player_pbp(one_season(t.pbp_events, season), ["contest_id", "player_id"])
    names = t.teams.select(F.col("id").alias("opponent_id"), F.col("name").alias("opponent"), F.col("short_name").alias("opponent_short"))
    rows = one_season(t.player_game_stats, season).join(games.join(weeks, "contest_id", "left"), "contest_id", "left")
    rows = rows.withColumns({
        "opponent_id": F.when(F.col("team_id") == F.col("away_team_id"), F.col("home_team_id")).otherwise(F.col("away_team_id")),
        "fantasy_points": round_to(fantasy_points(), 2), "total_blocks": F.coalesce("block_solos", F.lit(0.0)) + F.coalesce("block_assists", F.lit(0.0)),
    })
    return rows.join(names, "opponent_id", "left").join(pbp, ["contest_id", "player_id"], "left")


def team_player_table(t: Tables, season: int | None = None, week: int | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """Every rostered player's line on the roster's team, by season or for one week; players without
    a match keep a row."""
    from matchlens.operators.rally import player_pbp, season_pbp
    from matchlens.operators.totals import fantasy_points, season_totals, week_totals
    from matchlens.operators.weeks import contest_week_ids

    keys = ["player_id", "season"]
    if week is None:
        lines, pbp = season_totals(t.player_game_stats, season).drop("team_id"), season_pbp(t, season)
    else:
        lines = week_totals(t, season, week).drop("week_number")
        within = contest_week_ids(t, season).filter(F.col("week_number") == week).select("contest_id")
        pbp = player_pbp(one_season(t.pbp_events, season).join(within, "contest_id", "left_semi"), ["season", "player_id"])
        pct = F.when(F.col("set_attempts") > 0, F.col("assists") / F.col("set_attempts"))
        pbp = pbp.join(lines.select(*keys, "assists"), keys, "left").withColumn("assist_pct", pct).drop("assists")
    people = one_season(t.players, season).select(F.col("id").alias("player_id"), "season", "team_id", "name", "number", "position", "class_year", "height_inches")
    rows = people.join(lines, keys, "left").join(pbp, keys, "left")
    points = round_to(fantasy_points(weights), 2)
    return rows.withColumn("fantasy_points", points if week is None else F.when(F.col("gp").isNotNull(), points)).withColumnsRenamed({"gp": "games", "sp": "sets"})


def team_rosters(t: Tables, season: int | None = None) -> DataFrame:
    """Players of every team in order of number."""
    return one_season(t.players, season).withColumnRenamed("id", "player_id").orderBy("season", "team_id", F.asc_nulls_last("number"), "player_id")


def box_totals(t: Tables, season: int | None = None) -> DataFrame:
    """Team line of a box score: sums, NULL where nobody has the counter; sets as the most of any player."""
    from matchlens.tables import COUNTERS

    sums = one_season(t.player_game_stats, season).groupBy("contest_id", "team_id").agg(F.max("sets").alias("sets"), *[F.sum(c).alias(c) for c in COUNTERS])
    zero = F.lit(0.0)
    blocks = F.coalesce("block_solos", zero) + F.coalesce("block_assists", zero) / 2.0
    return sums.withColumn("team_blocks", F.when(F.col("block_solos").isNotNull() | F.col("block_assists").isNotNull(), blocks))


def game_leaders(t: Tables, season: int | None = None) -> DataFrame:
    """Best player of each side of a match in points, kills, assists, digs and blocks."""
    zero = F.lit(0.0)
    values = {c: F.coalesce(F.col(c), zero) for c in ("pts", "kills", "assists", "digs")}
    values["blocks"] = F.coalesce("block_solos", zero) + F.coalesce("block_assists", zero)
    best = one_season(t.player_game_stats, season).groupBy("contest_id", "team_id").agg(
        *[F.max(F.struct(v.alias("value"), (-F.col("player_id")).alias("p"))).alias(c) for c, v in values.items()])
    rows = best.select("contest_id", "team_id", F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("b")) for c in values])).alias("x"))
    return rows.select("contest_id", "team_id", "x.category", (-F.col("x.b.p")).alias("player_id"), F.col("x.b.value").alias("value")).filter("value > 0")
