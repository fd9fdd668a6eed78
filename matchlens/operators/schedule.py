"""Played and upcoming matches in one list, each match once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlens.functions.text import school_slug
from matchlens.operators.weeks import contest_week_ids
from matchlens.tables import Tables, one_season


def pair_key(a: Column | str, b: Column | str) -> Column:
    """The two sides of a match in either order."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.concat_ws(":", F.least(a, b).cast("string"), F.greatest(a, b).cast("string"))


def day_of(col: str | Column) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.substring(col, 1, 10)


def small_hours(date: str | Column) -> Column:
    """A match stored after midnight that belongs to the evening before."""
    date = F.col(date) if isinstance(date, str) else date
    clock = F.substring(date, 12, 5)
    return F.coalesce((clock != "") & (clock < "06:00"), F.lit(False))


def day_before(day: Column) -> Column:
    return F.date_format(F.date_sub(F.try_to_date(day, "yyyy-MM-dd"), 1), "yyyy-MM-dd")


def slate_day(date: str, minutes: Column) -> Column:
    """Day a match is listed under: one earlier when it starts before 5 a.m."""
    day = day_of(date)
    return F.when(minutes < 300, F.coalesce(day_before(day), day)).otherwise(day)


def sort_minutes(minutes: Column) -> Column:
    return F.when(minutes < 300, minutes + 1440).otherwise(minutes)


def clock_minutes(date: str) -> Column:
    """Minutes since midnight of a text timestamp."""
    hh, mm = F.substring(date, 12, 2).try_cast("int"), F.substring(date, 15, 2).try_cast("int")
    return hh * 60 + mm


def played(t: Tables, season: int | None = None) -> DataFrame:
    weeks = contest_week_ids(t, season).select("contest_id", "week_number")
    return one_season(t.contests, season).join(weeks, "contest_id", "left").select(
        "season", "date", "week_number", "contest_id", "ncaa_game_id", F.lit("played").alias("status"),
        "home_team_id", "away_team_id", "home_sets_won", "away_sets_won", "attendance",
    )


def upcoming(t: Tables, season: int | None = None) -> DataFrame:
    """Scheduled matches without a result that no played match covers, one row per match.

    A played match covers a listing with the same outside id, the same pair on the same day (or on
    the next day in the small hours), or — against an unlisted opponent — the same team that day.
    All are hash anti-joins; the two perspectives of a match are reduced to one before them.
    """
    listed = one_season(t.schedule, season).filter(F.col("result_raw").isNull()).withColumns({
        "day": day_of("date"), "pair": pair_key("team_id", "opponent_team_id"),
        "key": F.when(F.col("opponent_team_id").isNotNull(), pair_key("team_id", "opponent_team_id"))
        .otherwise(F.concat_ws("|", F.col("team_id").cast("string"), F.col("opponent_name"))),
    })
    games = one_season(t.contests, season).select("season", "date", "ncaa_game_id", "home_team_id", "away_team_id").withColumn("day", day_of("date"))
    outside = games.filter(F.col("ncaa_game_id").isNotNull()).select("season", "ncaa_game_id").distinct()
    late = games.filter(small_hours("date")).withColumn("day", day_before(F.col("day")))
    on_days = games.unionByName(late).filter(F.col("day").isNotNull())
    pairs = on_days.filter("home_team_id is not null and away_team_id is not null").select(
        "season", "day", pair_key("home_team_id", "away_team_id").alias("pair")).distinct()
    alone = on_days.filter(F.col("home_team_id").isNull() != F.col("away_team_id").isNull()).select(
        "season", "day", F.coalesce("home_team_id", "away_team_id").alias("team_id")).distinct()

    known = listed.filter("opponent_team_id is not null").join(pairs, ["season", "day", "pair"], "left_anti")
    unknown = listed.filter("opponent_team_id is null").join(alone, ["season", "day", "team_id"], "left_anti")
    left = known.unionByName(unknown).join(outside, ["season", "ncaa_game_id"], "left_anti")
    # The lower team id speaks for the match; its own listing decides home and away.
    pick = F.min_by(F.struct("team_id", "opponent_team_id", "opponent_name", "game_time", "site", "neutral_location", "contest_id", "ncaa_game_id"),
                    F.struct("team_id", F.coalesce("contest_id", F.lit(""))))
    one = left.groupBy("season", "date", "key").agg(pick.alias("s"))
    away = F.col("s.site") == "away"
    return one.select(
        "season", "date", "s.game_time", "s.contest_id", "s.ncaa_game_id", F.lit("upcoming").alias("status"), "s.neutral_location",
        F.when(away, F.col("s.opponent_team_id")).otherwise(F.col("s.team_id")).alias("home_team_id"),
        F.when(away, F.col("s.team_id")).otherwise(F.col("s.opponent_team_id")).alias("away_team_id"),
        F.when(F.col("s.opponent_team_id").isNull(), F.col("s.opponent_name")).alias("unlisted_opponent"),
    )


def scoreboard(t: Tables, season: int | None = None, window: Column | None = None) -> DataFrame:
    """Played and upcoming matches, optionally within a date window on ``date``."""
    board = played(t, season).unionByName(upcoming(t, season), allowMissingColumns=True)
    board = board if window is None else board.filter(window)
    names = t.teams
    for side in ("home", "away"):
        board = board.join(names.select(F.col("id").alias(f"{side}_team_id"), F.col("name").alias(f"{side}_team")), f"{side}_team_id", "left")
    return board


def with_broadcasts(board: DataFrame, broadcasts: DataFrame) -> DataFrame:
    """Attach the networks of each match, matched on day and pair."""
    # The networks of one match on one day form a short list.
    tags = broadcasts.groupBy("season", F.col("game_date").alias("_day"), pair_key("team_a_id", "team_b_id").alias("_pair")).agg(
        F.array_sort(F.collect_set("network")).alias("networks"))
    keyed = board.withColumns({"_day": day_of("date"), "_pair": pair_key("home_team_id", "away_team_id")})
    return keyed.join(tags, ["season", "_day", "_pair"], "left").drop("_day", "_pair")


def team_schedule(t: Tables, season: int | None = None, upcoming_only: bool = False, drop_played_days: bool = True) -> DataFrame:
    """Every team's matches in its own view: results, then listings on days it has not played."""
    games = one_season(t.contests, season)
    side = lambda me, other: F.struct(
        F.col(f"{me}_team_id").alias("team_id"), F.col(f"{other}_team_id").alias("opponent_id"), F.lit(me).alias("site"),
        F.col(f"{me}_sets_won").alias("team_sets"), F.col(f"{other}_sets_won").alias("opponent_sets"),
    )
    done = games.select("season", "date", "contest_id", F.explode(F.array(side("home", "away"), side("away", "home"))).alias("s")).select(
        "season", "date", "contest_id", "s.*", F.lit("played").alias("status"))
    done = done.withColumn("result", F.when(
        F.col("team_sets").isNotNull() & F.col("opponent_sets").isNotNull(),
        F.concat(F.when(F.col("team_sets") > F.col("opponent_sets"), "W").otherwise("L"), F.lit(" "),
                 F.col("team_sets").cast("string"), F.lit("-"), F.col("opponent_sets").cast("string"))))
    listed = one_season(t.schedule, season).filter(F.col("result_raw").isNull()).select(
        "season", "date", "contest_id", "team_id", F.col("opponent_team_id").alias("opponent_id"), "site", "opponent_name", "game_time",
        "neutral_location", F.lit("upcoming").alias("status"))
    if drop_played_days:
        days = done.filter(F.col("date").isNotNull()).select("season", "team_id", day_of("date").alias("_day")).distinct()
        listed = listed.withColumn("_day", day_of("date")).join(days, ["season", "team_id", "_day"], "left_anti").drop("_day")
    rows = listed if upcoming_only else done.unionByName(listed, allowMissingColumns=True)
    names = t.teams.select(F.col("id").alias("opponent_id"), F.col("name").alias("_o"))
    rows = rows.join(names, "opponent_id", "left")
    name = F.coalesce("_o", "opponent_name") if "opponent_name" in rows.columns else F.col("_o")
    return rows.withColumn("opponent", name).drop("_o", "opponent_name")


def games_on(t: Tables, season: int | None = None, window: Column | None = None) -> DataFrame:
    """Finals and scheduled matches per day with both teams' current rank.

    A listing is dropped when its pair played that day. ``window`` limits ``date``.
    """
    ranks = t.teams.select("id", "name", "avca_rank")
    done = one_season(t.contests, season).filter(F.col("date").isNotNull()).select(
        "season", day_of("date").alias("date"), F.lit("final").alias("status"), "home_team_id", "away_team_id",
        F.concat(F.col("away_sets_won").cast("string"), F.lit("-"), F.col("home_sets_won").cast("string")).alias("score"))
    pairs = done.select("season", "date", pair_key("home_team_id", "away_team_id").alias("pair")).distinct()
    listed = one_season(t.schedule, season).filter(F.col("result_raw").isNull()).withColumn("pair", pair_key("team_id", "opponent_team_id"))
    open_ = listed.filter("opponent_team_id is not null").join(pairs, ["season", "date", "pair"], "left_anti").unionByName(
        listed.filter("opponent_team_id is null").withColumn("pair", F.concat_ws("|", F.col("team_id").cast("string"), "opponent_name")))
    one = open_.groupBy("season", "date", "pair").agg(
        F.min_by(F.struct("team_id", "opponent_team_id", "opponent_name", "site", "game_time"), F.struct("team_id", F.coalesce("contest_id", F.lit("")))).alias("s"))
    away = F.col("s.site") == "away"
    plan = one.select(
        "season", "date", F.lit("scheduled").alias("status"), F.col("s.game_time").alias("time"),
        F.when(away, F.col("s.opponent_team_id")).otherwise(F.col("s.team_id")).alias("home_team_id"),
        F.when(away, F.col("s.team_id")).otherwise(F.col("s.opponent_team_id")).alias("away_team_id"), F.col("s.opponent_name").alias("_n"))
    rows = done.unionByName(plan, allowMissingColumns=True)
    if window is not None:
        rows = rows.filter(window)
    for side in ("home", "away"):
        rows = rows.join(ranks.select(F.col("id").alias(f"{side}_team_id"), F.col("name").alias(f"_{side}"), F.col("avca_rank").alias(f"{side}_rank")), f"{side}_team_id", "left")
    label = lambda s: F.coalesce(F.col(f"_{s}"), F.when(F.col(f"{s}_team_id").isNull(), F.col("_n")))
    return rows.select("season", "date", "status", "time", label("home").alias("home"), label("away").alias("away"), "home_rank", "away_rank", "score")


def overlay_live(board: DataFrame, live: DataFrame, t: Tables, points: DataFrame | None = None) -> DataFrame:
    """Put in-progress and just-finished scores onto upcoming rows; played rows are left alone.

    Rows match by outside id, else by day and pair of slugs. A feed lists the visitor first; where
    our home side is its visitor the scores are turned round. Of several rows of a game the newest (``at``,
    where the feed tells) counts, and a final one before a live one of the same time. ``points`` has the
    points per set of a game (``ncaa_game_id``, ``home_points``, ``visit_points``, maybe ``at``); with it the rows get
    ``set_scores``, turned round with the rest. A game without them keeps what the row had.
    """
    final = F.lower("game_state") == "final"
    newest = [F.col("at")] if "at" in live.columns else []
    at = F.struct(*newest, final, F.col("home_sets_won") + F.col("away_sets_won"), "home_sets_won", F.col("seonames")[0], "current_period", "ncaa_game_id")
    feed = live.filter(F.lower("game_state").isin("live", "final")).select(
        F.col("ncaa_game_id").alias("_id"), F.col("date").alias("_day"), F.struct(
            F.lower("game_state").alias("state"), F.col("seonames")[0].alias("visitor"), "home_sets_won", "away_sets_won", "current_period", "ncaa_game_id").alias("g"),
        F.concat_ws("|", F.array_sort(F.filter("seonames", lambda s: s != ""))).alias("_slugs"), at.alias("_at"))
    by_id = feed.filter(F.col("_id").isNotNull()).groupBy(F.col("_id").alias("ncaa_game_id")).agg(F.max_by("g", "_at").alias("_g1"))
    by_pair = feed.groupBy("_day", "_slugs").agg(F.max_by("g", "_at").alias("_g2"))
    slugs = t.teams.select(F.col("id"), school_slug(F.coalesce("short_name", "name")).alias("slug"))
    for side in ("home", "away"):
        board = board.join(slugs.select(F.col("id").alias(f"{side}_team_id"), F.col("slug").alias(f"_{side}_slug")), f"{side}_team_id", "left")
    both = F.when(F.col("_home_slug").isNotNull() & F.col("_away_slug").isNotNull(), F.concat_ws("|", F.array_sort(F.array("_home_slug", "_away_slug"))))
    board = board.withColumns({"_day": day_of("date"), "_slugs": both}).join(by_id, "ncaa_game_id", "left").join(by_pair, ["_day", "_slugs"], "left")
    g = F.when(F.col("status") == "upcoming", F.coalesce("_g1", "_g2"))
    board = board.withColumn("_g", g).drop("_g1", "_g2")
    turned = F.coalesce(F.col("_home_slug") == F.col("_g.visitor"), F.lit(False))
    live_now = F.col("_g.state") == "live"
    scores = {}
    if points is not None:
        last = F.max_by(F.struct("home_points", "visit_points"), F.col("at") if "at" in points.columns else F.lit(1))
        lines = points.filter("ncaa_game_id is not null").groupBy(F.col("ncaa_game_id").alias("_gid")).agg(last.alias("_p"))
        # Few rows have a game of the feed. The others match nothing; as NULLs they would all go to one task.
        key = F.concat(F.lit("="), "_gid")
        other = F.concat(F.lit("-"), F.xxhash64("date", "home_team_id", "away_team_id").cast("string"))
        board = board.withColumn("_gid", F.col("_g.ncaa_game_id")).withColumn("_key", F.coalesce(key, other)).drop("_gid")
        board = board.join(lines.select(key.alias("_key"), "_p"), "_key", "left")
        home, visit = F.col("_p.home_points"), F.col("_p.visit_points")
        told = F.struct(F.when(turned, home).otherwise(visit).alias("away"), F.when(turned, visit).otherwise(home).alias("home"))
        before = F.col("set_scores") if "set_scores" in board.columns else F.lit(None)
        scores["set_scores"] = F.when(F.col("_p").isNotNull(), told).otherwise(before)
    put = lambda a, b, old: F.when(F.col("_g").isNull(), F.col(old)).when(turned, F.col(f"_g.{a}")).otherwise(F.col(f"_g.{b}"))
    return board.withColumns(scores | {
        "home_sets_won": put("away_sets_won", "home_sets_won", "home_sets_won"), "away_sets_won": put("home_sets_won", "away_sets_won", "away_sets_won"),
        "status": F.when(F.col("_g").isNull(), F.col("status")).when(live_now, "live").otherwise("final_pending"),
        "live_period": F.when(F.coalesce(live_now, F.lit(False)), F.col("_g.current_period")),
    }).drop("_day", "_slugs", "_home_slug", "_away_slug", "_g", "_key", "_p")
