"""Win-loss records from set scores: season standings, streaks, records at a date, conferences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlens.functions.numbers import round_to
from matchlens.operators.conference import team_seasons, with_conference
from matchlens.operators.prefix import running_by_chunk
from matchlens.operators.ranking import check_choice, directed, top_per
from matchlens.tables import Tables, one_season


def appearances(t: Tables, season: int | None = None) -> DataFrame:
    """Each decided match seen from both sides; unplayed and level matches are left out."""
    decided = one_season(t.contests, season).filter(
        F.col("home_team_id").isNotNull() & F.col("away_team_id").isNotNull()
        & (F.col("home_sets_won") != F.col("away_sets_won"))
    )
    side = lambda me, other: F.struct(
        F.col(f"{me}_team_id").alias("team_id"), F.col(f"{other}_team_id").alias("opp_id"),
        F.col(f"{me}_sets_won").alias("own"), F.col(f"{other}_sets_won").alias("them"),
        F.lit(me).alias("site"),
    )
    return (
        decided.select("season", "contest_id", "date", F.explode(F.array(side("home", "away"), side("away", "home"))).alias("s"))
        .select("season", "contest_id", "date", "s.*")
        .withColumn("won", (F.col("own") > F.col("them")).cast("int"))
    )


def streaks(t: Tables, season: int | None = None) -> DataFrame:
    """Signed run from the latest match: wins positive, losses negative.

    The run consists of the matches after the latest one of the other kind, so it is counted with
    two partial aggregates instead of ordering a team's whole season in one task.
    """
    games = appearances(t, season).withColumn("at", F.struct(F.coalesce("date", F.lit("")).alias("d"), "contest_id"))
    last = games.groupBy("season", "team_id").agg(
        F.max(F.when(F.col("won") == 1, F.col("at"))).alias("win_at"),
        F.max(F.when(F.col("won") == 0, F.col("at"))).alias("loss_at"),
    ).withColumn("hot", F.col("loss_at").isNull() | (F.coalesce(F.col("win_at") > F.col("loss_at"), F.lit(False))))
    last = last.select("season", "team_id", "hot", F.when(F.col("hot"), F.col("loss_at")).otherwise(F.col("win_at")).alias("turn"))
    run = games.join(last, ["season", "team_id"]).filter(
        F.col("turn").isNull() | (F.col("at") > F.col("turn"))
    )
    return run.groupBy("season", "team_id").agg(
        (F.count(F.lit(1)) * F.when(F.first("hot"), 1).otherwise(-1)).cast("int").alias("win_streak")
    )


def team_records(t: Tables, season: int | None = None) -> DataFrame:
    """Season record of every team: sets, conference split, opponents' record, streak.

    Matches are first reduced to one row per (team, opponent); everything about opponents is then
    arithmetic on those few rows. An opponent's record leaves out the meeting itself.
    """
    pairs = appearances(t, season).groupBy("season", "team_id", "opp_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("won").alias("w"), F.sum("own").alias("own"), F.sum("them").alias("them")
    )
    # A pair's mirror row knows the opponent's season: each row hands its team's record to its mirror.
    whole = Window.partitionBy("season", "team_id")
    pairs = pairs.withColumns({"tw": F.sum("w").over(whole), "tl": F.sum(F.col("n") - F.col("w")).over(whole)})
    part = lambda me, opp, names, given: F.struct(
        F.col(me).alias("team_id"), F.col(opp).alias("opp_id"), *[(F.col(names[c]) if c in names else F.lit(None).cast("bigint")).alias(c) for c in given])
    cols = ("n", "w", "own", "them", "opp_w", "opp_l")
    swapped = pairs.select("season", F.explode(F.array(
        part("team_id", "opp_id", {c: c for c in cols[:4]}, cols), part("opp_id", "team_id", {"opp_w": "tw", "opp_l": "tl"}, cols))).alias("s"))
    pairs = swapped.select("season", "s.*").groupBy("season", "team_id", "opp_id").agg(*[F.max(c).alias(c) for c in cols])
    labels = team_seasons(t)
    theirs = labels.select("season", F.col("team_id").alias("opp_id"), F.col("conference_id").alias("opp_conf"), F.col("rpi_rank").alias("opp_rank"))
    mine = labels.select("season", "team_id", "team", "team_short", "conference", "conference_id", "conference_short", "rpi_rank", "rpi_record", "avca_rank")
    same = F.coalesce(F.col("opp_conf") == F.col("conference_id"), F.lit(False))
    lost = F.col("n") - F.col("w")
    ranked = F.col("opp_rank").isNotNull()
    sums = (
        pairs.join(mine, ["season", "team_id"])
        .join(theirs, ["season", "opp_id"], "left")
        .groupBy("season", "team_id", "team", "team_short", "conference", "conference_id", "conference_short", "rpi_rank", "rpi_record", "avca_rank")
        .agg(
            F.sum("n").alias("games"), F.sum("w").alias("wins"), F.sum(lost).alias("losses"),
            F.sum("own").alias("sets_won"), F.sum("them").alias("sets_lost"),
            F.sum(F.when(same, F.col("w")).otherwise(0)).alias("conf_wins"),
            F.sum(F.when(same, lost).otherwise(0)).alias("conf_losses"),
            F.sum(F.when(same, 0).otherwise(F.col("w"))).alias("nonconf_wins"),
            F.sum(F.when(same, 0).otherwise(lost)).alias("nonconf_losses"),
            F.sum(F.col("n") * F.col("opp_w") - lost).alias("opp_wins"),
            F.sum(F.col("n") * F.col("opp_l") - F.col("w")).alias("opp_losses"),
            round_to(F.try_divide(
                F.sum(F.when(ranked, F.col("n") * F.col("opp_rank"))).cast("double"), F.sum(F.when(ranked, F.col("n")))), 1
            ).alias("opp_rpi"),
        )
    )
    played = F.col("sets_won") + F.col("sets_lost")
    return sums.withColumn("set_pct", round_to(F.try_divide(F.col("sets_won").cast("double"), played), 3)).join(
        streaks(t, season), ["season", "team_id"]
    )


def standings(t: Tables, season: int | None = None) -> DataFrame:
    """Records in order of wins, losses and share of sets, per season; ordered within equal wins."""
    order = [F.asc("losses"), F.coalesce("set_pct", F.lit(0.0)).desc(), F.col("team_id")]
    placed = running_by_chunk(team_records(t, season), ["season"], -F.col("wins"), order, {}, seq="place")
    return placed.withColumn("place", F.col("place").cast("int"))


def ranked_records(
    t: Tables, season: int | None = None, conference: Column | None = None, sort_by: str = "wins", limit: int = 25,
    order: str = "desc",
) -> DataFrame:
    """Records by wins, share of sets or share of matches; teams without the value come last."""
    check_choice(sort_by, ("wins", "set_pct", "win_pct"), "sort_by")
    rows = team_records(t, season)
    if conference is not None:
        rows = rows.filter(conference)
    games = F.col("wins") + F.col("losses")
    rows = rows.withColumn("win_pct", round_to(F.try_divide(F.col("wins").cast("double"), games), 3))
    second = -F.col("losses") if sort_by == "wins" else F.col("wins")
    keys = [F.col(sort_by).isNull(), directed(sort_by, order), directed(second, order), F.col("team_id")]
    return top_per(rows, ["season"], keys, limit).select(
        "season", "rank", "team_id", "team", "conference", "wins", "losses", "win_pct", "sets_won", "sets_lost", "set_pct",
        "conf_wins", "conf_losses", "win_streak", "rpi_rank", "avca_rank",
    )


def rankings(t: Tables, season: int | None = None, poll: str = "avca", limit: int = 25) -> DataFrame:
    """Teams holding a rank in the poll, in rank order, with their record."""
    check_choice(poll, ("avca", "rpi"), "poll")
    held = f"{poll}_rank"
    ranked = team_seasons(t).filter(F.col(held).isNotNull())
    if season is not None:
        ranked = ranked.filter(F.col("season") == season)
    best = top_per(ranked, ["season"], [F.asc(held), F.col("team_id")], limit, rank="_pos")
    rec = team_records(t, season).select("season", "team_id", "wins", "losses")
    return best.join(rec, ["season", "team_id"], "left").select(
        "season", F.col(held).alias("rank"), F.lit(poll.upper()).alias("poll"), "team_id", "team", "team_short", "conference",
        "wins", "losses", F.concat_ws("-", F.col("wins").cast("string"), F.col("losses").cast("string")).alias("record"),
        "avca_rank", "rpi_rank",
    ).withColumn("record", F.when(F.col("wins").isNotNull(), F.col("record")))


def records_at(t: Tables, season: int | None = None) -> DataFrame:
    """Record of each team through each time it played, overall and within its conference.

    Matches are reduced to one row per (season, team, time) before the running sum, so the ordered
    group is bounded by the calendar, not by the number of matches.
    """
    games = with_conference(appearances(t, season).filter(F.col("date").isNotNull()), t).withColumnRenamed("conference_id", "my_conf")
    opp = team_seasons(t).select("season", F.col("team_id").alias("opp_id"), F.col("conference_id").alias("opp_conf"))
    games = games.join(opp, ["season", "opp_id"], "left").withColumn(
        "same", F.coalesce((F.col("opp_conf") == F.col("my_conf")).cast("int"), F.lit(0))
    )
    days = games.groupBy("season", "team_id", "date").agg(
        F.sum("won").alias("w"), F.sum(1 - F.col("won")).alias("l"),
        F.sum(F.col("won") * F.col("same")).alias("cw"), F.sum((1 - F.col("won")) * F.col("same")).alias("cl"),
        F.max("my_conf").alias("my_conf"), F.max(F.coalesce("conference_short", "conference")).alias("abbrev"),
    )
    so_far = Window.partitionBy("season", "team_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    for c in ("w", "l", "cw", "cl"):
        days = days.withColumn(f"sum_{c}", F.sum(c).over(so_far))
    text = lambda a, b: F.concat(F.col(f"sum_{a}").cast("string"), F.lit("-"), F.col(f"sum_{b}").cast("string"))
    return days.select(
        "season", "team_id", "date", F.col("sum_w").alias("wins"), F.col("sum_l").alias("losses"), text("w", "l").alias("record"),
        F.when(F.col("my_conf").isNotNull() & F.col("abbrev").isNotNull(), F.concat(text("cw", "cl"), F.lit(" "), F.col("abbrev"))).alias("conf_record"),
    )


def contest_headers(t: Tables, season: int | None = None) -> DataFrame:
    """Matches with both teams' names and their records through the match."""
    games = one_season(t.contests, season).select(
        "contest_id", "season", "date", "home_team_id", "away_team_id", "home_sets_won", "away_sets_won"
    )
    at = records_at(t, season)
    names = t.teams.select("id", "name")
    for side in ("home", "away"):
        rec = at.select(
            "season", "date", F.col("team_id").alias(f"{side}_team_id"), F.col("record").alias(f"{side}_record"),
            F.col("conf_record").alias(f"{side}_conf_record"),
        )
        games = games.join(names.select(F.col("id").alias(f"{side}_team_id"), F.col("name").alias(f"{side}_team")), f"{side}_team_id", "left")
        games = games.join(rec, ["season", "date", f"{side}_team_id"], "left")
    return games


def conference_summary(t: Tables, season: int | None = None) -> DataFrame:
    """Per (season, conference): members, ranked members, mean rank, overall and outside records."""
    members = team_records(t, season).filter(F.col("conference_id").isNotNull())
    return members.groupBy("season", "conference_id", "conference", "conference_short").agg(
        F.count(F.lit(1)).alias("team_count"), F.count("avca_rank").alias("ranked_count"),
        round_to(F.avg("rpi_rank"), 1).alias("avg_rpi_rank"),
        F.sum("wins").alias("overall_wins"), F.sum("losses").alias("overall_losses"),
        F.sum("nonconf_wins").alias("interconf_wins"), F.sum("nonconf_losses").alias("interconf_losses"),
    )


def conference_standings(t: Tables, season: int | None = None) -> DataFrame:
    order = [F.desc("conf_wins"), F.asc("conf_losses"), F.desc("wins"), F.asc("losses"), F.coalesce("set_pct", F.lit(0.0)).desc(), F.col("team_id")]
    place = F.row_number().over(Window.partitionBy("season", "conference_id").orderBy(*order))
    return team_records(t, season).filter(F.col("conference_id").isNotNull()).select(
        "season", "conference_id", place.alias("place"), "team_id", "team", "conf_wins", "conf_losses", "wins", "losses",
        "set_pct", "rpi_rank", "avca_rank",
    )
