"""Who started each set, who came in, and how the starting group changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlens.constants import LIBERO_POSITIONS
from matchlens.operators.rally import SET, sides
from matchlens.tables import Tables, one_season


def set_lineups(t: Tables, season: int | None = None, given: bool = True) -> DataFrame:
    """Role of each player per (contest, set, team): starter or sub.

    The role follows from the player's first event. A touch, a pre-serve ``sub_out``, a pre-serve
    ``sub_in`` of a libero, or a later ``sub_out`` of someone who was otherwise seen makes a starter;
    any other ``sub_in`` a sub; a lone later ``sub_out`` says nothing. Where starters are given for a
    team-set they replace the reconstruction, and whoever else appeared is a sub.
    """
    seen = one_season(t.pbp_events, season).filter(
        F.col("player_id").isNotNull() & ~F.coalesce(F.contains(F.col("player_name"), F.lit(", ")), F.lit(False))
    )
    # The side must be one of the contest's two teams; one row per player and set is left to join.
    first = seen.groupBy("season", *SET, "team_id", "player_id").agg(
        F.min_by(F.struct("touch_type", "rally_number", "player_name"), "seq").alias("f"),
        F.max((F.col("touch_type") != "sub_out").cast("int")).alias("was_on"),
    ).join(sides(t, season), "contest_id").filter(F.col("team_id").isin(F.col("home_team_id"), F.col("away_team_id")))
    people = one_season(t.players, season).select(F.col("id").alias("player_id"), "season", F.col("name").alias("roster_name"), "position", "number")
    rows = first.join(people, ["player_id", "season"], "left")
    kind, early = F.col("f.touch_type"), F.col("f.rally_number") == 0
    libero = F.arrays_overlap(F.split(F.coalesce("position", F.lit("")), "/"), F.array(*[F.lit(p) for p in LIBERO_POSITIONS]))
    role = (
        F.when((kind == "sub_in") & early & libero, "starter").when(kind == "sub_in", "sub")
        .when((kind == "sub_out") & (early | (F.col("was_on") == 1)), "starter").when(kind == "sub_out", None)
        .otherwise("starter")
    )
    rows = rows.select(
        "season", *SET, "team_id", F.when(F.col("team_id") == F.col("home_team_id"), "home").otherwise("away").alias("side"), "player_id",
        F.coalesce("roster_name", "f.player_name").alias("player"), "position", "number", role.alias("role"),
    )
    if not given:
        return rows.filter(F.col("role").isNotNull())
    listed = one_season(t.contest_set_starters, season).select(*SET, "team_id", "player_id", F.lit(True).alias("listed")).distinct()
    rows = rows.filter(F.col("role").isNotNull()).join(listed, [*SET, "team_id", "player_id"], "full_outer")
    any_listed = F.max(F.coalesce("listed", F.lit(False))).over(Window.partitionBy(*SET, "team_id"))
    rows = rows.withColumn("role", F.when(any_listed, F.when(F.col("listed"), "starter").otherwise("sub")).otherwise(F.col("role"))).drop("listed")
    # A listed starter without any event still needs the season and side of the match.
    games = one_season(t.contests, season).select(
        "contest_id", F.col("season").alias("_season"), F.col("home_team_id").alias("_home"))
    rows = rows.join(games, "contest_id").withColumns({
        "season": F.coalesce("season", "_season"),
        "side": F.coalesce("side", F.when(F.col("team_id") == F.col("_home"), "home").otherwise("away")),
    }).drop("_season", "_home")
    missing = one_season(t.players, season).select(
        F.col("id").alias("player_id"), "season", F.col("name").alias("_n"), F.col("position").alias("_p"), F.col("number").alias("_no"))
    return rows.join(missing, ["player_id", "season"], "left").withColumns({
        "player": F.coalesce("player", "_n"), "position": F.coalesce("position", "_p"), "number": F.coalesce("number", "_no"),
    }).drop("_n", "_p", "_no").select("season", *SET, "team_id", "side", "player_id", "player", "position", "number", "role")


def starter_changes(lineups: DataFrame) -> DataFrame:
    """Per (contest, set, team) after the first set: who joined and who left the starting group.

    A starting group is a handful of players, so it is held as one array.
    """
    groups = lineups.groupBy("season", *SET, "team_id").agg(F.array_sort(F.collect_set(F.when(F.col("role") == "starter", F.col("player_id")))).alias("six"))
    first = groups.groupBy("contest_id").agg(F.min("set_number").alias("vs_set"))
    base = groups.join(first, "contest_id").filter("set_number = vs_set").select("contest_id", "team_id", F.col("six").alias("base"))
    none = F.array().cast("array<bigint>")
    later = groups.join(first, "contest_id").filter("set_number <> vs_set").join(base, ["contest_id", "team_id"], "left").withColumn("base", F.coalesce("base", none))
    text = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x.cast("string")), ",")
    return later.select(
        "season", *SET, "team_id", "vs_set", text(F.array_except("six", "base")).alias("added"), text(F.array_except("base", "six")).alias("removed"),
    ).filter("added <> '' or removed <> ''")


def match_lineups(t: Tables, team_id: int, date: str, opponent_id: int | None = None, season: int | None = None) -> DataFrame:
    """Line-ups of one team's matches on a day; several rows of matches mean a doubleheader."""
    from matchlens.operators.timeline import matches_on

    return set_lineups(t, season).join(matches_on(t, team_id, date, opponent_id, season).select("contest_id"), "contest_id", "left_semi")
