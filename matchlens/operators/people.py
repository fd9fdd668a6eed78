"""Roster make-up, and who a player was in an earlier season."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlens.functions.numbers import round_to
from matchlens.constants import CLASS_ORDINALS, DOMESTIC_TAILS, TRANSFER_SORTS
from matchlens.functions.predicates import is_international
from matchlens.functions.text import normalize_class
from matchlens.operators.leaderboards import roster
from matchlens.operators.ranking import check_choice, directed, top_per
from matchlens.operators.totals import season_totals
from matchlens.tables import Tables


def height_text(inches: Column | str) -> Column:
    """Inches as feet-inches, e.g. 74 → 6-2."""
    col = F.col(inches) if isinstance(inches, str) else inches
    whole = F.bround(col.cast("double"), 0).cast("int")
    return F.when(col.isNotNull(), F.concat(F.floor(whole / 12).cast("string"), F.lit("-"), (whole % 12).cast("string")))


def _members(t: Tables, season: int | None, keep: Column | None) -> DataFrame:
    people = roster(t, season).filter(F.col("team").isNotNull())
    return people if keep is None else people.filter(keep)


def team_heights(
    t: Tables, season: int | None = None, keep: Column | None = None, sort_by: str = "avg_height", limit: int = 25,
    order: str = "desc",
) -> DataFrame:
    """Mean and greatest height per team, over measured players only."""
    check_choice(sort_by, ("avg_height", "max_height"), "sort_by")
    rows = _members(t, season, keep).filter(F.col("height_inches").isNotNull()).groupBy(
        "season", "team_id", "team", "conference"
    ).agg(F.count("height_inches").alias("players_measured"), F.avg("height_inches").alias("avg_h"), F.max("height_inches").alias("max_h"))
    key = "avg_h" if sort_by == "avg_height" else "max_h"
    return top_per(rows, ["season"], [directed(key, order), F.col("team_id")], limit).select(
        "season", "rank", "team_id", "team", "conference", "players_measured", round_to("avg_h", 1).alias("avg_height_inches"),
        height_text("avg_h").alias("avg_height"), F.col("max_h").alias("tallest_inches"), height_text("max_h").alias("tallest"),
    )


def class_ordinal(col: str = "class_year") -> Column:
    """1 for freshmen to 5 for graduates; redshirts as their class."""
    code = F.substring(normalize_class(F.col(col)), -2, 2)
    out = F.lit(None).cast("int")
    for name, n in CLASS_ORDINALS.items():
        out = F.when(code == name, n).otherwise(out)
    return out


def roster_makeup(
    t: Tables, season: int | None = None, keep: Column | None = None, sort_by: str = "international", limit: int = 25,
    order: str = "desc",
) -> DataFrame:
    """Size, share of international players and mean class per team."""
    check_choice(sort_by, ("international", "international_pct", "youngest", "oldest", "size"), "sort_by")
    rows = _members(t, season, keep).groupBy("season", "team_id", "team", "conference").agg(
        F.count(F.lit(1)).alias("roster_size"),
        F.count(F.when(is_international(), 1)).alias("international"),
        round_to(F.avg(class_ordinal()), 2).alias("avg_class_ordinal"),
    ).withColumn("international_pct", round_to(100.0 * F.col("international") / F.col("roster_size"), 1))
    keys = {
        "international": [directed("international", order), directed("international_pct", order)],
        "international_pct": [directed("international_pct", order), directed("international", order)],
        "size": [directed("roster_size", order)],
        "youngest": [F.asc_nulls_last("avg_class_ordinal")],
        "oldest": [F.desc_nulls_last("avg_class_ordinal")],
    }[sort_by]
    return top_per(rows, ["season"], [*keys, F.col("team_id")], limit)


def player_origins(t: Tables, group_by: str = "state", season: int | None = None, keep: Column | None = None, limit: int = 25) -> DataFrame:
    """Players per home state, or per foreign country."""
    check_choice(group_by, ("state", "country"), "group_by")
    tail = F.trim(F.element_at(F.split("hometown", ", "), -1))
    people = _members(t, season, keep).filter(F.contains(F.col("hometown"), F.lit(", ")))
    if group_by == "state":
        people = people.withColumn("origin", F.upper(tail)).filter(F.col("origin").isin(*DOMESTIC_TAILS))
    else:
        people = people.filter(is_international()).withColumn("origin", tail)
    counts = people.groupBy("season", "origin").agg(F.count(F.lit(1)).alias("players"))
    return top_per(counts, ["season"], [F.desc("players"), F.col("origin")], limit).withColumnRenamed("origin", group_by)


IDENTITY_TIERS = (("name", "hometown", "high_school"), ("name", "hometown"))
LENIENT_TIERS = (*IDENTITY_TIERS, ("name", "team_id"), ("name",))


def _unique_by(people: DataFrame, key: tuple[str, ...], payload: list[str]) -> DataFrame:
    """Rows whose key occurs exactly once; a shared key identifies nobody.

    Counting first keeps this a partial aggregate, so a very common name costs one row per task.
    """
    have = people
    for c in key:
        have = have.filter(F.col(c).isNotNull())
    cols = [F.max(c).alias(c) for c in payload]
    return have.groupBy("season", *key).agg(F.count(F.lit(1)).alias("_n"), *cols).filter("_n = 1").drop("_n")


def match_identity(asked: DataFrame, people: DataFrame, tiers=IDENTITY_TIERS, key: str = "player_id") -> DataFrame:
    """For every (asked row, season in ``seek``) the one person it can be, most specific tier first.

    ``asked`` has ``key``, the identity columns and ``seek``. Adds ``found_id`` and ``found_team``.
    """
    out = asked
    for i, tier in enumerate(tiers):
        hit = _unique_by(people, tier, ["player_id", *(["team_id"] if "team_id" not in tier else [])])
        hit = hit.select(
            F.col("season").alias("seek"), *tier, F.col("player_id").alias(f"_id{i}"), F.col("team_id").alias(f"_team{i}")
        )
        out = out.join(hit, ["seek", *tier], "left")
    n = range(len(tiers))
    out = out.withColumn("found_id", F.coalesce(*[F.col(f"_id{i}") for i in n]))
    pick = F.coalesce(*[F.when(F.col(f"_id{i}").isNotNull(), F.col(f"_team{i}")) for i in n])
    return out.withColumn("found_team", pick).drop(*[f"_id{i}" for i in n], *[f"_team{i}" for i in n])


def _people(t: Tables) -> DataFrame:
    return t.players.select(F.col("id").alias("player_id"), "season", "team_id", "name", "hometown", "high_school")


def previous_team(t: Tables, season: int | None = None) -> DataFrame:
    """Each player's team in the season just before, by strict identity."""
    people = _people(t)
    asked = people if season is None else people.filter(F.col("season") == season)
    asked = asked.filter(F.col("hometown").isNotNull()).withColumn("seek", F.col("season") - 1)
    return match_identity(asked, people).select("player_id", "season", "team_id", "found_id", F.col("found_team").alias("previous_team_id"))


def resolve_players(t: Tables, to_season: int) -> DataFrame:
    """Where every player of any season is found in ``to_season``, by the lenient tiers."""
    people = _people(t)
    return match_identity(people.withColumn("seek", F.lit(to_season)), people, LENIENT_TIERS).select("player_id", "season", "found_id")


def _newest_before(people: DataFrame, tier: tuple[str, ...], i: int) -> DataFrame:
    """Per (key, season), the newest earlier season in which the key names exactly one person.

    Keys are reduced to distinct (key, season) pairs first, so an ordered group holds at most a few
    rows per season however many people share a name.
    """
    payload = F.struct("season", "team_id").alias("hit")
    known = _unique_by(people, tier, ["player_id", "team_id"]).select(*tier, "season", payload)
    asked = people.select(*tier, "season").dropna().distinct().withColumn("ask", F.lit(True))
    before = Window.partitionBy(*tier).orderBy("season").rangeBetween(Window.unboundedPreceding, -1)
    return (
        asked.unionByName(known, allowMissingColumns=True)
        .withColumn("prev", F.last("hit", ignorenulls=True).over(before))
        .filter("ask")
        .select(*tier, "season", F.col("prev.season").alias(f"_s{i}"), F.col("prev.team_id").alias(f"_t{i}"))
    )


def transfers(t: Tables) -> DataFrame:
    """Newest earlier season in which the same person appears, and whether the team changed."""
    people = _people(t)
    out = people.filter(F.col("hometown").isNotNull())
    for i, tier in enumerate(IDENTITY_TIERS):
        out = out.join(_newest_before(people, tier, i), [*tier, "season"], "left")
    strict = F.col("_s0").isNotNull() & (F.col("_s1").isNull() | (F.col("_s0") >= F.col("_s1")))
    out = out.withColumns({
        "seek": F.when(strict, F.col("_s0")).otherwise(F.col("_s1")),
        "found_team": F.when(strict, F.col("_t0")).otherwise(F.col("_t1")),
    }).filter(F.col("seek").isNotNull())
    names = t.teams.select(F.col("id").alias("previous_team_id"), F.col("name").alias("previous_team"))
    moved = F.col("found_team") != F.col("team_id")
    return out.select(
        "player_id", "season", moved.alias("transferred"),
        F.when(moved, F.col("seek")).alias("previous_season"), F.when(moved, F.col("found_team")).alias("previous_team_id"),
    ).join(names, "previous_team_id", "left")


def transfer_impact(
    t: Tables, season: int | None = None, keep: Column | None = None, sort_by: str = "pts_per_set", min_sets: int = 10,
    limit: int = 25,
) -> DataFrame:
    """Transfers ranked by what they do at their new team."""
    check_choice(sort_by, TRANSFER_SORTS, "sort_by")
    moved = previous_team(t, season).filter(F.col("previous_team_id").isNotNull() & (F.col("previous_team_id") != F.col("team_id")))
    lines = season_totals(t.player_game_stats, season).drop("team_id")
    if min_sets:
        lines = lines.filter(F.col("sp") >= max(0, int(min_sets)))
    people = roster(t, season)
    if keep is not None:
        people = people.filter(keep)
    how = "inner" if min_sets else "left"
    rows = moved.select("player_id", "season", "previous_team_id").join(lines, ["player_id", "season"], how).join(people, ["player_id", "season"])
    names = t.teams.select(F.col("id").alias("previous_team_id"), F.col("name").alias("previous_team"))
    digits = {"hit_pct": 3} | {c: 2 for c in ("kills_per_set", "assists_per_set", "aces_per_set", "digs_per_set", "blocks_per_set", "pts_per_set")}
    rows = rows.withColumns({c: round_to(c, d) for c, d in digits.items()})
    return top_per(rows, ["season"], [directed(sort_by), F.col("player_id")], limit).join(names, "previous_team_id", "left").select(
        "season", "rank", "player_id", F.col("name").alias("player"), "position", "class_year", "team", "previous_team", "sp", "gp",
        "kills", "assists", "digs", "aces", "total_blocks", "pts", *digits,
    )
