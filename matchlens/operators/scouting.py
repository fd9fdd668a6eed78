"""Team metrics, where they stand in the league, and the scouting report built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlens.functions.numbers import round_to
from matchlens.constants import (
    BLOCKER_MIN_SETS, HITTER_MIN_ATTACKS, LIST_CAP, LOW_SAMPLE_MATCHES, METRICS, MIN_DISTRIBUTION_MATCHES, SECOND_SETTER_SHARE,
    SETTER_MIN_ASSISTS, SOLO_SETTER_SHARE, STRONG_PCT, WEAK_PCT,
)
from matchlens.operators.asof import quality_wins
from matchlens.operators.prefix import running_by_chunk
from matchlens.operators.ranking import top_per
from matchlens.operators.rally import phase_summary, rotation_summary, season_rollup
from matchlens.operators.records import team_records
from matchlens.operators.totals import ratio, season_totals
from matchlens.session import cut
from matchlens.tables import Tables, one_season

KEYS = [m[0] for m in METRICS]


def position_bucket(col: str = "position") -> Column:
    p = F.upper(F.coalesce(F.col(col), F.lit("")))
    return F.when(p.startswith("M"), "middle").when(p.startswith("O") | p.startswith("R"), "pin")


_ZERO = ("kills", "errors", "total_attacks", "assists", "aces", "digs", "block_solos", "block_assists", "pts")
_BY_POSITION = ("mid_k", "mid_e", "mid_ta", "pin_k", "pin_e", "pin_ta", "opp_aces")


def team_sides(t: Tables, season: int | None = None) -> DataFrame:
    """Per (season, team): own sums, and what opponents did against it, in one pass over box scores.

    A match side is summed once, whole and by the hitters' position. What a side faced is the match
    total less its own line. Lines by position need a roster entry, and count only in matches where
    exactly two sides have one.
    """
    people = t.players.select(F.col("id").alias("player_id"), "season", F.lit(1).alias("known"), position_bucket().alias("bucket"))
    lines = one_season(t.player_game_stats, season).select("season", "contest_id", "team_id", "player_id", *_ZERO)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    parts = {f"{s}_{x}": F.sum(F.when(F.col("bucket") == b, zero(c)).otherwise(0.0))
             for s, b in (("mid", "middle"), ("pin", "pin")) for x, c in (("k", "kills"), ("e", "errors"), ("ta", "total_attacks"))}
    parts["opp_aces"] = F.sum(F.when(F.col("known") == 1, zero("aces")).otherwise(0.0))
    sides = lines.join(people, ["player_id", "season"], "left").groupBy("season", "contest_id", "team_id").agg(
        F.max("known").alias("known"), *[F.sum(zero(c)).alias(c) for c in _ZERO], *[v.alias(k) for k, v in parts.items()])
    match = Window.partitionBy("contest_id", "season")
    others = lambda c: F.sum(c).over(match) - F.col(c)
    sides = sides.withColumns(
        {"_n": F.count("team_id").over(match), "_k": F.count("known").over(match)} | {f"_o_{c}": others(c) for c in ("kills", "errors", "total_attacks")}
        | {f"_p_{c}": others(c) for c in _BY_POSITION})
    faced, split = F.col("_n") > 1, (F.col("_k") == 2) & (F.col("known") == 1)
    return sides.groupBy("season", "team_id").agg(
        F.count("contest_id").alias("games"), *[F.sum(c).alias(c) for c in _ZERO],
        *[F.sum(F.when(faced, F.col(f"_o_{c}"))).alias(f"opp_{c}") for c in ("kills", "errors", "total_attacks")],
        *[F.sum(F.when(split, F.col(f"_p_{c}"))).alias(c) for c in _BY_POSITION])


def opponents_by_position(t: Tables, season: int | None = None) -> DataFrame:
    """Per (season, team): what opposing middles and pins hit, and aces taken."""
    return team_sides(t, season).filter("opp_aces is not null").select("season", "team_id", *_BY_POSITION)


def player_lines(t: Tables, season: int | None = None) -> DataFrame:
    """Season line of every rostered player, on the roster's team."""
    people = one_season(t.players, season).select(F.col("id").alias("player_id"), "season", "team_id", "name", "position", "number", "class_year")
    return people.join(season_totals(t.player_game_stats, season).drop("team_id"), ["player_id", "season"], "left").withColumnRenamed("sp", "sets")


def middle_share(t: Tables, season: int | None = None, lines: DataFrame | None = None) -> DataFrame:
    ta = F.coalesce("total_attacks", F.lit(0.0))
    mid = F.upper(F.coalesce("position", F.lit(""))).startswith("M")
    lines = player_lines(t, season) if lines is None else lines
    sums = lines.groupBy("season", "team_id").agg(F.sum(ta).alias("all_ta"), F.sum(F.when(mid, ta).otherwise(0.0)).alias("mid_ta"))
    return sums.select("season", "team_id", F.when(F.col("all_ta") > 0, round_to(F.col("mid_ta") / F.col("all_ta"), 3)).alias("middle_share"))


def team_metrics(t: Tables, season: int | None = None, records: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
    """One wide row of metrics per (season, team) with box scores. Every join is on aggregated rows."""
    keys = ["season", "team_id"]
    records = team_records(t, season) if records is None else records
    rec = records.select(
        *keys, (F.col("sets_won") + F.col("sets_lost")).alias("n_sets"), "wins", "losses", "set_pct", "opp_wins", "opp_losses")
    wins = quality_wins(t, season).groupBy(*keys).agg(F.count(F.lit(1)).alias("quality_wins"))
    rows = (
        team_sides(t, season).join(rec, keys, "left").join(middle_share(t, season, lines), keys, "left").join(wins, keys, "left")
        .withColumn("n_sets", F.coalesce(F.col("n_sets"), F.lit(0)))
    )
    per_set = lambda c: round_to(ratio(c, F.nullif(F.col("n_sets"), F.lit(0)).cast("double")), 2)
    share = lambda a, b: round_to(ratio(a, b), 3)
    col = F.col
    return rows.select(
        *keys, "games", "n_sets",
        share(col("kills") - col("errors"), "total_attacks").alias("hit_pct"),
        *[per_set(c).alias(f"{c}_per_set") for c in ("kills", "assists", "aces", "digs")],
        per_set(col("block_solos") + col("block_assists") / 2.0).alias("blocks_per_set"), per_set("pts").alias("pts_per_set"),
        per_set("errors").alias("hit_errors_per_set"), "middle_share",
        share(col("opp_kills") - col("opp_errors"), "opp_total_attacks").alias("opp_hit_pct"),
        per_set("opp_kills").alias("opp_kills_per_set"), per_set("opp_aces").alias("opp_aces_per_set"),
        share(col("mid_k") - col("mid_e"), "mid_ta").alias("opp_mid_hit_pct"), per_set("mid_ta").alias("opp_mid_atks_per_set"),
        share(col("pin_k") - col("pin_e"), "pin_ta").alias("opp_pin_hit_pct"), per_set("pin_ta").alias("opp_pin_atks_per_set"),
        share(col("wins").cast("double"), col("wins") + col("losses")).alias("win_pct"), "set_pct",
        F.coalesce("quality_wins", F.lit(0)).cast("double").alias("quality_wins"),
        share(col("opp_wins").cast("double"), col("opp_wins") + col("opp_losses")).alias("sos"),
    )


def league_standing(metrics: DataFrame) -> DataFrame:
    """Long form: value, mid-rank percentile, z-score and rank of every metric in its season.

    Rates are measured against teams with enough matches, but every team is placed. A league has a
    few hundred teams, so a (season, metric) group is small.
    """
    entries: list[Column] = []
    for i, (key, label, up, rate, cat, kind, auto) in enumerate(METRICS):
        facts = {"no": i, "label": label, "up": up, "rate": rate, "cat": cat, "kind": kind, "auto": auto}
        entries += [F.lit(key), F.struct(*[F.lit(v).alias(n) for n, v in facts.items()])]
    spec = F.create_map(*entries)
    long = metrics.unpivot(["season", "team_id", "games"], KEYS, "key", "value").filter("value is not null").withColumn("s", spec[F.col("key")])
    member = (~F.col("s.rate") | (F.col("games") >= MIN_DISTRIBUTION_MATCHES)).cast("int")
    league = Window.partitionBy("season", "key")
    upto = league.orderBy("value").rangeBetween(Window.unboundedPreceding, 0)
    val = F.when(F.col("_m") == 1, F.col("value"))
    rows = long.withColumn("_m", member).withColumns({
        "n": F.sum("_m").over(league).cast("int"), "_hi": F.sum("_m").over(upto),
        "_eq": F.sum("_m").over(Window.partitionBy("season", "key", "value")),
        "_avg": F.avg(val).over(league), "_std": F.stddev_pop(val).over(league),
    }).filter("n > 0")
    lo = F.col("_hi") - F.col("_eq")
    pct = 100.0 * (lo + F.col("_eq") / 2.0) / F.col("n")
    better = F.when(F.col("s.up"), F.col("n") - F.col("_hi")).otherwise(lo)
    z = (F.col("value") - F.col("_avg")) / F.when((F.col("n") > 1) & (F.col("_std") > 0), F.col("_std"))
    return rows.select(
        "season", "team_id", "games", "key", "value", round_to(F.when(F.col("s.up"), pct).otherwise(100.0 - pct), 1).alias("pct"),
        round_to(F.when(F.col("s.up"), z).otherwise(-z), 2).alias("z"), (better + 1).cast("int").alias("rank"), "n",
        F.col("s.no").alias("no"), F.col("s.label").alias("label"), F.col("s.cat").alias("cat"), F.col("s.kind").alias("kind"), F.col("s.auto").alias("auto"),
    )


def percentile_among(members: DataFrame, asked: DataFrame, chunk_of: Column) -> DataFrame:
    """Mid-rank percentile of each asked (season, value) among members' values.

    Values are counted first. The running count goes through chunks of neighbouring values
    (``chunk_of`` over ``value``), so no task holds a whole season's players.
    """
    counts = members.select("season", "value", F.lit(1).alias("m")).unionByName(asked.select("season", "value", F.lit(0).alias("m"))).groupBy(
        "season", "value").agg(F.sum("m").alias("eq"))
    total = counts.groupBy("season").agg(F.sum("eq").alias("n"))
    placed = running_by_chunk(counts, ["season"], chunk_of, ["value"], {"lo": "eq"})
    return placed.join(total, "season").filter("n > 0").select(
        "season", "value", round_to(100.0 * (F.col("lo") + F.col("eq") / 2.0) / F.col("n"), 1).alias("pct"))


def _thousandths() -> Column:
    return F.floor(F.col("value") * 1000)


def team_leaders(t: Tables, season: int | None = None, lines: DataFrame | None = None) -> DataFrame:
    """Top three hitters, two blockers and two middles per team, with hitters' national percentile."""
    lines = player_lines(t, season) if lines is None else lines
    ta = F.coalesce("total_attacks", F.lit(0.0))
    mid = F.upper(F.coalesce("position", F.lit(""))).startswith("M")
    kinds = (
        ("hitter", (ta >= HITTER_MIN_ATTACKS) & F.col("kills_per_set").isNotNull(), "kills_per_set", 3),
        ("blocker", (F.coalesce("sets", F.lit(0.0)) >= BLOCKER_MIN_SETS) & F.col("blocks_per_set").isNotNull(), "blocks_per_set", 2),
        ("middle", mid & (ta > 0), "total_attacks", 2),
    )
    out = None
    for kind, floor, by, k in kinds:
        best = top_per(lines.filter(floor), ["season", "team_id"], [F.desc(by), F.col("player_id")], k, rank="pos").select(
            "season", "team_id", F.lit(kind).alias("kind"), "pos", "player_id", "name", "position", "kills_per_set", "blocks_per_set", "hit_pct", "total_attacks", "total_blocks")
        out = best if out is None else out.unionByName(best)
    hitters = lines.filter((ta >= HITTER_MIN_ATTACKS) & F.col("hit_pct").isNotNull()).select("season", F.col("hit_pct").alias("value"))
    place = percentile_among(hitters, hitters, _thousandths()).select("season", F.col("value").alias("hit_pct"), F.col("pct").alias("_pct"))
    return out.join(place, ["season", "hit_pct"], "left").withColumn("nat_pct", F.when(F.col("kind") == "hitter", F.col("_pct"))).drop("_pct")


def setter_system(t: Tables, season: int | None = None, lines: DataFrame | None = None) -> DataFrame:
    """One or two setters, from their share of the team's assists, and how often the first attacks."""
    lines = player_lines(t, season) if lines is None else lines
    a = F.coalesce("assists", F.lit(0.0))
    total = lines.groupBy("season", "team_id").agg(F.sum(a).alias("total"))
    able = lines.filter(a >= SETTER_MIN_ASSISTS)
    aps = F.coalesce("total_attacks", F.lit(0.0)) / F.col("sets")
    members = able.filter(F.coalesce("sets", F.lit(0.0)) > 0).select("season", aps.alias("value"))
    top = top_per(able, ["season", "team_id"], [F.desc("assists"), F.col("player_id")], 2, rank="pos")
    who = F.struct("name", "assists", "sets", "total_attacks", "kills_per_set", "hit_pct")
    two = top.groupBy("season", "team_id").agg(F.max(F.when(F.col("pos") == 1, who)).alias("s1"), F.max(F.when(F.col("pos") == 2, who)).alias("s2")).join(
        total, ["season", "team_id"]).filter("total > 0")
    first, second = F.col("s1.assists") / F.col("total"), F.coalesce(F.col("s2.assists") / F.col("total"), F.lit(0.0))
    six = F.col("s2").isNotNull() & (second >= SECOND_SETTER_SHARE)
    rows = two.withColumns({
        "type": F.when(six, "6-2").when(first >= SOLO_SETTER_SHARE, "5-1"),
        "setters": F.when(six, F.array("s1.name", "s2.name")).otherwise(F.array("s1.name")),
        "top_share": round_to(first, 3),
        "value": F.when(F.col("s1.sets") > 0, round_to(F.coalesce("s1.total_attacks", F.lit(0.0)) / F.col("s1.sets"), 2)),
    })
    place = percentile_among(members, rows.filter("value is not null"), _thousandths())
    return rows.join(place, ["season", "value"], "left").select(
        "season", "team_id", "type", "setters", "top_share", F.col("value").alias("attacks_per_set"), F.col("s1.hit_pct").alias("setter_hit_pct"), F.col("pct").alias("attack_pct"))


def insights(standing: DataFrame) -> DataFrame:
    """Strengths and weaknesses: extreme percentiles of listed metrics, at most six of each."""
    side = F.when(F.col("pct") >= STRONG_PCT, "strength").when(F.col("pct") <= WEAK_PCT, "weakness")
    rows = standing.filter("auto").withColumn("side", side).filter("side is not null")
    order = [F.when(F.col("side") == "strength", -F.col("pct")).otherwise(F.col("pct")), F.col("no")]
    return top_per(rows, ["season", "team_id", "side"], order, LIST_CAP, rank="pos").select("season", "team_id", "side", "pos", "key", "label", "pct", "value", "kind")


# Wording of the cross-metric notes.
NOTES = {
    "leaky": ("weakness", "Big offense but a leaky defense — they can be outscored in a track meet rather than out-defended."),
    "block_first": ("neutral", "They block well but don't hit efficiently — a defense-first team you can stay with if you protect the ball."),
    "serving": ("weakness", "Serving is a real weapon for them — clean first-contact passing is a must to blunt their runs."),
    "soft": ("neutral", "Their record is strong but built on a soft schedule — the win total may overstate them."),
    "system": ("weakness", "They're much sharper in system than out of it — serving them off the net drops their attack markedly."),
}


def pct_map(standing: DataFrame) -> DataFrame:
    """Per (season, team), a map metric → standing; at most one entry per metric of the catalogue."""
    cell = F.struct("value", "pct", "z", "rank", "n", "label", "cat", "kind", "no")
    return standing.groupBy("season", "team_id").agg(F.map_from_entries(F.collect_list(F.struct("key", cell.alias("v")))).alias("pct"))


def contrast_notes(pcts: DataFrame, phase: DataFrame) -> DataFrame:
    """Telling combinations of percentiles; every rule needs its inputs to be there."""
    p = lambda k: F.try_element_at("pct", F.lit(k))["pct"]
    attack = F.greatest(p("hit_pct"), p("kills_per_set"))
    rules = {
        "leaky": (attack >= 80) & (p("opp_hit_pct") <= 30), "block_first": (p("blocks_per_set") >= 80) & (p("hit_pct") <= 35),
        "serving": p("aces_per_set") >= 85, "soft": (p("win_pct") >= 80) & (p("sos") <= 25), "system": F.col("in_out_gap") >= 0.100,
    }
    notes = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(NOTES[k][0]).alias("kind"), F.lit(NOTES[k][1]).alias("text"))) for k, cond in rules.items()]))
    return pcts.join(phase.select("season", "team_id", "in_out_gap"), ["season", "team_id"], "left").select("season", "team_id", notes.alias("notes"))


def scouting_reports(t: Tables, season: int | None = None, prose: bool = True) -> DataFrame:
    """One nested row per (season, team): record, standing, rotations, phases, leaders, notes, prose.

    Every list is bounded by construction: six rotations, the metric catalogue, seven leaders.
    """
    from matchlens.functions.prose import key_paragraphs, profile_paragraphs

    keys = ["season", "team_id"]
    # What several pieces read is written once: a row per team, or per player-season at most.
    lines, records = cut(player_lines(t, season)), cut(team_records(t, season))
    metrics = cut(team_metrics(t, season, records, lines))
    standing = cut(league_standing(metrics))
    phase, rollup = cut(phase_summary(t, season)), cut(season_rollup(t, season))
    pcts = pct_map(standing)
    lists = insights(standing).groupBy(*keys).agg(*[
        F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("pos", "key", "label", "pct", "value", "kind")))).alias(n)
        for s, n in (("strength", "strengths"), ("weakness", "weaknesses"))])
    lead = team_leaders(t, season, lines).groupBy(*keys).agg(*[
        F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("pos", "name", "position", "kills_per_set", "blocks_per_set", "hit_pct", "total_attacks", "nat_pct")))).alias(f"{k}s")
        for k in ("hitter", "blocker", "middle")])
    rots = rotation_summary(t, season, rollup=rollup).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("rotation", "sideout_pct", "hold_pct", "net", "recv_rallies", "hit_pct"))).alias("table"),
        F.max("weakest").alias("weakest"), F.max("strongest").alias("strongest"))
    rec = records.select(*keys, F.struct("wins", "losses", "conference", "conf_wins", "conf_losses", "win_streak").alias("record"))
    seen = rollup.groupBy(*keys).agg(F.max("matches_with_pbp").alias("_pbp"))
    names = t.teams.select(F.col("id").alias("team_id"), F.col("name").alias("team"))
    out = metrics.select(*keys, F.col("games").alias("matches"), F.col("n_sets").alias("sets")).filter("matches > 0").join(names, "team_id", "left")
    for piece in (
        rec, pcts, contrast_notes(pcts, phase), lists, lead, seen,
        rots.select(*keys, F.struct("table", "weakest", "strongest").alias("rotations")),
        phase.select(*keys, F.struct("fbso_hit_pct", "fbso_attacks", "trans_hit_pct", "trans_attacks", "in_out_gap").alias("phase")),
        setter_system(t, season, lines).select(*keys, F.struct("type", "setters", "top_share", "attacks_per_set", "setter_hit_pct", "attack_pct").alias("system")),
    ):
        out = out.join(piece, keys, "left")
    out = out.withColumns({
        "team": F.coalesce("team", F.concat(F.lit("Team "), F.col("team_id").cast("string"))),
        "low_sample": F.col("matches") < LOW_SAMPLE_MATCHES, "has_pbp": F.coalesce("_pbp", F.lit(0)) > 0,
    }).drop("_pbp")
    return out.withColumn("profile", profile_paragraphs()).withColumn("keys", key_paragraphs()) if prose else out
