"""Rally-level reconstruction from the ordered event log.

Every operator starts from :func:`touches`, which moves the events once — to (contest, set), a
group the rules of the game keep small — and adds what a touch needs to know about its rally with
window functions in that partitioning. Nothing relies on input order, only on ``seq``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlens.functions.numbers import round_to
from matchlens.operators.totals import ratio, season_totals
from matchlens.tables import Tables, one_season

SET = ["contest_id", "set_number"]
RALLY = [*SET, "rally_number"]
WHOLE = (Window.unboundedPreceding, Window.unboundedFollowing)


def by_set(events: DataFrame) -> DataFrame:
    return events.repartition(*[F.col(c) for c in SET])


def _is(kind: str) -> Column:
    return F.col("touch_type") == kind


def touches(events: DataFrame) -> DataFrame:
    """Events with their rally's first serve and first terminal, and the side's attack order.

    Adds ``serve_team``, ``term_type``, ``term_scorer``, ``term_team``, ``has_term``, ``last_attack``
    (the side's last attack in the rally), ``next_attack`` (the side's next attack), ``setter_id``
    (the side's latest named setter before), ``first_away_attack`` (first attack by a side that did
    not serve), ``is_fbso``, ``is_kill`` and ``is_error``.
    """
    rally = Window.partitionBy(*RALLY).orderBy("seq")
    side = Window.partitionBy(*RALLY, "team_id").orderBy("seq")
    whole, whole_side = rally.rowsBetween(*WHOLE), side.rowsBetween(*WHOLE)
    serve = F.struct("team_id", "player_id", "player_name")
    term = F.struct("terminal_type", "scoring_team_id", "team_id")
    attack_seq = F.when(_is("attack"), F.col("seq"))
    df = by_set(events).withColumns({
        "_serve": F.first(F.when(_is("serve"), serve), ignorenulls=True).over(whole),
        "_term": F.first(F.when(F.col("is_terminal"), term), ignorenulls=True).over(whole),
    })
    df = df.withColumns({
        "last_attack": F.max(attack_seq).over(whole_side),
        "next_attack": F.first(attack_seq, ignorenulls=True).over(side.rowsBetween(1, Window.unboundedFollowing)),
        "setter_id": F.last(F.when(_is("set"), F.col("player_id")), ignorenulls=True).over(side.rowsBetween(Window.unboundedPreceding, -1)),
        "serve_team": F.col("_serve.team_id"),
    })
    away = F.col("serve_team").isNotNull() & ~F.col("team_id").eqNullSafe(F.col("serve_team"))
    df = df.withColumn("_fbso_seq", F.min(F.when(away, attack_seq)).over(Window.partitionBy(*RALLY)))
    last = _is("attack") & (F.col("seq") == F.col("last_attack")) & F.col("_term").isNotNull()
    return df.withColumns({
        "is_fbso": _is("attack") & F.coalesce(F.col("seq") == F.col("_fbso_seq"), F.lit(False)),
        "is_kill": last & F.coalesce((F.col("_term.terminal_type") == "kill") & F.col("_term.scoring_team_id").eqNullSafe(F.col("team_id")), F.lit(False)),
        "is_error": last & F.coalesce((F.col("_term.terminal_type") == "attack_error") & F.col("_term.team_id").eqNullSafe(F.col("team_id")), F.lit(False)),
        "_kill_for": (F.col("_term.terminal_type") == "kill") & F.col("_term.scoring_team_id").eqNullSafe(F.col("team_id")),
        "_error_for": (F.col("_term.terminal_type") == "attack_error") & F.col("_term.team_id").eqNullSafe(F.col("team_id")),
    })


def attack_touches(events: DataFrame) -> DataFrame:
    """Every attack by a known hitter: setter, phase and outcome."""
    return touches(events).filter(_is("attack") & F.col("player_id").isNotNull()).select(
        "season", *RALLY, "seq", "team_id", F.col("player_id").alias("hitter_id"), "setter_id",
        F.when(F.col("is_fbso"), "fbso").otherwise("transition").alias("phase"), "is_kill", "is_error",
    )


def attack_lines(events: DataFrame, by: list[str], setter_id: int | None = None, phase: str | None = None) -> DataFrame:
    """Kills, errors and attempts, whole and by phase, per ``by``."""
    rows = attack_touches(events)
    if setter_id is not None:
        rows = rows.filter(F.col("setter_id") == setter_id)
    if phase is not None:
        rows = rows.filter(F.col("phase") == phase)
    return rows.groupBy(*by).agg(*_line_sums())


def _line_sums() -> list[Column]:
    n = lambda cond: F.count(F.when(cond, 1))
    out = [n(F.col("is_kill")).alias("kills"), n(F.col("is_error")).alias("errors"), F.count(F.lit(1)).alias("total_attacks")]
    for phase, short in (("fbso", "fbso"), ("transition", "trans")):
        there = F.col("phase") == phase
        out += [
            n(there & F.col("is_kill")).alias(f"{short}_kills"), n(there & F.col("is_error")).alias(f"{short}_errors"),
            n(there).alias(f"{short}_attacks"),
        ]
    return out


PBP_COUNTS = (
    "set_attempts", "serve_attempts", "setter_hit_kills", "setter_hit_errors", "setter_hit_attacks", "points_played",
    "fbso_kills", "fbso_errors", "fbso_attacks", "trans_kills", "trans_errors", "trans_attacks",
)


def player_contributions(events: DataFrame) -> DataFrame:
    """One row per event with what it adds to its player's counts.

    Points played use intervals, not a walk: a player on court from the start is owed every serve of
    the set, and each change of state adds or takes back the serves still to come. A player's first
    event tells whether they started on court; a repeated ``sub_in`` or ``sub_out`` changes nothing.
    """
    in_set = Window.partitionBy(*SET).orderBy("seq")
    own = Window.partitionBy(*SET, "player_id").orderBy("seq")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    sub = F.when(_is("sub_in"), 1).when(_is("sub_out"), 0)
    df = touches(events).withColumns({
        "_served": F.sum(F.when(_is("serve"), 1).otherwise(0)).over(in_set.rowsBetween(Window.unboundedPreceding, 0)),
        "_serves": F.sum(F.when(_is("serve"), 1).otherwise(0)).over(Window.partitionBy(*SET)),
    }).withColumns({
        "_nth": F.row_number().over(own),
        "_start": F.when(F.first("touch_type").over(own) == "sub_in", 0).otherwise(1),
        "_was": F.last(sub, ignorenulls=True).over(before),
    })
    fed = _is("set") & F.col("next_attack").isNotNull()
    to_last = fed & (F.col("next_attack") == F.col("last_attack"))
    one = lambda cond: F.when(cond, 1).otherwise(0)
    left = F.col("_serves") - F.col("_served")
    owed = F.when(F.col("_nth") == 1, F.col("_start") * F.col("_serves")).otherwise(0)
    change = F.coalesce((sub - F.coalesce(F.col("_was"), F.col("_start"))) * left, F.lit(0))
    attack = _is("attack")
    fbso = attack & F.col("is_fbso")
    trans = attack & ~F.col("is_fbso")
    return df.filter(F.col("player_id").isNotNull()).select(
        "season", *SET, "team_id", "player_id",
        one(_is("set")).alias("set_attempts"), one(_is("serve")).alias("serve_attempts"),
        one(to_last & F.col("_kill_for")).alias("setter_hit_kills"), one(to_last & F.col("_error_for")).alias("setter_hit_errors"),
        one(fed).alias("setter_hit_attacks"), (owed + change).alias("points_played"),
        one(fbso & F.col("is_kill")).alias("fbso_kills"), one(fbso & F.col("is_error")).alias("fbso_errors"), one(fbso).alias("fbso_attacks"),
        one(trans & F.col("is_kill")).alias("trans_kills"), one(trans & F.col("is_error")).alias("trans_errors"), one(trans).alias("trans_attacks"),
    )


def player_pbp(events: DataFrame, by: list[str]) -> DataFrame:
    """Counts per ``by`` (which holds ``player_id``), for players who did anything counted."""
    sums = player_contributions(events).groupBy(*by).agg(*[F.sum(c).alias(c) for c in PBP_COUNTS])
    seen = F.lit(False)
    for c in ("set_attempts", "serve_attempts", "points_played", "setter_hit_attacks", "fbso_attacks", "trans_attacks"):
        seen = seen | (F.col(c) > 0)
    return sums.filter(seen)


def season_pbp(t: Tables, season: int | None = None) -> DataFrame:
    """Play-by-play season line per player, with assists per set attempt."""
    lines = player_pbp(one_season(t.pbp_events, season), ["season", "player_id"])
    assists = season_totals(t.player_game_stats, season).select("player_id", "season", "assists")
    pct = F.when(F.col("set_attempts") > 0, F.col("assists") / F.col("set_attempts"))
    return lines.join(assists, ["player_id", "season"], "left").withColumn("assist_pct", pct).drop("assists")


def contest_box(t: Tables, season: int | None = None) -> DataFrame:
    """Box-score line per (contest, player) with its play-by-play counts where there are any."""
    pbp = player_pbp(one_season(t.pbp_events, season), ["contest_id", "player_id"]).drop("points_played", "setter_hit_kills", "setter_hit_errors")
    people = t.players.select(F.col("id").alias("player_id"), "season", "name", "number", "position", "class_year", "height_inches")
    return (
        one_season(t.player_game_stats, season)
        .join(people, ["player_id", "season"], "left")
        .join(pbp, ["contest_id", "player_id"], "left")
    )


def setter_hitting(events: DataFrame, by: list[str]) -> DataFrame:
    """Attacks off each setter's sets and their outcome."""
    rows = player_contributions(events).groupBy(*by).agg(
        F.sum("setter_hit_kills").alias("kills"), F.sum("setter_hit_errors").alias("errors"), F.sum("setter_hit_attacks").alias("attacks")
    )
    return rows.filter("attacks > 0")


def team_attack_splits(t: Tables, season: int | None = None, setter_id: int | None = None, by_week: bool = False) -> DataFrame:
    """Attack line per hitter of a team's roster, whole and by phase, optionally off one setter."""
    rows = attack_touches(one_season(t.pbp_events, season))
    if setter_id is not None:
        rows = rows.filter(F.col("setter_id") == setter_id)
    keys = ["season", "hitter_id"]
    if by_week:
        from matchlens.operators.weeks import contest_week_ids

        rows = rows.join(contest_week_ids(t, season).select("contest_id", "week_number"), "contest_id")
        keys.append("week_number")
    people = t.players.select(F.col("id").alias("hitter_id"), "season", F.col("team_id").alias("roster_team"), "name", "number", "position")
    return rows.groupBy(*keys).agg(*_line_sums()).join(people, ["hitter_id", "season"])


def sides(t: Tables, season: int | None = None) -> DataFrame:
    return one_season(t.contests, season).select("contest_id", "home_team_id", "away_team_id")


def events_with_sides(t: Tables, season: int | None = None) -> DataFrame:
    """Events with their contest's home and away team, partitioned by (contest, set)."""
    both = sides(t, season)
    return by_set(one_season(t.pbp_events, season).join(both, "contest_id"))


def rallies(t: Tables, season: int | None = None) -> DataFrame:
    """One row per rally: server, receiver, winner, and each side's attack counts.

    A rally needs a known serving side (from the serve, else from the reception) and a winner.
    """
    ev = events_with_sides(t, season).filter("rally_number >= 1")
    home, away = F.col("home_team_id"), F.col("away_team_id")
    ours = F.col("team_id").isin(home, away)
    at = lambda cond, val: F.min_by(F.when(cond, val), F.when(cond, F.col("seq")))
    n = lambda team, cond: F.count(F.when((F.col("team_id") == team) & cond, 1))
    swing = _is("attack") & ~F.col("is_terminal")
    kill = F.col("is_terminal") & (F.col("terminal_type") == "kill")
    miss = F.col("is_terminal") & (F.col("terminal_type") == "attack_error")
    rows = ev.groupBy("season", *RALLY, "home_team_id", "away_team_id").agg(
        # Field by field: numbers keep the aggregate in fixed-width hash buffers, a struct would sort.
        at(_is("serve"), F.col("team_id")).alias("_served_by"), at(_is("serve"), F.col("player_id")).alias("server_id"),
        at(_is("reception") & ours, F.col("team_id")).alias("_recv"),
        at(F.col("is_terminal"), F.col("scoring_team_id")).alias("winner"),
        *[n(team, cond).alias(f"{who}_{what}") for who, team in (("home", home), ("away", away))
          for what, cond in (("attack_attempts", swing), ("kills", kill), ("attack_errors", miss))],
    )
    other = lambda x: F.when(x == home, away).otherwise(home)
    served = F.col("_served_by")
    rows = rows.withColumn("serving", F.when(served.isin(home, away), served).when(F.col("_recv").isNotNull(), other(F.col("_recv"))))
    return rows.filter(F.col("serving").isNotNull() & F.col("winner").isin(home, away)).withColumn(
        "receiving", other(F.col("serving"))
    ).drop("_served_by", "_recv")


def main_setters(t: Tables, season: int | None = None) -> DataFrame:
    """The player of each side with the most set touches in a match; the smaller id on a tie."""
    sets = one_season(t.pbp_events, season).filter(_is("set") & F.col("player_id").isNotNull() & F.col("team_id").isNotNull())
    counts = sets.groupBy("contest_id", "team_id", "player_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("contest_id", "team_id").agg(F.max_by("player_id", F.struct("n", -F.col("player_id"))).alias("main_setter"))


def rotations(t: Tables, season: int | None = None) -> DataFrame:
    """Counts per (contest, set, team, rotation 1–6), rotation 1 having the main setter serve.

    A side moves on by one each time it wins a rally it received, so its position in a rally is one
    more than the number of such rallies before it, modulo six. Six rows appear for every side.
    """
    from matchlens.constants import ROTATION_FIELDS

    r = rallies(t, season)
    one = lambda cond: F.when(cond, 1).otherwise(0)
    home = F.struct(F.col("home_team_id").alias("team_id"), *[F.col(f"home_{c}").alias(c) for c in ("attack_attempts", "kills", "attack_errors")])
    away = F.struct(F.col("away_team_id").alias("team_id"), *[F.col(f"away_{c}").alias(c) for c in ("attack_attempts", "kills", "attack_errors")])
    rows = r.withColumn("s", F.explode(F.array(home, away))).select("season", *RALLY, "serving", "winner", "server_id", "s.*")
    serve, won = F.col("serving") == F.col("team_id"), F.col("winner") == F.col("team_id")
    before = Window.partitionBy(*SET, "team_id").orderBy("rally_number").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("slot", F.coalesce(F.sum(one(~serve & won)).over(before), F.lit(0)) % 6).join(
        main_setters(t, season), ["contest_id", "team_id"], "left"
    )
    rows = rows.withColumns({
        "serve_rallies": one(serve), "serve_won": one(serve & won), "recv_rallies": one(~serve), "recv_won": one(~serve & won),
        "points_won": one(won), "points_lost": one(~won),
        "_led": one(serve & F.coalesce(F.col("server_id") == F.col("main_setter"), F.lit(False))),
    })
    keys = ["season", *SET, "team_id"]
    slots = rows.groupBy(*keys, "slot").agg(*[F.sum(c).alias(c) for c in ROTATION_FIELDS], F.sum("_led").alias("_led"))
    team_set = slots.groupBy(*keys).agg(
        F.coalesce(F.max_by(F.when(F.col("_led") > 0, F.col("slot")), F.when(F.col("_led") > 0, F.struct("_led", -F.col("slot")))), F.lit(0)).alias("anchor"),
        *[F.map_from_entries(F.collect_list(F.struct("slot", F.struct(*ROTATION_FIELDS).alias("v")))).alias("by_slot")],
    )
    each = team_set.select(*keys, "anchor", "by_slot", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("rotation"))
    cell = F.try_element_at("by_slot", F.pmod(F.col("anchor") + F.col("rotation") - 1, F.lit(6)))
    return each.withColumn("cell", cell).select(
        *keys, F.col("rotation").cast("int").alias("rotation"), *[F.coalesce(F.col(f"cell.{c}"), F.lit(0)).alias(c) for c in ROTATION_FIELDS]
    )


def rotation_totals(t: Tables, by: list[str], season: int | None = None) -> DataFrame:
    from matchlens.constants import ROTATION_FIELDS

    return rotations(t, season).groupBy(*by, "rotation").agg(*[F.sum(c).alias(c) for c in ROTATION_FIELDS])


def phase_totals(t: Tables, season: int | None = None) -> DataFrame:
    """Per (season, team of the hitter): first-ball and transition lines."""
    people = t.players.select(F.col("id").alias("hitter_id"), "season", F.col("team_id").alias("hitter_team"))
    # Lines per hitter first: the roster join then sees one row per player, not one per attack.
    lines = attack_lines(one_season(t.pbp_events, season), ["season", "hitter_id"]).join(people, ["hitter_id", "season"])
    return lines.groupBy("season", F.col("hitter_team").alias("team_id")).agg(
        *[F.sum(c).alias(c) for c in ("fbso_kills", "fbso_errors", "fbso_attacks", "trans_kills", "trans_errors", "trans_attacks")]
    )


def season_rollup(t: Tables, season: int | None = None) -> DataFrame:
    """Season rotation counts per (season, team, rotation) with matches that have play-by-play."""
    from matchlens.constants import ROTATION_FIELDS

    counts = rotation_totals(t, ["season", "team_id"], season)
    seen = one_season(t.pbp_events, season).select("contest_id", "season").distinct().join(sides(t, season), "contest_id")
    both = seen.select("season", F.explode(F.array("home_team_id", "away_team_id")).alias("team_id")).groupBy("season", "team_id").agg(
        F.count(F.lit(1)).alias("matches_with_pbp")
    )
    six = both.filter(F.col("team_id").isNotNull()).select("season", "team_id", "matches_with_pbp", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("rotation"))
    return six.join(counts, ["season", "team_id", "rotation"], "left").na.fill(0, list(ROTATION_FIELDS))


def rotation_summary(t: Tables, season: int | None = None, min_recv: int = 10, rollup: DataFrame | None = None) -> DataFrame:
    """Side-out and hold rates per rotation, and each team's weakest and strongest rotation."""
    pct = lambda a, b: round_to(100.0 * ratio(F.col(a).cast("double"), F.col(b)), 1)
    rollup = season_rollup(t, season) if rollup is None else rollup
    table = rollup.select(
        "season", "team_id", "rotation", pct("recv_won", "recv_rallies").alias("sideout_pct"), pct("serve_won", "serve_rallies").alias("hold_pct"),
        (F.col("points_won") - F.col("points_lost")).alias("net"), "recv_rallies",
        round_to(ratio((F.col("kills") - F.col("attack_errors")).cast("double"), F.col("attack_attempts")), 3).alias("hit_pct"),
    )
    team = Window.partitionBy("season", "team_id")
    ok = (F.col("recv_rallies") >= min_recv) & F.col("sideout_pct").isNotNull()
    return table.withColumns({
        "weakest": F.min(F.when(ok, F.struct("sideout_pct", "rotation"))).over(team)["rotation"],
        "strongest": -F.max(F.when(ok, F.struct("sideout_pct", (-F.col("rotation")).alias("r")))).over(team)["r"],
    })


def phase_summary(t: Tables, season: int | None = None) -> DataFrame:
    """Hitting on the first ball and in transition, and the gap between them."""
    hit = lambda p: round_to(ratio((F.col(f"{p}_kills") - F.col(f"{p}_errors")).cast("double"), F.col(f"{p}_attacks")), 3)
    rows = phase_totals(t, season).withColumns({"fbso_hit_pct": hit("fbso"), "trans_hit_pct": hit("trans")})
    return rows.select(
        "season", "team_id", "fbso_hit_pct", "fbso_attacks", "trans_hit_pct", "trans_attacks",
        round_to(F.col("fbso_hit_pct") - F.col("trans_hit_pct"), 3).alias("in_out_gap"),
    ).filter("fbso_hit_pct is not null or trans_hit_pct is not null")
