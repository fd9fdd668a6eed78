"""The scoring sequence of a match: aggregates, runs, momentum, descriptions, stoppages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlens.constants import TERMINAL_PHRASES
from matchlens.operators.rally import RALLY, SET, WHOLE, events_with_sides
from matchlens.tables import Tables


def _is(kind: str) -> Column:
    return F.col("touch_type") == kind


def _named(kind: str, team: Column) -> Column:
    return _is(kind) & ~F.col("is_terminal") & F.col("team_id").eqNullSafe(team) & F.coalesce(F.col("player_name") != "", F.lit(False))


def scored_points(t: Tables, season: int | None = None) -> DataFrame:
    """One row per terminal, with server, assisting setter and a sentence describing the play."""
    rally = Window.partitionBy(*RALLY).orderBy("seq").rowsBetween(*WHOLE)
    first = lambda cond, val: F.first(F.when(cond, val), ignorenulls=True).over(rally)
    last = lambda cond, val: F.last(F.when(cond, val), ignorenulls=True).over(rally)
    df = events_with_sides(t, season).withColumns({
        "_serve": first(_is("serve"), F.struct("team_id", "player_name")),
        "_term": first(F.col("is_terminal"), F.struct("terminal_type", "scoring_team_id")),
    })
    scorer = F.col("_term.scoring_team_id")
    setter = F.struct("team_id", "player_id", "player_name")
    home, away = F.col("home_team_id"), F.col("away_team_id")
    # What the sentence of a play needs, per side: the last named set and attack, and all blocks.
    for who, team in (("home", home), ("away", away)):
        df = df.withColumns({
            f"_{who}_set": last(_named("set", team), F.col("player_name")),
            f"_{who}_attack": last(_named("attack", team), F.col("player_name")),
            f"_{who}_block": F.collect_list(F.when(_named("block", team), F.struct("seq", "player_name"))).over(rally),
        })
    kill = (F.col("_term.terminal_type") == "kill") & scorer.isNotNull()
    df = df.withColumn("_setter", last(kill & _is("set") & (F.col("team_id") == scorer), setter))
    points = df.filter("is_terminal")
    of = lambda what, team: F.when(team == home, F.col(f"_home_{what}")).when(team == away, F.col(f"_away_{what}"))
    return points.select(
        "season", *RALLY, "seq", "team_id", "player_id", "player_name", "terminal_type", "scoring_team_id", "away_score", "home_score",
        "home_team_id", "away_team_id", F.col("_serve.team_id").alias("serving_team_id"), F.col("_serve.player_name").alias("serving_name"),
        F.col("_setter.player_id").alias("assist_player_id"), F.col("_setter.player_name").alias("assist_name"),
        F.col("_setter.team_id").alias("assist_team_id"), _sentence(of, home, away).alias("description"),
    )


def _sentence(of, home: Column, away: Column) -> Column:
    """Wording of a scoring play from its outcome and the named touches before it."""
    kind = F.col("terminal_type")
    who = F.trim(F.coalesce("player_name", F.lit("")))
    by = lambda head: F.when(who != "", F.concat(F.lit(f"{head} by "), who)).otherwise(F.lit(head))
    add = lambda text, pre, extra: F.when(F.coalesce(extra, F.lit("")) != "", F.concat(text, F.lit(f" ({pre} "), extra, F.lit(")"))).otherwise(text)
    scorer, erred = F.col("scoring_team_id"), F.col("team_id")
    other = F.when(scorer.eqNullSafe(home), away).otherwise(home)
    beaten = of("attack", other)
    blockers = F.array_join(F.transform(F.array_sort(of("block", scorer)), lambda b: b["player_name"]), ", ")
    missed = by("Attack error")
    phrase = F.lit("Point")
    for name, text in TERMINAL_PHRASES.items():
        phrase = F.when(kind == name, text).otherwise(phrase)
    return (
        F.when(kind == "kill", add(by("Kill"), "from", of("set", scorer)))
        .when(kind == "ace", by("Ace"))
        .when((kind == "block") & beaten.isNotNull() & (who != ""), F.concat(F.lit("Attack error by "), beaten, F.lit(" (block by "), who, F.lit(")")))
        .when(kind == "block", by("Block"))
        .when((kind == "attack_error") & (F.coalesce(blockers, F.lit("")) != ""), add(missed, "block by", blockers))
        .when(kind == "attack_error", add(missed, "from", of("set", erred)))
        .when(kind == "service_error", "Service error")
        .otherwise(F.when(who != "", F.concat(phrase, F.lit(" by "), who)).otherwise(phrase))
    )


def _at_first(cond: Column, value: Column) -> Column:
    return F.min_by(F.when(cond, value), F.when(cond, F.col("seq")))


def rally_servers(t: Tables, season: int | None = None) -> DataFrame:
    """Team and player of each rally's first serve."""
    return events_with_sides(t, season).groupBy("season", *RALLY).agg(
        _at_first(_is("serve"), F.col("team_id")).alias("serving_team_id"), _at_first(_is("serve"), F.col("player_id")).alias("server_id"))


def kill_assists(t: Tables, season: int | None = None) -> DataFrame:
    """The scoring side's last setter in each rally that ended with a kill."""
    set_by = lambda w: _is("set") & (F.col("team_id") == F.col(f"{w}_team_id"))
    rows = events_with_sides(t, season).groupBy("season", *RALLY, "home_team_id", "away_team_id").agg(
        _at_first(F.col("is_terminal"), F.col("terminal_type") == "kill").alias("kill"),
        _at_first(F.col("is_terminal"), F.col("scoring_team_id")).alias("scorer"),
        *[F.max(F.when(set_by(w), 1)).alias(f"{w}_set") for w in ("home", "away")],
        *[F.max_by(F.when(set_by(w), F.col("player_id")), F.when(set_by(w), F.col("seq"))).alias(f"{w}_setter") for w in ("home", "away")],
    )
    home = F.col("scorer") == F.col("home_team_id")
    had = F.when(home, F.col("home_set")).when(F.col("scorer") == F.col("away_team_id"), F.col("away_set"))
    return rows.filter(F.col("kill") & had.isNotNull()).select(
        "season", *RALLY, F.col("scorer").alias("team_id"), F.when(home, F.col("home_setter")).otherwise(F.col("away_setter")).alias("assist_player_id"))


SIDE_COUNTS = (
    "set_attempts", "serve_attempts", "attack_attempts", "digs", "receptions", "kills", "aces", "blocks", "errors", "attack_errors",
    "set_errors", "points", "assists",
)


def side_aggregates(t: Tables, season: int | None = None) -> DataFrame:
    """Touch and outcome counts per (contest, set, side); points go to whoever scored."""
    rally = Window.partitionBy(*RALLY).orderBy("seq").rowsBetween(*WHOLE)
    df = events_with_sides(t, season)
    term = F.first(F.when(F.col("is_terminal"), F.struct("terminal_type", "scoring_team_id", "seq")), ignorenulls=True).over(rally)
    df = df.withColumn("_t", term)
    scored_kill = F.col("is_terminal") & (F.col("seq") == F.col("_t.seq")) & (F.col("terminal_type") == "kill")
    set_by = lambda w: F.max(F.when(_is("set"), F.col("team_id") == F.col(f"{w}_team_id"))).over(rally)
    df = df.withColumns({"_home_set": set_by("home"), "_away_set": set_by("away")})

    def counts(who: str) -> list[Column]:
        team = F.col(f"{who}_team_id")
        mine, touch = F.coalesce(F.col("team_id") == team, F.lit(False)), ~F.col("is_terminal")
        done = mine & F.col("is_terminal")
        kind = F.col("terminal_type")
        scored = F.coalesce(F.col("is_terminal") & (F.col("scoring_team_id") == team), F.lit(False))
        hits = {
            "set_attempts": mine & touch & _is("set"), "serve_attempts": mine & touch & _is("serve"),
            "attack_attempts": mine & touch & _is("attack"), "digs": mine & touch & _is("dig"),
            "receptions": mine & touch & _is("reception"), "kills": done & (kind == "kill"), "aces": done & (kind == "ace"),
            "blocks": done & (kind == "block"), "errors": done & kind.endswith("_error"),
            "attack_errors": done & (kind == "attack_error"), "set_errors": done & (kind == "set_error"), "points": scored,
            "assists": scored & scored_kill & F.coalesce(F.col(f"_{who}_set"), F.lit(False)),
        }
        return [F.count(F.when(hits[c], 1)).alias(c) for c in SIDE_COUNTS]

    both = df.groupBy("season", *SET, "home_team_id", "away_team_id").agg(
        F.struct(*counts("home")).alias("home"), F.struct(*counts("away")).alias("away")
    )
    side = lambda w: F.struct(F.lit(w).alias("side"), F.col(f"{w}_team_id").alias("team_id"), F.col(w).alias("n"))
    return both.select("season", *SET, F.explode(F.array(side("home"), side("away"))).alias("s")).select(
        "season", *SET, "s.side", "s.team_id", *[F.col(f"s.n.{c}").alias(c) for c in SIDE_COUNTS]
    )


def momentum(t: Tables, season: int | None = None) -> DataFrame:
    """Per (contest, set): points, ties, lead changes, longest runs and kinds of points."""
    points = events_with_sides(t, season).filter("is_terminal").withColumn(
        "side", F.when(F.col("scoring_team_id") == F.col("away_team_id"), "away").when(F.col("scoring_team_id") == F.col("home_team_id"), "home")
    ).filter(F.col("side").isNotNull())
    order = Window.partitionBy(*SET).orderBy("seq")
    same = Window.partitionBy(*SET, "side").orderBy("seq")
    diff = F.signum(F.col("away_score") - F.col("home_score")).cast("int")
    points = points.withColumns({
        "lead": diff, "_run": F.row_number().over(order) - F.row_number().over(same),
    }).withColumn("_held", F.last(F.when(F.col("lead") != 0, F.col("lead")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    points = points.withColumn("_len", F.count(F.lit(1)).over(Window.partitionBy(*SET, "side", "_run")))
    n = lambda cond: F.count(F.when(cond, 1))
    kinds = {"kills": F.col("terminal_type") == "kill", "aces": F.col("terminal_type") == "ace", "blocks": F.col("terminal_type") == "block",
             "opp_errors": F.col("terminal_type").endswith("_error")}
    out = points.groupBy("season", *SET).agg(
        n(F.col("side") == "away").alias("away_points"), n(F.col("side") == "home").alias("home_points"),
        n(F.col("lead") == 0).alias("ties"), n((F.col("lead") != 0) & (F.col("lead") != F.col("_held"))).alias("lead_changes"),
        *[F.coalesce(F.max(F.when(F.col("side") == w, F.col("_len"))), F.lit(0)).alias(f"{w}_run") for w in ("away", "home")],
        *[n((F.col("side") == w) & cond).alias(f"{w}_{k}") for w in ("away", "home") for k, cond in kinds.items()],
    )
    return out.withColumn("winner", F.when(F.col("away_points") > F.col("home_points"), "away").otherwise("home"))


def scoring_leaders(t: Tables, season: int | None = None, limit: int = 6) -> DataFrame:
    """Players who scored most points themselves, per match."""
    from matchlens.operators.ranking import top_per

    own = events_with_sides(t, season).filter(
        F.col("is_terminal") & F.col("terminal_type").isin("kill", "ace", "block") & F.col("player_name").isNotNull()
        & (F.col("scoring_team_id").isin(F.col("home_team_id"), F.col("away_team_id")))
    )
    n = lambda k: F.count(F.when(F.col("terminal_type") == k, 1))
    rows = own.groupBy("season", "contest_id", "player_name", "player_id").agg(
        F.min_by("scoring_team_id", F.struct("set_number", "seq")).alias("team_id"), F.count(F.lit(1)).alias("points"),
        n("kill").alias("kills"), n("ace").alias("aces"), n("block").alias("blocks"),
    )
    return top_per(rows, ["contest_id"], [F.desc("points"), F.col("player_name"), F.col("player_id")], limit)


def rally_log(t: Tables, season: int | None = None) -> DataFrame:
    """One line of text per point, with the running score and the assist."""
    p = scored_points(t, season)
    names = t.teams.select(F.col("id").alias("scoring_team_id"), F.col("name").alias("_team"))
    kind = F.col("terminal_type")
    verb = F.initcap(F.regexp_replace(F.coalesce(F.nullif(kind, F.lit("")), F.lit("point")), "_", " "))
    who = F.coalesce(F.nullif("player_name", F.lit("")), F.col("_team"), F.lit("?"))
    score = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    p = p.filter(F.col("scoring_team_id").isin(F.col("home_team_id"), F.col("away_team_id")))
    return p.join(names, "scoring_team_id", "left").select(
        "season", *RALLY, "seq",
        F.concat(F.lit("S"), F.col("set_number").cast("string"), F.lit(" "), score("away_score"), F.lit("-"), score("home_score"), F.lit(" — "), verb,
                 F.lit(" by "), who, F.when(F.col("assist_name").isNotNull(), F.concat(F.lit(" (assist "), F.col("assist_name"), F.lit(")"))).otherwise("")).alias("line"),
    )


def stoppages(t: Tables, season: int | None = None) -> DataFrame:
    """Runs of substitutions, one row per run and team that sends someone in."""
    sub = F.col("touch_type").isin("sub_in", "sub_out")
    order = Window.partitionBy(*SET).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    runs = events_with_sides(t, season).withColumn("_run", F.sum(F.when(sub, 0).otherwise(1)).over(order)).filter(sub)
    named = _is("sub_in") & F.coalesce(F.col("player_name") != "", F.lit(False))
    # A run is a handful of substitutions between two touches, so its list stays short.
    return (
        runs.groupBy("season", *SET, "_run", "team_id")
        .agg(F.min("seq").alias("seq"), F.array_sort(F.collect_list(F.when(named, F.struct("seq", "player_name")))).alias("p"))
        .filter(F.size("p") > 0)
        .select("season", *SET, "seq", "team_id", F.array_join(F.transform("p", lambda x: x["player_name"]), "; ").alias("players"))
    )


def matches_on(t: Tables, team_id: int, date: str, opponent_id: int | None = None, season: int | None = None) -> DataFrame:
    """A team's matches on a day, optionally against one opponent."""
    from matchlens.tables import one_season

    plays = lambda x: (F.col("home_team_id") == x) | (F.col("away_team_id") == x)
    games = one_season(t.contests, season).filter(F.col("date").startswith(date) & plays(team_id))
    return games if opponent_id is None else games.filter(plays(opponent_id))


def match_report(t: Tables, team_id: int, date: str, opponent_id: int | None = None, season: int | None = None) -> DataFrame:
    """Momentum of the sets of one team's matches on a day."""
    return momentum(t, season).join(matches_on(t, team_id, date, opponent_id, season).select("contest_id"), "contest_id", "left_semi")
