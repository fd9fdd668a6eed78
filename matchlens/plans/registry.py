"""Named read-only queries with caller arguments: ``call(name, tables, **arguments)`` → DataFrame.

Arguments are what an analyst types: team and conference names, spelled-out positions, a season or
none for all of them. A team name is looked up once, as one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlens.constants import API_LIMIT, CONTEST_LIMIT, TOOL_LIMIT
from matchlens.functions.predicates import in_conference, plays_position, roster_filters, within_days
from matchlens.operators import asof, leaderboards, lookups, people, records, schedule, scouting, timeline, totals
from matchlens.operators.entities import find_team
from matchlens.operators.lineups import match_lineups
from matchlens.operators.ranking import clamp_limit
from matchlens.tables import Tables


class UnknownTeam(ValueError):
    """No team matches the text."""


def team_id(t: Tables, text: str | None) -> int | None:
    if not text:
        return None
    found = find_team(t, text).first()["team_id"]
    if found is None:
        raise UnknownTeam(f"no team matched {text!r}")
    return found


def _conf(name: str | None) -> Column | None:
    return in_conference(name) if name else None


def _people(t: Tables, a: dict) -> dict:
    """Caller's roster filters, with the team looked up."""
    known = ("class_year", "position", "conference", "state", "hometown", "country", "international", "min_height_inches", "max_height_inches", "query")
    return {k: a[k] for k in known if a.get(k) is not None} | ({"team_id": team_id(t, a["team"])} if a.get("team") else {})


def _keep(t: Tables, a: dict) -> Column:
    return roster_filters(**_people(t, a))


def _rest(a: dict, *names: str) -> dict:
    return {k: a[k] for k in names if a.get(k) is not None}


def _match(t: Tables, a: dict) -> dict:
    return {"team_id": team_id(t, a["team"]), "date": a["date"], "opponent_id": team_id(t, a.get("opponent")), "season": a.get("season")}


def _player(t: Tables, df: DataFrame, a: dict) -> DataFrame:
    return df.filter(F.col("player_id") == a["player_id"])


TOOLS: dict[str, Callable[[Tables, dict], DataFrame]] = {
    "leaderboard": lambda t, a: leaderboards.leaderboard(t, **_rest(a, "stat", "season", "min_sets", "limit", "order"), **_people(t, a)),
    "search_players": lambda t, a: lookups.search_players(t, **_rest(a, "season", "sort_by", "limit", "order"), **_people(t, a)),
    "player_stats": lambda t, a: _player(t, lookups.player_cards(t, a.get("season")), a),
    "player_game_log": lambda t, a: _player(t, lookups.game_log(t, a.get("season")), a),
    "list_teams": lambda t, a: lookups.list_teams(t, a.get("query"), _conf(a.get("conference"))),
    "team_records": lambda t, a: records.ranked_records(t, conference=_conf(a.get("conference")), **_rest(a, "season", "sort_by", "limit", "order")),
    "rankings": lambda t, a: records.rankings(t, **_rest(a, "season", "poll", "limit")),
    "team_stats": lambda t, a: totals.team_stats(t, conference=_conf(a.get("conference")), team_id=team_id(t, a.get("team")), **_rest(a, "season", "sort_by", "limit", "order")),
    "team_heights": lambda t, a: people.team_heights(t, keep=_keep(t, a), **_rest(a, "season", "sort_by", "limit", "order")),
    "game_highs": lambda t, a: leaderboards.game_highs(
        t, conference=_conf(a.get("conference")), team_id=team_id(t, a.get("team")), position=plays_position(a.get("position")), **_rest(a, "stat", "season", "limit")),
    "double_doubles": lambda t, a: leaderboards.double_doubles(t, people_filter=_keep(t, a), **_rest(a, "season", "limit")),
    "team_roster_makeup": lambda t, a: people.roster_makeup(t, keep=_conf(a.get("conference")), **_rest(a, "season", "sort_by", "limit", "order")),
    "player_origins": lambda t, a: people.player_origins(t, keep=_conf(a.get("conference")), **_rest(a, "group_by", "season", "limit")),
    "transfer_impact": lambda t, a: people.transfer_impact(t, keep=_keep(t, a), **_rest(a, "season", "sort_by", "min_sets", "limit")),
    "team_defense": lambda t, a: totals.team_defense(t, conference=_conf(a.get("conference")), **_rest(a, "season", "sort_by", "min_games", "limit", "order")),
    "quality_wins": lambda t, a: asof.quality_win_counts(
        t, conference=_conf(a.get("conference")), team_id=team_id(t, a.get("team")), limit=a.get("limit", 25), **_rest(a, "season", "poll", "threshold")),
    "biggest_upsets": lambda t, a: asof.biggest_upsets(
        t, conference=_conf(a.get("conference")), team_id=team_id(t, a.get("team")), **_rest(a, "season", "poll", "threshold", "min_gap", "limit")),
    "team_schedule": lambda t, a: schedule.team_schedule(t, a.get("season"), a.get("upcoming_only", False), drop_played_days=False).filter(
        F.col("team_id") == team_id(t, a["team"])),
    "games_on_date": lambda t, a: schedule.games_on(t, a.get("season"), F.col("date") == a["date"]),
    "match_pbp": lambda t, a: timeline.match_report(t, **_match(t, a)),
    "match_lineups": lambda t, a: match_lineups(t, **_match(t, a)),
    "team_scouting_report": lambda t, a: scouting.scouting_reports(t, a.get("season")).filter(F.col("team_id") == team_id(t, a["team"])),
    "player_leaderboard": lambda t, a: leaderboards.player_leaderboard(t, **a),
    "fantasy_leaderboard": lambda t, a: leaderboards.fantasy_leaderboard(t, **a),
    "conference_summary": lambda t, a: records.conference_summary(t, a.get("season")),
    "conference_standings": lambda t, a: records.conference_standings(t, a.get("season")),
    "standings": lambda t, a: records.standings(t, a.get("season")),
    "scoreboard": lambda t, a: schedule.scoreboard(t, a.get("season"), within_days("date", a["start"], a["end"])),
    "search": lambda t, a: lookups.search(t, **a),
    "contests": lambda t, a: lookups.list_contests(t, **_rest(a, "season", "limit", "offset")),
}


# Named queries that page through longer lists than a tool shows.
PAGED = {"player_leaderboard": API_LIMIT, "fantasy_leaderboard": API_LIMIT, "contests": CONTEST_LIMIT}


def call(name: str, t: Tables, **arguments) -> DataFrame:
    """Run a named query; unknown names and arguments raise before any job starts.

    A caller's ``limit`` is held within what the list may show; the operators themselves return as many
    rows as they are asked for.
    """
    if name not in TOOLS:
        raise KeyError(f"no query {name!r}; known: {sorted(TOOLS)}")
    if arguments.get("limit") is not None:
        arguments["limit"] = clamp_limit(arguments["limit"], PAGED.get(name, TOOL_LIMIT))
    return TOOLS[name](t, arguments)
