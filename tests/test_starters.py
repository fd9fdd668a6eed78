"""Starters of many lines are matched once per name, not once per name and side."""

from collections import Counter

from pyspark.sql import functions as F

from matchlens.operators.entities import assign_starters, match_names, match_names_on_teams
from matchlens.tables import frames

PEOPLE = [
    (1, 10, 2000, "1", "Ann Lee"), (2, 10, 2000, "2", "Lee Bo Ann"), (3, 10, 2000, "3", "Cy Dee"), (4, 20, 2000, "4", "Cy Dee"), (5, 20, 2000, "5", "Cat Dee"),
    (6, 20, 2000, "6", "José Da Silva Cruz"), (7, 30, 2000, "7", "Ann Lee"), (8, 30, 2001, "8", "Cy Dee"), (9, 30, 2000, "9", "Eve Long Name"), (11, 30, 2000, "11", "Long Name Ida"),
]
GAMES = [("a", 10, 20), ("b", 20, 10), ("c", 30, 30), ("d", None, 30), ("e", 20, 30), ("e", 10, 30)]
NAMES = ["Ann Lee", "Dee, Cy", "C. Dee", "Silva da Jose", "Name Long", "Long Eve Uma", "", "Nobody Here", "Bo", "Dee", None]


def _tables(spark):
    rows = [(*p, None, None, None, None, None, None) for p in PEOPLE]
    games = [(c, 2000, None, h, a, None, None, None, None, None, None) for c, h, a in GAMES]
    return frames(spark, players=rows, contests=games)


def _roster(t):
    return t.players.select("season", "team_id", F.col("id").alias("player_id"), "name")


def test_names_of_several_teams_match_as_one_by_one(spark):
    t = _tables(spark)
    asked = spark.createDataFrame([(s, n, [10, 20, 30, 40]) for s in (2000, 2001) for n in NAMES if n is not None], "season int, name string, teams array<int>")
    got = match_names_on_teams(asked, _roster(t)).select("season", "name", F.explode("found").alias("f")).select("season", "name", "f.*")
    one_by_one = asked.select("season", F.explode("teams").alias("team_id"), "name")
    want = match_names(one_by_one, _roster(t), ["season", "team_id"]).filter("player_id is not null").select("season", "name", "team_id", "player_id")
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect())) and want.count() > 8


def test_a_side_gets_the_line(spark):
    t = _tables(spark)
    lines = [(2000, c, k, 0, n) for c in "abcdex" for k, some in ((1, NAMES[:3]), (2, NAMES[3:6]), (None, NAMES)) for n in some] + [(None, "a", 1, 0, "Ann Lee")]
    got = assign_starters(spark.createDataFrame(lines, "season int, contest_id string, set_number int, line_no int, name string"), t)
    roster = match_names(spark.createDataFrame([(2000, team, n) for team in (10, 20, 30) for n in NAMES if n is not None], "season int, team_id int, name string"), _roster(t), ["season", "team_id"])
    player = {(r.team_id, r.name): r.player_id for r in roster.filter("player_id is not null").collect()}
    want = set()
    for contest, number in {(c, k) for season, c, k, _, _ in lines if season and k}:
        sides = [(turn, team) for c, *teams in GAMES if c == contest for turn, team in enumerate(teams) if team]
        hits = {(turn, team, player[team, n]) for turn, team in sides for _, c, k, _, n in lines if (c, k) == (contest, number) and (team, n) in player}
        if hits:
            best = max((len({p for r, m, p in hits if (r, m) == side}), -side[0], side[1]) for side in {h[:2] for h in hits})[2]
            want |= {(2000, contest, best, number, p) for _, team, p in hits if team == best}
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 8


def test_a_name_moves_once_per_tier(spark):
    """However many teams a name is asked of, what goes through the joins is one row."""
    t = _tables(spark)
    asked = spark.createDataFrame([(2000, "Nobody Here", list(range(40)))], "season int, name string, teams array<int>")
    assert match_names_on_teams(asked, _roster(t)).isEmpty()
    lines = spark.createDataFrame([(2000, "a", 1, 0, "Ann Lee")], "season int, contest_id string, set_number int, line_no int, name string")
    plan = assign_starters(lines, t)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" in plan and "explode(array(struct" not in plan
