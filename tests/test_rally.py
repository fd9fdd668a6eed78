import random

from helpers import rows, tables

from matchlens.operators import lineups, rally, timeline

EV = ["contest_id", "season", "set_number", "rally_number", "seq", "touch_type", "player_id", "team_id", "is_terminal", "terminal_type", "scoring_team_id", "player_name", "away_score", "home_score"]
GAME = (["contest_id", "season", "home_team_id", "away_team_id"], [("X", 1900, 2, 1)])


def events(*touches):
    """(rally, touch, player, team[, terminal_type, scorer]) in order of play."""
    out = []
    for i, (r, touch, pid, team, *end) in enumerate(touches):
        out.append(("X", 1900, 1, r, i + 1, touch, pid, team, bool(end), end[0] if end else None, end[1] if end else None, f"P{pid}" if pid else None, None, None))
    return (EV, out)


def match(spark, ev, **more):
    return tables(spark, pbp_events=ev, contests=GAME, **more)


A, B = 1, 2
SPLITS = events(
    (1, "serve", 11, A), (1, "reception", 23, B), (1, "set", 21, B), (1, "attack", 22, B, "kill", B),
    (2, "serve", 24, B), (2, "reception", 33, A), (2, "set", 31, A), (2, "attack", 32, A), (2, "dig", 23, B), (2, "set", 21, B), (2, "attack", 22, B, "kill", B),
    (3, "serve", 11, A), (3, "reception", 23, B), (3, "set", 21, B), (3, "attack", 22, B, "attack_error", A),
)


def test_attack_splits(spark):
    t = match(spark, SPLITS)
    line = rally.attack_lines(t.pbp_events, ["hitter_id"])
    assert rows(line, "hitter_id", "fbso_kills", "fbso_errors", "fbso_attacks", "trans_kills", "trans_errors", "trans_attacks") == [(22, 1, 1, 2, 1, 0, 1), (32, 0, 0, 1, 0, 0, 0)]
    assert rows(rally.attack_lines(t.pbp_events, ["hitter_id"], setter_id=21), "hitter_id", "kills", "errors", "total_attacks") == [(22, 2, 1, 3)]
    assert rows(rally.attack_lines(t.pbp_events, ["hitter_id"], setter_id=21, phase="fbso"), "hitter_id", "kills", "errors", "total_attacks") == [(22, 1, 1, 2)]


def test_unknown_server_makes_every_attack_transition(spark):
    t = match(spark, events((1, "set", 21, B), (1, "attack", 22, B), (1, "terminal", 22, B, "kill", B)))
    assert rows(rally.attack_touches(t.pbp_events), "hitter_id", "setter_id", "phase", "is_kill") == [(22, 21, "transition", True)]


def test_setters_and_points_played(spark):
    ev = events(
        (1, "serve", 1, B), (1, "reception", 2, A), (1, "set", 3, A), (1, "attack", 4, A), (1, "terminal", 4, A, "kill", A),
        (2, "serve", 3, A), (2, "reception", 5, B), (2, "set", 6, B), (2, "attack", 7, B), (2, "terminal", 7, B, "attack_error", A))
    box = (["contest_id", "player_id", "team_id", "season", "assists"], [("X", 3, A, 1900, 3.0)])
    got = {r.player_id: r for r in rally.season_pbp(match(spark, ev, player_game_stats=box)).collect()}
    assert (got[3].set_attempts, got[3].serve_attempts, got[3].setter_hit_attacks, got[3].setter_hit_kills, got[3].assist_pct, got[3].points_played) == (1, 1, 1, 1, 3.0, 2)
    assert (got[6].set_attempts, got[6].serve_attempts, got[6].setter_hit_errors, got[6].assist_pct) == (1, 0, 1, None)


def walk(evs):
    """Points played by a plain walk through one set, written from the rule."""
    first, points = {}, {}
    for e in evs:
        if e[6] is not None:
            first.setdefault(e[6], e[5])
    on = {p for p, k in first.items() if k != "sub_in"}
    for e in evs:
        if e[5] == "sub_in" and e[6] is not None:
            on.add(e[6])
        elif e[5] == "sub_out" and e[6] is not None:
            on.discard(e[6])
        elif e[5] == "serve":
            for p in on:
                points[p] = points.get(p, 0) + 1
    return points


def test_points_played_equal_a_walk_on_random_logs(spark):
    rng = random.Random(5)
    logs, expected = [], {}
    for c in range(60):
        evs = [(f"c{c}", 1900, 1, 1, i, rng.choice(["serve", "sub_in", "sub_out", "dig", "set"]), rng.choice([None, 1, 2, 3, 4]), 1, False, None, None, None, None, None) for i in range(rng.randint(1, 25))]
        logs += evs
        expected |= {(f"c{c}", p): n for p, n in walk(evs).items()}
    rng.shuffle(logs)
    t = tables(spark, pbp_events=(EV, logs))
    got = {(c, p): n for c, p, n in rows(rally.player_pbp(t.pbp_events, ["contest_id", "player_id"]).filter("points_played > 0"), "contest_id", "player_id", "points_played")}
    assert got == expected


ROT = events(
    (1, "serve", 11, A), (1, "reception", 21, B), (1, "attack", 11, A), (1, "terminal", 11, A, "kill", A),
    (2, "serve", 11, A), (2, "reception", 21, B), (2, "attack", 22, B), (2, "terminal", 22, B, "kill", B),
    (3, "serve", 21, B), (3, "reception", 12, A), (3, "attack", 12, A), (3, "terminal", 12, A, "kill", A),
    (4, "serve", 10, A), (4, "terminal", 10, A, "ace", A),
    (5, "serve", 10, A), (5, "reception", 21, B), (5, "attack", 22, B), (5, "terminal", 22, B, "kill", B),
    (4, "set", 10, A), (2, "set", 10, A), (1, "set", 10, A),
)


def test_rotation_one_has_the_setter_serving(spark):
    t = match(spark, ROT)
    got = {r.rotation: r for r in rally.rotations(t).filter(f"team_id = {A}").collect()}
    assert set(got) == set(range(1, 7))
    assert (got[1].serve_rallies, got[1].serve_won, got[1].points_won, got[1].points_lost) == (2, 1, 1, 1)
    assert (got[6].serve_rallies, got[6].serve_won, got[6].recv_rallies, got[6].recv_won) == (2, 1, 1, 1)
    assert (got[6].points_won, got[6].kills, got[6].attack_attempts) == (2, 2, 2)
    everyone = rally.rotations(t).groupBy("team_id").sum("serve_rallies", "recv_rallies", "points_won").collect()
    assert all(r[1] + r[2] == 5 for r in everyone) and sum(r[3] for r in everyone) == 5


def test_substitutions_do_not_move_rotations(spark):
    noisy = (EV, [*ROT[1], ("X", 1900, 1, 0, 999, "sub_in", 77, A, False, None, None, None, None, None), ("X", 1900, 1, 3, 998, "sub_in", 78, A, False, None, None, None, None, None)])
    assert rows(rally.rotations(match(spark, ROT))) == rows(rally.rotations(match(spark, noisy)))


def test_lineups_from_first_events(spark):
    ev = events((0, "sub_out", 14, A), (0, "sub_in", 17, A), (0, "sub_in", 18, A), (1, "serve", 11, A), (1, "dig", 21, B), (2, "sub_in", 15, A), (3, "sub_out", 16, A), (4, "sub_in", 16, A), (5, "sub_out", 19, A))
    players = (["id", "team_id", "season", "name", "position"], [(17, A, 1900, "Lib", "L/DS"), (18, A, 1900, "Mid", "MB")])
    t = match(spark, ev, players=players)
    role = {r.player_id: r.role for r in lineups.set_lineups(t).filter(f"team_id = {A}").collect()}
    assert role == {14: "starter", 17: "starter", 18: "sub", 11: "starter", 15: "sub", 16: "starter"}


def test_given_starters_win(spark):
    ev = events(*[(1, "dig", p, A) for p in range(10, 16)], *[(1, "dig", p, B) for p in range(20, 26)])
    given = (["contest_id", "team_id", "set_number", "player_id", "season"], [("X", A, 1, p, 1900) for p in (10, 11, 12, 13, 14, 16)])
    got = lineups.set_lineups(match(spark, ev, contest_set_starters=given))
    names = lambda team, role: [r[0] for r in rows(got.filter(f"team_id = {team} and role = '{role}'"), "player_id")]
    assert names(A, "starter") == [10, 11, 12, 13, 14, 16] and names(A, "sub") == [15]
    assert names(B, "starter") == [20, 21, 22, 23, 24, 25] and names(B, "sub") == []


def test_momentum(spark):
    seq = [(A, 1, 0), (B, 1, 1), (B, 1, 2), (B, 1, 3), (B, 1, 4), (A, 2, 4), (A, 3, 4)]
    ev = (EV, [("X", 1900, 1, i + 1, i + 1, "terminal", 5, s, True, "kill", s, "P5", a, h) for i, (s, a, h) in enumerate(seq)])
    r = timeline.momentum(match(spark, ev)).first()
    assert (r.away_points, r.home_points, r.ties, r.lead_changes, r.away_run, r.home_run, r.winner) == (3, 4, 1, 1, 2, 4, "home")


def test_sentences(spark):
    ev = events(
        (1, "serve", 1, A), (1, "set", 2, B), (1, "attack", 3, B), (1, "terminal", 3, B, "kill", B), (2, "serve", 3, B), (2, "attack", 1, A), (2, "terminal", 3, B, "block", B),
        (3, "serve", 1, A), (3, "attack", 3, B), (3, "block", 1, A), (3, "terminal", 3, B, "attack_error", A), (4, "terminal", 1, A, "service_error", B), (5, "terminal", None, B, "set_error", A))
    said = [s for _, s in sorted(rows(timeline.scored_points(match(spark, ev)), "rally_number", "description"))]
    assert said == ["Kill by P3 (from P2)", "Attack error by P1 (block by P3)", "Attack error by P3 (block by P1)", "Service error", "Set error"]
