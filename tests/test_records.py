from helpers import rows, tables

from matchlens.operators import asof, conference, records

TEAMS = (["id", "name", "short_name", "conference_id", "rpi_rank", "avca_rank"], [(1, "Team One", "T1", 100, None, None), (2, "Team Two", "T2", 100, 5, 3), (3, "Team Three", "T3", 200, 10, None)])
CONFS = (["id", "name", "short_name"], [(100, "A", "AA"), (200, "B", "BB"), (300, "C", "CC")])
IDS = (["team_id", "season", "ncaa_team_id"], [(i, 2026, str(i)) for i in (1, 2, 3)])
GAMES = (
    ["contest_id", "season", "date", "home_team_id", "away_team_id", "home_sets_won", "away_sets_won"],
    [("g1", 2026, "2026-09-01 18:00", 1, 2, 3, 1), ("g2", 2026, "2026-09-05 18:00", 3, 1, 3, 2), ("g3", 2026, "2026-09-10 18:00", 1, 3, 3, 2), ("g4", 2026, "2026-09-12 18:00", 1, 2, None, None)],
)


def league(spark, **more):
    return tables(spark, **({"teams": TEAMS, "conferences": CONFS, "team_season_ids": IDS, "contests": GAMES} | more))


def test_team_records(spark):
    got = {r.team_id: r for r in records.team_records(league(spark)).collect()}
    one = got[1]
    assert (one.games, one.wins, one.losses, one.sets_won, one.sets_lost, one.set_pct) == (3, 2, 1, 8, 6, 0.571)
    assert (one.conf_wins, one.conf_losses, one.nonconf_wins, one.nonconf_losses) == (1, 0, 1, 1)
    assert (one.opp_wins, one.opp_losses, one.opp_rpi, one.win_streak) == (1, 1, 8.3, 1)
    assert got[3].win_streak == -1


def test_records_at_each_match(spark):
    got = rows(records.records_at(league(spark)).filter("team_id = 1"), "date", "record", "conf_record")
    assert got == [("2026-09-01 18:00", "1-0", "1-0 AA"), ("2026-09-05 18:00", "1-1", "1-0 AA"), ("2026-09-10 18:00", "2-1", "1-0 AA")]


def test_level_match_is_ignored_and_empty_date_sorts_first(spark):
    games = (GAMES[0], [("a", 2026, None, 1, 2, 3, 0), ("b", 2026, "2026-09-02", 1, 2, 2, 2), ("c", 2026, "2026-09-01", 2, 1, 3, 0)])
    got = {r.team_id: r.win_streak for r in records.streaks(league(spark, contests=games)).collect()}
    assert got == {1: -1, 2: 1}


def test_past_season_keeps_its_conference(spark):
    ids = (["team_id", "season", "ncaa_team_id", "conference_id"], [(1, 2025, "x", 300), (1, 2026, "y", None)])
    got = rows(conference.team_seasons(league(spark, team_season_ids=ids)), "season", "conference")
    assert got == [(2025, "C"), (2026, "A")]


def ranks(*snaps):
    return (["season", "as_of", "team_id", "rpi_rank", "avca_rank"], [(2026, __import__("datetime").date.fromisoformat(d), tid, r, a) for d, tid, r, a in snaps])


def test_rank_counts_only_from_its_day(spark):
    before = league(spark, ranking_snapshots=ranks(("2026-08-30", 2, 5, 3)))
    after = league(spark, ranking_snapshots=ranks(("2026-09-02", 2, 5, 3)))
    assert rows(asof.quality_wins(before), "team_id", "opponent_id", "rank_at_time") == [(1, 2, 3)]
    assert rows(asof.quality_wins(after)) == []


def test_newer_snapshot_without_poll_rank_hides_the_older_one(spark):
    t = league(spark, ranking_snapshots=ranks(("2026-08-01", 2, 5, 3), ("2026-08-30", 2, 6, None)))
    assert rows(asof.quality_wins(t)) == []
    assert rows(asof.quality_wins(t, poll="rpi"), "rank_at_time") == [(6,)]


def test_upset_needs_a_worse_ranked_winner(spark):
    t = league(spark, ranking_snapshots=ranks(("2026-08-30", 1, 50, None), ("2026-08-30", 2, 5, 3), ("2026-08-30", 3, 60, None)))
    got = rows(asof.biggest_upsets(t, poll="rpi"), "rank", "winner_id", "loser_id", "gap")
    assert got == [(1, 1, 2, 45), (2, 3, 1, 10)]
