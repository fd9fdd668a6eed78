from helpers import rows, tables
from pyspark.sql import functions as F

from matchlens.operators import cumulative, leaderboards, people, totals, weeks

BOX = ["contest_id", "player_id", "team_id", "season", "sets", "kills", "errors", "total_attacks", "aces", "digs", "assists", "block_solos", "block_assists", "serr"]


def test_season_totals_keep_unrecorded_counters_null(spark):
    t = tables(spark, player_game_stats=(BOX, [
        ("a", 1, 9, 2026, 3.0, 10.0, 2.0, 25.0, None, None, None, None, None, None), ("b", 1, 9, 2026, 4.0, 6.0, 4.0, 20.0, None, None, None, None, None, None)]))
    r = totals.season_totals(t.player_game_stats).first()
    assert (r.gp, r.sp, r.kills, r.errors, r.total_attacks, r.hit_pct, r.kills_per_set, r.aces) == (2, 7.0, 16.0, 6.0, 45.0, 10 / 45, 16 / 7, None)


def test_fantasy_points(spark):
    t = tables(spark, player_game_stats=(BOX, [("a", 1, 9, 2026, 3.0, 15.0, 3.0, None, 2.0, 5.0, 1.0, 1.0, 2.0, 1.0), ("a", 2, 9, 2026, *[None] * 10)]))
    points = lambda w: rows(totals.season_totals(t.player_game_stats).withColumn("p", totals.fantasy_points(w)), "player_id", "p")
    assert points(None) == [(1, 20.75), (2, 0.0)]
    assert points(totals.resolve_weights(aces=0)) == [(1, 17.75), (2, 0.0)]
    assert totals.resolve_weights(kills=99)["kills"] == 10.0


def test_weeks_start_on_monday_and_bad_dates_have_none(spark):
    days = ["2101-09-06", "2101-09-06 19:00", "2101-09-13", "2101-09-20", None, "TBD-not-a-date", "2101-02-31"]
    t = tables(spark, contests=(["contest_id", "season", "date"], [(str(i), 2101, d) for i, d in enumerate(days)]))
    assert [w for _, w in rows(weeks.contest_weeks(t), "contest_id", "week_number")] == [1, 1, 2, 3, None, None, None]


def test_qualifier_is_capped_by_the_field(spark):
    t = tables(spark, player_game_stats=(BOX, [("a", i, 9, 2026, 3.0, 1.0, 0.0, float(ta), *[None] * 6) for i, ta in enumerate((30, 20, 5, 4))]))
    get = lambda stat: rows(leaderboards.adaptive_qualifier(t, stat), "by", "anchor", "min")
    assert get("hit_pct") == [("attacks", 1, 10)]
    assert get("kills_per_set") == [("sets", 1, 3)]
    assert leaderboards.adaptive_qualifier(t, "kills") is None


def test_opponents_line_with_three_sides_and_missing_counters(spark):
    t = tables(spark, player_game_stats=(BOX, [
        ("a", 1, 1, 2026, 3.0, 5.0, *[None] * 8), ("a", 2, 2, 2026, 3.0, 7.0, *[None] * 8), ("a", 3, 3, 2026, 3.0, None, *[None] * 8), ("b", 1, 1, 2026, 3.0, 9.0, *[None] * 8)]))
    assert rows(totals.team_defense_totals(t), "team_id", "games", "opp_kills", "opp_errors") == [(1, 1, 7.0, None), (2, 1, 5.0, None), (3, 1, 12.0, None)]


def test_transfer_uses_newest_earlier_season_and_skips_shared_names(spark):
    cols = ["id", "team_id", "season", "name", "hometown", "high_school"]
    t = tables(spark, teams=(["id", "name"], [(1, "One"), (2, "Two"), (3, "Three")]), players=(cols, [
        (10, 1, 2023, "Ann", "X, IN", "H"), (11, 2, 2024, "Ann", "X, IN", "H"), (12, 3, 2026, "Ann", "X, IN", "H"),
        (20, 1, 2025, "Bea", "Y, IN", None), (21, 2, 2025, "Bea", "Y, IN", None), (22, 3, 2026, "Bea", "Y, IN", None), (30, 1, 2025, "Cat", None, None), (31, 2, 2026, "Cat", None, None),
        (40, 1, 2025, "Dee", "Z, IN", "P"), (41, 1, 2026, "Dee", "Z, IN", None)]))
    got = rows(people.transfers(t), "player_id", "transferred", "previous_season", "previous_team_id")
    assert got == [(11, True, 2023, 1), (12, True, 2024, 2), (41, False, None, None)]


def test_season_sums_move_lines_once_and_can_take_back(spark):
    lines = tables(spark, player_game_stats=(BOX, [
        ("a", 1, 9, 2026, 3.0, 10.0, *[None] * 8), ("a", 1, 8, 2026, 1.0, 2.5, *[None] * 8), ("b", 1, 9, 2026, 4.0, None, *[None] * 8)])).player_game_stats
    was = lines.withColumn("times", F.lit(-1))
    now = lines.filter("contest_id = 'a'").withColumn("times", F.lit(1))
    assert rows(cumulative.partial_sums(lines), *cumulative.KEYS, "matches", "sum_sets", "sum_kills", "n_kills", "sum_digs", "n_digs") == [(1, 2026, 9, 2, 8.0, 12.5, 2, 0.0, 0)]
    difference = cumulative.partial_sums(was.unionByName(now), "times")
    assert rows(difference, *cumulative.KEYS, "matches", "sum_sets", "sum_kills", "n_sets", "n_kills") == [(1, 2026, 9, -1, -4.0, 0.0, -1, 0)]
    assert difference._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
