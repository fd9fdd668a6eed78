import pytest
from helpers import rows, tables

from matchlens.operators import broadcasts, entities, loads, schedule
from matchlens.operators.prefix import running_by_chunk
from matchlens.sources import files, merge

TEAMS = (["id", "name", "short_name", "aliases"], [(1, "University of Ohio", "Ohio", None), (2, "Iowa", "Iowa", ["Hawks"]), (3, "San José State", "SJSU", None)])
IDS = (["team_id", "season", "ncaa_team_id"], [(1, 2103, "101"), (2, 2103, "102")])
SCHED = ["Season", "TeamNcaaId", "Date", "Time", "OpponentName", "OpponentNcaaId", "Site", "NeutralLocation", "ResultRaw", "ContestId"]


def staged(spark, *lines):
    return spark.createDataFrame([(2103, "101", d, tm, n, o, "home", None, None, c) for d, tm, n, o, c in lines], files.SCHEDULE_CSV)


def test_schedule_load_is_idempotent_prunes_and_keeps_known_values(spark):
    t = tables(spark, teams=TEAMS, team_season_ids=IDS)
    first = staged(spark, ("2103-09-08", "07:00 PM", "Iowa", "102", "c1"), ("2103-09-12", "12:00 AM", "San José St.", None, None), ("2103-09-15", None, "hawks", None, None))
    once = loads.load_schedule(first, t)
    assert rows(once, "date", "opponent_team_id") == [("2103-09-08", 2), ("2103-09-12", None), ("2103-09-15", 2)]
    assert rows(loads.load_schedule(first, t.replace(schedule=once))) == rows(once)
    later = staged(spark, ("2103-09-08", "12:00 AM", "Iowa", "102", None), ("2103-09-15", None, "hawks", None, None))
    twice = loads.load_schedule(later, t.replace(schedule=once))
    assert rows(twice, "date", "game_time", "contest_id") == [("2103-09-08", "07:00 PM", "c1"), ("2103-09-15", None, None)]


def board(spark, contests, listings):
    t = tables(
        spark, teams=TEAMS, contests=(["contest_id", "season", "date", "home_team_id", "away_team_id", "ncaa_game_id"], contests),
        schedule=(["season", "team_id", "opponent_team_id", "opponent_name", "date", "site", "ncaa_game_id"], listings))
    return rows(schedule.scoreboard(t), "status", "date")


def test_scoreboard_shows_each_match_once(spark):
    both = [(2103, 1, 2, "Iowa", "2103-09-03", "home", "g9"), (2103, 2, 1, "Ohio", "2103-09-03", "away", "g9")]
    assert len(board(spark, [], both)) == 1
    assert board(spark, [("c", 2103, "2103-09-04 18:00", 1, 2, "g9")], both) == [("played", "2103-09-04 18:00")]
    plain = [(*r[:6], None) for r in both]
    assert board(spark, [("c", 2103, "2103-09-04 01:00", 1, 2, None)], plain) == [("played", "2103-09-04 01:00")]
    assert len(board(spark, [("c", 2103, "2103-09-02 18:00", 1, 2, None)], plain)) == 2
    alone = [(2103, 1, None, "Some College", "2103-09-03", "home", None)]
    assert board(spark, [("c", 2103, "2103-09-03 18:00", 1, None, None)], alone) == [("played", "2103-09-03 18:00")]


def test_generic_listing_yields_to_a_specific_one(spark):
    t = tables(spark, teams=TEAMS, contests=(["contest_id", "season", "date", "home_team_id", "away_team_id"], [("c", 2103, "2103-09-03 18:00", 1, 2)]))
    feed = "season int, feed_no int, source_rank int, team_a string, team_b string, date string, network_raw string, source string, is_live boolean, start_utc timestamp, channel_no string"

    def shown(*nets):
        df = spark.createDataFrame([(2103, i, i, "#5 Ohio", "Iowa", "2103-09-04", n, "s", True, None, None) for i, n in enumerate(nets)], feed)
        return [r[0] for r in rows(broadcasts.listed_broadcasts(df, t, "2103-09-03"), "network")]

    assert shown("espn.com", "ESPNU") == ["ESPNU"]
    assert shown("espn.com", "SEC Network") == ["SEC Network"]
    assert shown("espn.com", "BTN") == ["Big Ten Network", "ESPN/ESPN+"]
    assert shown("Disney+ 3") == []


def test_name_tiers(spark):
    roster = spark.createDataFrame([(1, 10, "Ann Lee"), (1, 11, "Zoe Lee"), (1, 12, "Ava Tiessen-Roodbol"), (1, 13, "Gabriela Machin Borges"), (1, 14, "Bella Dearinger")], "team_id int, player_id bigint, name string")
    asked = spark.createDataFrame([(1, n) for n in ("Lee, Ann", "Annie Lee", "Mia Lee", "Ava Roodbol", "Gabriela Machin", "Arabella Dearinger", "Nobody")], "team_id int, name string")
    got = dict(rows(entities.match_names(asked, roster, ["team_id"]), "name", "player_id"))
    assert got == {"Lee, Ann": 10, "Annie Lee": 10, "Mia Lee": None, "Ava Roodbol": 12, "Gabriela Machin": 13, "Arabella Dearinger": 14, "Nobody": None}


def test_conference_diff_infers_renames(spark):
    ours = spark.createDataFrame([("1", "A1", "Alpha"), ("2", "A2", "Alpha"), ("3", "C", "Beta"), ("4", "D", "Beta"), ("5", "E", "Beta"), ("6", "Gone", "Beta")], "outside_id string, team string, conference string")
    theirs = spark.createDataFrame([("1", "x", "The Alpha"), ("2", "x", "The Alpha"), ("3", "x", "The Alpha"), ("4", "x", "Beta"), ("5", "x", "Beta"), ("9", "New", "Beta")], "outside_id string, team string, conference string")
    assert rows(entities.diff_conferences(ours, theirs), "kind", "outside_id") == [("mismatch", "3"), ("missing_here", "9"), ("missing_there", "6")]


def test_append_refuses_other_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    files.append_checked(spark.range(3), path)
    files.append_checked(spark.range(3), path)
    assert spark.read.parquet(path).count() == 6
    with pytest.raises(files.SchemaDrift):
        files.append_checked(spark.range(3).withColumnRenamed("id", "other"), path)


def test_unreadable_csv_lines_are_kept_aside(spark, tmp_path):
    (tmp_path / "a.csv").write_text('ContestID,Seq\n00123,1\n77,x\n')
    got = rows(files.read_csv(spark, str(tmp_path / "a.csv"), "ContestID string, Seq int", "bad"), "ContestID", "Seq", "bad")
    assert got == [("00123", 1, None), ("77", None, "77,x")]


def test_refresh_freezes_the_past(spark):
    old = spark.createDataFrame([("a", "2026-01-01", "old"), ("b", "2026-01-05", "old")], "k string, d string, v string")
    new = spark.createDataFrame([("a", "2026-01-01", "new"), ("c", "2026-01-05", "new")], "k string, d string, v string")
    merged = merge.refresh_forward(old, new, ["k"], "d", "2026-01-03", "2026-01-09")
    assert rows(merged, "k", "v") == [("a", "old"), ("c", "new")]
    assert rows(merge.refresh_forward(merged, new, ["k"], "d", "2026-01-03", "2026-01-09"), "k", "v") == [("a", "old"), ("c", "new")]


def test_running_counts_over_one_hot_key(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.6 else f"k{rng.randint(1, 4)}", i, rng.randint(0, 1)) for i in range(2000)]
    got = running_by_chunk(spark.createDataFrame(data, "k string, o int, x int"), ["k"], F.floor(F.col("o") / 50), ["o"], {"before": "x"}, seq="seq")
    want, seen = {}, {}
    for k, o, x in data:
        n, s = seen.get(k, (0, 0))
        want[(k, o)] = (n + 1, s)
        seen[k] = (n + 1, s + x)
    assert {(r.k, r.o): (r.seq, r.before) for r in got.collect()} == want


def test_backfill_refuses_a_poor_harvest(spark):
    t = tables(spark, teams=TEAMS, team_season_ids=IDS)
    harvest = spark.createDataFrame([("901", "Univ. of Iowa"), ("902", "Ohio"), ("903", "Utah")], "outside_id string, name string")
    with pytest.raises(entities.TooFewMatched):
        entities.backfill(t, harvest, 2104, min_match=3)
    new, report = entities.backfill(t, harvest.replace("Univ. of Iowa", "Hawks"), 2104, min_match=2)
    assert rows(new.team_season_ids, "team_id", "season", "ncaa_team_id") == [(1, 2103, "101"), (1, 2104, "902"), (2, 2103, "102"), (2, 2104, "901")]
    assert rows(report, "kind", "outside_id", "name") == [("unmapped", "903", "Utah"), ("unmatched", None, "San José State")]
