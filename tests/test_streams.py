"""Streams fed in several batches from one checkpoint."""

import random
from collections import Counter

import pytest
from helpers import rows, tables
from pyspark.sql import functions as F

from matchlens.operators import schedule
from matchlens.sources.versioned import VersionedTable
from matchlens.streaming import jobs, late, ordered

EVENT = "season int, contest_id string, set_number int, seq int, touch_type string, scoring_team_id int, side string, at timestamp"


def feed(spark, tmp_path, parts, stream, each=None):
    """One run per part from one checkpoint; the output after every run."""
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for part in parts:
        part.write.mode("append").parquet(folder)
        jobs.run(stream(spark.readStream.schema(part.schema).parquet(folder)), checkpoint=mark, path=None if each else out, each=each)
        yield None if each else spark.read.parquet(out)


def match(contest="m", sets=(30, 25), start="2026-01-05 18:00:00", seed=1):
    """Events of a match, in order: rallies of a serve, some touches and a point."""
    rng, made, seq = random.Random(seed), [], 0
    for number, rallies in enumerate(sets, 1):
        for _ in range(rallies):
            for touch in ["serve", *["set"] * rng.randint(0, 3), "terminal"]:
                seq += 1
                side = rng.choice(["home", "away"]) if touch == "terminal" else None
                made.append((2026, contest, number, seq, touch, {"home": 1, "away": 2}.get(side), side, start))
    return made


def frame(spark, events):
    return spark.createDataFrame([e[:-1] for e in events], EVENT.rsplit(",", 1)[0]).withColumn("at", F.lit(events[0][-1]).cast("timestamp")) if events else spark.createDataFrame([], EVENT)


def by_hand(events):
    """Rally, score, ties and lead changes after each event."""
    made, number = [], None
    for _, contest, s, seq, touch, _, side, _ in events:
        if s != number:
            number, rally, score, held, ties, changes = s, 0, {"home": 0, "away": 0}, 0, 0, 0
        rally += touch == "serve"
        if side:
            score[side] += 1
            lead = (score["away"] > score["home"]) - (score["away"] < score["home"])
            ties += lead == 0
            changes += lead != 0 and held != 0 and lead != held
            held = lead or held
        made.append((contest, s, seq, rally, score["home"], score["away"], ties, changes))
    return made


COLS = ["contest_id", "set_number", "seq", "rally_number", "home_points", "away_points", "ties", "lead_changes"]


def test_events_out_of_order_over_batches_come_out_once_and_in_order(spark, tmp_path):
    first, second = match(), match("n", (12,), seed=2)
    events = first + second
    random.Random(5).shuffle(events)
    cut = len(events) // 3
    parts = [frame(spark, p) for p in (events[:cut], events[cut : 2 * cut], events[cut : 2 * cut], events[2 * cut :] + events[:5])]
    grown = [sorted(rows(df, *COLS)) for df in feed(spark, tmp_path, parts, ordered.in_order)]
    # What is out stays out, and a batch that is sent again adds nothing.
    assert set(grown[0]) <= set(grown[1]) == set(grown[2]) and len(grown[1]) == len(grown[2])
    assert grown[-1] == sorted(by_hand(first) + by_hand(second))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.filter("after_hole").count() == 0
    assert set(rows(ordered.set_lines(out), *COLS[:2], *COLS[4:])) == {(*r[:2], *r[4:]) for r in last_rows(first, second)}


def last_rows(*matches):
    found = {}
    for events in matches:
        for r in by_hand(events):
            found[r[:2]] = r
    return set(found.values())


def test_a_timer_gives_up_on_a_hole(spark, tmp_path):
    events = match(sets=(3,))
    lost = events[4][3]
    with_hole = [e for e in events if e[3] != lost]
    later = match("later", (1,), start="2026-01-20 18:00:00", seed=9)
    parts = [frame(spark, with_hole), frame(spark, later), frame(spark, match("last", (1,), start="2026-02-20 18:00:00", seed=10))]
    outs = [sorted((r.seq, r.after_hole) for r in df.filter("contest_id = 'm'").collect()) for df in feed(spark, tmp_path, parts, ordered.in_order)]
    assert outs[0] == [(s, False) for s in range(1, lost)]
    # The watermark is three days behind the next match, so the match is closed: the rest comes, marked.
    assert outs[-1] == outs[0] + [(s, True) for s in range(lost + 1, len(events) + 1)]


def test_late_rows_are_marked_and_kept(spark, tmp_path):
    ddl = "k long, day string"
    part = lambda *given: spark.createDataFrame(list(given), ddl).select("k", F.col("day").cast("timestamp").alias("ts"))
    parts = [
        part((1, "2026-01-10"), (2, "2026-01-09"), (2, "2026-01-09")),
        part((2, "2026-01-09"), (3, "2026-01-08"), (4, "2026-01-05"), (5, None)),
        part((6, "2026-01-20"), (1, "2026-01-10")),
        part((1, "2026-01-10"), (7, "2026-01-16"), (8, "2026-01-18"), (6, "2026-01-20")),
    ]
    shape = parts[0].schema
    kept, gaps = (VersionedTable(spark, str(tmp_path / n), shape, ["k"], 4) for n in ("kept", "gaps"))
    list(feed(spark, tmp_path, parts, lambda s: late.marked(s, ["k"], "ts", groups=3), each=jobs.late_sink(kept, gaps)))
    # Four days late, without a time, or a repeat of a row that the window has forgotten.
    assert rows(kept.read(), "k") == [(1,), (2,), (3,), (6,), (8,)]
    assert rows(gaps.read(), "k") == [(1,), (4,), (5,), (7,)]
    jobs.fill_gaps(kept, gaps, ["k"])
    jobs.fill_gaps(kept, gaps, ["k"])
    assert rows(kept.read(), "k") == [(k,) for k in range(1, 9)]


def test_a_late_batch_sent_again_is_stored_once(spark, tmp_path):
    rows_of = lambda *given: spark.createDataFrame(list(given), "k long, late boolean")
    shape = rows_of((1, True)).drop("late").schema
    kept, gaps = (VersionedTable(spark, str(tmp_path / n), shape, ["k"], 2) for n in ("kept", "gaps"))
    for _ in range(2):
        jobs.late_sink(kept, gaps)(rows_of((1, False), (2, True)), 0)
    assert rows(kept.read()) == [(1,)] and rows(gaps.read()) == [(2,)]


TEAMS = (["id", "name", "short_name"], [(1, "Ohio", "Ohio"), (2, "Iowa", "Iowa"), (3, "Utah", "Utah"), (4, "Rice", "Rice")])


def board(spark):
    t = tables(spark, teams=TEAMS)
    rows_ = [("2026-09-08 18:00", "upcoming", "c1", "g1", 1, 2), ("2026-09-08 18:00", "upcoming", "c2", "g2", 3, 4), ("2026-09-08 18:00", "played", "c3", "g3", 1, 3), ("2026-09-08", "upcoming", "c4", None, 2, 3)]
    df = spark.createDataFrame(rows_, "date string, status string, contest_id string, ncaa_game_id string, home_team_id int, away_team_id int")
    old = F.when(F.col("status") == "played", 3)
    return t, df.withColumns({"home_sets_won": old, "away_sets_won": old - 2, "set_scores": F.lit(None).cast("struct<away:array<int>,home:array<int>>"), "live_period": F.lit(None).cast("string")})


def live(spark, *games):
    return spark.createDataFrame(list(games), "ncaa_game_id string, date string, game_state string, seonames array<string>, home_sets_won int, away_sets_won int, current_period string")


POINTS = "ncaa_game_id string, home_points array<int>, visit_points array<int>, at int"


def test_set_scores_are_turned_with_the_sets(spark):
    t, df = board(spark)
    games = live(
        spark, ("g1", "2026-09-08", "live", ["iowa", "ohio"], 2, 1, "4TH SET"), ("g2", "2026-09-08", "final", ["utah", "rice"], 3, 0, "F"),
        ("g3", "2026-09-08", "final", ["utah", "ohio"], 0, 3, "F"), ("g9", "2026-09-08", "live", ["iowa", "utah"], 1, 0, "2ND SET"))
    points = spark.createDataFrame([("g1", [25, 25, 9], [20, 23, 11], 2), ("g1", [25], [20], 1), ("g2", [25, 25, 25], [1, 2, 3], 1), ("g3", [1], [2], 1)], POINTS)
    got = {r.contest_id: r for r in schedule.overlay_live(df, games, t, points).collect()}
    shown = lambda c: (got[c].status, got[c].home_sets_won, got[c].away_sets_won, got[c].set_scores and (got[c].set_scores.home, got[c].set_scores.away))
    assert shown("c1") == ("live", 2, 1, ([25, 25, 9], [20, 23, 11]))
    # Our home side is the feed's visitor: everything is turned round.
    assert shown("c2") == ("final_pending", 0, 3, ([1, 2, 3], [25, 25, 25]))
    assert shown("c3") == ("played", 3, 1, None)
    # Found by its pair, without points: the sets stand alone.
    assert shown("c4") == ("live", 0, 1, None)


def test_rows_without_a_game_are_spread(spark):
    t, df = board(spark)
    many = df.unionByName(df.filter("contest_id = 'c3'").drop("away_team_id").join(spark.range(300).select(F.col("id").cast("int").alias("away_team_id"))))
    points = spark.createDataFrame([("g1", [25], [20], 1)], POINTS)
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        shown = schedule.overlay_live(many, live(spark, ("g1", "2026-09-08", "live", ["iowa", "ohio"], 2, 1, "4TH SET")), t, points)
        got = shown.select("set_scores", F.spark_partition_id().alias("task")).collect()
        assert len(got) == 304 and max(Counter(r.task for r in got).values()) < 150
        assert [r.set_scores.home for r in got if r.set_scores] == [[25]]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_live_scores_join_two_streams(spark, tmp_path):
    at = lambda df: df.withColumn("at", F.timestamp_seconds("at"))
    updates = lambda *given: at(spark.createDataFrame(list(given), "ncaa_game_id string, home_sets_won int, at long"))
    points = lambda *given: at(spark.createDataFrame([(g, h, v, s) for g, h, v, s in given], "ncaa_game_id string, home_points array<int>, visit_points array<int>, at long"))
    shape = updates(("g", 0, 0)).withColumns({"home_points": F.array(F.lit(1)), "visit_points": F.array(F.lit(1)), "points_at": F.col("at")}).schema
    table = VersionedTable(spark, str(tmp_path / "live"), shape, ["ncaa_game_id"], 4)
    u, p = str(tmp_path / "u"), str(tmp_path / "p")
    batches = [
        (updates(("a", 1, 1000)), points(("a", [20], [9], 900))),
        # The newest update of a comes before its points; that of b never gets any; an old one of a is sent again.
        (updates(("a", 2, 2000), ("b", 1, 2000)), points(("a", [20], [9], 900))),
        (updates(("a", 1, 1000)), points(("a", [25, 3], [11, 4], 1950), ("a", [1], [1], 5))),
        (updates(("clock", 0, 9000)), points(("clock", [0], [0], 9000))),
    ]
    for up, line in batches:
        up.write.mode("append").parquet(u)
        line.write.mode("append").parquet(p)
        joined = jobs.latest_score(spark.readStream.schema(up.schema).parquet(u), spark.readStream.schema(line.schema).parquet(p), late="30 minutes")
        order = F.struct("at", F.coalesce("points_at", F.timestamp_seconds(F.lit(0))))
        jobs.run(joined, checkpoint=str(tmp_path / "mark"), each=jobs.newest_sink(table, ["ncaa_game_id"], order))
    assert rows(table.read().filter("ncaa_game_id <> 'clock'"), "ncaa_game_id", "home_sets_won", "home_points", "visit_points") == [("a", 2, [25, 3], [11, 4]), ("b", 1, None, None)]


@pytest.mark.parametrize("order", ["forward", "backward"])
def test_weekly_sums_in_update_mode(spark, tmp_path, order):
    ddl = "ts string, event_type string, value double"
    parts = [spark.createDataFrame([(d, "x", v)], ddl).withColumn("ts", F.col("ts").cast("timestamp")) for d, v in (("2026-01-05", 1.0), ("2026-01-11", 2.0), ("2026-01-12", 4.0))]
    parts = parts if order == "forward" else parts[::-1]
    weeks = lambda s: jobs.weekly(s, "ts", ["event_type"], late="30 days").select(F.date_format("window.start", "yyyy-MM-dd").alias("monday"), "event_type", "n", "total")
    table = VersionedTable(spark, str(tmp_path / "weeks"), spark.createDataFrame([], "monday string, event_type string, n long, total double").schema, ["monday"], 4)
    folder, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    for part in parts:
        part.write.mode("append").parquet(folder)
        jobs.run(weeks(spark.readStream.schema(part.schema).parquet(folder)), checkpoint=mark, mode="update", each=jobs.replace_sink(table, ["monday", "event_type"]))
    assert rows(table.read()) == [("2026-01-05", "x", 2, 3.0), ("2026-01-12", "x", 1, 4.0)]
