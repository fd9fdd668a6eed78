"""Streaming jobs over several micro-batches from one checkpoint; results equal the batch ones.

Every job is fed batch by batch and stopped in between, as a scheduler would run it: state and progress have to
survive that. Batches come out of order, and some twice.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from matchlens.operators import checks, schedule
from matchlens.plans.catalog import query
from matchlens.sources.versioned import VersionedTable
from matchlens.streaming import jobs, late, ordered


def _fed(t, parts, stream, *, mode="append", each=None):
    """Run ``stream(input)`` once per part, a folder that gets one part more each time; returns the output folder."""
    folder, out, mark = (jobs.fresh_dir(t.spark, n) for n in ("in", "out", "mark"))
    for part in parts:
        part.write.mode("append").parquet(folder)
        made = stream(t.spark.readStream.schema(part.schema).parquet(folder))
        jobs.run(made, checkpoint=mark, mode=mode, path=None if each else out, each=each)
    return out


def _thirds(df, *by):
    """The rows in three parts that have nothing to do with their order, the middle one once more."""
    part = F.pmod(F.xxhash64(*by), F.lit(3))
    a, b, c = (df.filter(part == k) for k in (2, 0, 1))
    return [a, b, b, c]


def _table(t, df, by, buckets=16):
    return VersionedTable(t.spark, jobs.fresh_dir(t.spark, "table"), df.schema, by, buckets)


def _at():
    """Event time as an instant; the test data holds wall-clock times without a zone."""
    return F.col("ts").cast("timestamp").alias("ts")


def _sides(t):
    """Events with the side that scored, and the time they came in: a second each."""
    teams = t.contests.select("contest_id", "season", "home_team_id", "away_team_id")
    scored = F.when(F.col("is_terminal") & (F.col("scoring_team_id") == F.col("home_team_id")), "home").when(
        F.col("is_terminal") & (F.col("scoring_team_id") == F.col("away_team_id")), "away")
    ev = t.pbp_events.select("contest_id", "season", "set_number", "seq", "touch_type", "is_terminal", "scoring_team_id")
    at = F.timestamp_seconds(F.lit(946684800) + F.col("seq")).alias("at")
    return ev.join(teams, ["contest_id", "season"], "left").select(*ordered.KEY, *[c for c in ordered.FIELDS if c != "side"], scored.alias("side"), at)


def _in_order(t):
    out = _fed(t, _thirds(_sides(t), "contest_id", "seq"), ordered.in_order)
    return t.spark.read.parquet(out)


_late = "event_id % 2 = 1 and ts < (select max(ts) from events) - interval 3 day"


def _late_parts(t):
    """Even events; the newest odd ones with repeats of even ones; and last the odd ones that are days late."""
    ev = t.events.select("event_id", "user_id", "event_type", _at())
    odd = F.col("event_id") % 2 == 1
    fresh = F.col("ts") >= ev.agg(F.max("ts")).first()[0] - F.expr("interval 3 days")
    return [ev.filter(~odd), ev.filter(fresh), ev.filter(odd & ~fresh)]


def _marked(t):
    parts = _late_parts(t)
    kept, gaps = (_table(t, parts[0], ["event_id"]) for _ in range(2))
    _fed(t, parts, lambda s: late.marked(s, ["event_id"], "ts", groups=16), each=jobs.late_sink(kept, gaps))
    return kept, gaps


@query("st1_trailing_window_dedup", "select event_id, user_id, event_type from events")
def st1(t):
    """Late rows are in the gap table and the batch job takes them up: nothing is lost and nothing is there twice."""
    kept, gaps = _marked(t)
    jobs.fill_gaps(kept, gaps, ["event_id"])
    return kept.read().select("event_id", "user_id", "event_type")


@query("st1_repeats_within_the_window", "select event_id, user_id, event_type from events")
def st1_window(t):
    ev = t.events.select("event_id", "user_id", "event_type", _at())
    out = _fed(t, [ev.unionByName(ev)], lambda s: jobs.once_within(s, ["event_id"], "ts"))
    return t.spark.read.parquet(out).select("event_id", "user_id", "event_type")


@query("st2_idempotent_ingest", "select contest_id, season, set_number, seq, touch_type from pbp_events")
def st2(t):
    ev = t.pbp_events.select("contest_id", "set_number", "seq", "touch_type", "season")
    table = _table(t, ev, ["contest_id"])
    _fed(t, _thirds(ev, "contest_id", "seq"), lambda s: s, each=jobs.event_sink(table))
    return table.read()


@query("st3_weekly_buckets", """select strftime(date_trunc('week', ts), '%Y-%m-%d') as monday, event_type, count(*) as n, round(sum(value), 4) as total from events group by all""")
def st3(t):
    """Update mode: a batch puts out the weeks it changed, which replace the stored ones."""
    ev = t.events.select(_at(), "event_type", "value")
    monday = F.date_format("window.start", "yyyy-MM-dd").alias("monday")
    weeks = lambda s: jobs.weekly(s, "ts", ["event_type"], late="1000 days").select(monday, "event_type", "n", "total")
    like = t.spark.createDataFrame([], "monday string, event_type string, n long, total double")
    table = _table(t, like, ["monday"])
    a, b, _, c = _thirds(ev, "ts", "event_type", "value")
    _fed(t, [a, b, c], weeks, mode="update", each=jobs.replace_sink(table, ["monday", "event_type"]))
    return table.read().withColumn("total", F.round("total", 4))


def _updates(t):
    """Three updates per game out of order, and points per set for most of them, some minutes before."""
    games = t.listed_games.select("ncaa_game_id", "date", "game_state", F.split("seonames", r"\|").alias("seonames"), "home_sets_won", "away_sets_won", "current_period", F.timestamp_seconds("start_epoch").alias("at"))
    shifted = lambda minutes, sets: games.withColumns({"at": F.col("at") + F.make_dt_interval(mins=F.lit(minutes)), "home_sets_won": sets})
    updates = [shifted(2, F.col("home_sets_won")), shifted(0, F.lit(0)), shifted(1, F.lit(1))]
    listed = lambda c: F.split(c, r"\|").cast("array<int>").alias(c)
    points = t.game_points.select("ncaa_game_id", F.timestamp_seconds("at_epoch").alias("at"), listed("home_points"), listed("visit_points"))
    return updates, [points, points.filter("false"), points]


def live_table(t):
    """Newest score per game with its points per set, kept by a stream–stream join."""
    updates, points = _updates(t)
    like = updates[0].withColumns({"home_points": F.lit(None).cast("array<int>"), "visit_points": F.lit(None).cast("array<int>"), "points_at": F.lit(None).cast("timestamp")})
    table = _table(t, like, ["ncaa_game_id"])
    boards, lines, mark = (jobs.fresh_dir(t.spark, n) for n in ("board", "lines", "mark"))
    # The last batch only moves the clock on, so that updates without points come out too.
    tick = lambda df: df.limit(1).withColumns({"ncaa_game_id": F.lit("clock"), "at": F.lit("2200-01-01").cast("timestamp")})
    for board, line in zip([*updates, tick(updates[0])], [*points, tick(points[0])]):
        board.write.mode("append").parquet(boards)
        line.write.mode("append").parquet(lines)
        read = lambda path, df: t.spark.readStream.schema(df.schema).parquet(path)
        joined = jobs.latest_score(read(boards, board), read(lines, line), late="36500 days")
        order = F.struct("at", F.coalesce("points_at", F.lit("1900-01-01").cast("timestamp")))
        jobs.run(joined, checkpoint=mark, each=jobs.newest_sink(table, ["ncaa_game_id"], order))
    return table


@query("st4_live_overlay", """select b.season, b.contest_id, g.ncaa_game_id, g.game_state, g.home_sets_won, g.away_sets_won, replace(p.home_points, '|', ',') as home_points, replace(p.visit_points, '|', ',') as visit_points
    from o_upcoming b join listed_games g on concat('x', b.contest_id) = replace(g.ncaa_game_id, 'n', 'x') left join game_points p on p.ncaa_game_id = g.ncaa_game_id and p.at_epoch = g.start_epoch - 60
    where g.game_state in ('live', 'final')""")
def st4(t):
    board = schedule.upcoming(t).withColumn("ncaa_game_id", F.concat(F.lit("n"), "contest_id"))
    return jobs.overlay(live_table(t).read(), board).select(
        "season", "contest_id", "ncaa_game_id", "game_state", "home_sets_won", "away_sets_won", F.array_join("home_points", ",").alias("home_points"), F.array_join("visit_points", ",").alias("visit_points"))


@query("st5_running_score", "select season, contest_id, set_number, scoring_team_id, count(*) as points from pbp_events where is_terminal group by all")
def st5(t):
    return ordered.running_points(_in_order(t))


@query("st5_momentum", "select contest_id, set_number, ties, lead_changes from o_momentum")
def st5_momentum(t):
    return ordered.set_lines(_in_order(t)).filter("n > 0").select("contest_id", "set_number", "ties", "lead_changes")


@query("st6_rally_grouping", """select contest_id, season, set_number, seq, cast(sum((touch_type = 'serve')::int) over (partition by contest_id, set_number order by seq) as int) as rally_number from pbp_events""")
def st6(t):
    return _in_order(t).select("contest_id", "season", "set_number", "seq", "rally_number")


@query("st6_bursts", """select user_id, count(*) as n from (select *, sum(new) over (partition by user_id order by ts, event_id) as grp from (
    select *, case when lag(ts) over (partition by user_id order by ts, event_id) is null or ts >= lag(ts) over (partition by user_id order by ts, event_id) + interval 12 hour then 1 else 0 end as new from events) a) b group by user_id, grp""")
def st6_bursts(t):
    """Append mode: a burst comes out when the watermark has passed its end; the last row only moves the clock on."""
    ev = t.events.select("user_id", _at())
    tick = ev.limit(1).select(F.lit(None).cast(dict(ev.dtypes)["user_id"]).alias("user_id"), F.lit("2200-01-01").cast("timestamp").alias("ts"))
    a, b, _, c = _thirds(ev, "user_id", "ts")
    out = _fed(t, [a, b, c, tick], lambda s: jobs.bursts(s, "ts", "user_id", "12 hours", late="1000 days"))
    return t.spark.read.parquet(out).filter("user_id is not null").select("user_id", "n")


@query("st7_late_rows_to_gap_table", f"select event_id, coalesce({_late}, false) as late from events")
def st7(t):
    kept, gaps = _marked(t)
    shown = lambda table, flag: table.read().select("event_id", F.lit(flag).alias("late"))
    # Repeats of rows that the window has forgotten are late as well; they are stored already.
    missing = shown(gaps, True).join(kept.read().select("event_id"), "event_id", "left_anti")
    return shown(kept, False).unionByName(missing)


@query("st8_gaps_to_heal", "select contest_id, season, date from contests k where home_sets_won is not null and date >= '2001-06-30' and date <> 'TBD-not-a-date' and not exists (select 1 from pbp_events e where e.contest_id = k.contest_id)")
def st8(t):
    return checks.missing_pbp(t).filter(jobs.within("date", 30, "2001-07-30") & (F.col("date") != "TBD-not-a-date"))


@query("st9_refresh_forward", """select season, contest_id, case when substr(date, 1, 10) >= '1998-07-01' and date <> 'TBD-not-a-date' then 'new' else 'old' end as source from contests""")
def st9(t):
    rows = t.contests.select("contest_id", F.substring("date", 1, 10).alias("day"), "season")
    feeds = [rows.withColumn("source", F.lit(s)) for s in ("old", "new", "new")]
    table = _table(t, feeds[0], ["day"])
    _fed(t, feeds, lambda s: s, each=jobs.refresh_sink(table, ["contest_id", "day"], "day", "1998-07-01", "2003-12-31"))
    return table.read().select("season", "contest_id", "source")
