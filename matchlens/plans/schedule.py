"""Schedules, scoreboards, broadcasts and live overlays."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchlens.operators import broadcasts, loads, schedule
from matchlens.plans.catalog import query, shared
from matchlens.plans.text import _answers  # noqa: F401
from matchlens.sources.staged import CHANNELS

TODAY, BACK, AHEAD = "1998-07-01", 1200, 1200

_pair = lambda a, b: f"case when {a} is null or {b} is null then null else concat(least({a}, {b}), ':', greatest({a}, {b})) end"
_prev = lambda d: f"strftime(cast({d} as date) - interval 1 day, '%Y-%m-%d')"
_labels = (
    ("ESPN+", "espn-plus"), ("ESPN2", "espn2"), ("ESPNU", "espnu"), ("ESPN/ESPN+", "espn"), ("ESPN", "espn"), (None, None), ("ACC Network Extra", "accnx"), ("ACC Network", "accn"),
    ("SEC Network+", "secn-plus"), ("SEC Network", "secn"), ("Big Ten Network", "btn"), ("B1G+", "b1g-plus"), ("FS1", "fs1"), ("FOX Sports", None), ("FOX", "fox"), ("CBS", "cbs"),
    ("CBS Sports Network", None), (None, None), ("Web stream", None), (None, None), ("CW", None), ("Peacock", "peacock"), ("MW+", "mw-plus"), ("FloSports", "flosports"), (None, None), ("YouTube", "youtube"))
_lit = lambda v: "null" if v is None else f"'{v}'"
_rows = ", ".join(f"({i}, {_lit(a)}, {_lit(b)})" for i, (a, b) in enumerate(_labels))

shared(
    o_games=f"""select contest_id, season, date, substr(date, 1, 10) as day, ncaa_game_id, home_team_id, away_team_id, {_pair('home_team_id', 'away_team_id')} as pair, date like '____-__-__ 01:00' as late,
        home_sets_won, away_sets_won, attendance from contests""",
    o_listed=f"""select s.*, {_pair('team_id', 'opponent_team_id')} as pair, substr(date, 1, 10) as day, coalesce({_pair('team_id', 'opponent_team_id')}, concat(team_id, '|', opponent_name)) as key
        from schedule s where result_raw is null""",
    o_open=f"""select * from o_listed l where not exists (select 1 from o_games g where g.season = l.season and g.ncaa_game_id = l.ncaa_game_id)
        and not exists (select 1 from o_games g where g.season = l.season and g.pair = l.pair and g.day = l.day)
        and not exists (select 1 from o_games g where g.season = l.season and g.pair = l.pair and g.late and {_prev('case when g.late then g.day end')} = l.day)""",
    o_upcoming="""select season, date, game_time, contest_id, ncaa_game_id, 'upcoming' as status, neutral_location, case when site = 'away' then opponent_team_id else team_id end as home_team_id,
          case when site = 'away' then team_id else opponent_team_id end as away_team_id, case when opponent_team_id is null then opponent_name end as unlisted_opponent
        from (select *, row_number() over (partition by season, date, key order by team_id, coalesce(contest_id, '')) as rn from o_open) x where rn = 1""",
    o_board="""select k.season, k.date, w.week_number, k.contest_id, k.ncaa_game_id, 'played' as status, k.home_team_id, k.away_team_id, k.home_sets_won, k.away_sets_won, k.attendance, null as game_time,
          null as neutral_location, null as unlisted_opponent from contests k left join o_weeks w on w.contest_id = k.contest_id
        union all select season, date, null, contest_id, ncaa_game_id, status, home_team_id, away_team_id, null, null, null, game_time, neutral_location, unlisted_opponent from o_upcoming""",
    o_days_played=f"""select distinct season, day as game_date, least(home_team_id, away_team_id) as a, greatest(home_team_id, away_team_id) as b from o_games where day is not null
        union select season, date, least(team_id, opponent_team_id), greatest(team_id, opponent_team_id) from schedule where opponent_team_id is not null""",
    o_window=f"""select * from o_days_played where game_date between strftime(date '{TODAY}' - interval {BACK} day, '%Y-%m-%d') and strftime(date '{TODAY}' + interval {AHEAD} day, '%Y-%m-%d')""",
    o_listing=f"""select f.season, f.feed_no, f.source_rank, f.date, f.network_raw, f.source, f.is_live, f.start_utc, f.channel_no, l.label as network, l.logo as logo_key,
          least(h.id, a.id) as a, greatest(h.id, a.id) as b from feeds f
        join teams h on replace(lower(h.name), '_', ' ') = replace(regexp_replace(f.team_a, '^#5 ', ''), '_', ' ')
        join teams a on concat('The ', a.name, ' University') = f.team_b
        join (values {_rows}) l(i, label, logo) on l.i = f.feed_no % {len(CHANNELS)} where l.label is not null and h.id <> a.id""",
    o_attached=f"""select l.*, w.game_date from o_listing l join o_window w on w.season = l.season and w.a = l.a and w.b = l.b and abs(cast(w.game_date as date) - cast(l.date as date)) <= 1 where l.date is not null
        union all select l.*, case when u.n = 1 then u.only_day else u.near_day end from o_listing l join (select season, a, b, count(*) as n, min(game_date) as only_day,
          count(*) filter (abs(cast(game_date as date) - date '{TODAY}') <= 1) as near, min(game_date) filter (abs(cast(game_date as date) - date '{TODAY}') <= 1) as near_day from o_window group by all) u
          on u.season = l.season and u.a = l.a and u.b = l.b where l.date is null and (u.n = 1 or (l.is_live and u.near = 1))""",
    o_rows="""select season, game_date, a as team_a_id, b as team_b_id, network, arg_min(source, (source_rank, feed_no)) as source, arg_min(network_raw, (source_rank, feed_no)) as raw_channel, max(logo_key) as logo_key,
          max(is_live) as is_live, case when max(is_live) and not arg_min(is_live, (source_rank, feed_no)) then arg_min(start_utc, (source_rank, feed_no)) filter (is_live) else arg_min(start_utc, (source_rank, feed_no)) end as start_utc,
          arg_min(channel_no, (source_rank, feed_no)) filter (channel_no is not null) as channel_no
        from o_attached group by season, game_date, a, b, network""",
    o_refined="""select * from o_rows r where not (network = 'ESPN/ESPN+' and exists (select 1 from o_rows s where s.season = r.season and s.game_date = r.game_date and s.team_a_id = r.team_a_id and s.team_b_id = r.team_b_id
          and s.network in ('ESPN', 'ESPN2', 'ESPNU', 'ESPN+', 'ESPNews', 'ACC Network Extra', 'SEC Network+', 'ACC Network', 'SEC Network', 'Longhorn Network')))""",
)
_board_cols = ["season", "date", "week_number", "contest_id", "ncaa_game_id", "status", "home_team_id", "away_team_id", "home_sets_won", "away_sets_won", "attendance", "game_time", "neutral_location", "unlisted_opponent"]
_bc_cols = ["season", "game_date", "team_a_id", "team_b_id", "network", "logo_key", "source", "is_live", "raw_channel", "channel_no"]


def _listed(t):
    return broadcasts.listed_broadcasts(t.feeds, t, TODAY, BACK, AHEAD)


def _attached(t):
    from datetime import date, timedelta

    ref = date.fromisoformat(TODAY)
    days = broadcasts.match_days(t, (ref - timedelta(days=BACK)).isoformat(), (ref + timedelta(days=AHEAD)).isoformat())
    return broadcasts.resolve_listings(t.feeds, t), days


query("u2_scoreboard", f"select {', '.join(_board_cols)} from o_board")(lambda t: schedule.scoreboard(t).select(*_board_cols))
query("j12_shifted_day_dedup", "select season, date, contest_id, game_time, home_team_id, away_team_id, unlisted_opponent from o_upcoming")(
    lambda t: schedule.upcoming(t).select("season", "date", "contest_id", "game_time", "home_team_id", "away_team_id", "unlisted_opponent"))
query("u3_team_schedule", """select g.season, g.date, g.contest_id, g.team_id, g.opponent_id, g.site, g.status, g.result, coalesce(o.name, g.opponent_name) as opponent from (
      select season, date, contest_id, home_team_id as team_id, away_team_id as opponent_id, 'home' as site, 'played' as status, null as opponent_name,
        case when home_sets_won is not null and away_sets_won is not null then concat(case when home_sets_won > away_sets_won then 'W ' else 'L ' end, home_sets_won, '-', away_sets_won) end as result from contests
      union all select season, date, contest_id, away_team_id, home_team_id, 'away', 'played', null,
        case when home_sets_won is not null and away_sets_won is not null then concat(case when away_sets_won > home_sets_won then 'W ' else 'L ' end, away_sets_won, '-', home_sets_won) end from contests
      union all select season, date, contest_id, team_id, opponent_team_id, site, 'upcoming', opponent_name, null from schedule s where not exists (
        select 1 from contests k where k.season = s.season and (k.home_team_id = s.team_id or k.away_team_id = s.team_id) and substr(k.date, 1, 10) = substr(s.date, 1, 10))) g
    left join teams o on o.id = g.opponent_id""")(
    lambda t: schedule.team_schedule(t).select("season", "date", "contest_id", "team_id", "opponent_id", "site", "status", "result", "opponent"))
query("u4_games_on_date", f"""select g.season, g.date, status, time, coalesce(h.name, opponent_name) as home, coalesce(a.name, opponent_name) as away, h.avca_rank as home_rank, a.avca_rank as away_rank, score from (
      select season, day as date, 'final' as status, null as time, home_team_id, away_team_id, null as opponent_name, case when home_sets_won is not null and away_sets_won is not null then concat(away_sets_won, '-', home_sets_won) end as score from o_games where day is not null
      union all select season, date, 'scheduled', game_time, case when site = 'away' then opponent_team_id else team_id end, case when site = 'away' then team_id else opponent_team_id end, case when opponent_team_id is null then opponent_name end, null
        from (select *, row_number() over (partition by season, date, key order by team_id, coalesce(contest_id, '')) as rn from o_listed l
          where not exists (select 1 from o_games g where g.season = l.season and g.pair = l.pair and g.day = l.date)) x where rn = 1) g
    left join teams h on h.id = g.home_team_id left join teams a on a.id = g.away_team_id""")(lambda t: schedule.games_on(t))
query("j9_unordered_pair_join", f"""select s.season, s.contest_id as listed, s.team_id, g.contest_id from schedule s join o_games g on g.season = s.season and g.day = s.date and g.pair = {_pair('s.team_id', 's.opponent_team_id')}""")(
    lambda t: t.schedule.select("season", "contest_id", "team_id", "date", schedule.pair_key("team_id", "opponent_team_id").alias("pair")).withColumnRenamed("contest_id", "listed").join(
        t.contests.select("season", "contest_id", schedule.day_of("date").alias("date"), schedule.pair_key("home_team_id", "away_team_id").alias("pair")), ["season", "date", "pair"]).select(
        "season", "listed", "team_id", "contest_id"))
query("j10_day_tolerance_join", "select season, feed_no, network, game_date, a as team_a_id, b as team_b_id from o_attached where date is not null")(
    lambda t: (lambda p: broadcasts.attach_dated(p[0].filter("date is not null"), p[1]))(_attached(t)).select("season", "feed_no", "network", "game_date", "team_a_id", "team_b_id"))
query("j11_undated_listing", "select season, feed_no, network, game_date, a as team_a_id, b as team_b_id from o_attached where date is null")(
    lambda t: (lambda p: broadcasts.attach_undated(p[0].filter("date is null"), p[1], TODAY))(_attached(t)).select("season", "feed_no", "network", "game_date", "team_a_id", "team_b_id"))
query("u6_one_row_per_network", f"select {', '.join(_bc_cols)}, strftime(start_utc, '%Y-%m-%d %H:%M') as starts from o_rows")(
    lambda t: (lambda p: broadcasts.one_per_network(broadcasts.attach_dated(p[0].filter("date is not null"), p[1]).unionByName(
        broadcasts.attach_undated(p[0].filter("date is null"), p[1], TODAY), allowMissingColumns=True)))(_attached(t)).withColumn("starts", F.date_format("start_utc", "yyyy-MM-dd HH:mm")).select(*_bc_cols, "starts"))
query("u7_generic_label_dropped", "select season, game_date, team_a_id, team_b_id, network from o_refined")(lambda t: _listed(t).select("season", "game_date", "team_a_id", "team_b_id", "network"))
query("c14_broadcast_ingest", f"select {', '.join(_bc_cols)} from o_refined")(lambda t: _listed(t).select(*_bc_cols))
_old = "select season, game_date, team_a_id, team_b_id, network, logo_key, 'old' as source, is_live, raw_channel, channel_no from o_refined where network <> 'ESPN2'"
query("s12_refresh_forward", f"""select * from ({_old}) o where game_date < '{TODAY}' or game_date > strftime(date '{TODAY}' + interval {AHEAD} day, '%Y-%m-%d')
    union all select {', '.join(_bc_cols)} from o_refined where game_date between '{TODAY}' and strftime(date '{TODAY}' + interval {AHEAD} day, '%Y-%m-%d') or network = 'ESPN2'""")(
    lambda t: _refreshed(t).select(*_bc_cols))


def _refreshed(t):
    """Old broadcasts in a versioned table by day, after an ingest."""
    from matchlens.plans.loads import stored

    table = stored(t, _listed(t).filter("network <> 'ESPN2'").withColumn("source", F.lit("old")), ["game_date"])
    broadcasts.refresh_stored_broadcasts(table, t.feeds, t, TODAY, BACK, AHEAD)
    return table.read()



@query("u2_board_with_networks", f"""select b.season, b.date, b.contest_id, b.status, b.home_team_id, b.away_team_id, n.networks from o_board b left join (
    select season, game_date, team_a_id, team_b_id, string_agg(distinct network, ',' order by network) as networks from o_refined group by all) n
    on n.season = b.season and n.game_date = substr(b.date, 1, 10) and n.team_a_id = least(b.home_team_id, b.away_team_id) and n.team_b_id = greatest(b.home_team_id, b.away_team_id)""")
def board_networks(t):
    return schedule.with_broadcasts(schedule.scoreboard(t), _listed(t)).select(
        "season", "date", "contest_id", "status", "home_team_id", "away_team_id", F.array_join("networks", ",").alias("networks"))


def _live(t):
    games = loads.resolve_listed_games(_games(t), t)
    return games


def _games(t):
    return t.listed_games.withColumns({"seonames": F.split("seonames", r"\|"), "name_shorts": F.split("name_shorts", r"\|")})


def _points(t):
    listed = lambda c: F.split(c, r"\|").cast("array<int>").alias(c)
    return t.game_points.select("ncaa_game_id", F.col("at_epoch").alias("at"), listed("home_points"), listed("visit_points"))


shared(
    o_feed="""select g.*, split_part(seonames, '|', 1) as visitor, split_part(seonames, '|', 2) as host from listed_games g where game_state in ('live', 'final')""",
    o_feed_pair="""select date, least(visitor, host) as x, greatest(visitor, host) as y, arg_max(struct_pack(state := game_state, visitor := visitor, home_sets_won := home_sets_won, away_sets_won := away_sets_won, p := current_period, id := ncaa_game_id),
        struct_pack(f := game_state = 'final', n := home_sets_won + away_sets_won, h := home_sets_won, v := visitor, p := current_period, id := ncaa_game_id)) as g from o_feed group by all""",
)
query("c22_live_overlay", """select season, date, contest_id, home_team_id, away_team_id, unlisted_opponent, case when g is null then status when g.state = 'live' then 'live' else 'final_pending' end as status,
    case when g is null then home_sets_won when g.visitor = hs then g.away_sets_won else g.home_sets_won end as home_sets_won,
    case when g is null then away_sets_won when g.visitor = hs then g.home_sets_won else g.away_sets_won end as away_sets_won, case when g.state = 'live' then g.p end as live_period,
    replace(case when g.visitor = hs then p.visit_points else p.home_points end, '|', ',') as home_points, replace(case when g.visitor = hs then p.home_points else p.visit_points end, '|', ',') as away_points
    from (select b.*, replace(lower(h.name), '_', '-') as hs, case when b.status = 'upcoming' then f.g end as g from o_board b left join teams h on h.id = b.home_team_id left join teams a on a.id = b.away_team_id
      left join o_feed_pair f on f.date = substr(b.date, 1, 10) and f.x = least(replace(lower(h.name), '_', '-'), replace(lower(a.name), '_', '-')) and f.y = greatest(replace(lower(h.name), '_', '-'), replace(lower(a.name), '_', '-'))) z
    left join game_points p on p.ncaa_game_id = z.g.id and p.at_epoch = 946684800 + cast(replace(z.g.id, 'n', '') as bigint) * 1800 - 60""")(
    lambda t: schedule.overlay_live(schedule.scoreboard(t).withColumn("ncaa_game_id", F.lit(None).cast("string")), _games(t), t.replace(teams=t.teams.withColumn("short_name", F.col("name"))), _points(t)).select(
        "season", "date", "contest_id", "home_team_id", "away_team_id", "unlisted_opponent", "status", "home_sets_won", "away_sets_won", "live_period",
        F.array_join("set_scores.home", ",").alias("home_points"), F.array_join("set_scores.away", ",").alias("away_points")))

