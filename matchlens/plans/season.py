"""Season and week queries over box scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchlens.constants import FANTASY_WEIGHTS, LEADER_COMPONENTS
from matchlens.functions import predicates as P
from matchlens.operators import conference, leaderboards, totals, weeks
from matchlens.plans import registry
from matchlens.plans.catalog import query, shared
from matchlens.tables import COUNTERS

_sums = ", ".join(f"sum({c}) as {c}" for c in COUNTERS)
_zero_sums = ", ".join(f"sum(coalesce({c}, 0)) as {c}" for c in COUNTERS)
_rates = """case when total_attacks > 0 then (kills - errors) / total_attacks end as hit_pct,
  block_solos + block_assists as total_blocks, kills / nullif(sp, 0) as kills_per_set,
  assists / nullif(sp, 0) as assists_per_set, aces / nullif(sp, 0) as aces_per_set,
  digs / nullif(sp, 0) as digs_per_set, (block_solos + block_assists) / nullif(sp, 0) as blocks_per_set,
  pts / nullif(sp, 0) as pts_per_set"""
_points = " + ".join(f"{w} * coalesce({s}, 0)" for s, w in FANTASY_WEIGHTS.items())

shared(
    o_season=f"""select player_id, season, max(team_id) as team_id, count(distinct contest_id) as gp, sum(sets) as sp, {_sums}
        from player_game_stats group by player_id, season""",
    o_season_rates=f"select *, {_rates} from o_season",
    o_raw_days="""select contest_id, season, date as raw_date from contests
        union all select null, season, date from schedule""",
    o_days="""select contest_id, season,
          case when regexp_matches(raw_date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') then cast(substr(raw_date, 1, 10) as date) end as game_date
        from o_raw_days""",
    o_weeks="""select contest_id, season, game_date, cast(date_trunc('week', game_date) as date) as week_monday,
          cast(datediff('day', min(cast(date_trunc('week', game_date) as date)) over (partition by season), cast(date_trunc('week', game_date) as date)) / 7 as int) + 1 as week_number
        from o_days""",
    o_week=f"""select player_id, p.season, week_number, count(distinct p.contest_id) as gp, sum(coalesce(sets, 0)) as sp, {_zero_sums}
        from player_game_stats p join o_weeks w on w.contest_id = p.contest_id group by player_id, p.season, week_number""",
    o_week_rates=f"select *, {_rates.replace('case when total_attacks > 0 then', 'case when total_attacks <> 0 then')} from o_week",
    o_roster="""select p.id as player_id, p.season, p.team_id, p.ncaa_player_id, p.name, p.number, p.position, p.class_year, p.height_inches, p.hometown,
          p.high_school, t.name as team, t.short_name as team_short, c.id as conference_id, c.name as conference, c.short_name as conference_short
        from players p left join teams t on t.id = p.team_id
        left join team_season_ids s on s.team_id = t.id and s.season = p.season
        left join conferences c on c.id = coalesce(s.conference_id, t.conference_id)""",
    o_team_season="""select s.team_id, s.season, t.name as team, t.short_name as team_short, t.rpi_rank, t.rpi_record, t.avca_rank,
          c.id as conference_id, c.name as conference, c.short_name as conference_short
        from team_season_ids s join teams t on t.id = s.team_id
        left join conferences c on c.id = coalesce(s.conference_id, t.conference_id)""",
)


def _top(body: str, by: str, order: str, limit: int, cols: str) -> str:
    return f"""select {cols} from (select *, row_number() over (partition by {by} order by {order}) as rank from ({body}) x) y
        where rank <= {limit}"""


@query("a1_season_cumulative", """select player_id, season, team_id, gp, sp, kills, errors, total_attacks, assists, aces, serr, digs, retatt,
    rerr, block_solos, block_assists, berr, pts, bhe, total_blocks, round(hit_pct, 6) as hit_pct, round(kills_per_set, 6) as kills_per_set,
    round(assists_per_set, 6) as assists_per_set, round(aces_per_set, 6) as aces_per_set, round(digs_per_set, 6) as digs_per_set,
    round(blocks_per_set, 6) as blocks_per_set, round(pts_per_set, 6) as pts_per_set from o_season_rates""")
def a1(t):
    df = totals.season_totals(t.player_game_stats)
    return df.withColumns({c: F.round(c, 6) for c in ("hit_pct", *totals.RATES)})


@query("s5_season_scan", "select contest_id, season, home_team_id, away_team_id from contests where season = 1998")
def s5(t):
    from matchlens.tables import one_season

    return one_season(t.contests, 1998).select("contest_id", "season", "home_team_id", "away_team_id")


@query("j1_season_conference", "select * from o_team_season")
def j1(t):
    return conference.team_seasons(t)


@query("j8_conferences_present", """select distinct season, conference_id as id, conference as name, conference_short as short_name
    from o_team_season where conference_id is not null""")
def j8(t):
    return conference.conferences_in_season(t)


@query("w1_contest_weeks", """select contest_id, season, game_date, cast(date_trunc('week', game_date) as date) as week_monday,
    cast(datediff('day', min(cast(date_trunc('week', game_date) as date)) over (partition by season), cast(date_trunc('week', game_date) as date)) / 7 as int) + 1 as week_number
    from (select contest_id, season, case when regexp_matches(date, '^[0-9]{4}-') then cast(substr(date, 1, 10) as date) end as game_date from contests) d""")
def w1(t):
    return weeks.played_weeks(t)


@query("w2_weeks_with_schedule", "select contest_id, season, game_date, week_monday, week_number from o_weeks")
def w2(t):
    return weeks.contest_weeks(t)


@query("u1_contests_and_schedule", "select contest_id, season, raw_date from o_raw_days")
def u1(t):
    return t.contests.select("contest_id", "season", F.col("date").alias("raw_date")).unionByName(
        t.schedule.select(F.lit(None).cast("string").alias("contest_id"), "season", F.col("date").alias("raw_date"))
    )


@query("a12_weeks_list", """select season, week_number, min(week_monday) as start, count(contest_id) as contest_count,
    cast(min(week_monday) + interval 6 day as date) as "end" from o_weeks group by season, week_number""")
def a12(t):
    return weeks.list_weeks(t)


@query("a13_seasons", "select distinct season from contests")
def a13(t):
    return weeks.list_seasons(t)


_week_round = ", ".join(f"round({c}, 6) as {c}" for c in ("hit_pct", *totals.RATES))


@query("a2_week_totals", f"""select player_id, season, week_number, gp, sp, {', '.join(COUNTERS)}, total_blocks, {_week_round} from o_week_rates""")
def a2(t):
    df = totals.week_totals(t)
    return df.withColumns({c: F.round(c, 6) for c in ("hit_pct", *totals.RATES)})


_leader_cols = "rank, player_id, name, team_id, team, conference, position, class_year, height_inches, gp as games, sp as sets, round(value, 6) as value, " + ", ".join(
    f"round({c}, 6) as c_{c}" for c in LEADER_COMPONENTS)


def _rounded_leaders(df):
    return df.withColumns({c: F.round(c, 6) for c in ("value", *[f"c_{x}" for x in LEADER_COMPONENTS])})


def _season_leaders(stat: str, where: str = "true", limit: int = 50) -> str:
    body = f"""select s.* exclude (team_id), s.{stat} as value, r.* exclude (player_id, season) from o_season_rates s
        join o_roster r on r.player_id = s.player_id and r.season = s.season where {where}"""
    return _top(body, "season", "value desc nulls last, player_id", limit, "season, " + _leader_cols)


@query("a3_season_leaderboard", _season_leaders("kills"))
def a3(t):
    return _rounded_leaders(leaderboards.player_leaderboard(t, "kills"))


@query("a3_hit_pct_leaderboard_floor", _season_leaders("hit_pct", "s.total_attacks >= 60 and s.sp >= 6 and r.position like '%S%'"))
def a3b(t):
    return _rounded_leaders(leaderboards.player_leaderboard(t, "hit_pct", min_attacks=60, min_sets=6, position="S"))


@query("a2_week_leaderboard", _top("""select s.*, s.kills_per_set as value, r.* exclude (player_id, season) from o_week_rates s
    join o_roster r on r.player_id = s.player_id and r.season = s.season""", "season, week_number", "value desc nulls last, player_id", 10,
    "season, week_number, " + _leader_cols))
def a2_board(t):
    return _rounded_leaders(leaderboards.player_leaderboard(t, "kills_per_set", scope="week", limit=10))


@query("f10_week_floor_having", _top("""select s.*, s.hit_pct as value, r.* exclude (player_id, season) from o_week_rates s
    join o_roster r on r.player_id = s.player_id and r.season = s.season where sp >= 5 and total_attacks >= 40""", "season, week_number", "value desc nulls last, player_id", 5,
    "season, week_number, " + _leader_cols))
def f10(t):
    return _rounded_leaders(leaderboards.player_leaderboard(t, "hit_pct", scope="week", min_sets=5, min_attacks=40, limit=5))


@query("k1_offset_page", f"""select season, {_leader_cols} from (select *, row_number() over (partition by season order by value desc nulls last, player_id) as rank
    from (select s.* exclude (team_id), s.aces as value, r.* exclude (player_id, season) from o_season_rates s
    join o_roster r on r.player_id = s.player_id and r.season = s.season) x) y where rank > 20 and rank <= 40""")
def k1(t):
    return _rounded_leaders(leaderboards.player_leaderboard(t, "aces", limit=20, offset=20))


@query("k2_ascending_nulls_last", _top("""select s.* exclude (team_id), s.serr as value, r.* exclude (player_id, season) from o_season_rates s
    join o_roster r on r.player_id = s.player_id and r.season = s.season""", "season", "value asc nulls last, player_id", 100,
    "season, rank, player_id, name as player, team, conference, class_year, position, hometown, high_school, gp as games, sp as sets, retatt as receptions, rerr as reception_errors, 'serr' as stat, value"))
def k2(t):
    return registry.call("leaderboard", t, stat="serr", order="asc", limit=500)


_tool_cols = "season, rank, player_id, name as player, team, conference, class_year, position, hometown, high_school, gp as games, sp as sets, retatt as receptions, rerr as reception_errors, '{stat}' as stat, value"


def _tool(stat: str, expr: str, where: str, limit: int = 25) -> str:
    return _top(f"""select s.* exclude (team_id), {expr} as value, r.* exclude (player_id, season) from o_season_rates s
        join o_roster r on r.player_id = s.player_id and r.season = s.season where {where}""", "season",
        "value desc nulls last, player_id", limit, _tool_cols.replace("{stat}", stat))


@query("c1_leaderboard_tool", _tool("digs", "s.digs", "class_year like '%Fr%' and (position = 'S' or position = 'DS') is not null and list_contains(string_split(position, '/'), 'DS') and sp >= 3"))
def c1(t):
    return leaderboards.leaderboard(t, "digs", class_year="freshman", position="defensive specialist", min_sets=3)


@query("f15_rec_net_leaderboard", _tool("rec_net", "coalesce(s.retatt, 0) - coalesce(s.rerr, 0)", "true"))
def f15(t):
    return leaderboards.leaderboard(t, "rec_net")


def _who(where: str) -> str:
    return f"select player_id, season, name, position, class_year, hometown, height_inches, conference from o_roster where {where}"


def _pick(keep):
    return lambda t: leaderboards.roster(t).filter(keep()).select(
        "player_id", "season", "name", "position", "class_year", "hometown", "height_inches", "conference")


_us = "('" + "','".join(P.DOMESTIC_TAILS) + "')"
query("f1_fall_season", """select o_orderkey, cast(case when month(o_orderdate) >= 8 then year(o_orderdate) else year(o_orderdate) - 1 end as int) as fall_season from orders""")(
    lambda t: t.orders.select("o_orderkey", P.fall_season(F.col("o_orderdate")).alias("fall_season")))
query("f2_name_contains", _who("contains(lower(name), 'widget') or contains(lower(team), 'nation_1')"))(_pick(lambda: P.contains("name", "Widget") | P.contains("team", "Nation_1")))
query("f3_position_token", _who("list_contains(string_split(upper(position), '/'), 'S')"))(_pick(lambda: P.plays_position("setter")))
query("f4_position_substring", _who("contains(lower(position), 's')"))(_pick(lambda: P.position_like("S")))
query("f5_class_year", _who("class_year like '%So%'"))(_pick(lambda: P.in_class("sophomore")))
query("f6_conference", _who("lower(conference) like '%eur%' or lower(conference_short) like '%eur%'"))(_pick(lambda: P.in_conference("eur")))
query("f7_state", _who("lower(hometown) like '%, in'"))(_pick(lambda: P.from_state("Indiana")))
query("f8_domestic", _who(f"upper(list_extract(string_split(hometown, ', '), -1)) in {_us}"))(_pick(lambda: P.is_domestic()))
query("f8_international", _who(f"hometown is not null and upper(list_extract(string_split(hometown, ', '), -1)) not in {_us}"))(_pick(lambda: P.is_international()))
query("f8_country", _who("lower(hometown) like '%, serbia'"))(_pick(lambda: P.from_country("Serbia")))
query("f9_height_range", _who("height_inches between 70 and 74"))(_pick(lambda: P.height_between(70, 74)))
query("f11_date_window", "select contest_id, date from contests where substr(date, 1, 10) between '1996-03-01' and '1996-09-30' and date <> 'TBD-not-a-date'")(
    lambda t: t.contests.filter(P.within_days("date", "1996-03-01", "1996-09-30")).select("contest_id", "date"))
query("f12_date_prefix", "select contest_id, date from contests where date like '1997-05-%'")(
    lambda t: t.contests.filter(F.col("date").startswith("1997-05-")).select("contest_id", "date"))
query("f13_week_filter", "select contest_id, season, week_number from o_weeks where week_number = 3 and contest_id is not null")(
    lambda t: weeks.contest_weeks(t).filter("week_number = 3 and contest_id is not null").select("contest_id", "season", "week_number"))
query("f16_alias_search", "select id, name from teams where contains(lower(array_to_string(aliases, '|')), 'sch. 1')")(
    lambda t: t.teams.filter(F.exists("aliases", lambda x: P.contains(x, "sch. 1"))).select("id", "name"))


@query("a4_fantasy_season", _top(f"""select s.* exclude (team_id), {_points} as points, r.* exclude (player_id, season) from o_season_rates s
    join o_roster r on r.player_id = s.player_id and r.season = s.season""", "season", "points desc nulls last, player_id", 50,
    "season, rank, player_id, name, team, conference, position, gp as games, sp as sets, round(points, 2) as value"))
def a4(t):
    return leaderboards.fantasy_leaderboard(t)


@query("a4_fantasy_week_weights", _top("""select s.*, 0.5 * coalesce(digs, 0) + 0.25 * coalesce(assists, 0) + coalesce(block_solos, 0) + 0.5 * coalesce(block_assists, 0) + 10 * kills
      - 0.5 * errors - 0.5 * serr - 0.25 * rerr - 0.25 * berr - 0.25 * bhe as points, r.* exclude (player_id, season) from o_week_rates s
    join o_roster r on r.player_id = s.player_id and r.season = s.season""", "season, week_number", "points desc nulls last, player_id", 10,
    "season, week_number, rank, player_id, name, team, conference, position, gp as games, sp as sets, round(points, 2) as value"))
def a4_week(t):
    return leaderboards.fantasy_leaderboard(t, scope="week", limit=10, weights=totals.resolve_weights(kills=99, aces=0))


@query("a5_adaptive_qualifier", """select season, 'hit_pct' as stat, 'attacks' as "by", anchor,
    least(greatest(10, cast(round_even(6.67 * anchor, 0) as int)), cap) as "min"
    from (select season, cast(quantile_disc(gp, 0.75) as int) as anchor, cast(max(total_attacks) as int) as cap from o_season_rates group by season) f""")
def a5(t):
    return leaderboards.adaptive_qualifier(t, "hit_pct")


@query("a5_qualifier_by_position_week", """select season, week_number, position, 'digs_per_set' as stat, 'sets' as "by", anchor,
    least(greatest(3, cast(round_even(2.0 * anchor, 0) as int)), cap) as "min"
    from (select s.season, week_number, position, cast(quantile_disc(gp, 0.75) as int) as anchor, cast(max(sp) as int) as cap from o_week_rates s
      join o_roster r on r.player_id = s.player_id and r.season = s.season group by s.season, week_number, position) f""")
def a5b(t):
    return leaderboards.adaptive_qualifier(t, "digs_per_set", scope="week", by_position=True)


shared(
    o_team_sums=f"""select season, team_id, count(distinct contest_id) as games, {_sums} from player_game_stats group by season, team_id""",
    o_sides="""select season, contest_id, team_id, sum(kills) as k, sum(errors) as e, sum(total_attacks) as ta from player_game_stats group by season, contest_id, team_id""",
    o_faced="""select me.season, me.team_id, count(distinct me.contest_id) as games, sum(o.k) as opp_kills, sum(o.e) as opp_errors, sum(o.ta) as opp_total_attacks
        from o_sides me join o_sides o on o.contest_id = me.contest_id and o.team_id <> me.team_id group by me.season, me.team_id""",
)


@query("a6_team_stats", _top("""select s.* , block_solos + block_assists / 2.0 as total_blocks, (kills - errors) / nullif(total_attacks, 0) as hit_pct, r.team, r.conference
    from o_team_sums s join o_team_season r on r.team_id = s.team_id and r.season = s.season""", "season", "hit_pct desc nulls last, team_id", 25,
    "season, rank, team_id, team, conference, games, kills, assists, aces, digs, total_blocks, pts, errors, total_attacks, round(hit_pct, 3) as hit_pct"))
def a6(t):
    return totals.team_stats(t, sort_by="hit_pct")


@query("a6_team_lines_by_week", f"""select season, week_number, rank, team_id, team, team_short, conference, games, kills, assists, aces, digs, total_blocks, pts, fantasy_points
    from (select *, row_number() over (partition by season, week_number order by fantasy_points desc nulls last, team_id) as rank from (
      select s.*, r.team, r.team_short, r.conference, block_solos + block_assists / 2.0 as total_blocks, round({_points}, 2) as fantasy_points
      from (select p.season, week_number, team_id, count(distinct p.contest_id) as games, {_zero_sums} from player_game_stats p join o_weeks w on w.contest_id = p.contest_id
            group by p.season, week_number, team_id) s join o_team_season r on r.team_id = s.team_id and r.season = s.season) x) y where rank <= 400""")
def a6_week(t):
    return totals.team_stat_lines(t, by_week=True)


@query("a19_team_offense", f"select season, team_id, games, {', '.join(COUNTERS)} from o_team_sums")
def a19(t):
    return totals.team_totals(t)


@query("j4_opponent_line", "select season, team_id, games, opp_kills, opp_errors, opp_total_attacks from o_faced")
def j4(t):
    return totals.team_defense_totals(t)


@query("a7_team_defense", _top("""select s.*, (opp_kills - opp_errors) / nullif(opp_total_attacks, 0) as hit, r.team, r.conference
    from o_faced s join o_team_season r on r.team_id = s.team_id and r.season = s.season where games >= 2""", "season", "hit asc nulls last, team_id", 25,
    "season, rank, team_id, team, conference, games, opp_kills, opp_errors, opp_total_attacks, round(hit, 3) as opp_hit_pct"))
def a7(t):
    return totals.team_defense(t, min_games=2)


@query("k6_game_highs", f"""select g.season, rank, r.name as player, r.team, r.conference, r.position, o.name as opponent, substr(k.date, 1, 10) as date, sets, 'kills' as stat, value
    from (select *, row_number() over (partition by season order by kills desc, contest_id, player_id) as rank, kills as value from player_game_stats where kills is not null) g
    join o_roster r on r.player_id = g.player_id and r.season = g.season
    left join contests k on k.contest_id = g.contest_id
    left join teams o on o.id = case when g.team_id = k.away_team_id then k.home_team_id else k.away_team_id end where rank <= 25""")
def k6(t):
    return leaderboards.game_highs(t)


@query("k6_game_highs_filtered", f"""select g.season, rank, g.name as player, team, conference, position, o.name as opponent, substr(k.date, 1, 10) as date, sets, 'total_blocks' as stat, value
    from (select *, row_number() over (partition by season order by value desc, contest_id, player_id) as rank from (select p.season, p.contest_id, p.player_id, p.team_id as side_id, p.sets, coalesce(block_solos, 0) + coalesce(block_assists, 0) as value,
      r.name, r.team, r.conference, r.position from player_game_stats p
      join o_roster r on r.player_id = p.player_id and r.season = p.season where list_contains(string_split(r.position, '/'), 'OH')) x) g
    left join contests k on k.contest_id = g.contest_id
    left join teams o on o.id = case when g.side_id = k.away_team_id then k.home_team_id else k.away_team_id end where rank <= 10""")
def k6b(t):
    return leaderboards.game_highs(t, "total_blocks", position=P.plays_position("outside"), limit=10)


@query("a15_double_doubles", """select season, rank, player_id, player, team, conference, position, double_doubles, triple_doubles from (
    select g.season, g.player_id, r.name as player, r.team, r.conference, r.position, dd as double_doubles, td as triple_doubles,
      row_number() over (partition by g.season order by dd desc, td desc, g.player_id) as rank
    from (select season, player_id, sum(case when n >= 2 then 1 else 0 end) as dd, sum(case when n >= 3 then 1 else 0 end) as td from (
        select season, player_id, (coalesce(kills, 0) >= 10)::int + (coalesce(assists, 0) >= 10)::int + (coalesce(digs, 0) >= 10)::int + (coalesce(aces, 0) >= 10)::int
          + (coalesce(block_solos, 0) + coalesce(block_assists, 0) >= 10)::int as n from player_game_stats) c group by season, player_id) g
    join o_roster r on r.player_id = g.player_id and r.season = g.season where dd > 0) x where rank <= 25""")
def a15(t):
    return leaderboards.double_doubles(t)


@query("c9_conference_leaders", _season_leaders("pts", "r.conference_id = 2", 50))
def c9(t):
    return _rounded_leaders(leaderboards.player_leaderboard(t, "pts", conference_id=2))


query("w3_leaderboard_rank", """select season, rank, player_id from (select season, player_id, row_number() over (partition by season order by digs desc nulls last, player_id) as rank from o_season) x where rank <= 50""")(
    lambda t: leaderboards.player_leaderboard(t, "digs").select("season", "rank", "player_id"))
query("k3_limit_clamp", """select season, rank, player_id from (select season, player_id, row_number() over (partition by season order by kills desc nulls last, player_id) as rank from o_season) x where rank <= 500""")(
    lambda t: registry.call("player_leaderboard", t, stat="kills", limit=10**6).select("season", "rank", "player_id"))
query("f14_every_rankable_stat", " union all ".join(f"select season, '{s}' as stat, player_id from (select season, player_id, row_number() over (partition by season order by {s} desc nulls last, player_id) as rank from o_season_rates) x where rank = 1" for s in ("pts", "retatt", "digs_per_set")))(
    lambda t: leaderboards.leaderboard(t, "pts", limit=1).select("season", "stat", "player_id").unionByName(leaderboards.leaderboard(t, "retatt", limit=1).select("season", "stat", "player_id")).unionByName(
        leaderboards.leaderboard(t, "digs_per_set", limit=1).select("season", "stat", "player_id")))
