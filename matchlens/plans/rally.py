"""Play-by-play queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchlens.constants import ROTATION_FIELDS
from matchlens.operators import lineups, rally, timeline
from matchlens.plans.catalog import query, shared

_R = "contest_id, set_number, rally_number"
_on = lambda a, b: f"{a}.contest_id = {b}.contest_id and {a}.set_number = {b}.set_number and {a}.rally_number = {b}.rally_number"

shared(
    o_ev="select e.*, k.home_team_id, k.away_team_id from pbp_events e join contests k on k.contest_id = e.contest_id",
    o_term=f"select {_R}, min(seq) as seq, arg_min(terminal_type, seq) as terminal_type, arg_min(scoring_team_id, seq) as scorer, arg_min(team_id, seq) as team_id from pbp_events where is_terminal group by all",
    o_serve=f"select {_R}, arg_min(team_id, seq) as team_id, arg_min(coalesce(player_id, -1), seq) as server, arg_min(coalesce(player_name, ''), seq) as server_name from pbp_events where touch_type = 'serve' group by all",
    o_last=f"select {_R}, team_id, max(seq) as last_attack from pbp_events where touch_type = 'attack' group by all",
    o_feeds=f"""select s.season, s.contest_id, s.set_number, s.rally_number, s.seq, s.team_id, s.player_id, min(a.seq) as atk
        from pbp_events s join pbp_events a on {_on('a', 's')} and a.team_id = s.team_id and a.seq > s.seq and a.touch_type = 'attack'
        where s.touch_type = 'set' and s.player_id is not null group by all""",
    o_fed=f"""select f.*, f.atk = l.last_attack and t.terminal_type = 'kill' and t.scorer = f.team_id as k, f.atk = l.last_attack and t.terminal_type = 'attack_error' and t.team_id = f.team_id as e
        from o_feeds f join o_last l on {_on('l', 'f')} and l.team_id = f.team_id left join o_term t on {_on('t', 'f')}""",
    o_first_ball=f"""select a.contest_id, a.set_number, a.rally_number, min(a.seq) as seq from pbp_events a join o_serve s on {_on('s', 'a')} and a.team_id <> s.team_id where a.touch_type = 'attack' group by all""",
    o_attacks=f"""select a.season, a.contest_id, a.set_number, a.rally_number, a.seq, a.team_id, a.player_id as hitter_id,
          (select arg_max(s.player_id, s.seq) from pbp_events s where {_on('s', 'a')} and s.team_id = a.team_id and s.touch_type = 'set' and s.player_id is not null and s.seq < a.seq) as setter_id,
          case when fb.seq is not null then 'fbso' else 'transition' end as phase,
          coalesce(a.seq = l.last_attack and t.terminal_type = 'kill' and t.scorer = a.team_id, false) as is_kill,
          coalesce(a.seq = l.last_attack and t.terminal_type = 'attack_error' and t.team_id = a.team_id, false) as is_error
        from pbp_events a join o_last l on {_on('l', 'a')} and l.team_id = a.team_id
        left join o_term t on {_on('t', 'a')} left join o_first_ball fb on {_on('fb', 'a')} and fb.seq = a.seq
        where a.touch_type = 'attack' and a.player_id is not null""",
    o_first_event="select season, contest_id, set_number, player_id, arg_min(touch_type, seq) as first_type from pbp_events where player_id is not null group by all",
    o_court="""select p.season, p.contest_id, p.set_number, p.player_id, s.seq,
          coalesce((select arg_max(x.touch_type, x.seq) from pbp_events x where x.contest_id = p.contest_id and x.set_number = p.set_number and x.player_id = p.player_id
              and x.touch_type in ('sub_in', 'sub_out') and x.seq < s.seq), case when first_type = 'sub_in' then 'sub_out' else 'sub_in' end) = 'sub_in' as on_court
        from o_first_event p join pbp_events s on s.contest_id = p.contest_id and s.set_number = p.set_number and s.touch_type = 'serve'""",
    o_pbp_parts="""select season, contest_id, player_id, (touch_type = 'set')::int as sa, (touch_type = 'serve')::int as sv, 0 as hk, 0 as he, 0 as ha, 0 as pp, 0 as fk, 0 as fe, 0 as fa, 0 as tk, 0 as te, 0 as ta
          from pbp_events where player_id is not null and touch_type in ('set', 'serve')
        union all select season, contest_id, player_id, 0, 0, coalesce(k, false)::int, coalesce(e, false)::int, 1, 0, 0, 0, 0, 0, 0, 0 from o_fed
        union all select season, contest_id, player_id, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0 from o_court where on_court
        union all select season, contest_id, hitter_id, 0, 0, 0, 0, 0, 0, (phase = 'fbso' and is_kill)::int, (phase = 'fbso' and is_error)::int, (phase = 'fbso')::int,
          (phase <> 'fbso' and is_kill)::int, (phase <> 'fbso' and is_error)::int, (phase <> 'fbso')::int from o_attacks""",
)
_pbp_sums = """sum(sa) as set_attempts, sum(sv) as serve_attempts, sum(hk) as setter_hit_kills, sum(he) as setter_hit_errors, sum(ha) as setter_hit_attacks, sum(pp) as points_played,
  sum(fk) as fbso_kills, sum(fe) as fbso_errors, sum(fa) as fbso_attacks, sum(tk) as trans_kills, sum(te) as trans_errors, sum(ta) as trans_attacks"""
shared(o_pbp=f"select season, player_id, {_pbp_sums} from o_pbp_parts group by season, player_id",
       o_pbp_match=f"select season, contest_id, player_id, {_pbp_sums} from o_pbp_parts group by season, contest_id, player_id")

query("p1_set_serve_attempts", """select contest_id, player_id, sum((touch_type = 'set')::int) as set_attempts, sum((touch_type = 'serve')::int) as serve_attempts from pbp_events
    where player_id is not null and touch_type in ('set', 'serve') group by all""")(
    lambda t: t.pbp_events.filter("player_id is not null and touch_type in ('set', 'serve')").groupBy("contest_id", "player_id").agg(
        F.count(F.when(F.col("touch_type") == "set", 1)).alias("set_attempts"), F.count(F.when(F.col("touch_type") == "serve", 1)).alias("serve_attempts")))
query("p2_setter_hitting", """select contest_id, player_id, sum(coalesce(k, false)::int) as kills, sum(coalesce(e, false)::int) as errors, count(*) as attacks from o_fed group by all""")(
    lambda t: rally.setter_hitting(t.pbp_events, ["contest_id", "player_id"]))
query("p3_attack_touches", f"select season, {_R}, seq, team_id, hitter_id, setter_id, phase, is_kill, is_error from o_attacks")(lambda t: rally.attack_touches(t.pbp_events))
_phase = ", ".join(f"sum((phase = '{p}' and {c})::int) as {s}_{n}" for p, s in (("fbso", "fbso"), ("transition", "trans")) for c, n in (("is_kill", "kills"), ("is_error", "errors"), ("true", "attacks")))
query("p4_attack_lines_by_setter", f"select contest_id, hitter_id, setter_id, sum(is_kill::int) as kills, sum(is_error::int) as errors, count(*) as total_attacks, {_phase} from o_attacks group by all")(
    lambda t: rally.attack_lines(t.pbp_events, ["contest_id", "hitter_id", "setter_id"]))
query("p5_points_played", "select contest_id, player_id, points_played from o_pbp_match where points_played > 0")(
    lambda t: rally.player_pbp(t.pbp_events, ["contest_id", "player_id"]).filter("points_played > 0").select("contest_id", "player_id", "points_played"))
query("a23_pbp_season_stats", """select p.*, round(case when set_attempts > 0 then assists / set_attempts end, 6) as assist_pct from o_pbp p
    left join o_season s on s.player_id = p.player_id and s.season = p.season""")(lambda t: rally.season_pbp(t).withColumn("assist_pct", F.round("assist_pct", 6)))
query("a24_contest_box", """select g.contest_id, g.player_id, g.season, g.team_id, g.kills, g.assists, g.digs, r.name, r.number, r.position, p.set_attempts, p.serve_attempts, p.setter_hit_attacks,
    p.fbso_kills, p.fbso_errors, p.fbso_attacks, p.trans_kills, p.trans_errors, p.trans_attacks
    from player_game_stats g left join o_roster r on r.player_id = g.player_id and r.season = g.season left join o_pbp_match p on p.contest_id = g.contest_id and p.player_id = g.player_id""")(
    lambda t: rally.contest_box(t).select("contest_id", "player_id", "season", "team_id", "kills", "assists", "digs", "name", "number", "position", "set_attempts", "serve_attempts", "setter_hit_attacks",
                                          "fbso_kills", "fbso_errors", "fbso_attacks", "trans_kills", "trans_errors", "trans_attacks"))
query("a25_team_attack_splits", f"""select a.season, a.hitter_id, r.team_id as roster_team, r.name, r.number, r.position, kills, errors, total_attacks, fbso_kills, fbso_errors, fbso_attacks, trans_kills, trans_errors, trans_attacks
    from (select season, hitter_id, sum(is_kill::int) as kills, sum(is_error::int) as errors, count(*) as total_attacks, {_phase} from o_attacks group by all) a
    join o_roster r on r.player_id = a.hitter_id and r.season = a.season""")(lambda t: rally.team_attack_splits(t))

_rot_sums = ", ".join(f"sum({c}) as {c}" for c in ROTATION_FIELDS)
shared(
    o_rally=f"""select e.season, e.contest_id, e.set_number, e.rally_number, max(home_team_id) as home, max(away_team_id) as away,
          coalesce(max(s.team_id), case when arg_min(e.team_id, e.seq) filter (e.touch_type = 'reception') = max(home_team_id) then max(away_team_id)
            when arg_min(e.team_id, e.seq) filter (e.touch_type = 'reception') is not null then max(home_team_id) end) as serving, max(nullif(s.server, -1)) as server, max(t.scorer) as winner
        from o_ev e left join o_serve s on {_on('s', 'e')} left join o_term t on {_on('t', 'e')} where e.rally_number >= 1 group by e.season, e.contest_id, e.set_number, e.rally_number""",
    o_valid="select *, case when serving = home then away else home end as receiving from o_rally where serving is not null and winner is not null",
    o_side_rally="""select season, contest_id, set_number, rally_number, home as team_id, serving, receiving, winner, server from o_valid
        union all select season, contest_id, set_number, rally_number, away, serving, receiving, winner, server from o_valid""",
    o_slot="""select *, coalesce(sum((receiving = team_id and winner = team_id)::int) over (partition by contest_id, set_number, team_id order by rally_number rows between unbounded preceding and 1 preceding), 0) % 6 as slot from o_side_rally""",
    o_setter="""select contest_id, team_id, player_id as main_setter from (select contest_id, team_id, player_id, row_number() over (partition by contest_id, team_id order by count(*) desc, player_id) as rn
        from pbp_events where touch_type = 'set' and player_id is not null group by contest_id, team_id, player_id) x where rn = 1""",
    o_anchor="""select contest_id, set_number, team_id, slot as anchor from (select s.contest_id, s.set_number, s.team_id, slot, row_number() over (partition by s.contest_id, s.set_number, s.team_id order by count(*) desc, slot) as rn
        from o_slot s join o_setter m on m.contest_id = s.contest_id and m.team_id = s.team_id and m.main_setter = s.server where serving = s.team_id group by s.contest_id, s.set_number, s.team_id, slot) x where rn = 1""",
    o_swing=f"""select {_R}, team_id, sum((touch_type = 'attack' and not is_terminal)::int) as attack_attempts, sum((is_terminal and terminal_type = 'kill')::int) as kills,
        sum((is_terminal and terminal_type = 'attack_error')::int) as attack_errors from pbp_events group by all""",
    o_cell=f"""select s.season, s.contest_id, s.set_number, s.team_id, (slot - coalesce(anchor, 0) + 6) % 6 + 1 as rotation, (serving = s.team_id)::int as serve_rallies, (serving = s.team_id and winner = s.team_id)::int as serve_won,
          (serving <> s.team_id)::int as recv_rallies, (serving <> s.team_id and winner = s.team_id)::int as recv_won, (winner = s.team_id)::int as points_won, (winner <> s.team_id)::int as points_lost,
          coalesce(w.kills, 0) as kills, coalesce(w.attack_errors, 0) as attack_errors, coalesce(w.attack_attempts, 0) as attack_attempts
        from o_slot s left join o_anchor a on a.contest_id = s.contest_id and a.set_number = s.set_number and a.team_id = s.team_id
        left join o_swing w on {_on('w', 's')} and w.team_id = s.team_id
        union all select distinct season, contest_id, set_number, team_id, r, 0, 0, 0, 0, 0, 0, 0, 0, 0 from o_slot, range(1, 7) q(r)""",
    o_rot=f"select season, contest_id, set_number, team_id, cast(rotation as int) as rotation, {_rot_sums} from o_cell group by season, contest_id, set_number, team_id, rotation",
    o_rollup=f"""select m.season, m.team_id, m.n as matches_with_pbp, cast(q.r as int) as rotation, {', '.join(f'coalesce(sum({c}), 0) as {c}' for c in ROTATION_FIELDS)}
        from (select season, team_id, count(*) as n from (select distinct season, contest_id, home_team_id as team_id from o_ev union all select distinct season, contest_id, away_team_id from o_ev) u group by season, team_id) m
        join range(1, 7) q(r) on true left join o_rot o on o.season = m.season and o.team_id = m.team_id and o.rotation = q.r group by m.season, m.team_id, m.n, q.r""",
    o_phase=f"select a.season, r.team_id, {_phase} from o_attacks a join o_roster r on r.player_id = a.hitter_id and r.season = a.season group by a.season, r.team_id",
)
query("p6_rotations", f"select season, contest_id, set_number, team_id, rotation, {', '.join(ROTATION_FIELDS)} from o_rot")(lambda t: rally.rotations(t))
query("p6_rotation_match_totals", f"select contest_id, team_id, rotation, {_rot_sums} from o_rot group by contest_id, team_id, rotation")(lambda t: rally.rotation_totals(t, ["contest_id", "team_id"]))
query("a26_season_rollup", f"select season, team_id, rotation, matches_with_pbp, {', '.join(ROTATION_FIELDS)} from o_rollup")(lambda t: rally.season_rollup(t))
shared(o_rot_table="""select season, team_id, rotation, round(100.0::double * recv_won / nullif(recv_rallies, 0), 1) as sideout_pct, round(100.0::double * serve_won / nullif(serve_rallies, 0), 1) as hold_pct,
    points_won - points_lost as net, recv_rallies, round((kills - attack_errors)::double / nullif(attack_attempts, 0), 3) as hit_pct from o_rollup""")
query("a27_rotation_summary", """select r.*, w.weakest, w.strongest from o_rot_table r left join (select season, team_id, arg_min(rotation, (sideout_pct, rotation)) as weakest, arg_max(rotation, (sideout_pct, -rotation)) as strongest
    from o_rot_table where recv_rallies >= 10 and sideout_pct is not null group by season, team_id) w on w.season = r.season and w.team_id = r.team_id""")(lambda t: rally.rotation_summary(t))
query("a28_phase_summary", """select season, team_id, f as fbso_hit_pct, fbso_attacks, x as trans_hit_pct, trans_attacks, round(f - x, 3) as in_out_gap from (
    select *, round((fbso_kills - fbso_errors)::double / nullif(fbso_attacks, 0), 3) as f, round((trans_kills - trans_errors)::double / nullif(trans_attacks, 0), 3) as x from o_phase) p where f is not null or x is not null""")(
    lambda t: rally.phase_summary(t))

query("p8_kill_assists", f"""select t.contest_id, t.set_number, t.rally_number, s.season, s.team_id, arg_max(coalesce(s.player_id, -1), s.seq) as assist_player_id from o_term t
    join pbp_events s on {_on('s', 't')} and s.touch_type = 'set' and s.team_id = t.scorer where t.terminal_type = 'kill' group by all""")(
    lambda t: timeline.kill_assists(t).withColumn("assist_player_id", F.coalesce("assist_player_id", F.lit(-1).cast("bigint"))))
query("p9_rally_server", f"""select e.season, e.contest_id, e.set_number, e.rally_number, max(s.team_id) as serving_team_id, max(nullif(s.server, -1)) as server_id
    from pbp_events e left join o_serve s on {_on('s', 'e')} group by e.season, e.contest_id, e.set_number, e.rally_number""")(lambda t: timeline.rally_servers(t))
shared(
    o_assist=f"""select t.contest_id, t.set_number, t.rally_number, max(s.team_id) as team_id, arg_max(coalesce(s.player_id, -1), s.seq) as pid, arg_max(coalesce(s.player_name, ''), s.seq) as pname from o_term t
        join pbp_events s on {_on('s', 't')} and s.touch_type = 'set' and s.team_id = t.scorer where t.terminal_type = 'kill' group by t.contest_id, t.set_number, t.rally_number""",
    o_two="select contest_id, set_number, season, 'home' as side, max(home_team_id) as team_id from o_ev group by all union all select contest_id, set_number, season, 'away', max(away_team_id) from o_ev group by all",
)
query("p10_set_aggregates", """select x.season, x.contest_id, x.set_number, x.side, x.team_id, coalesce(set_attempts, 0) as set_attempts, coalesce(serve_attempts, 0) as serve_attempts, coalesce(attack_attempts, 0) as attack_attempts,
    0 as digs, coalesce(receptions, 0) as receptions, coalesce(kills, 0) as kills, coalesce(aces, 0) as aces, coalesce(blocks, 0) as blocks, coalesce(errors, 0) as errors, coalesce(attack_errors, 0) as attack_errors,
    coalesce(set_errors, 0) as set_errors, coalesce(points, 0) as points, coalesce(assists, 0) as assists
    from o_two x left join (select contest_id, set_number, team_id, sum((touch_type = 'set')::int) as set_attempts, sum((touch_type = 'serve')::int) as serve_attempts, sum((touch_type = 'attack')::int) as attack_attempts,
        sum((touch_type = 'reception')::int) as receptions, sum(coalesce(terminal_type = 'kill', false)::int) as kills, sum(coalesce(terminal_type = 'ace', false)::int) as aces, sum(coalesce(terminal_type = 'block', false)::int) as blocks,
        sum(coalesce(terminal_type like '%_error', false)::int) as errors, sum(coalesce(terminal_type = 'attack_error', false)::int) as attack_errors, sum(coalesce(terminal_type = 'set_error', false)::int) as set_errors
      from pbp_events group by contest_id, set_number, team_id) c on c.contest_id = x.contest_id and c.set_number = x.set_number and c.team_id = x.team_id
    left join (select contest_id, set_number, scoring_team_id, count(*) as points from pbp_events where is_terminal group by all) p on p.contest_id = x.contest_id and p.set_number = x.set_number and p.scoring_team_id = x.team_id
    left join (select contest_id, set_number, team_id, count(*) as assists from o_assist group by all) a on a.contest_id = x.contest_id and a.set_number = x.set_number and a.team_id = x.team_id""")(
    lambda t: timeline.side_aggregates(t))
shared(
    o_touch=f"""select {_R}, team_id, arg_max(player_name, seq) filter (touch_type = 'set' and player_name <> '') as last_set, arg_max(player_name, seq) filter (touch_type = 'attack' and player_name <> '') as last_attack
        from pbp_events where not is_terminal and player_name is not null group by all""",
    o_points=f"""select e.season, e.contest_id, e.set_number, e.rally_number, e.seq, e.player_id, e.player_name, e.terminal_type, e.scoring_team_id, e.away_score, e.home_score,
          s.team_id as serving_team_id, nullif(s.server_name, '') as serving_name, nullif(a.pid, -1) as assist_player_id, nullif(a.pname, '') as assist_name,
          case terminal_type
            when 'kill' then concat('Kill', case when e.player_name is not null then concat(' by ', e.player_name) else '' end, case when x.last_set is not null then concat(' (from ', x.last_set, ')') else '' end)
            when 'ace' then concat('Ace', case when e.player_name is not null then concat(' by ', e.player_name) else '' end)
            when 'block' then case when e.player_name is not null and y.last_attack is not null then concat('Attack error by ', y.last_attack, ' (block by ', e.player_name, ')')
               when e.player_name is not null then concat('Block by ', e.player_name) else 'Block' end
            when 'attack_error' then concat('Attack error', case when e.player_name is not null then concat(' by ', e.player_name) else '' end, case when z.last_set is not null then concat(' (from ', z.last_set, ')') else '' end)
            when 'service_error' then 'Service error'
            else concat('Set error', case when e.player_name is not null then concat(' by ', e.player_name) else '' end) end as description
        from o_ev e left join o_serve s on {_on('s', 'e')} left join o_assist a on {_on('a', 'e')}
        left join o_touch x on {_on('x', 'e')} and x.team_id = e.scoring_team_id
        left join o_touch y on {_on('y', 'e')} and y.team_id = case when e.scoring_team_id = e.home_team_id then e.away_team_id else e.home_team_id end
        left join o_touch z on {_on('z', 'e')} and z.team_id = e.team_id
        where e.is_terminal""",
)
_point_cols = ["season", "contest_id", "set_number", "rally_number", "seq", "player_id", "player_name", "terminal_type", "scoring_team_id", "away_score", "home_score", "serving_team_id", "serving_name", "assist_player_id", "assist_name", "description"]
query("p11_scoring_timeline", f"select {', '.join(_point_cols)} from o_points")(lambda t: timeline.scored_points(t).select(*_point_cols))
query("p12_rally_log", """select season, contest_id, set_number, rally_number, seq, concat('S', set_number, ' ', away_score, '-', home_score, ' — ',
    case terminal_type when 'kill' then 'Kill' when 'ace' then 'Ace' when 'block' then 'Block' when 'attack_error' then 'Attack Error' when 'service_error' then 'Service Error' else 'Set Error' end, ' by ',
    coalesce(player_name, t.name), case when assist_name is not null then concat(' (assist ', assist_name, ')') else '' end) as line from o_points p left join teams t on t.id = p.scoring_team_id""")(lambda t: timeline.rally_log(t))
shared(
    o_pt="""select *, case when scoring_team_id = away_team_id then 'away' else 'home' end as side, sign(away_score - home_score) as lead from o_ev where is_terminal""",
    o_pt2="""select *, (select arg_max(b.lead, b.seq) from o_pt b where b.contest_id = a.contest_id and b.set_number = a.set_number and b.seq < a.seq and b.lead <> 0) as held,
        row_number() over (partition by contest_id, set_number order by seq) - row_number() over (partition by contest_id, set_number, side order by seq) as island from o_pt a""",
    o_runs="select contest_id, set_number, side, max(n) as run from (select contest_id, set_number, side, island, count(*) as n from o_pt2 group by all) g group by contest_id, set_number, side",
)
_momentum = """select p.season, p.contest_id, p.set_number, sum((side = 'away')::int) as away_points, sum((side = 'home')::int) as home_points, sum((lead = 0)::int) as ties,
    sum(coalesce(lead <> 0 and lead <> held, false)::int) as lead_changes,
    coalesce((select run from o_runs r where r.contest_id = p.contest_id and r.set_number = p.set_number and r.side = 'away'), 0) as away_run,
    coalesce((select run from o_runs r where r.contest_id = p.contest_id and r.set_number = p.set_number and r.side = 'home'), 0) as home_run,
    """ + ", ".join(f"sum((side = '{w}' and {c})::int) as {w}_{n}" for w in ("away", "home") for n, c in (("kills", "terminal_type = 'kill'"), ("aces", "terminal_type = 'ace'"), ("blocks", "terminal_type = 'block'"), ("opp_errors", "terminal_type like '%_error'"))) + """,
    case when sum((side = 'away')::int) > sum((side = 'home')::int) then 'away' else 'home' end as winner from o_pt2 p group by p.season, p.contest_id, p.set_number"""
shared(o_momentum=_momentum)
query("p12_match_momentum", "select * from o_momentum")(lambda t: timeline.momentum(t))
query("w7_lead_changes", f"select contest_id, set_number, ties, lead_changes from ({_momentum}) m")(lambda t: timeline.momentum(t).select("contest_id", "set_number", "ties", "lead_changes"))
query("w8_biggest_run", "select contest_id, set_number, side, run from o_runs")(lambda t: timeline.momentum(t).select("contest_id", "set_number", F.explode(F.array(
    F.struct(F.lit("away").alias("side"), F.col("away_run").alias("run")), F.struct(F.lit("home").alias("side"), F.col("home_run").alias("run")))).alias("s")).select("contest_id", "set_number", "s.*").filter("run > 0"))
query("p12_scoring_leaders", """select season, contest_id, player_name, player_id, team_id, points, kills, aces, blocks, rank from (select *, row_number() over (partition by contest_id order by points desc, player_name, player_id) as rank from (
    select season, contest_id, player_name, player_id, arg_min(scoring_team_id, (set_number, seq)) as team_id, count(*) as points, sum((terminal_type = 'kill')::int) as kills, sum((terminal_type = 'ace')::int) as aces,
    sum((terminal_type = 'block')::int) as blocks from o_ev where is_terminal and terminal_type in ('kill', 'ace', 'block') and player_name is not null group by season, contest_id, player_name, player_id) g) x where rank <= 6""")(
    lambda t: timeline.scoring_leaders(t))
query("w11_substitution_stoppages", """select season, contest_id, set_number, min(seq) as seq, team_id, string_agg(case when touch_type = 'sub_in' and player_name <> '' then player_name end, '; ' order by seq) as players
    from (select *, sum((touch_type not in ('sub_in', 'sub_out'))::int) over (partition by contest_id, set_number order by seq) as run from pbp_events) e where touch_type in ('sub_in', 'sub_out')
    group by season, contest_id, set_number, run, team_id having players is not null""")(lambda t: timeline.stoppages(t))

shared(
    o_first="""select e.season, e.contest_id, e.set_number, e.team_id, e.player_id, arg_min(touch_type, seq) as kind, arg_min(rally_number, seq) as at_rally, max((touch_type <> 'sub_out')::int) as was_on, arg_min(player_name, seq) as ev_name, max(home_team_id) as home
        from o_ev e where player_id is not null and not contains(coalesce(player_name, ''), ', ') group by e.season, e.contest_id, e.set_number, e.team_id, e.player_id""",
    o_role="""select f.*, case when kind = 'sub_in' and at_rally = 0 and (list_contains(string_split(r.position, '/'), 'L') or list_contains(string_split(r.position, '/'), 'DS')) then 'starter' when kind = 'sub_in' then 'sub'
          when kind = 'sub_out' and (at_rally = 0 or was_on = 1) then 'starter' when kind = 'sub_out' then null else 'starter' end as role
        from o_first f left join o_roster r on r.player_id = f.player_id and r.season = f.season""",
    o_lineup="""select coalesce(f.season, k.season) as season, coalesce(f.contest_id, s.contest_id) as contest_id, coalesce(f.set_number, s.set_number) as set_number, coalesce(f.team_id, s.team_id) as team_id,
          coalesce(f.player_id, s.player_id) as player_id, case when coalesce(f.team_id, s.team_id) = k.home_team_id then 'home' else 'away' end as side,
          case when g.contest_id is not null then case when s.player_id is not null then 'starter' else 'sub' end else role end as role, f.ev_name
        from (select * from o_role where role is not null) f full outer join contest_set_starters s on s.contest_id = f.contest_id and s.set_number = f.set_number and s.team_id = f.team_id and s.player_id = f.player_id
        join contests k on k.contest_id = coalesce(f.contest_id, s.contest_id)
        left join (select distinct contest_id, set_number, team_id from contest_set_starters) g on g.contest_id = coalesce(f.contest_id, s.contest_id) and g.set_number = coalesce(f.set_number, s.set_number) and g.team_id = coalesce(f.team_id, s.team_id)""",
    o_six="select contest_id, season, set_number, team_id, list_sort(list(distinct player_id) filter (role = 'starter')) as six from o_lineup group by all",
)
query("p7_set_lineups", """select l.season, l.contest_id, l.set_number, l.team_id, l.side, l.player_id, coalesce(r.name, l.ev_name) as player, r.position, r.number, l.role from o_lineup l
    left join o_roster r on r.player_id = l.player_id and r.season = l.season""")(lambda t: lineups.set_lineups(t))
query("p7_starter_changes", """select s.season, s.contest_id, s.set_number, s.team_id, f.vs_set, array_to_string(list_sort(list_filter(coalesce(s.six, []), lambda x: not list_contains(coalesce(b.six, []), x))), ',') as added,
    array_to_string(list_sort(list_filter(coalesce(b.six, []), lambda x: not list_contains(coalesce(s.six, []), x))), ',') as removed
    from o_six s join (select contest_id, min(set_number) as vs_set from o_lineup group by all) f on f.contest_id = s.contest_id
    left join o_six b on b.contest_id = s.contest_id and b.team_id = s.team_id and b.set_number = f.vs_set where s.set_number <> f.vs_set and (added <> '' or removed <> '')""")(
    lambda t: lineups.starter_changes(lineups.set_lineups(t)))
query("p13_match_lineups_by_team_and_day", """select l.contest_id, l.set_number, l.team_id, l.player_id, l.role from o_lineup l join contests k on k.contest_id = l.contest_id
    where k.date like '1998-0%' and (k.home_team_id = 7 or k.away_team_id = 7)""")(
    lambda t: lineups.match_lineups(t, 7, "1998-0").select("contest_id", "set_number", "team_id", "player_id", "role"))
query("p12_match_report_by_team_and_day", """select m.contest_id, m.set_number, m.away_points, m.home_points, m.lead_changes from o_momentum m join contests k on k.contest_id = m.contest_id
    where k.date like '1997-%' and (k.home_team_id = 7 or k.away_team_id = 7)""")(
    lambda t: timeline.match_report(t, 7, "1997-").select("contest_id", "set_number", "away_points", "home_points", "lead_changes"))
