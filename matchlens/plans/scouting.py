"""Team metrics, league percentiles, leaders, systems, reports; player and match products."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchlens.constants import METRICS, MIN_DISTRIBUTION_MATCHES
from matchlens.operators import checks, lookups, rally, scouting, totals, weeks
from matchlens.plans.catalog import query, shared
from matchlens.tables import COUNTERS

_keys = [m[0] for m in METRICS]
_spec = ", ".join(f"('{k}', {i}, '{label}', {str(up).lower()}, {str(rate).lower()}, '{cat}', '{kind}', {str(auto).lower()})" for i, (k, label, up, rate, cat, kind, auto) in enumerate(METRICS))
_per = lambda e: f"round(({e}) / nullif(n_sets, 0), 2)"

shared(
    o_bucket="""select p.season, p.contest_id, p.team_id, case when r.position like 'M%' then 'mid' when r.position like 'O%' or r.position like 'R%' then 'pin' end as b,
          coalesce(kills, 0) as k, coalesce(errors, 0) as e, coalesce(total_attacks, 0) as ta, coalesce(aces, 0) as a from player_game_stats p join o_roster r on r.player_id = p.player_id and r.season = p.season""",
    o_two_sided="select contest_id from o_bucket group by contest_id having count(distinct team_id) = 2",
    o_opp_pos="""select b.season, o.team_id, sum(case when b = 'mid' then k else 0 end) as mid_k, sum(case when b = 'mid' then e else 0 end) as mid_e, sum(case when b = 'mid' then ta else 0 end) as mid_ta,
          sum(case when b = 'pin' then k else 0 end) as pin_k, sum(case when b = 'pin' then e else 0 end) as pin_e, sum(case when b = 'pin' then ta else 0 end) as pin_ta, sum(a) as opp_aces
        from o_bucket b join o_two_sided using (contest_id) join (select distinct contest_id, team_id from o_bucket) o on o.contest_id = b.contest_id and o.team_id <> b.team_id group by b.season, o.team_id""",
    o_lines="""select r.season, r.team_id, r.player_id, r.name, r.position, s.sp as sets, s.total_attacks, s.hit_pct, s.kills_per_set, s.blocks_per_set, s.total_blocks, s.assists
        from o_roster r left join o_season_rates s on s.player_id = r.player_id and s.season = r.season""",
    o_middle="""select season, team_id, case when sum(coalesce(total_attacks, 0)) > 0 then round(sum(case when position like 'M%' then coalesce(total_attacks, 0) else 0 end) / sum(coalesce(total_attacks, 0)), 3) end as middle_share
        from o_lines group by season, team_id""",
    o_metric_base="""select s.season, s.team_id, s.games, coalesce(r.sets_won + r.sets_lost, 0) as n_sets, coalesce(s.kills, 0) as k, coalesce(s.errors, 0) as e, coalesce(s.total_attacks, 0) as ta, coalesce(s.assists, 0) as ast,
          coalesce(s.aces, 0) as ace, coalesce(s.digs, 0) as dig, coalesce(block_solos, 0) + coalesce(block_assists, 0) / 2.0 as blk, coalesce(s.pts, 0) as pt, m.middle_share, f.team_id is not null as faced,
          coalesce(f.opp_kills, 0) as ok, coalesce(f.opp_errors, 0) as oe, coalesce(f.opp_total_attacks, 0) as ota, o.opp_aces, o.mid_k, o.mid_e, o.mid_ta, o.pin_k, o.pin_e, o.pin_ta, r.wins, r.losses, r.set_pct,
          coalesce(q.n, 0) as qw, r.opp_wins, r.opp_losses
        from o_team_sums s left join o_records r on r.season = s.season and r.team_id = s.team_id left join o_middle m on m.season = s.season and m.team_id = s.team_id
        left join o_faced f on f.season = s.season and f.team_id = s.team_id left join o_opp_pos o on o.season = s.season and o.team_id = s.team_id
        left join (select season, team_id, count(*) as n from o_quality group by all) q on q.season = s.season and q.team_id = s.team_id""",
    o_metrics=f"""select season, team_id, games, n_sets, round((k - e) / nullif(ta, 0), 3) as hit_pct, {_per('k')} as kills_per_set, {_per('ast')} as assists_per_set, {_per('ace')} as aces_per_set, {_per('dig')} as digs_per_set,
          {_per('blk')} as blocks_per_set, {_per('pt')} as pts_per_set, {_per('e')} as hit_errors_per_set, middle_share, case when faced then round((ok - oe) / nullif(ota, 0), 3) end as opp_hit_pct,
          case when faced then {_per('ok')} end as opp_kills_per_set, {_per('opp_aces')} as opp_aces_per_set, round((mid_k - mid_e) / nullif(mid_ta, 0), 3) as opp_mid_hit_pct, {_per('mid_ta')} as opp_mid_atks_per_set,
          round((pin_k - pin_e) / nullif(pin_ta, 0), 3) as opp_pin_hit_pct, {_per('pin_ta')} as opp_pin_atks_per_set, round(wins / (wins + losses), 3) as win_pct, set_pct, qw::double as quality_wins,
          round(opp_wins / nullif(opp_wins + opp_losses, 0), 3) as sos from o_metric_base""",
    o_long=" union all ".join(f"select season, team_id, games, '{k}' as key, {k} as value from o_metrics where {k} is not null" for k in _keys),
    o_spec=f"select * from (values {_spec}) s(key, no, label, up, rate, cat, kind, auto)",
    o_member=f"select l.*, s.* exclude (key), (not s.rate or games >= {MIN_DISTRIBUTION_MATCHES}) as member from o_long l join o_spec s on s.key = l.key",
    o_standing="""select season, team_id, games, key, value, round(case when up then p else 100 - p end, 1) as pct, round(case when up then z else -z end, 2) as z,
          cast(case when up then n - lo - eq else lo end + 1 as int) as rank, cast(n as int) as n, no, label, cat, kind, auto from (
          select a.*, d.n, d.lo, d.eq, 100.0::double * (d.lo + d.eq / 2.0::double) / d.n as p, case when d.n > 1 and d.sd > 0 then (a.value - d.mean) / d.sd end as z
          from o_member a join lateral (select count(*) as n, count(*) filter (b.value < a.value) as lo, count(*) filter (b.value = a.value) as eq, avg(b.value) as mean, stddev_pop(b.value) as sd
            from o_member b where b.season = a.season and b.key = a.key and b.member) d on true where d.n > 0) x""",
)
query("a20_opponents_by_position", "select season, team_id, mid_k, mid_e, mid_ta, pin_k, pin_e, pin_ta, opp_aces from o_opp_pos")(lambda t: scouting.opponents_by_position(t))
query("j5_two_sided_contests", "select season, team_id, opp_aces from o_opp_pos")(lambda t: scouting.opponents_by_position(t).select("season", "team_id", "opp_aces"))
query("a21_middle_share", "select season, team_id, middle_share from o_middle")(lambda t: scouting.middle_share(t))
query("a22_team_metrics", f"select season, team_id, games, n_sets, {', '.join(_keys)} from o_metrics")(lambda t: scouting.team_metrics(t))
query("w4_league_percentiles", "select season, team_id, key, value, pct, rank, n from o_standing")(lambda t: scouting.league_standing(scouting.team_metrics(t)).select("season", "team_id", "key", "value", "pct", "rank", "n"))
query("w5_z_scores", "select season, team_id, key, z from o_standing")(lambda t: scouting.league_standing(scouting.team_metrics(t)).select("season", "team_id", "key", "z"))
query("k10_insights", """select season, team_id, side, cast(pos as int) as pos, key, label, pct, value, kind from (select *, row_number() over (partition by season, team_id, side order by case when side = 'strength' then -pct else pct end, no) as pos
    from (select *, case when pct >= 85 then 'strength' when pct <= 15 then 'weakness' end as side from o_standing where auto) x where side is not null) y where pos <= 6""")(
    lambda t: scouting.insights(scouting.league_standing(scouting.team_metrics(t))))
shared(
    o_pcts="""select season, team_id, max(pct) filter (key = 'hit_pct') as hit, max(pct) filter (key = 'kills_per_set') as kps, max(pct) filter (key = 'opp_hit_pct') as opp, max(pct) filter (key = 'blocks_per_set') as blk,
        max(pct) filter (key = 'aces_per_set') as ace, max(pct) filter (key = 'win_pct') as win, max(pct) filter (key = 'sos') as sos from o_standing group by season, team_id""",
    o_gap="""select season, team_id, round(round((fbso_kills - fbso_errors)::double / nullif(fbso_attacks, 0), 3) - round((trans_kills - trans_errors)::double / nullif(trans_attacks, 0), 3), 3) as gap from o_phase""",
    o_hitters="""select season, hit_pct as v from o_lines where hit_pct is not null and coalesce(total_attacks, 0) >= 30""",
    o_hitter_pct="""select season, v, round(100.0::double * (sum(n) over (partition by season order by v) - n / 2.0::double) / sum(n) over (partition by season), 1) as pct from (select season, v, count(*) as n from o_hitters group by all) c""",
    o_leaders="""select * from (select season, team_id, 'hitter' as kind, row_number() over (partition by season, team_id order by kills_per_set desc, player_id) as pos, player_id from o_lines where coalesce(total_attacks, 0) >= 30 and kills_per_set is not null) a where pos <= 3
        union all select * from (select season, team_id, 'blocker', row_number() over (partition by season, team_id order by blocks_per_set desc, player_id) as pos, player_id from o_lines where coalesce(sets, 0) >= 10 and blocks_per_set is not null) b where pos <= 2
        union all select * from (select season, team_id, 'middle', row_number() over (partition by season, team_id order by total_attacks desc, player_id) as pos, player_id from o_lines where position like 'M%' and coalesce(total_attacks, 0) > 0) c where pos <= 2""",
    o_setters="""select *, row_number() over (partition by season, team_id order by assists desc, player_id) as pos from o_lines where coalesce(assists, 0) >= 30""",
    o_assists="select season, team_id, sum(coalesce(assists, 0)) as total from o_lines group by season, team_id",
    o_aps="select season, coalesce(total_attacks, 0) / sets as v from o_setters where coalesce(sets, 0) > 0",
)
query("c11_contrast_notes", """select p.season, p.team_id, (greatest(hit, kps) >= 80 and opp <= 30) is true as leaky, (blk >= 80 and hit <= 35) is true as block_first, (ace >= 85) is true as serving, (win >= 80 and sos <= 25) is true as soft, (gap >= 0.1) is true as system
    from o_pcts p left join o_gap g on g.season = p.season and g.team_id = p.team_id""")(
    lambda t: scouting.contrast_notes(scouting.pct_map(scouting.league_standing(scouting.team_metrics(t))), rally.phase_summary(t)).select(
        "season", "team_id", *[F.exists("notes", (lambda w: lambda n: n["text"] == w)(text)).alias(k) for k, (_, text) in scouting.NOTES.items()]))
query("k9_team_leaders", """select l.season, l.team_id, l.kind, cast(l.pos as int) as pos, l.player_id, x.name, x.position, round(x.kills_per_set, 6) as kills_per_set, round(x.blocks_per_set, 6) as blocks_per_set, round(x.hit_pct, 6) as hit_pct,
    x.total_attacks, x.total_blocks, case when l.kind = 'hitter' then h.pct end as nat_pct from o_leaders l join o_lines x on x.season = l.season and x.player_id = l.player_id left join o_hitter_pct h on h.season = l.season and h.v = x.hit_pct""")(
    lambda t: scouting.team_leaders(t).withColumns({c: F.round(c, 6) for c in ("kills_per_set", "blocks_per_set", "hit_pct")}))
query("c13_hitter_distribution", "select season, v as value, pct from o_hitter_pct")(
    lambda t: (lambda h: scouting.percentile_among(h, h, F.floor(F.col("value") * 1000)))(
        scouting.player_lines(t).filter("hit_pct is not null and total_attacks >= 30").select("season", F.col("hit_pct").alias("value"))))
query("a29_setter_system", """select s.season, s.team_id, case when two then '6-2' when share >= 0.6 then '5-1' end as type, case when two then concat(n1, ',', n2) else n1 end as setters, round(share, 3) as top_share, v as attacks_per_set, h1 as setter_hit_pct,
      case when v is not null then round(100.0::double * ((select count(*) from o_aps d where d.season = s.season and d.v < s.v) + (select count(*) from o_aps d where d.season = s.season and d.v = s.v) / 2.0::double)
        / nullif((select count(*) from o_aps d where d.season = s.season), 0), 1) end as attack_pct from (
      select a.season, a.team_id, a.name as n1, b.name as n2, a.assists / t.total as share, b.assists is not null and b.assists / t.total >= 0.3 as two, case when a.sets > 0 then round(coalesce(a.total_attacks, 0) / a.sets, 2) end as v, round(a.hit_pct, 6) as h1
      from o_setters a join o_assists t on t.season = a.season and t.team_id = a.team_id and t.total > 0 left join o_setters b on b.season = a.season and b.team_id = a.team_id and b.pos = 2 where a.pos = 1) s""")(
    lambda t: scouting.setter_system(t).withColumns({"setters": F.array_join("setters", ","), "setter_hit_pct": F.round("setter_hit_pct", 6)}))
query("c10_scouting_report", """select m.season, m.team_id, t.name as team, m.games as matches, m.n_sets as sets, m.games < 4 as low_sample, r.wins, r.losses, r.win_streak, coalesce(p.n, 0) as n_pct, coalesce(i.s, 0) as strengths, coalesce(i.w, 0) as weaknesses,
    coalesce(l.h, 0) as hitters, coalesce(i.sk, '') as strength_keys, coalesce(i.wk, '') as weakness_keys, coalesce(l.hn, '') as hitter_names, coalesce(l.bn, '') as blocker_names, coalesce(l.mn, '') as middle_names, g.gap from o_metrics m left join teams t on t.id = m.team_id left join o_records r on r.season = m.season and r.team_id = m.team_id
    left join (select season, team_id, count(*) as n from o_standing group by all) p on p.season = m.season and p.team_id = m.team_id
    left join (select season, team_id, least(6, count(*) filter (pct >= 85)) as s, least(6, count(*) filter (pct <= 15)) as w, array_to_string(list(key order by -pct, no) filter (pct >= 85)[1:6], ',') as sk,
      array_to_string(list(key order by pct, no) filter (pct <= 15)[1:6], ',') as wk from o_standing where auto group by season, team_id) i on i.season = m.season and i.team_id = m.team_id
    left join (select l.season, l.team_id, count(*) filter (kind = 'hitter') as h, string_agg(name, ',' order by pos) filter (kind = 'hitter') as hn, string_agg(name, ',' order by pos) filter (kind = 'blocker') as bn,
      string_agg(name, ',' order by pos) filter (kind = 'middle') as mn from o_leaders l join o_lines x on x.season = l.season and x.player_id = l.player_id group by l.season, l.team_id) l on l.season = m.season and l.team_id = m.team_id
    left join o_gap g on g.season = m.season and g.team_id = m.team_id where m.games > 0""")(
    lambda t: scouting.scouting_reports(t, prose=False).select(
        "season", "team_id", "team", "matches", "sets", "low_sample", "record.wins", "record.losses", "record.win_streak", F.when(F.col("pct").isNull(), 0).otherwise(F.size("pct")).alias("n_pct"),
        *[F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).alias(c) for c in ("strengths", "weaknesses", "hitters")],
        *[F.coalesce(F.array_join(F.col(c)[f], ","), F.lit("")).alias(n) for c, f, n in (
            ("strengths", "key", "strength_keys"), ("weaknesses", "key", "weakness_keys"), ("hitters", "name", "hitter_names"), ("blockers", "name", "blocker_names"), ("middles", "name", "middle_names"))],
        F.col("phase.in_out_gap").alias("gap")))
query("c12_scouting_prose")(lambda t: scouting.scouting_reports(t).select(
    "season", "team_id", "team", F.array_join("profile", "\n").alias("profile"), F.array_join("keys", "\n").alias("keys")))

# --- players and matches ---------------------------------------------------------------------------
_box = ", ".join(COUNTERS)
query("c3_player_cards", """select r.player_id, r.season, r.name, r.team, r.position, s.gp, s.sp, s.kills, round(s.hit_pct, 6) as hit_pct, cast(g.gs as int) as gs, p.points_played, p.fbso_attacks from o_roster r
    left join o_season_rates s on s.player_id = r.player_id and s.season = r.season left join o_scraped g on g.player_id = r.player_id and g.season = r.season left join o_pbp p on p.player_id = r.player_id and p.season = r.season""")(
    lambda t: lookups.player_cards(t, pbp=rally.season_pbp(t)).select("player_id", "season", "name", "team", "position", "gp", "sp", "kills", F.round("hit_pct", 6).alias("hit_pct"), "gs", "points_played", "fbso_attacks"))
shared(
    o_scraped="""select player_id, season, gp::double as gp, gp - 1.0 as gs, sp, case when player_id % 7 = 0 then kills + 1 else kills end as kills, errors, total_attacks, assists, aces, serr, case when player_id % 5 = 0 then digs + 0.5 else digs end as digs,
          retatt, rerr, block_solos, block_assists, berr, pts, bhe from o_season where player_id % 11 <> 0
        union all select p.id, p.season, null, null, null, null, null, null, null, null, null, null, null, null, null, null, null, null, null from players p
          where p.id % 17 = 0 and not exists (select 1 from o_season s where s.player_id = p.id and s.season = p.season)""",
)
query("c4_player_game_log", f"""select g.player_id, g.season, g.contest_id, k.date, w.week_number, o.name as opponent, g.kills, g.digs, round({' + '.join(f'{v} * coalesce(g.{c}, 0)' for c, v in totals.FANTASY_WEIGHTS.items())}, 2) as fantasy_points,
    p.set_attempts, p.points_played, p.trans_attacks from player_game_stats g left join contests k on k.contest_id = g.contest_id left join o_weeks w on w.contest_id = g.contest_id
    left join teams o on o.id = case when g.team_id = k.away_team_id then k.home_team_id else k.away_team_id end left join o_pbp_match p on p.contest_id = g.contest_id and p.player_id = g.player_id""")(
    lambda t: lookups.game_log(t).select("player_id", "season", "contest_id", "date", "week_number", "opponent", "kills", "digs", "fantasy_points", "set_attempts", "points_played", "trans_attacks"))
query("c5_team_player_table", f"""select r.player_id, r.season, r.team_id, r.name, s.gp as games, s.kills, round({' + '.join(f'{v} * coalesce(s.{c}, 0)' for c, v in totals.FANTASY_WEIGHTS.items())}, 2) as fantasy_points, p.set_attempts, p.fbso_kills
    from o_roster r left join o_season s on s.player_id = r.player_id and s.season = r.season left join o_pbp p on p.player_id = r.player_id and p.season = r.season""")(
    lambda t: lookups.team_player_table(t).select("player_id", "season", "team_id", "name", "games", "kills", "fantasy_points", "set_attempts", "fbso_kills"))
query("c5_team_player_table_week", """select r.player_id, r.season, r.team_id, r.name, w.gp as games, w.kills, w.digs from o_roster r left join (select * from o_week where week_number = 10) w on w.player_id = r.player_id and w.season = r.season""")(
    lambda t: lookups.team_player_table(t, week=10).select("player_id", "season", "team_id", "name", "games", "kills", "digs"))
query("j3_roster_preserving_join", "select r.player_id, r.season, s.kills from o_roster r left join o_season s on s.player_id = r.player_id and s.season = r.season")(
    lambda t: scouting.player_lines(t).select("player_id", "season", "kills"))
query("j2_fact_to_dims", """select p.contest_id, p.player_id, r.name, w.week_number, p.kills from player_game_stats p join o_roster r on r.player_id = p.player_id and r.season = p.season join o_weeks w on w.contest_id = p.contest_id""")(
    lambda t: t.player_game_stats.select("contest_id", "player_id", "season", "kills").join(
        t.players.select(F.col("id").alias("player_id"), "season", "name"), ["player_id", "season"]).join(
        weeks.contest_week_ids(t).select("contest_id", "week_number"), "contest_id").select("contest_id", "player_id", "name", "week_number", "kills"))
query("c2_search", """select season, kind, id, name, rank from (select *, row_number() over (partition by season, kind order by name, id) as rank from (
    select season, 'player' as kind, player_id as id, name from o_roster where contains(lower(name), 'ring') union all select season, 'team', team_id, team from o_team_season where contains(lower(team), 'ring') or contains(lower(team_short), 'ring')) x) y where rank <= 20""")(
    lambda t: lookups.search(t, "Ring"))
query("c2_list_teams", "select t.id, t.name as team, t.short_name, c.name as conference from teams t left join conferences c on c.id = t.conference_id where contains(lower(t.name), '_1') or contains(lower(t.short_name), '_1') or contains(lower(array_to_string(t.aliases, '|')), '_1')")(
    lambda t: lookups.list_teams(t, "_1").drop("aliases"))
query("c23_team_roster", "select player_id, season, team_id, number, name from o_roster")(
    lambda t: lookups.team_rosters(t).select("player_id", "season", "team_id", "number", "name"))
query("c23_contest_list", """select season, contest_id, date, h.name as home, a.name as away, place from (select *, row_number() over (partition by season order by contest_id) as place from contests) x
    left join teams h on h.id = x.home_team_id left join teams a on a.id = x.away_team_id where place <= 200""")(
    lambda t: lookups.list_contests(t).select("season", "contest_id", "date", "home", "away", "place"))
query("c23_contest_list_page", """select season, contest_id, place from (select *, row_number() over (partition by season order by contest_id) as place from contests) x where place > 40 and place <= 70""")(
    lambda t: lookups.list_contests(t, limit=30, offset=40).select("season", "contest_id", "place"))
query("c23_player_game_stats", f"select contest_id, player_id, season, team_id, {_box} from player_game_stats where player_id = 103")(
    lambda t: t.player_game_stats.filter("player_id = 103").select("contest_id", "player_id", "season", "team_id", *COUNTERS))
query("f18_favorite_contests", """select distinct f.user_id, f.season, p.contest_id from favorites f join player_game_stats p on p.player_id = f.entity_id and p.season = f.season where f.entity_type = 'player'""")(lambda t: lookups.favorite_contests(t))
query("f18_favorite_teams", "select distinct f.user_id, f.season, p.team_id from favorites f join players p on p.id = f.entity_id where f.entity_type = 'player'")(lambda t: lookups.favorite_teams(t))
query("a30_signups", """select date, "new", sum("new") over (order by date) as cumulative from (select d.date, count(u.user_id) as "new" from (select cast(unnest(generate_series((select min(cast(created_at as date)) from users), (select max(cast(created_at as date)) from users), interval 1 day)) as date) as date) d
    left join users u on cast(u.created_at as date) = d.date group by d.date) x""")(lambda t: lookups.signups_by_day(t))
query("a31_team_box_totals", f"""select contest_id, team_id, max(sets) as sets, {', '.join(f'sum({c}) as {c}' for c in COUNTERS)}, case when sum(block_solos) is not null or sum(block_assists) is not null then coalesce(sum(block_solos), 0) + coalesce(sum(block_assists), 0) / 2.0 end as team_blocks
    from player_game_stats group by contest_id, team_id""")(lambda t: lookups.box_totals(t))
query("a31_game_leaders", """select contest_id, team_id, category, player_id, value from (select contest_id, team_id, category, player_id, value, row_number() over (partition by contest_id, team_id, category order by value desc, player_id) as rn from (
    select contest_id, team_id, player_id, 'pts' as category, coalesce(pts, 0) as value from player_game_stats union all select contest_id, team_id, player_id, 'kills', coalesce(kills, 0) from player_game_stats
    union all select contest_id, team_id, player_id, 'assists', coalesce(assists, 0) from player_game_stats union all select contest_id, team_id, player_id, 'digs', coalesce(digs, 0) from player_game_stats
    union all select contest_id, team_id, player_id, 'blocks', coalesce(block_solos, 0) + coalesce(block_assists, 0) from player_game_stats) x) y where rn = 1 and value > 0""")(lambda t: lookups.game_leaders(t))

# --- checks ----------------------------------------------------------------------------------------
_cmp = ", ".join(f"('{c}', coalesce(d.{c}, 0), coalesce(s.{c}, 0))" for c in checks.COMPARED)
query("a18_reconcile", f"""select d.player_id, d.season, x.f as field, x.a as derived, x.b as scraped from o_season d join o_scraped s on s.player_id = d.player_id and s.season = d.season,
    lateral (values {_cmp}) x(f, a, b) where abs(x.a - x.b) > 0.4""")(lambda t: checks.reconcile(t, tolerance=0.4))
_any = " or ".join(f"abs(coalesce(d.{c}, 0) - coalesce(s.{c}, 0)) > 0.5" for c in checks.COMPARED)
query("a18_reconcile_summary", f"""select coalesce(d.season, s.season) as season, count(d.player_id) as derived_players, count(s.player_id) as scraped_players, count(*) filter (d.player_id is not null and s.player_id is not null) as compared,
    count(*) filter (d.player_id is not null and s.player_id is not null and not ({_any})) as matching, count(*) filter (d.player_id is not null and s.player_id is not null and ({_any})) as discrepancies,
    count(*) filter (d.player_id is null) as only_scraped, count(*) filter (s.player_id is null) as only_derived from o_season d full outer join o_scraped s on s.player_id = d.player_id and s.season = d.season group by 1""")(
    lambda t: checks.reconcile_summary(t))
query("j21_full_outer_sources", "select coalesce(d.player_id, s.player_id) as player_id, coalesce(d.season, s.season) as season, d.kills as d_kills, s.kills as s_kills from o_season d full outer join o_scraped s on s.player_id = d.player_id and s.season = d.season")(
    lambda t: checks.both_sources(t).select("player_id", "season", "d_kills", "s_kills"))
query("u8_only_in_one_source", """select player_id, season, 'derived' as only_in from o_season d where not exists (select 1 from o_scraped s where s.player_id = d.player_id and s.season = d.season)
    union all select player_id, season, 'scraped' from o_scraped s where not exists (select 1 from o_season d where s.player_id = d.player_id and s.season = d.season)""")(lambda t: checks.only_in_one(t))
query("j7_missing_pbp", "select contest_id, season, date from contests k where home_sets_won is not null and not exists (select 1 from pbp_events e where e.contest_id = k.contest_id)")(lambda t: checks.missing_pbp(t))
query("s17_recent_missing_pbp", "select contest_id, season, date from contests k where home_sets_won is not null and date >= '2000-01-01' and not exists (select 1 from pbp_events e where e.contest_id = k.contest_id)")(lambda t: checks.missing_pbp(t, since="2000-01-01"))
query("s18_unfilled_contests", "select contest_id, season from contests where date is null or home_team_id is null or away_team_id is null or home_sets_won is null or away_sets_won is null")(lambda t: checks.unfilled_contests(t))
