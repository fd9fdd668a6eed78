"""Records, standings, ranks at the time, quality wins and upsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchlens.operators import asof, records
from matchlens.plans.catalog import query, shared

shared(
    o_app="""select season, contest_id, date, home_team_id as team_id, away_team_id as opp_id, home_sets_won as own, away_sets_won as them, home_sets_won > away_sets_won as won
          from contests where home_sets_won <> away_sets_won
        union all select season, contest_id, date, away_team_id, home_team_id, away_sets_won, home_sets_won, away_sets_won > home_sets_won
          from contests where home_sets_won <> away_sets_won""",
    o_app_no="select *, row_number() over (partition by season, team_id order by coalesce(date, '') desc, contest_id desc) as back from o_app",
    o_latest="select season, team_id, won as hot from o_app_no where back = 1",
    o_streak="""select a.season, a.team_id, max(hot) as hot, coalesce(min(case when won <> hot then back end), max(back) + 1) - 1 as len
        from o_app_no a join o_latest l on l.season = a.season and l.team_id = a.team_id group by a.season, a.team_id""",
    o_overall="select season, team_id, sum(won::int) as w, sum((not won)::int) as l from o_app group by season, team_id",
    o_game="""select a.*, m.conference_id is not null and o.conference_id is not null and m.conference_id = o.conference_id as same, o.rpi_rank as opp_rank,
          x.w - (case when a.won then 0 else 1 end) as ow, x.l - (case when a.won then 1 else 0 end) as ol
        from o_app a join o_team_season m on m.season = a.season and m.team_id = a.team_id
        left join o_team_season o on o.season = a.season and o.team_id = a.opp_id
        join o_overall x on x.season = a.season and x.team_id = a.opp_id""",
    o_rec="""select g.season, g.team_id, count(*) as games, sum(won::int) as wins, sum((not won)::int) as losses, sum(own) as sets_won, sum(them) as sets_lost,
          sum((same and won)::int) as conf_wins, sum((same and not won)::int) as conf_losses, sum((not same and won)::int) as nonconf_wins,
          sum((not same and not won)::int) as nonconf_losses, sum(ow) as opp_wins, sum(ol) as opp_losses, round(avg(opp_rank), 1) as opp_rpi,
          round(sum(own) / (sum(own) + sum(them)), 3) as set_pct
        from o_game g group by g.season, g.team_id""",
    o_records="""select r.*, m.team, m.team_short, m.conference, m.conference_id, m.conference_short, m.rpi_rank, m.rpi_record, m.avca_rank,
          cast(case when s.hot then s.len else -s.len end as int) as win_streak
        from o_rec r join o_team_season m on m.season = r.season and m.team_id = r.team_id join o_streak s on s.season = r.season and s.team_id = r.team_id""",
    o_at="""select season, team_id, date, max(sum_w) as wins, max(sum_l) as losses, max(sum_cw) as cw, max(sum_cl) as cl, max(conf) as conf, max(abbrev) as abbrev from (
          select a.season, a.team_id, a.date, m.conference_id as conf, coalesce(m.conference_short, m.conference) as abbrev,
            sum(won::int) over w as sum_w, sum((not won)::int) over w as sum_l,
            sum((won and coalesce(m.conference_id = o.conference_id, false))::int) over w as sum_cw, sum((not won and coalesce(m.conference_id = o.conference_id, false))::int) over w as sum_cl
          from o_app a left join o_team_season m on m.season = a.season and m.team_id = a.team_id left join o_team_season o on o.season = a.season and o.team_id = a.opp_id
          where date is not null window w as (partition by a.season, a.team_id order by date range between unbounded preceding and current row)) x group by season, team_id, date""",
    o_snap="select season, team_id, as_of, rpi_rank as rpi, avca_rank as avca from ranking_snapshots",
    o_decided="""select season, contest_id, case when regexp_matches(date, '^[0-9]{4}-') then cast(substr(date, 1, 10) as date) end as day,
          case when home_sets_won > away_sets_won then home_team_id else away_team_id end as winner_id,
          case when home_sets_won > away_sets_won then away_team_id else home_team_id end as loser_id,
          concat(greatest(home_sets_won, away_sets_won), '-', least(home_sets_won, away_sets_won)) as score
        from contests where home_sets_won <> away_sets_won""",
    o_ranked="""select d.*, w.rpi as winner_rpi, w.avca as winner_avca, l.rpi as loser_rpi, l.avca as loser_avca from o_decided d
        left join o_snap w on w.season = d.season and w.team_id = d.winner_id and w.as_of = (select max(as_of) from o_snap s where s.season = d.season and s.team_id = d.winner_id and s.as_of <= d.day)
        left join o_snap l on l.season = d.season and l.team_id = d.loser_id and l.as_of = (select max(as_of) from o_snap s where s.season = d.season and s.team_id = d.loser_id and s.as_of <= d.day)""",
)

_record_cols = """season, team_id, team, team_short, conference, conference_id, conference_short, rpi_rank, rpi_record, avca_rank, games, wins, losses, sets_won, sets_lost,
  conf_wins, conf_losses, nonconf_wins, nonconf_losses, opp_wins, opp_losses, opp_rpi, set_pct, win_streak"""

query("a8_team_records", f"select {_record_cols} from o_records")(lambda t: records.team_records(t))
query("w6_signed_streak", "select season, team_id, win_streak from o_records")(lambda t: records.streaks(t))
query("k4_standings", f"""select {_record_cols}, row_number() over (partition by season order by wins desc, losses, coalesce(set_pct, 0) desc, team_id) as place from o_records""")(
    lambda t: records.standings(t))

_ranked_cols = "season, rank, team_id, team, conference, wins, losses, win_pct, sets_won, sets_lost, set_pct, conf_wins, conf_losses, win_streak, rpi_rank, avca_rank"
query("a9_records_by_win_pct", f"""select {_ranked_cols} from (select *, row_number() over (partition by season order by win_pct is null, win_pct desc, wins desc, team_id) as rank
    from (select *, round(wins / (wins + losses), 3) as win_pct from o_records) x) y where rank <= 25""")(lambda t: records.ranked_records(t, sort_by="win_pct"))
query("k5_worst_records_graded_first", f"""select {_ranked_cols} from (select *, row_number() over (partition by season order by wins, -losses, team_id) as rank
    from (select *, round(wins / (wins + losses), 3) as win_pct from o_records) x) y where rank <= 10""")(lambda t: records.ranked_records(t, order="asc", limit=10))
query("k7_rankings", """select m.season, m.avca_rank as rank, 'AVCA' as poll, m.team_id, m.team, m.team_short, m.conference, r.wins, r.losses,
    case when r.wins is not null then concat(r.wins, '-', r.losses) end as record, m.avca_rank, m.rpi_rank
    from o_team_season m left join o_records r on r.season = m.season and r.team_id = m.team_id where m.avca_rank is not null""")(lambda t: records.rankings(t))
query("k7_rankings_rpi_top", """select season, rpi_rank as rank, 'RPI' as poll, team_id, team, team_short, conference, wins, losses, record, avca_rank, rpi_rank
    from (select m.*, r.wins, r.losses, case when r.wins is not null then concat(r.wins, '-', r.losses) end as record, row_number() over (partition by m.season order by m.rpi_rank, m.team_id) as pos
      from o_team_season m left join o_records r on r.season = m.season and r.team_id = m.team_id where m.rpi_rank is not null) x where pos <= 5""")(
    lambda t: records.rankings(t, poll="rpi", limit=5))
_at = """season, team_id, date, wins, losses, concat(wins, '-', losses) as record,
    case when conf is not null and abbrev is not null then concat(cw, '-', cl, ' ', abbrev) end as conf_record from o_at"""
query("w10_running_record", f"select {_at}")(lambda t: records.records_at(t))
query("a10_contest_records", """select k.contest_id, k.season, k.date, k.home_team_id, k.away_team_id, k.home_sets_won, k.away_sets_won, h.name as home_team, a.name as away_team,
    concat(x.wins, '-', x.losses) as home_record, case when x.season is null then null else concat(x.cw, '-', x.cl, ' ', x.abbrev) end as home_conf_record,
    concat(y.wins, '-', y.losses) as away_record, case when y.season is null then null else concat(y.cw, '-', y.cl, ' ', y.abbrev) end as away_conf_record
    from (select * from contests where home_sets_won is not null and date is not null) k left join teams h on h.id = k.home_team_id left join teams a on a.id = k.away_team_id
    left join o_at x on x.season = k.season and x.team_id = k.home_team_id and x.date = k.date
    left join o_at y on y.season = k.season and y.team_id = k.away_team_id and y.date = k.date""")(
    lambda t: records.contest_headers(t).filter("home_sets_won is not null and date is not null"))
query("a11_conference_summary", """select season, conference_id, conference, conference_short, count(*) as team_count, count(avca_rank) as ranked_count, round(avg(rpi_rank), 1) as avg_rpi_rank,
    sum(wins) as overall_wins, sum(losses) as overall_losses, sum(nonconf_wins) as interconf_wins, sum(nonconf_losses) as interconf_losses
    from o_records group by all""")(lambda t: records.conference_summary(t))
query("k4_conference_standings", """select season, conference_id, row_number() over (partition by season, conference_id order by conf_wins desc, conf_losses, wins desc, losses, coalesce(set_pct, 0) desc, team_id) as place,
    team_id, team, conf_wins, conf_losses, wins, losses, set_pct, rpi_rank, avca_rank from o_records""")(lambda t: records.conference_standings(t))


@query("j6_rank_as_of", """select k.season, k.contest_id, k.team_id, r.rpi, r.avca from (
      select season, contest_id, winner_id as team_id, day from o_decided union all select season, contest_id, loser_id, day from o_decided) k
    left join o_snap r on r.season = k.season and r.team_id = k.team_id and r.as_of = (select max(as_of) from o_snap s where s.season = k.season and s.team_id = k.team_id and s.as_of <= k.day)""")
def j6(t):
    sides = asof.decided_matches(t).select("season", "contest_id", "day", F.explode(F.array("winner_id", "loser_id")).alias("team_id"))
    return sides.join(asof.ranks_as_of(t, sides), ["season", "team_id", "day"], "left").select("season", "contest_id", "team_id", "rpi", "avca")


_quality = """select q.season, q.winner_id as team_id, m.team, m.team_short, m.conference, m.conference_short, q.loser_id as opponent_id, o.name as opponent, o.short_name as opponent_short,
    loser_avca as rank_at_time, 'avca' as poll, day as date, score, contest_id from o_ranked q
    left join o_team_season m on m.season = q.season and m.team_id = q.winner_id left join teams o on o.id = q.loser_id where loser_avca <= 25"""
shared(o_quality=_quality)
query("c7_quality_wins", "select * from o_quality")(lambda t: asof.quality_wins(t))
query("c7_quality_win_counts", """select season, rank, team_id, team, team_short, conference, quality_wins, best_rank, best_opponent from (
    select *, row_number() over (partition by season order by quality_wins desc, team, team_id) as rank from (
      select season, team_id, team, team_short, conference, count(*) as quality_wins, min(rank_at_time) as best_rank,
        arg_min(opponent, (rank_at_time, coalesce(date, date '0001-01-01'), contest_id)) as best_opponent from o_quality group by season, team_id, team, team_short, conference) c) x where rank <= 25""")(
    lambda t: asof.quality_win_counts(t, limit=25))
_upset = """select season, rank, winner_id, w.name as winner, loser_id, l.name as loser, winner_rpi, winner_avca, loser_rpi, loser_avca, gap, '{poll}' as poll, day as date, score, contest_id from (
    select *, row_number() over (partition by season order by gap is null, gap desc nulls last, coalesce(loser_avca, 999), coalesce(cast(day as string), ''), contest_id) as rank
    from (select *, winner_rpi - loser_rpi as gap from o_ranked) g where {where}) x left join teams w on w.id = winner_id left join teams l on l.id = loser_id where rank <= 10"""
query("c8_upsets_poll", _upset.replace("{poll}", "avca").replace("{where}", "loser_avca <= 25 and (winner_avca is null or winner_avca > loser_avca)"))(lambda t: asof.biggest_upsets(t))
query("c8_upsets_rpi", _upset.replace("{poll}", "rpi").replace("{where}", "gap >= 5"))(lambda t: asof.biggest_upsets(t, poll="rpi", min_gap=5))
query("k8_upset_order_all", """select season, contest_id, row_number() over (partition by season order by gap is null, gap desc nulls last, coalesce(loser_avca, 999), coalesce(cast(day as string), ''), contest_id) as rank
    from (select *, winner_rpi - loser_rpi as gap from o_ranked) g where gap >= 1 qualify rank <= 100""")(
    lambda t: asof.biggest_upsets(t, poll="rpi", limit=100).select("season", "contest_id", "rank"))
