"""Rosters, heights, origins, identity across seasons, transfers."""

from __future__ import annotations


from matchlens.operators import lookups, people
from matchlens.plans.catalog import query, shared
from matchlens.plans.season import P

_us = "('" + "','".join(P.DOMESTIC_TAILS) + "')"
_foreign = f"(hometown is not null and upper(list_extract(string_split(hometown, ', '), -1)) not in {_us})"
_feet = lambda e: f"concat(cast(floor(round_even({e}, 0) / 12) as int), '-', cast(round_even({e}, 0) as int) % 12)"

shared(
    o_known_hs="""select season, name, hometown, high_school, max(player_id) as player_id, max(team_id) as team_id from o_roster
        where name is not null and hometown is not null and high_school is not null group by all having count(*) = 1""",
    o_known_town="""select season, name, hometown, max(player_id) as player_id, max(team_id) as team_id from o_roster
        where name is not null and hometown is not null group by all having count(*) = 1""",
    o_identity="""select p.player_id, p.season, p.team_id, y.season as seek, coalesce(a.player_id, b.player_id) as found_id, case when a.player_id is not null then a.team_id else b.team_id end as found_team
        from o_roster p join (select distinct season from players) y on y.season < p.season
        left join o_known_hs a on a.season = y.season and a.name = p.name and a.hometown = p.hometown and a.high_school = p.high_school
        left join o_known_town b on b.season = y.season and b.name = p.name and b.hometown = p.hometown
        where p.hometown is not null""",
)

query("a14_team_heights", f"""select season, rank, team_id, team, conference, players_measured, round(avg_h, 1) as avg_height_inches, {_feet('avg_h')} as avg_height, max_h as tallest_inches, {_feet('max_h')} as tallest
    from (select *, row_number() over (partition by season order by avg_h desc, team_id) as rank from (
      select season, team_id, team, conference, count(height_inches) as players_measured, avg(height_inches) as avg_h, max(height_inches) as max_h from o_roster
      where height_inches is not null group by season, team_id, team, conference) g) x where rank <= 25""")(lambda t: people.team_heights(t))
query("a16_roster_makeup", f"""select season, rank, team_id, team, conference, roster_size, international, avg_class_ordinal, international_pct from (
    select *, row_number() over (partition by season order by international_pct desc, international desc, team_id) as rank from (
      select season, team_id, team, conference, count(*) as roster_size, sum({_foreign}::int) as international,
        round(avg(case right(class_year, 2) when 'Fr' then 1 when 'So' then 2 when 'Jr' then 3 when 'Sr' then 4 when 'Gr' then 5 end), 2) as avg_class_ordinal,
        round(100.0 * sum({_foreign}::int)::double / count(*), 1) as international_pct
      from o_roster group by season, team_id, team, conference) g) x where rank <= 25""")(lambda t: people.roster_makeup(t, sort_by="international_pct"))
query("a17_origins_state", f"""select season, rank, state, players from (select *, row_number() over (partition by season order by players desc, state) as rank from (
    select season, upper(list_extract(string_split(hometown, ', '), -1)) as state, count(*) as players from o_roster where upper(list_extract(string_split(hometown, ', '), -1)) in {_us} group by all) g) x where rank <= 25""")(
    lambda t: people.player_origins(t))
query("a17_origins_country", f"""select season, rank, country, players from (select *, row_number() over (partition by season order by players desc, country) as rank from (
    select season, list_extract(string_split(hometown, ', '), -1) as country, count(*) as players from o_roster where {_foreign} group by all) g) x where rank <= 25""")(
    lambda t: people.player_origins(t, "country"))
query("j13_previous_season_identity", """select p.player_id, p.season, p.team_id, i.found_id, i.found_team as previous_team_id from o_roster p
    left join o_identity i on i.player_id = p.player_id and i.season = p.season and i.seek = p.season - 1 where p.hometown is not null""")(lambda t: people.previous_team(t))
query("j14_resolve_into_season", """select p.player_id, p.season, coalesce(a.player_id, b.player_id, c.player_id, d.player_id) as found_id from o_roster p
    left join o_known_hs a on a.season = 1998 and a.name = p.name and a.hometown = p.hometown and a.high_school = p.high_school
    left join o_known_town b on b.season = 1998 and b.name = p.name and b.hometown = p.hometown
    left join (select name, team_id, max(player_id) as player_id from o_roster where season = 1998 group by all having count(*) = 1) c on c.name = p.name and c.team_id = p.team_id
    left join (select name, max(player_id) as player_id from o_roster where season = 1998 group by all having count(*) = 1) d on d.name = p.name""")(
    lambda t: people.resolve_players(t, 1998))
query("w9_newest_earlier_season", """select player_id, season, found_team <> team_id as transferred, case when found_team <> team_id then seek end as previous_season,
    case when found_team <> team_id then found_team end as previous_team_id, case when found_team <> team_id then n.name end as previous_team
    from (select *, row_number() over (partition by player_id, season order by seek desc) as rn from o_identity where found_id is not null) x left join teams n on n.id = found_team where rn = 1""")(
    lambda t: people.transfers(t))
query("c6_transfer_impact", """select season, rank, player_id, x.name as player, position, class_year, team, n.name as previous_team, sp, gp, kills, assists, digs, aces, total_blocks, pts, hit_pct,
    kills_per_set, assists_per_set, aces_per_set, digs_per_set, blocks_per_set, pts_per_set from (
      select r.* exclude (player_id, season), s.* exclude (team_id, hit_pct, kills_per_set, assists_per_set, aces_per_set, digs_per_set, blocks_per_set, pts_per_set),
        round(hit_pct, 3) as hit_pct, round(kills_per_set, 2) as kills_per_set, round(assists_per_set, 2) as assists_per_set, round(aces_per_set, 2) as aces_per_set,
        round(digs_per_set, 2) as digs_per_set, round(blocks_per_set, 2) as blocks_per_set, round(pts_per_set, 2) as pts_per_set, i.found_team,
        row_number() over (partition by s.season order by round(pts_per_set, 2) desc nulls last, s.player_id) as rank
      from o_season_rates s join o_roster r on r.player_id = s.player_id and r.season = s.season
      join o_identity i on i.player_id = s.player_id and i.season = s.season and i.seek = s.season - 1 and i.found_team <> i.team_id where s.sp >= 3) x
    left join teams n on n.id = found_team where rank <= 25""")(lambda t: people.transfer_impact(t, min_sets=3))
query("c2_search_players", """select player_id, season, rank, name as player, team, conference, position, class_year, number, height_inches, hometown from (
    select *, row_number() over (partition by season order by height_inches desc nulls last, name, player_id) as rank from o_roster
    where list_contains(string_split(position, '/'), 'MB') and height_inches >= 70) x where rank <= 20""")(
    lambda t: lookups.search_players(t, position="middle", min_height_inches=70, sort_by="height").select(
        "player_id", "season", "rank", "player", "team", "conference", "position", "class_year", "number", "height_inches", "hometown"))
