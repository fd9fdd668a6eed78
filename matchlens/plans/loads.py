"""Entity resolution, loads and merges over staged inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchlens.constants import ROSTER_OVERRIDES
from matchlens.operators import entities, loads
from matchlens.operators.cumulative import SeasonView
from matchlens.plans.catalog import query, shared
from matchlens.sources import files, merge
from matchlens.sources.staged import CLASSES, HEIGHTS, POSITIONS
from matchlens.sources.versioned import VersionedTable
from matchlens.tables import SCHEMAS

_key = lambda e: f"array_to_string(list_filter(string_split(regexp_replace(lower({e}), '[^a-z0-9 ]', ' ', 'g'), ' '), lambda w: w <> '' and w not in ('university', 'college', 'of', 'the')), ' ')"

shared(
    o_spelling="select id, name as s from teams union all select id, short_name from teams union all select id, unnest(aliases) from teams",
    o_team_key=f"select {_key('s')} as k, min(id) as id from o_spelling group by 1",
    o_plain="select *, trim(regexp_replace(regexp_replace(lower(name), '[.''`]', '', 'g'), '[^a-z0-9]+', ' ', 'g')) as p from asked_names",
    o_asked="""select distinct season, team_id, name, p, array_to_string(list_sort(list_distinct(string_split(p, ' '))), ' ') as tk, string_split(p, ' ') as w from o_plain""",
    o_people="""select season, team_id, id, p, array_to_string(list_sort(list_distinct(string_split(p, ' '))), ' ') as tk, string_split(p, ' ') as w
        from (select season, team_id, id, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) as p from players) x""",
    o_t1="select season, team_id, p as k, min(id) as id from o_people group by all having count(distinct id) = 1",
    o_t2="select season, team_id, tk as k, min(id) as id from o_people group by all having count(distinct id) = 1",
    o_t3="select season, team_id, concat(left(w[1], 1), ' ', w[-1]) as k, min(id) as id from o_people where len(w) >= 2 group by all having count(distinct id) = 1",
    o_t4="select season, team_id, w[-1] as k, min(id) as id from o_people where len(w) >= 2 group by all having count(distinct id) = 1",
    o_first_tiers="""select a.*, coalesce(t1.id, t2.id, t3.id, t4.id) as id from o_asked a left join o_t1 t1 on t1.season = a.season and t1.team_id = a.team_id and t1.k = a.p
        left join o_t2 t2 on t2.season = a.season and t2.team_id = a.team_id and t2.k = a.tk left join o_t3 t3 on t3.season = a.season and t3.team_id = a.team_id and len(a.w) >= 2 and t3.k = concat(left(a.w[1], 1), ' ', a.w[-1])
        left join o_t4 t4 on t4.season = a.season and t4.team_id = a.team_id and len(a.w) >= 2 and t4.k = a.w[-1]""",
    o_overlap="""select season, team_id, name, min(id) as id from (select a.season, a.team_id, a.name, b.id, count(*) as n from (select season, team_id, name, unnest(list_distinct(w)) as v from o_first_tiers where id is null) a
        join (select season, team_id, id, unnest(list_distinct(w)) as v from o_people) b on b.season = a.season and b.team_id = a.team_id and b.v = a.v group by all having count(*) >= 2) c group by all having count(distinct id) = 1""",
    o_matched="""select f.season, f.team_id, f.name, coalesce(f.id, o.id) as player_id from o_first_tiers f left join o_overlap o on o.season = f.season and o.team_id = f.team_id and o.name = f.name""",
)
_roster = lambda t: t.players.select("season", "team_id", F.col("id").alias("player_id"), "name")

query("j15_fuzzy_names", "select season, team_id, name, player_id from o_matched")(lambda t: entities.match_names(t.asked_names, _roster(t), ["season", "team_id"]))
query("j17_alias_dictionary", f"select h.outside_id, h.season, h.name, k.id as team_id from harvest h left join o_team_key k on k.k = {_key('h.name')}")(
    lambda t: entities.resolve_team(t.harvest, t, "name", "team_id"))
query("j17_find_team", "select 'the nation 7 college' as text, 7 as team_id union all select 'tion_1', 1 union all select 'nowhere', null")(
    lambda t: entities.find_team(t, "the nation 7 college").unionByName(entities.find_team(t, "tion_1")).unionByName(entities.find_team(t, "nowhere")))
query("j18_id_then_name", f"""select s.season as season, s.contestid as contest, s.teamncaaid as who, coalesce(i.team_id, k.id) as opponent_team_id from staged_schedule s left join team_season_ids i on i.season = s.season and i.ncaa_team_id = s.opponentncaaid
    left join o_team_key k on k.k = {_key('s.opponentname')}""")(
    lambda t: entities.resolve_by_id_or_name(t.staged_schedule.select(F.col("Season").alias("season"), F.col("ContestId").alias("contest"), F.col("TeamNcaaId").alias("who"), "OpponentNcaaId", "OpponentName"),
                                             t, "OpponentNcaaId", "OpponentName", "opponent_team_id").select("season", "contest", "who", "opponent_team_id"))
_label_id = "case trim(m.label) when 'AME' then 1 when 'AFRICA' then 0 when 'EUROPE' then (select id from conferences where name = 'EUROPE') when 'ASIA' then (select id from conferences where name = 'ASIA') end"
query("j19_conference_labels", f"select team_id, season, {_label_id} as conference_id from membership m")(
    lambda t: entities.resolve_conference(t.membership.withColumn("label", F.trim("label")), t, "label").select("team_id", "season", "conference_id"))
query("j19_new_conferences", "select 'Big Ten Conference' as name, 'Big Ten' as short_name")(lambda t: entities.new_conferences(t.membership.withColumn("label", F.trim("label")), t, "label"))
query("j20_photo_matches", """select h.season, h.team_id, h.true_id, coalesce(n.id, j.id) as player_id from photo_hits h
    left join (select season, team_id, k, max(id) as id from (select season, team_id, id, array_to_string(list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(name), '[^a-z ]', ' ', 'g'), ' '), lambda w: w <> ''))), ' ') as k from players) p group by all) n
      on n.season = h.season and n.team_id = h.team_id and n.k = array_to_string(list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(h.name), '[^a-z ]', ' ', 'g'), ' '), lambda w: w <> ''))), ' ')
    left join (select season, team_id, number, min(id) as id from players group by all having count(*) = 1) j on j.season = h.season and j.team_id = h.team_id and j.number = h.jersey""")(
    lambda t: entities.match_photos(t.photo_hits, t).select("season", "team_id", "true_id", "player_id"))
query("j22_conference_diff", """select kind, outside_id, team, own, "foreign", expected from (
    select coalesce(o.ncaa_team_id, x.outside_id) as outside_id, coalesce(o.name, x.team) as team, o.conference as own, x.conference as "foreign", e.own as expected,
      case when o.ncaa_team_id is null then 'missing_here' when x.outside_id is null then 'missing_there' when e.own is not null and coalesce(o.conference, '') <> e.own then 'mismatch' end as kind
    from (select s.ncaa_team_id, m.team as name, m.conference from team_season_ids s join o_team_season m on m.team_id = s.team_id and m.season = s.season) o
    full outer join second_source x on x.outside_id = o.ncaa_team_id
    left join (select f, arg_max(own, (n, own)) as own from (select x.conference as f, m.conference as own, count(*) as n from second_source x join team_season_ids s on s.ncaa_team_id = x.outside_id
      join o_team_season m on m.team_id = s.team_id and m.season = s.season group by all) v group by f) e on e.f = x.conference) z where kind is not null""")(
    lambda t: entities.diff_conferences(
        _our_membership(t), t.second_source.select("outside_id", "team", "conference")))


def _our_membership(t):
    from matchlens.operators.conference import team_seasons

    ids = t.team_season_ids.select("team_id", "season", F.col("ncaa_team_id").alias("outside_id"))
    return ids.join(team_seasons(t), ["team_id", "season"]).select("outside_id", "team", "conference")


query("j23_backfill_ids", f"""select t.id, t.name, (select max(h.outside_id) from harvest h where {_key('h.name')} in (select {_key('s')} from o_spelling s where s.id = t.id)) as outside_id from teams t""")(
    lambda t: entities.backfill_ids(t, t.harvest)[0].select("id", "name", "outside_id"))
query("j23_backfill_short_names", "select s.team_id, s.season, t.short_name as old_short, h.name as new_short from harvest h join team_season_ids s on s.ncaa_team_id = h.outside_id join teams t on t.id = s.team_id where t.short_name <> h.name")(
    lambda t: entities.backfill_short_names(t, t.harvest))
query("s20_name_gaps", """select season, team_id, name, occurrences, contests, kind from (select g.season, g.team_id, g.name, g.occurrences, g.contests,
    case when name = 'Zed 0' and exists (select 1 from o_t4 p where p.season = g.season and p.team_id = g.team_id and p.k = '0') then 'VARIANT' else 'ROSTER_GAP' end as kind
    from (select season, team_id, case when seq % 5 = 0 then 'Zed 0' else concat('Mr Roe', seq % 5) end as name, count(*) as occurrences, count(distinct contest_id) as contests from pbp_events where touch_type <> 'terminal' group by all) g) x""")(
    lambda t: entities.name_gaps(t.replace(pbp_events=t.pbp_events.withColumns({"player_id": F.lit(None).cast("bigint"), "player_name": F.when(F.col("seq") % 5 == 0, "Zed 0").otherwise(F.concat(F.lit("Mr Roe"), (F.col("seq") % 5).cast("string")))}))).drop("player_id"))

# --- starters --------------------------------------------------------------------------------------
shared(
    o_lines6="""select k.contest_id, k.season, 1 as set_number, cast(g.team_id = k.home_team_id as int) as line_no, list(distinct g.name) as names from (select p.contest_id, p.team_id, p.player_id, r.name from player_game_stats p join players r on r.id = p.player_id) g
        join contests k on k.contest_id = g.contest_id group by all""",
    o_line_name="select contest_id, season, set_number, line_no, unnest(names) as name from o_lines6",
    o_side_name="""select l.*, s.turn, s.team_id, trim(regexp_replace(lower(l.name), '[^a-z0-9]+', ' ', 'g')) as p from o_line_name l join (select contest_id, 0 as turn, home_team_id as team_id from contests union all select contest_id, 1, away_team_id from contests) s on s.contest_id = l.contest_id""",
    o_line_keys="select *, string_split(p, ' ') as w, array_to_string(list_sort(list_distinct(string_split(p, ' '))), ' ') as tk from o_side_name",
    o_line_asked="select distinct season, team_id, name, p, w, tk from o_line_keys",
    o_line_first="""select a.*, coalesce(t1.id, t2.id, t3.id, t4.id) as id from o_line_asked a left join o_t1 t1 on t1.season = a.season and t1.team_id = a.team_id and t1.k = a.p left join o_t2 t2 on t2.season = a.season and t2.team_id = a.team_id and t2.k = a.tk
        left join o_t3 t3 on t3.season = a.season and t3.team_id = a.team_id and t3.k = concat(left(a.w[1], 1), ' ', a.w[-1]) left join o_t4 t4 on t4.season = a.season and t4.team_id = a.team_id and t4.k = a.w[-1]""",
    o_line_over="""select season, team_id, name, min(id) as id from (select a.season, a.team_id, a.name, b.id, count(*) as n from (select season, team_id, name, unnest(list_distinct(w)) as v from o_line_first where id is null) a
        join (select season, team_id, id, unnest(list_distinct(w)) as v from o_people) b on b.season = a.season and b.team_id = a.team_id and b.v = a.v group by all having count(*) >= 2) c group by all having count(distinct id) = 1""",
    o_line_hit="""select k.contest_id, k.season, k.set_number, k.line_no, k.turn, k.team_id, coalesce(f.id, o.id) as player_id from o_line_keys k left join o_line_first f on f.season = k.season and f.team_id = k.team_id and f.name = k.name
        left join o_line_over o on o.season = k.season and o.team_id = k.team_id and o.name = k.name""",
    o_line_side="""select contest_id, season, set_number, line_no, team_id from (select contest_id, season, set_number, line_no, team_id, row_number() over (partition by contest_id, season, set_number, line_no order by count(distinct player_id) desc, turn) as rn, count(distinct player_id) as n
        from o_line_hit group by contest_id, season, set_number, line_no, turn, team_id) x where rn = 1 and n > 0""",
    o_assigned="select distinct h.season, h.contest_id, h.team_id, h.set_number, h.player_id from o_line_hit h join o_line_side s using (contest_id, season, set_number, line_no, team_id) where h.player_id is not null",
)


def _lines(t):
    """Per side of a match one line: the names of its box score, one row each."""
    people = t.players.select(F.col("id").alias("player_id"), "name")
    games = t.contests.select("contest_id", "home_team_id")
    rows = t.player_game_stats.select("contest_id", "season", "team_id", "player_id").join(people, "player_id").join(games, "contest_id")
    return rows.select("contest_id", "season", (F.col("team_id") == F.col("home_team_id")).cast("int").alias("line_no"), "name", F.lit(1).alias("set_number")).distinct()


query("j16_starters_to_sides", "select season, contest_id, team_id, set_number, player_id from o_assigned")(lambda t: entities.assign_starters(_lines(t), t))
query("c16_lineup_load", """select contest_id, team_id, set_number, player_id, season from o_assigned union all select contest_id, team_id, set_number, player_id, season from contest_set_starters s
    where not exists (select 1 from o_assigned a where a.contest_id = s.contest_id and a.team_id = s.team_id and a.set_number = s.set_number)""")(lambda t: loads.load_starters(_lines(t), t))

# --- box scores and play-by-play -------------------------------------------------------------------
_new_line = """select contestid as contest_id, p.id as player_id, p.team_id, s.season, s.s::double as sets, s.kills::double as kills, case when s.assists = '-' then null else s.assists::double end as assists,
    case when s.aces = 'nan' then null else s.aces::double end as aces from staged_box s join players p on p.ncaa_player_id = s.playerid and p.season = s.season"""
shared(o_new_line=_new_line)


def _twice(t):
    box = t.staged_box
    return box.unionByName(box)


def _stale(t):
    return t.replace(
        player_game_stats=t.stale_box,
        contests=t.stale_contests.withColumns({"set_scores": F.lit(None).cast("struct<away:array<int>,home:array<int>>"), "ncaa_game_id": F.lit(None).cast("string"), "location": F.lit(None).cast("string"), "attendance": F.lit(None).cast("int")}),
    )


query("u5_duplicate_box_rows", "select contestid as contest_id, playerid as player, name as name from staged_box")(
    lambda t: loads.once_per_player(_twice(t)).select(F.col("ContestID").alias("contest_id"), F.col("PlayerID").alias("player"), F.col("Name").alias("name")))
query("s1_box_csv_scan", "select contestid as id, playerid as player, kills as k, hometeamncaaid as home from staged_box")(
    lambda t: _through_csv(t, t.staged_box.select("ContestID", "PlayerID", "Kills", "HomeTeamNcaaId"), "ContestID string, PlayerID string, Kills string, HomeTeamNcaaId string").select(
        F.col("ContestID").alias("id"), F.col("PlayerID").alias("player"), F.col("Kills").alias("k"), F.col("HomeTeamNcaaId").alias("home")))
query("s2_pbp_csv_scan", "select contest_id, set_number, rally_number, seq, touch_type, player_name, is_terminal, away_score from pbp_events")(
    lambda t: _through_csv(t, t.pbp_events.select("contest_id", "set_number", "rally_number", "seq", "touch_type", "player_name", "is_terminal", "away_score"),
                           "contest_id string, set_number int, rally_number int, seq int, touch_type string, player_name string, is_terminal boolean, away_score int", "_bad").filter("_bad is null").drop("_bad"))


def _through_csv(t, df, schema, corrupt=None):
    import uuid

    from matchlens.session import shared_dir

    path = f"{shared_dir(t.spark)}/csv-{uuid.uuid4().hex}"
    df.write.option("header", True).csv(path)
    return files.read_csv(t.spark, path, schema, corrupt)


query("s8_upsert_box_lines", """select coalesce(o.contest_id, n.contest_id) as contest_id, coalesce(o.player_id, n.player_id) as player_id, coalesce(n.team_id, o.team_id) as team_id,
    case when n.player_id is not null then n.kills else o.kills end as kills, case when n.player_id is not null then n.assists else o.assists end as assists, o.digs from stale_box o full outer join o_new_line n on n.contest_id = o.contest_id and n.player_id = o.player_id""")(
    lambda t: merge.upsert(t.stale_box, loads.box_lines(loads.once_per_player(_twice(t)), t), ["contest_id", "player_id"]).select("contest_id", "player_id", "team_id", "kills", "assists", "digs"))
query("c17_box_load_contests", """select coalesce(n.contest_id, o.contest_id) as contest_id, coalesce(n.season, o.season) as season, case when n.contest_id is not null then coalesce(n.date, o.date) else o.date end as date,
    coalesce(n.home_team_id, o.home_team_id) as home_team_id, coalesce(n.away_team_id, o.away_team_id) as away_team_id, coalesce(n.home_sets_won, o.home_sets_won) as home_sets_won, coalesce(n.away_sets_won, o.away_sets_won) as away_sets_won
    from stale_contests o full outer join (select k.* from contests k where exists (select 1 from player_game_stats p where p.contest_id = k.contest_id)) n on n.contest_id = o.contest_id""")(
    lambda t: loads.load_box(_twice(t), _stale(t)).contests.select("contest_id", "season", "date", "home_team_id", "away_team_id", "home_sets_won", "away_sets_won"))
query("c17_box_load_lines", """select coalesce(o.contest_id, n.contest_id) as contest_id, coalesce(o.player_id, n.player_id) as player_id, case when n.player_id is not null then n.kills else o.kills end as kills from stale_box o
    full outer join o_new_line n on n.contest_id = o.contest_id and n.player_id = o.player_id""")(lambda t: loads.load_box(_twice(t), _stale(t)).player_game_stats.select("contest_id", "player_id", "kills"))
query("s19_load_report", "select count(*) as rows, count(*) filter (p.id is not null) as loaded, count(*) filter (p.id is null) as skipped from staged_box s left join players p on p.ncaa_player_id = s.playerid and p.season = s.season")(
    lambda t: loads.report(loads.players_by_outside_id(t.staged_box, t), loaded=F.col("player_id").isNotNull(), skipped=F.col("player_id").isNull()))
query("s19_merge_changes", """select count(*) filter (o.contest_id is null) as inserted, count(*) filter (o.contest_id is not null and n.contest_id is not null) as updated, count(*) filter (n.contest_id is null) as untouched
    from stale_box o full outer join o_new_line n on n.contest_id = o.contest_id and n.player_id = o.player_id""")(
    lambda t: merge.changes(t.stale_box, loads.box_lines(loads.once_per_player(_twice(t)), t), ["contest_id", "player_id"]))


def _pbp_file(t):
    return t.staged_pbp.withColumnRenamed("SetNo", "Set")


shared(o_name_of="""select season, team_id, k, min(id) as id from (select season, team_id, id, array_to_string(list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(trim(regexp_replace(regexp_replace(name, '\\b[0-9]+\\b', '', 'g'), '\\s+', ' ', 'g'))), '[^a-z ]', ' ', 'g'), ' '), lambda w: w <> ''))), ' ') as k from players) p
    where k <> '' group by all""",
       o_loaded_pbp="""select s.contestid as contest_id, s.season as season, s.setno as set_number, s.rally as rally_number, s.seq as seq, s.touchtype as touch_type, s.playername as player_name, n.id as player_id, i.team_id, s.isterminal as is_terminal, s.terminaltype as terminal_type, g.team_id as scoring_team_id
        from staged_pbp s left join team_season_ids i on i.season = s.season and i.ncaa_team_id = case when s.side = 'away' then s.awayncaaid else s.homencaaid end
        left join team_season_ids g on g.season = s.season and g.ncaa_team_id = case s.scoringside when 'away' then s.awayncaaid when 'home' then s.homencaaid end
        left join o_name_of n on n.season = s.season and n.team_id = i.team_id and n.k = array_to_string(list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(trim(regexp_replace(regexp_replace(s.playername, '\\b[0-9]+\\b', '', 'g'), '\\s+', ' ', 'g'))), '[^a-z ]', ' ', 'g'), ' '), lambda w: w <> ''))), ' ')""")
_pbp_cols = ["contest_id", "season", "set_number", "rally_number", "seq", "touch_type", "player_name", "player_id", "team_id", "is_terminal", "terminal_type", "scoring_team_id"]
query("c18_pbp_load", f"select {', '.join(_pbp_cols)} from o_loaded_pbp")(lambda t: loads.pbp_rows(_pbp_file(t), t).select(*_pbp_cols))
query("s9_replace_contest_events", """select contest_id, seq, touch_type from o_loaded_pbp union all select contest_id, seq, 'stale' from pbp_events e where cast(contest_id as bigint) % 2 = 0 and not exists (select 1 from staged_pbp s where s.contestid = e.contest_id)
    union all select concat('x', contest_id), seq, 'stale' from pbp_events""")(
    lambda t: _replaced_events(t))


def _replaced_events(t):
    """Events per contest in a versioned table; a load replaces the contests it has."""
    cols = ["contest_id", "seq", "touch_type"]
    stale = t.pbp_events.withColumn("touch_type", F.lit("stale"))
    other = stale.withColumn("contest_id", F.concat(F.lit("x"), "contest_id"))
    table = stored(t, stale.unionByName(other).select(*cols), ["contest_id"])
    merge.replace_stored(table, loads.pbp_rows(_pbp_file(t), t).select(*cols), ["contest_id"])
    return table.read()


query("s13_fill_only_if_missing", """select coalesce(o.contest_id, n.contest_id) as contest_id, coalesce(o.home_team_id, n.home_team_id) as home_team_id, coalesce(o.away_team_id, n.away_team_id) as away_team_id, n.loc as location, n.att as attendance
    from stale_contests o full outer join (select s.contestid as contest_id, max(h.team_id) as home_team_id, max(a.team_id) as away_team_id, max(s.location) as loc, max(s.attendance) as att from staged_pbp s left join team_season_ids h on h.season = s.season and h.ncaa_team_id = s.homencaaid
      left join team_season_ids a on a.season = s.season and a.ncaa_team_id = s.awayncaaid group by s.contestid) n on n.contest_id = o.contest_id""")(
    lambda t: loads.load_pbp(_pbp_file(t), _stale(t)).contests.select("contest_id", "home_team_id", "away_team_id", "location", "attendance"))
query("s7_resume_ledger", "select distinct contest_id from contests k where not exists (select 1 from stale_box b where b.contest_id = k.contest_id) and not exists (select 1 from pbp_events e where e.contest_id = k.contest_id)")(
    lambda t: files.not_yet_seen(t.contests, "contest_id", t.stale_box, t.pbp_events).select("contest_id"))

# --- rosters, schedules, teams ---------------------------------------------------------------------
_codes = ("Fr", "R-So", "R-Fr", "Jr", "Sr", "Gr", "Fifth", "Fr", "R-Fr", None, None, "R-So", "Fr", "R-Sr")
_inches = (74, 74, 71, 74, None, None, None, 69, None, 72)
_list = lambda name, vs: ", ".join(f"({i}, {'null' if v is None else repr(v)})" for i, v in enumerate(vs))
query("c19_roster_rows", f"""select p.season, p.team_id, case when p.id % 19 <> 0 then p.ncaa_player_id end as ncaa_player_id, p.name, p.number, nullif(trim(s.pos), '') as position, c.v as class_year, cast(h.v as int) as height_inches, p.hometown, p.high_school
    from players p join (values {_list('c', _codes)}) c(i, v) on c.i = p.id % {len(CLASSES)} join (values {_list('h', _inches)}) h(i, v) on h.i = p.id % {len(HEIGHTS)}
    join (values {_list('p', POSITIONS)}) s(i, pos) on s.i = p.id % {len(POSITIONS)}""")(
    lambda t: loads.roster_rows(t.staged_roster.withColumnRenamed("HighSchool", "High School"), t))
query("c19_roster_load", f"""select p.id, p.season, p.team_id, p.name, c.v as class_year from players p join (values {_list('c', _codes)}) c(i, v) on c.i = p.id % {len(CLASSES)} where p.id % 19 <> 0
    union all select id, season, team_id, name, class_year from players where id % 19 = 0
    union all select cast(concat('0x', left(md5(concat_ws('|', p.season, concat_ws(':', 'name', p.team_id, p.name))), 13)) as bigint), p.season, p.team_id, p.name, min(c.v)
    from players p join (values {_list('c', _codes)}) c(i, v) on c.i = p.id % {len(CLASSES)} where p.id % 19 = 0 group by p.season, p.team_id, p.name""")(
    lambda t: loads.load_roster(t.staged_roster.withColumnRenamed("HighSchool", "High School"), t).select("id", "season", "team_id", "name", "class_year"))
query("f17_overrides", """select id, case when id % 3 = 0 then 72 else height_inches end as height_inches, case when id % 3 = 1 then 'MB' else position end as position from players""")(
    lambda t: loads.apply_overrides(t.players.select("id", "height_inches", "position", F.when(F.col("id") % 3 == 0, ROSTER_OVERRIDES[0][0]).when(F.col("id") % 3 == 1, ROSTER_OVERRIDES[2][0]).alias("ncaa_player_id"))).drop("ncaa_player_id"))
shared(
    o_sched_new=f"""select s.season, i.team_id, s.opponentname as opponent_name, s.date, max(coalesce(o.team_id, k.id)) as opponent_team_id, max(s.time) as time, max(nullif(s.contestid, '')) as contest_id, max(s.site) as site from staged_schedule s
        join team_season_ids i on i.season = s.season and i.ncaa_team_id = s.teamncaaid left join team_season_ids o on o.season = s.season and o.ncaa_team_id = s.opponentncaaid left join o_team_key k on k.k = {_key('s.opponentname')} group by s.season, i.team_id, s.opponentname, s.date""",
    o_sched_old="select season, team_id, opponent_name, date, max(opponent_team_id) as opponent_team_id, max(game_time) as game_time, max(contest_id) as contest_id, max(site) as site from schedule group by season, team_id, opponent_name, date",
)
_sched_keys = ["season", "team_id", "date", "opponent_name"]


def _one_schedule(t):
    return t.replace(schedule=t.schedule.groupBy(*_sched_keys).agg(*[F.max(c).alias(c) for c in t.schedule.columns if c not in _sched_keys]),
                     staged_schedule=t.staged_schedule.groupBy("Season", "TeamNcaaId", "OpponentName", "Date").agg(*[F.max(c).alias(c) for c in t.staged_schedule.columns if c not in ("Season", "TeamNcaaId", "OpponentName", "Date")]))


_sched = """select coalesce(n.season, o.season) as season, coalesce(n.team_id, o.team_id) as team_id, coalesce(n.date, o.date) as date, coalesce(n.opponent_name, o.opponent_name) as opponent_name,
    case when n.team_id is not null then n.opponent_team_id else o.opponent_team_id end as opponent_team_id, case when n.team_id is null then o.game_time when coalesce(n.time, '') in ('', '12:00 AM') and o.game_time is not null then o.game_time else n.time end as game_time,
    coalesce(n.contest_id, o.contest_id) as contest_id from o_sched_old o full outer join o_sched_new n on n.season = o.season and n.team_id = o.team_id and n.date = o.date and n.opponent_name = o.opponent_name"""
shared(o_sched_merged=_sched)
_sched_run = lambda t: loads.load_schedule(_one_schedule(t).staged_schedule, _one_schedule(t))
query("c19_schedule_load", """select m.* from o_sched_merged m where exists (select 1 from o_sched_new n where n.season = m.season and n.team_id = m.team_id and n.date = m.date and n.opponent_name = m.opponent_name)
    or not exists (select 1 from o_sched_new n where n.season = m.season and n.team_id = m.team_id)""")(
    lambda t: _sched_run(t).select(*_sched_keys, "opponent_team_id", "game_time", "contest_id"))
query("s10_prune_unlisted", """select season, team_id, count(*) as n from (select m.* from o_sched_merged m where exists (select 1 from o_sched_new n where n.season = m.season and n.team_id = m.team_id and n.date = m.date and n.opponent_name = m.opponent_name)
    or not exists (select 1 from o_sched_new n where n.season = m.season and n.team_id = m.team_id)) x group by all""")(lambda t: _pruned_schedule(t).groupBy("season", "team_id").agg(F.count(F.lit(1)).alias("n")))


def _pruned_schedule(t):
    """A scrape merged into the stored schedule, a versioned table."""
    one = _one_schedule(t)
    table = stored(t, one.schedule, ["season", "team_id"])
    loads.load_schedule_into(table, one.staged_schedule, one)
    return table.read()


query("s11_keep_real_time", """select contest_id, team_id, case when coalesce(game_time, '') in ('', '12:00 AM') and contest_id is not null then '06:00 PM' else game_time end as t from schedule""")(
    lambda t: t.schedule.select("contest_id", "team_id", merge.keep_real_time(F.col("game_time"), F.when(F.col("contest_id").isNotNull(), "06:00 PM"), F.coalesce("game_time", F.lit("")).isin("", "12:00 AM")).alias("t")))
_season_file = lambda t: merge.latest(t.staged_box.select("PlayerID", "Season", "ContestID", "S", "Kills"), ["PlayerID", "Season"], F.col("ContestID")).withColumns(
    {"GP": F.lit("7"), "GS": F.when(F.col("PlayerID").cast("bigint") % 2 == 0, "5").otherwise("-"), "Hit Pct": F.lit(".250"), "Trpl Dbl": F.lit("1")})
# Every third player has an older line; of players without a match in the file it stays.
_old_lines = lambda t: t.players.filter("id % 3 = 0").select(F.col("id").alias("player_id"), "season", F.lit(1.0).alias("gs"), F.lit(99.0).alias("kills"), F.lit(3.0).alias("digs"))


def _whole(t, name, have):
    """``have`` with all columns of a stored table; those it lacks are NULL."""
    kinds = t.spark.createDataFrame([], SCHEMAS[name]).dtypes
    return have.select(*[(F.col(c).cast(k).alias(c) if c in have.columns else F.lit(None).cast(k).alias(c)) for c, k in kinds])


def _stored_lines(t):
    return t.replace(player_season_stats_scraped=_whole(t, "player_season_stats_scraped", _old_lines(t)))


query("c19_season_lines_load", """with fresh as (select p.id as player_id, s.season as season, max(s.s::double) as sp, max(s.kills::double) as kills from staged_box s join players p on p.ncaa_player_id = s.playerid and p.season = s.season
      where s.contestid = (select max(b.contestid) from staged_box b where b.playerid = s.playerid and b.season = s.season) group by all),
    old as (select id as player_id, season, 1.0::double as gs, 99.0::double as kills, 3.0::double as digs from players where id % 3 = 0)
    select coalesce(f.player_id, o.player_id) as player_id, coalesce(f.season, o.season) as season, case when f.player_id is not null then 7.0::double end as gp,
      case when f.player_id is null then o.gs when f.player_id % 2 = 0 then 5.0::double end as gs, f.sp, case when f.player_id is null then o.kills else f.kills end as kills, o.digs,
      case when f.player_id is not null then 0.25::double end as hit_pct, case when f.player_id is not null then 1.0::double end as trpl_dbl
    from fresh f full outer join old o on o.player_id = f.player_id and o.season = f.season""")(
    lambda t: loads.load_season_lines(_season_file(t), _stored_lines(t)).select("player_id", "season", "gp", "gs", "sp", "kills", "digs", "hit_pct", "trpl_dbl"))
query("c19_season_lines", """select p.id as player_id, s.season as season, max(s.s::double) as sp, max(s.kills::double) as kills from staged_box s join players p on p.ncaa_player_id = s.playerid and p.season = s.season where s.contestid = (
    select max(b.contestid) from staged_box b where b.playerid = s.playerid and b.season = s.season) group by all""")(
    lambda t: loads.season_lines(merge.latest(t.staged_box.select("PlayerID", "Season", "ContestID", "S", "Kills"), ["PlayerID", "Season"], F.col("ContestID")), t))
def _coach_file(t):
    return t.nation.select(
        (F.col("n_nationkey") * 10000 + 1998).cast("string").alias("TeamID"), F.when(F.col("n_nationkey") != 4, F.concat(F.lit("Coach "), "n_name")).otherwise(" ").alias("CoachName"),
        F.lit("c").alias("CoachId"), F.lit("3").alias("Seasons"), F.lit("1-0").alias("Record"))


def _old_coaches(t):
    """An assistant per team in three seasons, the loaded one among them."""
    years = F.explode(F.array(F.lit(1997), F.lit(1998), F.lit(None).cast("int"))).alias("season")
    have = t.nation.select(F.col("n_nationkey").cast("int").alias("team_id"), years, F.concat(F.lit("Old "), "n_name").alias("name"), F.lit("Assistant").alias("title"), F.lit(1).alias("sort_order"))
    return _whole(t, "coaches", have.withColumn("id", F.col("team_id") + F.coalesce("season", F.lit(0))))


query("c19_coaches_load", """select team_id, 1998 as season, name, 'Head Coach' as title, '1-0' as record from (select n_nationkey as team_id, concat('Coach ', n_name) as name from nation where n_nationkey <> 4) x
    union all select n_nationkey, y, concat('Old ', n_name), 'Assistant', null from nation, (values (1997), (null)) v(y)""")(
    lambda t: loads.load_coaches(_coach_file(t), t.replace(coaches=_old_coaches(t)), 1998).select("team_id", "season", "name", "title", "record"))


def _team_file(t):
    """Every other team, with a new short name, and one that is not stored."""
    known = t.nation.filter("n_nationkey % 2 = 0").select("n_name", F.col("n_regionkey").alias("r"), F.col("n_nationkey").cast("string").alias("k"))
    named = known.select(F.col("n_name").alias("team"), F.concat(F.lit("S"), "k").alias("short_name"), F.create_map(F.lit("1998"), F.concat(F.lit("new"), "k")).alias("ncaa_team_ids"))
    fresh = t.region.limit(1).select(F.lit("Fresh College").alias("team"), F.lit("Fresh").alias("short_name"), F.create_map(F.lit("1998"), F.lit("f1")).alias("ncaa_team_ids"))
    return named.unionByName(fresh).withColumns({"conference": F.lit(""), "city": F.lit("Town"), "state": F.lit("TX"), "team_name_aliases": F.array(F.lit("x"))})


query("c19_teams_load", """select t.id, t.name, case when t.id % 2 = 0 then concat('S', t.id) else t.short_name end as short_name, case when t.id % 2 = 0 then 'Town' end as city, t.conference_id,
      case when t.id % 2 = 0 then concat('new', t.id) else i.ncaa_team_id end as outside_id from teams t left join team_season_ids i on i.team_id = t.id and i.season = 1998
    union all select (select max(n_nationkey) + 1 from nation), 'Fresh College', 'Fresh', 'Town', null, 'f1'""")(lambda t: _loaded_teams(t))


def _loaded_teams(t):
    new = loads.load_teams(_team_file(t), t.replace(teams=_whole(t, "teams", t.teams)), 1998)
    ids = new.team_season_ids.filter("season = 1998").select(F.col("team_id").alias("id"), F.col("ncaa_team_id").alias("outside_id"))
    return new.teams.join(ids, "id", "left").select("id", "name", "short_name", "city", "conference_id", "outside_id")


query("c19_coaches", "select team_id, 1998 as season, name, 'Head Coach' as title from (select n_nationkey as team_id, concat('Coach ', n_name) as name from nation where n_nationkey <> 4) x")(
    lambda t: loads.coach_rows(t.nation.select(
        (F.col("n_nationkey") * 10000 + 1998).cast("string").alias("TeamID"), F.when(F.col("n_nationkey") != 4, F.concat(F.lit("Coach "), "n_name")).otherwise(" ").alias("CoachName"), F.lit("c").alias("CoachId"), F.lit("3").alias("Seasons"), F.lit("1-0").alias("Record")),
        t, 1998).select("team_id", "season", "name", "title"))
query("c19_teams", "select n_name as name, concat('N', n_nationkey) as short_name, n_regionkey as conference_id, 'Town' as city from nation")(
    lambda t: loads.team_rows(t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("team"), F.concat(F.lit(" N"), F.col("n_nationkey").cast("string")).alias("short_name"), F.upper("r_name").alias("conference"), F.lit("Town").alias("city"), F.lit("").alias("state"),
        F.array().cast("array<string>").alias("team_name_aliases")), t).select("name", "short_name", "conference_id", "city"))
query("s3_team_json_scan", "select n_name as team, cast(n_nationkey * 10000 + 1998 as varchar) as outside_id, 2 as n_aliases from nation")(lambda t: _team_json(t))


def _team_json(t):
    import uuid

    from matchlens.session import shared_dir

    path = f"{shared_dir(t.spark)}/json-{uuid.uuid4().hex}"
    ids = F.create_map(F.lit("1998"), (F.col("id") * 10000 + 1998).cast("string"))
    t.teams.select(F.col("name").alias("team"), "short_name", F.col("aliases").alias("team_name_aliases"), ids.alias("ncaa_team_ids")).write.json(path)
    return t.spark.read.schema(files.TEAM_JSON).json(path).select("team", files.season_id(1998).alias("outside_id"), F.size("team_name_aliases").alias("n_aliases"))


query("s4_conference_logos", "select id, name, case when id <> 2 then concat(lower(name), '.svg') end as logo from conferences")(
    lambda t: files.with_logos(t.conferences, files.logos(t.region.select(F.concat(
        F.lit('{"'), F.col("r_name"), F.lit('": {"logo": "'), F.when(F.col("r_regionkey") == 2, " ").otherwise(F.concat(F.lower("r_name"), F.lit(".svg"))), F.lit('"}}')).alias("j")), "j")).select("id", "name", "logo"))
_nkey = _key("regexp_replace(school, ' \\([0-9]+\\)$', '')")
query("c20_rpi_enrichment", f"""select t.id, case when r.rank_no is not null then r.rank_no else t.rpi_rank end as rpi_rank, case when r.rank_no is not null then r.record else t.rpi_record end as rpi_record from teams t
    left join (select k.id, r.* from rank_table r join o_team_key k on k.k = {_key('school')}) r on r.id = t.id""")(
    lambda t: loads.enrich_ranks(t, t.rank_table.withColumnsRenamed({"rank_no": "RPI Rank", "school": "School", "record": "Record"}), "rpi").select("id", "rpi_rank", "rpi_record"))
query("c20_poll_enrichment", f"select t.id, r.rank_no as avca_rank from teams t left join (select k.id, r.rank_no from rank_table r join o_team_key k on k.k = {_nkey}) r on r.id = t.id")(
    lambda t: loads.enrich_ranks(t, t.rank_table.withColumnsRenamed({"rank_no": "Rank", "school": "Institution"}), "avca").select("id", "avca_rank"))
query("c21_season_memberships", f"select s.team_id, s.season, coalesce({_label_id}, s.conference_id) as conference_id from team_season_ids s join membership m on m.team_id = s.team_id and m.season = s.season")(
    lambda t: loads.season_memberships(t, t.membership.select("season", "ncaa_team_id", "label")).select("team_id", "season", "conference_id"))
query("s14_snapshot_ranks", """select season, as_of, team_id, rpi_rank, avca_rank from ranking_snapshots where as_of <> date '1998-05-01' or team_id not in (select id from teams where rpi_rank is not null or avca_rank is not null)
    union all select 1998, date '1998-05-01', id, rpi_rank, avca_rank from teams where rpi_rank is not null or avca_rank is not null""")(
    lambda t: merge.snapshot_ranks(t.ranking_snapshots, t.teams, 1998, "1998-05-01").select("season", "as_of", "team_id", "rpi_rank", "avca_rank"))
query("s15_poll_archive", """select s.season, s.as_of, s.team_id, s.rpi_rank, coalesce(p.avca_rank, s.avca_rank) as avca_rank from ranking_snapshots s left join polls p on p.season = s.season and p.as_of = s.as_of and p.team_id = s.team_id and p.slug_no = 1""")(
    lambda t: merge.archive_polls(t.ranking_snapshots, t.polls).select("season", "as_of", "team_id", "rpi_rank", "avca_rank"))
query("s16_refresh_season_totals", "select player_id, season, team_id, gp, kills, hit_pct from o_season_rates")(lambda t: _refreshed(t))


def _refreshed(t):
    """A season view through insertions, changes and deletions of matches, reading only what changed."""
    box = t.player_game_stats
    digit = F.pmod(F.xxhash64("contest_id"), F.lit(10))
    # At first a tenth of the matches is missing, a tenth has other figures, and some are there that go later.
    wrong = box.filter(digit == 1).withColumns({"kills": F.col("kills") + 3, "errors": F.lit(None).cast("double")})
    bogus = box.filter(digit == 2).withColumn("contest_id", F.concat(F.lit("gone "), "contest_id"))
    table = stored(t, box.filter("1 = 0"), ["contest_id"])
    view = SeasonView(t.spark, _fresh(t, "season"), table, buckets=16)
    table.replace_all(box.filter(digit > 1).unionByName(wrong).unionByName(bogus))
    view.refresh()
    merge.replace_stored(table, box.filter(digit < 2), ["contest_id"])
    view.refresh()
    table.merge(bogus, lambda old, new: old.join(new.select("contest_id").distinct(), "contest_id", "left_anti").select(*old.columns))
    view.refresh()
    return view.read().select("player_id", "season", "team_id", "gp", "kills", "hit_pct")


def _fresh(t, name):
    import uuid

    from matchlens.session import shared_dir

    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def stored(t, df, by, buckets=16):
    """A versioned table that holds these rows."""
    table = VersionedTable(t.spark, _fresh(t, "table"), df.schema, by, buckets)
    table.replace_all(df)
    return table


query("s6_checked_append", "select contest_id, season, seq from pbp_events")(lambda t: _appended(t))


def _appended(t):
    import uuid

    from matchlens.session import shared_dir

    path = f"{shared_dir(t.spark)}/append-{uuid.uuid4().hex}"
    rows = t.pbp_events.select("contest_id", "season", "seq")
    files.append_checked(rows.filter("seq % 2 = 0"), path)
    files.append_checked(rows.filter("seq % 2 = 1"), path)
    return t.spark.read.parquet(path)


# --- outside ids -----------------------------------------------------------------------------------
def _listed_games(t):
    return t.listed_games.withColumns({"seonames": F.split("seonames", r"\|"), "name_shorts": F.split("name_shorts", r"\|")})


shared(
    o_pair_game="""select season, substr(date, 1, 10) as day, least(home_team_id, away_team_id) as a, greatest(home_team_id, away_team_id) as b, max(concat('n', contest_id)) as gid from contests where date is not null and date <> 'TBD-not-a-date' group by all""",
    o_et="""select ncaa_game_id, case when hour(e) = 0 and minute(e) = 0 then null else strftime(e, '%I:%M %p') end as et from (select ncaa_game_id, timezone('America/New_York', to_timestamp(start_epoch)) as e from listed_games) g""",
)
query("c15_map_contests", "select k.contest_id, coalesce(g.gid, k.ncaa_game_id) as ncaa_game_id from contests k left join o_pair_game g on g.season = k.season and g.day = substr(k.date, 1, 10) and g.a = least(k.home_team_id, k.away_team_id) and g.b = greatest(k.home_team_id, k.away_team_id)")(
    lambda t: loads.map_games(t, _listed_games(t))[0].select("contest_id", "ncaa_game_id"))
query("c15_map_schedule", """select s.contest_id, s.team_id, coalesce(e.et, s.game_time) as game_time, case when e.et is not null and e.et is distinct from s.game_time then case when coalesce(s.game_time, '') in ('', '12:00 AM') then 'filled' else 'corrected' end end as time_change
    from schedule s left join o_pair_game g on g.season = s.season and g.day = s.date and g.a = least(s.team_id, s.opponent_team_id) and g.b = greatest(s.team_id, s.opponent_team_id) and s.opponent_team_id is not null left join o_et e on e.ncaa_game_id = g.gid""")(
    lambda t: loads.map_games(t, _listed_games(t))[1].select("contest_id", "team_id", "game_time", "time_change"))
