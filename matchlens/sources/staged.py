"""Staged inputs of the loads, derived from the test data: messy names, feeds, files to merge.

Texts are plain SQL shared with the check queries. ``vocab`` columns take their value from a fixed
list by row number, so that hand-worked answers exist for every value.
"""

from __future__ import annotations

# Sample cells of staged files.
CHANNELS = (
    "ESPN+ 45: A vs B", "ESPN2", "espnu hd", "espn.com", "ESPN 1", "ESPNews", "ACCNX", "ACC Network", "SEC Network+", "SECN",
    "BTN", "B1G+", "FS1", "FOX Sports", "AL | Birmingham | FOX 6 WBRC", "CBS 2 KCBS", "CBS Sports Network", "Disney+ Events 3",
    "uconnhuskies.com", "some local channel", "THE CW 12", "Peacock", "watch.themw.com", "FloSports", "SiriusXM radio", "YouTube",
)
CLASSES = (
    "Freshman", "Redshirt Sophomore", "R-Fr", "Junior", "sr.", "Grad", "5th year", "First Year", "rfr", "", "Staff", "r so", "FY", "Redshirt  Senior",
)
HEIGHTS = ("6-2", "6'2", "5-11", "6 2", "7", "6-13", "", "5' 9", "3-2", "6-0")
POSITIONS = (
    "OH/RS", "Setter", "Head Coach", "L/DS", "Middle Blocker", "Opposite/Setter", "Utility", "Left Side", "lib", "", "MB, OH", "S", "Right Side",
    "Graduate Assistant", "Opp/Middle",
)
NUMBERS = ("12", "0.091", "", "nan", "-", "1,234", "5.0", "abc", " 7 ", "/", "None")
CELLS = ("@ Nebraska", "#5 Ohio St.", "Penn St. @Las Vegas, NV", "@ #12 Texas (Exh)", "RV Utah", "Iowa @", "  Duke  ", "NR Rice @Hall (A)")
TITLES = (
    "ESPN+ 45: Ohio vs. Iowa", "Women's College Volleyball: Ohio at Iowa", "Volleyball (W) Ohio @ Iowa", "Ohio - Iowa (Big Ten Network)",
    "Flo Sports 12: College Volleyball: #5 Ohio vs Iowa Fri", "Miami (OH) at Iowa", "Showcase - Ohio v. Iowa", "no match here", "NCAA Women's Volleyball: Ohio — Iowa",
)
PLAYS = (
    "Ann Lee serves to Bea Roe", "Ann Lee serves", "Reception by Bea Roe", "Set by Cat Poe", "Attack by Dee Moe", "Dig by Eve Noe", "Block by Fay Joe",
    "Sub in Gia Koe", "Sub out Gia Koe", "Timeout Ohio", "Set started", "Media challenge", "First ball kill by Dee Moe", "Attack error by Dee Moe",
    "Ann Lee serves an ace", "Service error by Ann Lee", "Block error by Fay Joe", "Ball handling error by Cat Poe", "Point awarded",
)
STARTER_LINES = ("Ohio starters: Ann Lee; Bea Roe; Cat Poe.", "Iowa Starters: Dee Moe, Eve Noe , Fay Joe", "no line", "Ohio starters: A. B.;; C")
VOTED = ("Nebraska (57)", "Texas [3]", "Miami (OH)", "#5 Ohio", "No. 12 Iowa", "(3) Utah", "Plain")
SCORES = ('[25,20,15]|[20,25,13]', '[25,null,null]|[20,25,null]', '[]|[]', '[25,25,25,null]|[10,11,12,null]')


def _pick(number: str, values: tuple[str, ...]) -> str:
    quoted = [f"when {i} then concat({', chr(39), '.join(repr_sql(p) for p in v.split(chr(39)))})" for i, v in enumerate(values)]
    return f"case {number} % {len(values)} {' '.join(quoted)} end"


def repr_sql(text: str) -> str:
    return "'" + text + "'"


STAGED: dict[str, str] = {
    "messy_names": """
        select p_partkey, case p_partkey % 6 when 0 then concat(split_part(p_name, ' ', 2), ', ', split_part(p_name, ' ', 1))
          when 1 then concat(cast(p_partkey % 50 as string), ' ', p_name) when 2 then concat('  ', upper(p_name), '   jr ')
          when 3 then concat('José ', p_name, ' O', chr(39), 'Neil-', split_part(p_name, ' ', 1))
          when 4 then concat('San JosÃ© ', p_name) else concat('The University of ', p_name, ' St.') end as raw
        from {part}""",
    "vocab": f"""
        select s_suppkey as k, {_pick('s_suppkey', CHANNELS)} as channel, {_pick('s_suppkey', CLASSES)} as class_text,
          {_pick('s_suppkey', HEIGHTS)} as height_text, {_pick('s_suppkey', POSITIONS)} as position_text, {_pick('s_suppkey', NUMBERS)} as number_text,
          {_pick('s_suppkey', CELLS)} as cell, {_pick('s_suppkey', TITLES)} as title, {_pick('s_suppkey', PLAYS)} as play,
          {_pick('s_suppkey', STARTER_LINES)} as starters, {_pick('s_suppkey', VOTED)} as voted, {_pick('s_suppkey', SCORES)} as scores
        from {{supplier}}""",
    "feeds": f"""
        select k.season, k.fno as feed_no, k.src as source_rank,
          concat(case when k.fno % 3 = 0 then '#5 ' else '' end, lower(h.name)) as team_a, concat('The ', a.name, ' University') as team_b,
          case when k.fno % 7 <> 0 then substr(cast(cast(k.day as date) + (cast(k.fno % 4 as int) - 1) * interval 1 day as string), 1, 10) end as date,
          {_pick('k.fno', CHANNELS)} as network_raw, case k.src when 0 then 'ics' when 1 then 'playlist' else 'epg' end as source,
          (k.fno + k.src) % 2 = 0 as is_live, cast(concat(k.day, ' 18:00:00') as timestamp) as start_utc,
          case when k.src = 1 then cast(k.fno % 90 as string) end as channel_no
        from (select season, home_team_id, away_team_id, substr(date, 1, 10) as day, cast(contest_id as bigint) as fno, cast(cast(contest_id as bigint) % 3 as int) as src
              from {{contests}} where date is not null and date <> 'TBD-not-a-date') k
        join {{teams}} h on h.id = k.home_team_id join {{teams}} a on a.id = k.away_team_id""",
    "listed_games": """
        select k.season, concat('n', k.contest_id) as ncaa_game_id, substr(k.date, 1, 10) as date,
          concat(replace(lower(a.name), '_', '-'), '|', replace(lower(h.name), '_', '-')) as seonames,
          concat(a.short_name, '|', case when cast(k.contest_id as bigint) % 9 = 0 then 'Elsewhere' else h.short_name end) as name_shorts,
          cast(946684800 + cast(k.contest_id as bigint) * 1800 as bigint) as start_epoch,
          case cast(k.contest_id as bigint) % 3 when 0 then 'live' when 1 then 'final' else 'pre' end as game_state,
          cast(cast(k.contest_id as bigint) % 4 as int) as home_sets_won, cast(cast(k.contest_id as bigint) % 3 as int) as away_sets_won, 'SET 2' as current_period
        from {contests} k join {teams} h on h.id = k.home_team_id join {teams} a on a.id = k.away_team_id
        where k.date is not null and k.date <> 'TBD-not-a-date'""",
    "game_points": """
        select ncaa_game_id, start_epoch - 60 as at_epoch,
          concat('25|', cast(18 + home_sets_won as string), '|', cast(start_epoch / 1800 % 15 as int)) as home_points, concat('20|25|', cast(away_sets_won as string)) as visit_points
        from {listed_games} where home_sets_won <> 3
        union all select ncaa_game_id, start_epoch - 120, '25', '20' from {listed_games} where home_sets_won <> 3""",
    "staged_box": """
        select cast(p.team_id as string) as TeamID, p.season as Season, p.contest_id as ContestID,
          case when p.player_id % 37 = 0 then '999999999' else cast(p.player_id as string) end as PlayerID, concat('P', cast(p.player_id as string)) as Name,
          case when k.date is null then '' else k.date end as Date,
          cast(k.home_team_id * 10000 + k.season as string) as HomeTeamNcaaId, cast(k.away_team_id * 10000 + k.season as string) as AwayTeamNcaaId,
          case when k.home_sets_won is null then '' else cast(k.home_sets_won as string) end as HomeSetsWon,
          case when k.away_sets_won is null then '' else cast(k.away_sets_won as string) end as AwaySetsWon, '' as SetScores,
          cast(p.sets as string) as S, cast(p.kills as string) as Kills, case when p.assists is null then '-' else cast(p.assists as string) end as Assists,
          case when p.aces is null then 'nan' else cast(p.aces as string) end as Aces
        from {player_game_stats} p join {contests} k on k.contest_id = p.contest_id""",
    "stale_box": """
        select contest_id, player_id, team_id, season, sets, kills + 100 as kills, errors, total_attacks, assists, aces, serr, digs, retatt, rerr,
          block_solos, block_assists, berr, pts, bhe
        from {player_game_stats} where cast(contest_id as bigint) % 2 = 0 or player_id % 37 = 0""",
    "stale_contests": """
        select contest_id, season, case when cast(contest_id as bigint) % 3 = 0 then 'old' else date end as date,
          case when cast(contest_id as bigint) % 5 <> 0 then home_team_id end as home_team_id, away_team_id, home_sets_won, cast(null as int) as away_sets_won
        from {contests} where cast(contest_id as bigint) % 2 = 0""",
    "staged_pbp": """
        select e.contest_id as ContestID, e.season as Season, e.set_number as SetNo, e.rally_number as Rally, e.seq as Seq, e.touch_type as TouchType,
          r.name as PlayerName, case when e.team_id = k.home_team_id then 'home' else 'away' end as Side, e.is_terminal as IsTerminal, e.terminal_type as TerminalType,
          case when e.scoring_team_id is null then null when e.scoring_team_id = k.home_team_id then 'home' else 'away' end as ScoringSide,
          e.away_score as AwayScore, e.home_score as HomeScore, cast(k.away_team_id * 10000 + k.season as string) as AwayNcaaId,
          cast(k.home_team_id * 10000 + k.season as string) as HomeNcaaId, concat('Hall ', e.contest_id) as Location, cast(cast(e.contest_id as bigint) % 500 as int) as Attendance
        from {pbp_events} e join {contests} k on k.contest_id = e.contest_id left join {players} r on r.id = e.player_id and r.season = e.season""",
    "staged_roster": f"""
        select cast(team_id * 10000 + season as string) as TeamID, season as Season, case when id % 19 <> 0 then cast(id as string) end as PlayerID, name as Player,
          cast(number as string) as Number, {_pick('id', POSITIONS)} as Pos, {_pick('id', CLASSES)} as Yr, {_pick('id', HEIGHTS)} as Ht, hometown as Hometown, high_school as HighSchool
        from {{players}}""",
    "staged_schedule": """
        select season as Season, cast(team_id * 10000 + season as string) as TeamNcaaId, date as Date, case when length(contest_id) % 2 = 0 then '12:00 AM' else '08:15 PM' end as Time,
          case when opponent_team_id % 2 = 0 then concat('nation ', cast(opponent_team_id as string)) else opponent_name end as OpponentName,
          case when opponent_team_id % 3 = 0 then cast(opponent_team_id * 10000 + season as string) end as OpponentNcaaId,
          site as Site, neutral_location as NeutralLocation, '' as ResultRaw, case when cast(contest_id as bigint) % 3 = 0 then '' else contest_id end as ContestId
        from {schedule} where (team_id + season) % 4 <> 0""",
    "membership": """
        select team_id, season, ncaa_team_id, case team_id % 6 when 0 then 'AFRICA' when 1 then 'AME' when 2 then 'Big Ten' when 3 then ' EUROPE ' when 4 then '' else 'ASIA' end as label
        from {team_season_ids}""",
    "harvest": """
        select ncaa_team_id as outside_id, season, case when team_id % 4 = 0 then concat('Nat', chr(39), 'l Sch. ', cast(team_id as string)) when team_id % 4 = 1 then concat('the nation ', cast(team_id as string), ' college')
          when team_id % 4 = 2 then concat('N-', cast(team_id as string)) else concat('Unknown ', cast(team_id as string)) end as name
        from {team_season_ids}""",
    "rank_table": """
        select n_nationkey + 1 as rank_no, case when n_nationkey % 3 = 0 then concat('The ', n_name, ' University') else concat(n_name, ' (', cast(n_nationkey as string), ')') end as school,
          concat(cast(n_nationkey as string), '-2') as record
        from {nation} where n_nationkey % 2 = 0""",
    "polls": """
        select season, as_of, slug_no, team_id, cast((team_id * 3 + slug_no) % 25 + 1 as int) as avca_rank
        from (select season, as_of, team_id, 1 as slug_no from {ranking_snapshots} union all select season, as_of, team_id, 2 from {ranking_snapshots} where team_id % 2 = 1) p
        where team_id % 3 <> 0""",
    "asked_names": """
        select season, team_id, id as true_id, case id % 7 when 0 then name when 1 then concat(split_part(name, ' ', 2), ' ', split_part(name, ' ', 1), ' ', split_part(name, ' ', 3))
          when 2 then concat(substr(name, 1, 1), 'ella ', split_part(name, ' ', 3)) when 3 then concat('Zed ', split_part(name, ' ', 3)) when 4 then concat(name, ' Borges')
          when 5 then concat('Nobody', cast(id as string), ' Known') else upper(concat(split_part(name, ' ', 1), '. ', split_part(name, ' ', 2), '-', split_part(name, ' ', 3))) end as name
        from {players}""",
    "photo_hits": """
        select season, team_id, id as true_id, number as jersey, case when id % 3 = 0 then concat(split_part(name, ' ', 3), ' ', split_part(name, ' ', 2), ' ', split_part(name, ' ', 1)) else concat('Someone ', cast(id as string)) end as name
        from {players}""",
    "second_source": """
        select case when team_id % 11 = 5 then concat('X', ncaa_team_id) else ncaa_team_id end as outside_id, season, concat('T', cast(team_id as string)) as team, case when team_id % 11 = 0 then 'Zeta' else concat('League ', cast(coalesce(conference_id, team_id % 5) as string)) end as conference
        from {team_season_ids} where team_id % 13 <> 0""",
}
