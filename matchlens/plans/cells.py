"""Readers of staged cells over whole tables.

Each query writes a table's own values the ways a staged file spells them, reads the cells, and must
give the values back; the check queries look at the values alone.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from matchlens.functions import networks, parse, text
from matchlens.plans.catalog import query


def _cells(df, cell: str, *keep: str):
    return df.select(*keep, F.expr(cell).alias("cell"))


_class = """case class_year
  when 'Fr' then case id % 4 when 0 then 'Freshman' when 1 then 'fr.' when 2 then '  First  Year' else 'FY' end
  when 'R-So' then case id % 3 when 0 then 'Redshirt Sophomore' when 1 then 'r so' else 'RS - Redshirt Soph.' end
  when 'Jr' then case id % 2 when 0 then 'JUNIOR' else 'Jr' end else case id % 2 when 0 then 'Senior' else 'sr.' end end"""
query("n7_class_of_players", "select id as player_id, class_year as code from players")(
    lambda t: _cells(t.players, _class, "id").select(F.col("id").alias("player_id"), text.normalize_class("cell").alias("code")))

_height = """case id % 5 when 0 then concat(h div 12, '-', h % 12) when 1 then concat(h div 12, "'", h % 12, '"') when 2 then concat(h div 12, ' ', h % 12)
  when 3 then concat(' ', h div 12, "' ", h % 12, ' in') else concat(h div 12, '’', h % 12) end"""
query("n10_heights_of_players", """select id as player_id, case when height_inches is null then '' else concat(height_inches // 12, '-', height_inches % 12) end as height, height_inches as inches from players""")(
    lambda t: _cells(t.players.withColumn("h", F.col("height_inches")), _height, "id").select(
        F.col("id").alias("player_id"), text.normalize_height("cell").alias("height"), text.height_inches("cell").alias("inches")))

_position = """case position when 'S' then 'Setter' when 'OH' then 'Outside Hitter' when 'MB' then 'Middle  Blocker' when 'L/DS' then 'Libero/DS' when 'OH/RS' then 'OH, Right Side'
  else 'Defensive Specialist' end"""
query("n11_positions_of_players", """select id as player_id, case position when 'S' then 'S' when 'OH' then 'OH' when 'MB' then 'MB' when 'OH/RS' then 'OH,RS' else 'DS' end as codes from players""")(
    lambda t: _cells(t.players, _position, "id").select(F.col("id").alias("player_id"), F.array_join(text.position_codes("cell"), ",").alias("codes")))

_amount = """case o_orderkey % 6 when 0 then concat(' ', case when n >= 1000 then concat(n div 1000, ',', lpad(cast(n % 1000 as string), 3, '0')) else cast(n as string) end) when 1 then concat(n, '.0') when 2 then '-' when 3 then 'nan' when 4 then '' else cast(n as string) end"""
query("n12_amounts_of_orders", """select o_orderkey, case when o_orderkey % 6 in (0, 1, 5) then cast(floor(o_totalprice) as double) end as num, case when o_orderkey % 6 in (0, 1, 5) then cast(floor(o_totalprice) as bigint) end as whole
    from orders""")(
    lambda t: _cells(t.orders.withColumn("n", F.floor("o_totalprice").cast("bigint")), _amount, "o_orderkey").select(
        "o_orderkey", text.num("cell").alias("num"), text.num_int("cell").alias("whole")))

_title = """concat(case fno % 5 when 0 then 'ESPN+ 45: ' when 1 then "Women's College Volleyball: " when 2 then 'College Volleyball: ' else '' end, a,
  case fno % 4 when 0 then ' vs. ' when 1 then ' at ' when 2 then ' vs ' else ' - ' end, b, case fno % 3 when 0 then ' Fri' when 1 then ' @ Main Hall' else '' end)"""


def _pairs(t):
    name = lambda side: t.teams.select(F.col("id").alias(f"{side}_id"), F.col("name").alias(side))
    games = t.contests.select(F.col("contest_id").cast("bigint").alias("fno"), F.col("away_team_id").alias("a_id"), F.col("home_team_id").alias("b_id"))
    return games.join(name("a"), "a_id").join(name("b"), "b_id")


query("n16_titles_of_contests", "select cast(k.contest_id as bigint) as fno, a.name as team_a, h.name as team_b from contests k join teams a on a.id = k.away_team_id join teams h on h.id = k.home_team_id")(
    lambda t: _cells(_pairs(t), _title, "fno").select("fno", networks.clean_title("cell").alias("c")).select("fno", networks.matchup("c").alias("m")).select("fno", "m.team_a", "m.team_b"))

_opponent = """concat(case when site = 'away' then '@ ' when site = 'neutral' then '' else ' ' end, case when team_id % 3 = 0 then concat('#', team_id, ' ') else '' end, opponent_name,
  case when team_id % 4 = 0 then ' (Exh)' else '' end, case when site = 'neutral' then concat(' @', neutral_location) else '' end)"""
query("n17_opponents_of_schedule", """select contest_id, team_id, site, case when site = 'neutral' and team_id % 4 = 0 then opponent_name else opponent_name end as opponent, case when site = 'neutral' then neutral_location end as location from schedule""")(
    lambda t: _cells(t.schedule, _opponent, "contest_id", "team_id").select("contest_id", "team_id", parse.opponent_cell("cell").alias("o")).select("contest_id", "team_id", "o.*"))

_voted = """concat(case c_custkey % 4 when 0 then '#5 ' when 1 then 'No. 12 ' when 2 then '(3) ' else '' end, c_name, case c_custkey % 3 when 0 then ' (57)' when 1 then ' [3]' else '' end)"""
query("n18_ranks_of_customers", "select c_custkey, c_name as name from customer")(
    lambda t: _cells(t.customer, _voted, "c_custkey").select("c_custkey", text.strip_rank_prefix(text.strip_vote_suffix("cell")).alias("name")))

_scores = """concat('{"away":[', 10 + o_orderkey % 16, ',', 11 + o_custkey % 15, case when o_orderkey % 3 = 0 then ',null' else ',15' end, '],"home":[25,', 20 + o_orderkey % 6,
  case when o_orderkey % 3 = 0 then ',null' else ',9' end, ']}')"""
query("n19_sets_of_orders", """select o_orderkey, concat(10 + o_orderkey % 16, ',', 11 + o_custkey % 15, case when o_orderkey % 3 = 0 then '' else ',15' end) as away,
    concat('25,', 20 + o_orderkey % 6, case when o_orderkey % 3 = 0 then '' else ',9' end) as home from orders""")(
    lambda t: _cells(t.orders, _scores, "o_orderkey").select("o_orderkey", parse.set_scores("cell").alias("s")).select("o_orderkey", parse.played_sets(F.col("s.away"), F.col("s.home")).alias("p")).select(
        "o_orderkey", F.array_join("p.away", ",").alias("away"), F.array_join("p.home", ",").alias("home")))

_starters = """concat(p_type, case p_partkey % 2 when 0 then ' starters: ' else ' Starters:  ' end, p_name, case p_partkey % 3 when 0 then '; ' else ' , ' end, p_brand, '; ', p_type, '.')"""
query("n20_starters_of_parts", "select p_partkey, concat(p_name, ',', p_brand, ',', p_type) as names from part")(
    lambda t: _cells(t.part, _starters, "p_partkey").select("p_partkey", F.array_join(parse.starter_names("cell"), ",").alias("names")))

_play = """case touch_type when 'serve' then concat(player_name, ' serves') when 'terminal' then concat('First ball kill by ', player_name) else concat(upper(substr(touch_type, 1, 1)), substr(touch_type, 2, 20), ' by ', player_name) end"""
query("p14_texts_of_events", """select contest_id, set_number, seq, touch_type as touch, case when touch_type = 'terminal' then 'kill' end as outcome, player_name as player from pbp_events
    where player_name is not null and touch_type in ('serve', 'reception', 'set', 'attack', 'dig', 'block', 'terminal')""")(
    lambda t: _cells(t.pbp_events.filter("player_name is not null and touch_type in ('serve', 'reception', 'set', 'attack', 'dig', 'block', 'terminal')"), _play, "contest_id", "set_number", "seq", "touch_type").select(
        "contest_id", "set_number", "seq", parse.play_kind("cell", F.col("touch_type") == "terminal").alias("p")).select("contest_id", "set_number", "seq", "p.touch", "p.outcome", "p.player"))

# The channel of a programme, written by table values: two networks with numbers, a local station, none.
_channel = """case o_orderkey % 6 when 0 then concat('ESPN+ ', o_custkey) when 1 then concat('ESPN', 1 + o_orderkey % 2) when 2 then concat('AL | Birmingham | FOX ', o_custkey % 90 + 1, ' WBRC')
  when 3 then concat('www.host', o_custkey, '.com') when 4 then '  ACCNX ' else concat('channel of ', o_orderpriority) end"""
query("n15_channels_of_orders", """select o_orderkey, case o_orderkey % 6 when 0 then 'ESPN+' when 1 then case o_orderkey % 2 when 1 then 'ESPN2' else 'ESPN' end when 2 then 'FOX' when 3 then 'Web stream' when 4 then 'ACC Network Extra' end as label from orders""")(
    lambda t: networks.with_network(_cells(t.orders, _channel, "o_orderkey"), "cell", "label", "logo").select("o_orderkey", "label"))
