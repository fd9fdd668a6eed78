"""Text normalisation over whole document texts, messy names and staged cells.

Cells come from fixed lists, so their answers are worked out by hand here.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from matchlens.constants import SCHOOL_STOP_WORDS
from matchlens.functions import networks, parse, text
from matchlens.operators.people import height_text
from matchlens.operators.schedule import clock_minutes, slate_day, sort_minutes
from matchlens.plans.catalog import query, shared
from matchlens.sources.staged import (
    CELLS, CHANNELS, CLASSES, HEIGHTS, NUMBERS, PLAYS, POSITIONS, SCORES, STARTER_LINES, TITLES, VOTED,
)

_stop = ", ".join(f"'{w}'" for w in SCHOOL_STOP_WORDS)


def _digest(expr):
    return lambda t: t.documents.select("doc_id", expr("text").alias("x")).select("doc_id", F.length("x").alias("n"), F.md5("x").alias("digest"))


def _answers(values: tuple, answers: tuple, cols: list[str]) -> str:
    """Row number → hand-worked answer, as a VALUES list."""
    lit = lambda v: "null" if v is None else str(v) if isinstance(v, int) else f"{v}::double" if isinstance(v, float) else "'" + str(v).replace("'", "''") + "'"
    assert len(values) == len(answers), (len(values), len(answers))
    rows = ", ".join(f"({i}, {', '.join(lit(v) for v in (a if isinstance(a, tuple) else (a,)))})" for i, a in enumerate(answers))
    return f"select s_suppkey as k, {', '.join(cols)} from supplier join (values {rows}) a(i, {', '.join(cols)}) on a.i = s_suppkey % {len(values)}"


# Spaces only here: the documents hold no other white space than blanks and line ends.
shared(
    o_flat="select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as x from documents",
    o_folded="select doc_id, lower(trim(regexp_replace(strip_accents(text), '\\s+', ' ', 'g'))) as x from documents",
)
_digest_sql = "select doc_id, length(x) as n, md5(x) as digest from "
query("n1_normalize_text", _digest_sql + "o_flat")(_digest(text.normalize_text))
query("n3_school_key_documents", _digest_sql + f"(select doc_id, array_to_string(list_filter(string_split(regexp_replace(x, '[^a-z0-9 ]', ' ', 'g'), ' '), lambda w: w <> '' and w not in ({_stop})), ' ') as x from o_folded) d")(
    _digest(text.school_key))
query("n4_slug_documents", _digest_sql + "(select doc_id, regexp_replace(trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g')), ' +', '-', 'g') as x from o_folded) d")(_digest(text.school_slug))
query("n5_canonical_words_documents", _digest_sql + "(select doc_id, array_to_string(list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(x), '[^a-z ]', ' ', 'g'), ' '), lambda w: w <> ''))), ' ') as x from o_flat) d")(
    _digest(text.canonical_name))
query("n9_strip_accents_documents", _digest_sql + "(select doc_id, strip_accents(text) as x from documents) d")(_digest(text.strip_accents))
_strange = "Ștefan Popescu, Nguyễn Thị Ánh, Ḩāḇ, café, ÅÆø ñandú"
query("n9_strip_accents_any_script", _digest_sql + f"(select doc_id, strip_accents(concat('{_strange} e', chr(769), 'o', chr(803), chr(770), ' ', text)) as x from documents) d")(
    lambda t: _digest(text.strip_accents)(t.replace(documents=t.documents.withColumn("text", F.concat(F.lit(f"{_strange} e\u0301o\u0323\u0302 "), "text")))))
query("n8_fix_mojibake", "select p_partkey, replace(raw, 'JosÃ©', 'José') as fixed from messy_names")(lambda t: t.messy_names.select("p_partkey", text.fix_mojibake("raw").alias("fixed")))
query("n2_player_name", """select p_partkey, case when len(parts) = 2 then concat_ws(' ', trim(parts[2]), trim(parts[1])) else x end as name
    from (select p_partkey, x, string_split(x, ',') as parts from (select p_partkey, trim(regexp_replace(regexp_replace(raw, '\\b[0-9]+\\b', '', 'g'), '\\s+', ' ', 'g')) as x from messy_names) a) b""")(
    lambda t: t.messy_names.select("p_partkey", text.normalize_player_name("raw").alias("name")))
query("n3_school_key_names", f"""select p_partkey, array_to_string(list_filter(string_split(regexp_replace(lower(strip_accents(replace(raw, 'JosÃ©', 'José'))), '[^a-z0-9 ]', ' ', 'g'), ' '), lambda w: w <> '' and w not in ({_stop})), ' ') as k
    from messy_names""")(lambda t: t.messy_names.select("p_partkey", text.school_key("raw").alias("k")))
query("n6_name_keys", """select p_partkey, x as plain, array_to_string(list_sort(list_distinct(w)), ' ') as tokens, case when len(w) >= 2 then concat(left(w[1], 1), ' ', w[-1]) end as initial,
    case when len(w) >= 2 then w[-1] end as last from (select p_partkey, x, list_filter(string_split(x, ' '), lambda v: v <> '') as w from (
      select p_partkey, trim(regexp_replace(regexp_replace(lower(strip_accents(replace(raw, 'JosÃ©', 'José'))), '[.''`’]', '', 'g'), '[^a-z0-9]+', ' ', 'g')) as x from messy_names) a) b""")(
    lambda t: t.messy_names.select("p_partkey", text.plain_name("raw").alias("plain")).select(
        "p_partkey", "plain", F.array_join(text.name_tokens("plain"), " ").alias("tokens"), text.initial_and_surname("plain").alias("initial"), text.surname("plain").alias("last")))

query("n7_class_codes", _answers(CLASSES, ("Fr", "R-So", "R-Fr", "Jr", "Sr", "Gr", "Fifth", "Fr", "R-Fr", "", "", "R-So", "Fr", "R-Sr"), ["code"]))(
    lambda t: t.vocab.select("k", text.normalize_class("class_text").alias("code")))
query("n10_heights", _answers(HEIGHTS, (("6-2", 74), ("6-2", 74), ("5-11", 71), ("6-2", 74), ("", None), ("", None), ("", None), ("5-9", 69), ("", None), ("6-0", 72)), ["height", "inches"]))(
    lambda t: t.vocab.select("k", text.normalize_height("height_text").alias("height"), text.height_inches("height_text").alias("inches")))
query("n10_height_text", "select player_id, case when height_inches is not null then concat(height_inches // 12, '-', height_inches % 12) end as height from o_roster")(
    lambda t: t.players.select(F.col("id").alias("player_id"), height_text("height_inches").alias("height")))
query("n11_position_codes", _answers(POSITIONS, ("OH,RS", "S", "", "DS", "MB", "RS,S", "DS,OH", "OH", "DS", "", "MB,OH", "S", "RS", "", "MB,RS"), ["codes"]))(
    lambda t: t.vocab.select("k", F.array_join(text.position_codes("position_text"), ",").alias("codes")))
query("n12_numbers", _answers(NUMBERS, ((12.0, 12, "12"), (0.091, 0, "0.091"), (None, None, None), (None, None, "nan"), (None, None, "-"), (1234.0, 1234, "1,234"), (5.0, 5, "5.0"),
                                        (None, None, "abc"), (7.0, 7, "7"), (None, None, "/"), (None, None, "None")), ["num", "whole", "cell"]))(
    lambda t: t.vocab.select("k", text.num("number_text").alias("num"), text.num_int("number_text").alias("whole"), text.clean_str("number_text").alias("cell")))
_written = """concat(cast(month(o_orderdate) as {s}), '/', cast(day(o_orderdate) as {s}), '/', cast(year(o_orderdate) as {s}), case o_orderkey % 4 when 0 then '  07:05 PM' when 1 then ' 12:30 am' when 2 then '' else ' 99:99 PM' end)"""
query("n13_league_datetime", """select o_orderkey, concat(strftime(o_orderdate, '%Y-%m-%d'), case o_orderkey % 4 when 0 then ' 19:05' when 1 then ' 00:30' else '' end) as at from orders""")(
    lambda t: t.orders.select("o_orderkey", F.expr(_written.replace("{s}", "string")).alias("w")).select("o_orderkey", parse.league_datetime("w").alias("at")))
query("n14_eastern_time", """select ncaa_game_id, case when hour(e) = 0 and minute(e) = 0 then null else strftime(e, '%I:%M %p') end as et
    from (select ncaa_game_id, timezone('America/New_York', to_timestamp(start_epoch)) as e from listed_games) g""")(
    lambda t: t.listed_games.select("ncaa_game_id", parse.eastern_time("start_epoch").alias("et")))
query("n14_time_unset", "select contest_id, team_id, coalesce(game_time, '') in ('', '12:00 AM') as unset from schedule")(
    lambda t: t.schedule.select("contest_id", "team_id", parse.time_unset("game_time").alias("unset")))
query("n15_network_labels", _answers(CHANNELS, (
    ("ESPN+", "espn-plus"), ("ESPN2", "espn2"), ("ESPNU", "espnu"), ("ESPN/ESPN+", "espn"), ("ESPN", "espn"), (None, None), ("ACC Network Extra", "accnx"), ("ACC Network", "accn"),
    ("SEC Network+", "secn-plus"), ("SEC Network", "secn"), ("Big Ten Network", "btn"), ("B1G+", "b1g-plus"), ("FS1", "fs1"), ("FOX Sports", None), ("FOX", "fox"), ("CBS", "cbs"),
    ("CBS Sports Network", None), (None, None), ("Web stream", None), (None, None), ("CW", None), ("Peacock", "peacock"), ("MW+", "mw-plus"), ("FloSports", "flosports"), (None, None), ("YouTube", "youtube")),
    ["label", "logo"]))(lambda t: networks.with_network(t.vocab.select("k", "channel"), "channel", "label", "logo").select("k", "label", "logo"))
query("n16_matchup_titles", _answers(TITLES, (
    ("Ohio", "Iowa"), ("Ohio", "Iowa"), (None, None), ("Ohio", "Iowa"), ("#5 Ohio", "Iowa"), ("Miami (OH)", "Iowa"), ("Ohio", "Iowa"), (None, None), ("Ohio", "Iowa")), ["team_a", "team_b"]))(
    lambda t: t.vocab.select("k", networks.clean_title("title").alias("c")).select("k", networks.matchup("c").alias("m")).select("k", "m.team_a", "m.team_b"))
query("n17_opponent_cells", _answers(CELLS, (
    ("away", "Nebraska", None), ("home", "Ohio St.", None), ("neutral", "Penn St.", "Las Vegas, NV"), ("away", "Texas", None), ("home", "Utah", None), ("neutral", "Iowa", None),
    ("home", "Duke", None), ("neutral", "Rice", "Hall (A)")), ["site", "opponent", "location"]))(
    lambda t: t.vocab.select("k", parse.opponent_cell("cell").alias("o")).select("k", "o.*"))
query("n18_rank_and_votes", _answers(VOTED, ("Nebraska", "Texas", "Miami (OH)", "Ohio", "Iowa", "Utah", "Plain"), ["name"]))(
    lambda t: t.vocab.select("k", text.strip_rank_prefix(text.strip_vote_suffix("voted")).alias("name")))
query("n19_played_sets", _answers(SCORES, (("25,20,15", "20,25,13"), ("25", "20"), ("", ""), ("25,25,25", "10,11,12")), ["away", "home"]))(
    lambda t: t.vocab.select("k", F.split("scores", r"\|").alias("s")).select("k", parse.played_sets(
        F.from_json(F.col("s")[0], "array<int>"), F.from_json(F.col("s")[1], "array<int>")).alias("p")).select(
        "k", F.array_join("p.away", ",").alias("away"), F.array_join("p.home", ",").alias("home")))
query("n19_set_scores_json", _answers(SCORES, (3, 3, 0, 4), ["n_sets"]))(
    lambda t: t.vocab.select("k", F.split("scores", r"\|").alias("s")).select("k", F.size(parse.set_scores(F.concat(
        F.lit('{"away":'), F.col("s")[0], F.lit(',"home":'), F.col("s")[1], F.lit("}")))["home"]).alias("n_sets")))
query("n20_starter_names", _answers(STARTER_LINES, ("Ann Lee,Bea Roe,Cat Poe", "Dee Moe,Eve Noe,Fay Joe", "", "A. B,C"), ["names"]))(
    lambda t: t.vocab.select("k", F.array_join(parse.starter_names("starters"), ",").alias("names")))
query("n21_bands_and_ordinals", """select s_suppkey as k, case when p >= 90 then 'elite' when p >= 75 then 'strong' when p >= 60 then 'above-average' when p >= 40 then 'solid' when p >= 25 then 'below-average'
    when p >= 10 then 'weak' else 'poor' end as band, concat(p, case when p % 100 between 10 and 20 then 'th' when p % 10 = 1 then 'st' when p % 10 = 2 then 'nd' when p % 10 = 3 then 'rd' else 'th' end, ' percentile nationally') as text
    from (select s_suppkey, cast(s_suppkey % 101 as int) as p from supplier) x""")(
    lambda t: t.supplier.select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") % 101).cast("double").alias("p")).select(
        "k", parse.band(F.col("p")).alias("band"), parse.nationally(F.col("p")).alias("text")))
query("n21_value_texts", """select s_suppkey as k, concat(case when v < 0 then '-' else '' end, ltrim(printf('%.3f', abs(v)), '0')) as hit, printf('%.1f', v) as rate
    from (select s_suppkey, (s_suppkey % 400 - 100) / 1000 as v from supplier) x""")(
    lambda t: t.supplier.select(F.col("s_suppkey").alias("k"), ((F.col("s_suppkey") % 400 - 100) / 1000).alias("v")).select(
        "k", parse.hit_text(F.col("v")).alias("hit"), parse.rate_text(F.col("v")).alias("rate")))
query("n22_conference_short", "select o_orderkey as k, regexp_replace(concat(o_orderpriority, case when o_orderkey % 2 = 0 then ' Conference' else ' League' end), '\\s+Conference$', '') as short from orders")(
    lambda t: t.orders.select(F.col("o_orderkey").alias("k"), text.default_conference_short(F.concat("o_orderpriority", F.when(F.col("o_orderkey") % 2 == 0, " Conference").otherwise(" League"))).alias("short")))
query("n23_slate_day", """select contest_id, case when date like '% 01:00' then cast(cast(cast(substr(date, 1, 10) as date) - interval 1 day as date) as varchar) else substr(date, 1, 10) end as slate,
    case when date like '% 01:00' then 1500 when date like '% 18:00' then 1080 end as minutes from contests""")(
    lambda t: t.contests.select("contest_id", "date", clock_minutes("date").alias("m")).select(
        "contest_id", slate_day("date", F.col("m")).alias("slate"), sort_minutes(F.col("m")).alias("minutes")))
query("p14_play_texts", _answers(PLAYS, (
    ("serve", None, "Ann Lee", "Bea Roe"), ("serve", None, "Ann Lee", None), ("reception", None, "Bea Roe", None), ("set", None, "Cat Poe", None), ("attack", None, "Dee Moe", None), ("dig", None, "Eve Noe", None),
    ("block", None, "Fay Joe", None), ("sub_in", None, "Gia Koe", None), ("sub_out", None, "Gia Koe", None), (None, None, None, None), (None, None, None, None), (None, None, None, None),
    ("terminal", "kill", "Dee Moe", None), ("terminal", "attack_error", "Dee Moe", None), ("terminal", "ace", "Ann Lee", None), ("terminal", "service_error", "Ann Lee", None),
    ("terminal", "block_error", "Fay Joe", None), ("terminal", "ball_handling_error", "Cat Poe", None), ("terminal", "other", None, None)), ["touch", "outcome", "player", "receiver"]))(
    lambda t: t.vocab.select("k", parse.play_kind("play", F.col("k") % len(PLAYS) >= 12).alias("p")).select("k", "p.*"))


@query("p14_rally_numbering", """select contest_id, set_number, seq, sum((touch_type = 'serve')::int) over (partition by contest_id, set_number order by seq) as rally, row_number() over (partition by contest_id, set_number order by seq) as pos
    from pbp_events""")
def p14_numbering(t):
    from pyspark.sql import Window

    from matchlens.operators.rally import SET, by_set

    order = Window.partitionBy(*SET).orderBy("seq")
    serves = F.sum(F.when(F.col("touch_type") == "serve", 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return by_set(t.pbp_events.select(*SET, "seq", "touch_type")).select(*SET, "seq", serves.alias("rally"), F.row_number().over(order).alias("pos"))
