"""The package's tables, derived from the test data's generic ones.

Orders play the matches, line items the box-score lines, parts the players, nations the teams,
regions the conferences and user events the play-by-play. Texts in ``PORTABLE`` are plain SQL;
``plans.views`` reuses them for the check queries. Tables whose construction needs care at scale
(running counts over a user's events) are DataFrame code here and separate SQL there.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlens.operators.prefix import running_by_chunk
from matchlens.sources.staged import STAGED
from matchlens.tables import Tables

RAW = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

#: Line items that one task joins with their matches and groups.
LINES_PER_TASK = 500_000

PORTABLE: dict[str, str] = {
    "conferences": """
        select cast(r_regionkey as int) as id, r_name as name, upper(substr(r_name, 1, 3)) as short_name
        from {region}""",
    "contests": """
        select cast(o_orderkey as string) as contest_id, cast(year(o_orderdate) as int) as season,
          case when o_orderkey % 97 = 0 then null when o_orderkey % 101 = 0 then 'TBD-not-a-date'
               else concat(cast(cast(o_orderdate as date) as string),
                           case when o_orderkey % 13 = 0 then ' 01:00' else ' 18:00' end) end as date,
          cast(c_nationkey as int) as home_team_id,
          cast((c_nationkey + 1 + o_orderkey % 24) % 25 as int) as away_team_id,
          case when o_orderstatus = 'P' then null when o_orderkey % 2 = 0 then 3
               else cast(o_orderkey % 3 as int) end as home_sets_won,
          case when o_orderstatus = 'P' then null when o_orderkey % 2 = 1 then 3
               else cast(o_orderkey % 3 as int) end as away_sets_won,
          case when o_orderkey % 3 = 0 then concat('g', cast(o_orderkey as string)) end as ncaa_game_id,
          cast(cast(floor(o_totalprice) as int) % 5000 as int) as attendance
        from {orders} join {customer} on c_custkey = o_custkey""",
    "ranking_weeks": """
        select '01' as m union all select '05' union all select '09'""",
    "player_game_stats": """
        select cast(k.order_no as string) as contest_id, cast(l_partkey * 100 + (k.season - 1995) as bigint) as player_id,
          case when min(l_linenumber) % 2 = 1 then k.home_team_id else k.away_team_id end as team_id,
          k.season,
          cast(3 + l_partkey % 3 as double) as sets,
          cast(sum(cast(l_quantity as int)) as double) as kills,
          cast(sum(cast(round(l_discount * 100) as int)) as double) as errors,
          cast(sum(cast(l_quantity as int)) + sum(cast(round(l_discount * 100) as int)) + 5 as double) as total_attacks,
          case when min(case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end) <> 1 then cast(sum(l_suppkey % 40) as double) end as assists,
          case when min(case l_linestatus when 'F' then 0 else 1 end) = 0 then cast(sum(cast(round(l_tax * 100) as int)) as double) end as aces,
          case when min(case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end) = 2 then cast(sum(l_linenumber) as double) end as serr,
          cast(max(l_linenumber) as double) as digs,
          cast(sum(l_suppkey % 10) as double) as retatt,
          cast(min(l_linenumber) - 1 as double) as rerr,
          cast(count(*) as double) as block_solos,
          cast(min(l_linenumber) as double) as block_assists,
          case when min(case l_linestatus when 'F' then 0 else 1 end) = 1 then cast(1 as double) end as berr,
          cast(sum(cast(l_quantity as int)) + count(*) as double) as pts,
          cast(max(l_linenumber) % 2 as double) as bhe
        from {lineitem} join (
          select o_orderkey as order_no, cast(year(o_orderdate) as int) as season, cast(c_nationkey as int) as home_team_id,
            cast((c_nationkey + 1 + o_orderkey % 24) % 25 as int) as away_team_id
          from {orders} join {customer} on c_custkey = o_custkey) k on k.order_no = l_orderkey
        group by k.order_no, l_partkey, k.season, k.home_team_id, k.away_team_id""",
    "schedule": """
        select season, team_id, opponent_team_id, opponent_name, date,
          case when ok % 4 = 0 then '12:00 AM' when ok % 4 = 1 then '07:30 PM' when ok % 4 = 2 then '05:00 PM' end as game_time,
          case when ok % 11 = 0 then 'neutral' else site end as site,
          case when ok % 11 = 0 then 'Neutral Hall' end as neutral_location,
          cast(null as string) as result_raw, contest_id, ncaa_game_id
        from (
          select p.ok, p.season, p.team_id, case when p.ok % 10 <> 7 then p.opponent_id end as opponent_team_id,
            case when p.ok % 10 <> 7 then o.n_name else 'Independent College' end as opponent_name,
            cast(case when p.ok % 13 = 0 then p.day - interval 1 day
                      when p.ok % 3 = 1 then p.day + interval 1 day else p.day end as date) as day,
            substr(cast(case when p.ok % 13 = 0 then p.day - interval 1 day
                      when p.ok % 3 = 1 then p.day + interval 1 day else p.day end as string), 1, 10) as date,
            p.site, p.contest_id, p.ncaa_game_id
          from (
            select cast(contest_id as bigint) as ok, season, home_team_id as team_id, away_team_id as opponent_id,
              cast(substr(date, 1, 10) as date) as day, 'home' as site, contest_id, ncaa_game_id
            from {dated_undecided}
            union all
            select cast(contest_id as bigint), season, away_team_id, home_team_id,
              cast(substr(date, 1, 10) as date), 'away', contest_id, ncaa_game_id
            from {dated_undecided}
          ) p join {nation} o on o.n_nationkey = p.opponent_id
        ) s""",
    "dated_undecided": """
        select * from {contests} where home_sets_won is null and date is not null and date <> 'TBD-not-a-date'""",
    "favorites": """
        select distinct c_custkey as user_id, 'player' as entity_type,
          cast(c_custkey * 100 + c_custkey % 7 as bigint) as entity_id, cast(1995 + c_custkey % 7 as int) as season
        from {customer}""",
    "users": """
        select user_id, min(ts) as created_at from {events} group by user_id""",
}

# Columns that depend on how an engine spells "one row per season": {season_rows}.
PER_SEASON: dict[str, str] = {
    "team_season_ids": """
        select cast(n_nationkey as int) as team_id, cast(season as int) as season,
          cast(n_nationkey * 10000 + season as string) as ncaa_team_id,
          case when (n_nationkey + season) % 7 = 0 then cast((n_regionkey + 1) % 5 as int) end as conference_id
        from {season_rows}""",
    "players": """
        select cast(p_partkey * 100 + (season - 1995) as bigint) as id, cast(season as int) as season,
          cast((p_partkey + case when p_partkey % 3 = 0 then season - 1995 else 0 end) % 25 as int) as team_id,
          cast(p_partkey * 100 + (season - 1995) as string) as ncaa_player_id,
          concat(p_name, ' ', cast(p_partkey - p_partkey % 8 as string)) as name,
          cast(p_partkey % 40 as int) as number,
          case p_size % 6 when 0 then 'S' when 1 then 'OH' when 2 then 'MB' when 3 then 'L/DS' when 4 then 'OH/RS' else 'DS' end as position,
          case (p_size + season) % 4 when 0 then 'Fr' when 1 then 'R-So' when 2 then 'Jr' else 'Sr' end as class_year,
          case when p_size % 11 <> 0 then cast(64 + p_size % 16 as int) end as height_inches,
          case when p_partkey % 13 <> 0 then concat(p_brand, ', ', case p_size % 5 when 0 then 'IN' when 1 then 'TX' when 2 then 'PR' when 3 then 'Serbia' else 'Canada' end) end as hometown,
          case when p_partkey % 2 = 0 then concat('High ', cast(p_partkey % 16 as string)) end as high_school
        from {season_rows}""",
    "ranking_snapshots": """
        select cast(season as int) as season, cast(concat(cast(season as string), '-', m, '-01') as date) as as_of,
          cast(n_nationkey as int) as team_id,
          cast(1 + (n_nationkey * 7 + cast(m as int) * 3) % 40 as int) as rpi_rank,
          concat(cast(n_nationkey as string), '-', m) as rpi_record,
          case when (n_nationkey * 11 + cast(m as int)) % 40 < 25 then cast(1 + (n_nationkey * 11 + cast(m as int)) % 40 as int) end as avca_rank
        from {season_rows}""",
}


def _portable(t: Tables, name: str) -> DataFrame:
    text = (PORTABLE | STAGED)[name]
    return t.spark.sql(text, **{n: t[n] for n in re.findall(r"\{(\w+)\}", text)})


def _per_season(name: str, base: str, months: bool = False) -> object:
    def make(t: Tables) -> DataFrame:
        text = PER_SEASON[name]
        years = "(select array_sort(collect_set(year(o_orderdate))) from {orders})"
        rows = f"(select * from {{{base}}} lateral view explode({years}) y as season"
        rows += " lateral view explode(array('01', '05', '09')) w as m)" if months else ")"
        return t.spark.sql(
            text.replace("{season_rows}", rows), **{base: t[base], "orders": t["orders"]}
        )

    return make


def _players(t: Tables) -> DataFrame:
    """Every part in every season.

    Spark takes an exploded table to be no larger than the table itself, and so sent millions of
    players to the driver for a broadcast. A product with the few seasons is not underestimated;
    joins with players are then settled by the bytes that adaptive execution meets.
    """
    years = "(select distinct year(o_orderdate) as season from {orders} where o_orderdate is not null)"
    rows = f"(select /*+ broadcast(y) */ * from {{part}} cross join {years} y)"
    return t.spark.sql(PER_SEASON["players"].replace("{season_rows}", rows), part=t["part"], orders=t["orders"])


def _player_game_stats(t: Tables) -> DataFrame:
    """Line items of a match and part, summed into a box-score line.

    Sorted, joined and grouped twice they take some fifty times their shuffled bytes, by which adaptive
    execution merges partitions; so tasks are dealt by rows. Few lines are left to it. They meet by
    ``contest_id``, so that what groups by match or joins with matches finds them in place.
    """
    lines = t["lineitem"].withColumn("match_no", F.col("l_orderkey").cast("string"))
    tasks = -(-lines.count() // LINES_PER_TASK)
    if tasks > 1:
        lines = lines.repartition(tasks, "match_no")
    text = PORTABLE["player_game_stats"].replace("k.order_no = l_orderkey", "k.order_no = match_no")
    text = text.replace("cast(k.order_no as string)", "k.order_no").replace("o_orderkey as order_no", "cast(o_orderkey as string) as order_no")
    return t.spark.sql(text, lineitem=lines, orders=t["orders"], customer=t["customer"])


def _teams(t: Tables) -> DataFrame:
    return t.spark.sql(
        """select cast(n_nationkey as int) as id, n_name as name,
             concat('N-', cast(n_nationkey as string)) as short_name,
             cast(n_regionkey as int) as conference_id,
             case when n_nationkey % 2 = 0 then 'IN' else 'TX' end as state,
             array(concat('The ', n_name, ' University'), concat("Nat'l Sch. ", n_nationkey)) as aliases,
             case when n_nationkey % 5 <> 0 then cast(n_nationkey + 1 as int) end as rpi_rank,
             concat(cast(n_nationkey as string), '-1') as rpi_record,
             case when n_nationkey < 10 then cast(10 - n_nationkey as int) end as avca_rank
           from {nation}""",
        nation=t["nation"],
    )


def _contests(t: Tables) -> DataFrame:
    played = F.col("home_sets_won").isNotNull()
    points = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.lit(25) - i)
    return _portable(t, "contests").withColumns(
        {
            "set_scores": F.when(played, F.struct(points.alias("away"), points.alias("home"))),
            "location": F.lit(None).cast("string"),
        }
    )


def _pbp_events(t: Tables) -> DataFrame:
    marked = t["events"].select(
        "user_id", "event_id", "ts", "event_type", "value",
        F.when(F.col("event_type").isin("purchase", "error"), 1).otherwise(0).alias("is_term"),
    )
    placed = running_by_chunk(
        marked, ["user_id"], F.date_trunc("hour", "ts"), ["ts", "event_id"],
        {"_rallies": "is_term"}, seq="seq",
    ).withColumn("rally_number", (F.col("_rallies") + 1).cast("int"))
    games = t["contests"].select("contest_id", "season", "home_team_id", "away_team_id")
    return placed.withColumn("contest_id", F.col("user_id").cast("string")).join(
        games, "contest_id"
    ).transform(_as_pbp)


def _as_pbp(df: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    rally = Window.partitionBy("contest_id", "set_number", "rally_number").orderBy("seq")
    score = Window.partitionBy("contest_id", "set_number").orderBy("seq")
    even = F.col("event_id") % 2 == 0
    term = F.col("is_term") == 1
    home, away = F.col("home_team_id"), F.col("away_team_id")
    pid = (F.col("event_id") % 2) * 100 + F.floor("value").cast("int") % 8
    return (
        df.withColumn("set_number", (1 + F.floor((F.col("rally_number") - 1) / 25)).cast("int"))
        .withColumn(
            "scoring_team_id",
            F.when(term, F.when(even == (F.col("event_type") == "purchase"), home).otherwise(away)),
        )
        .withColumn("_first", F.row_number().over(rally))
        .withColumn("player_id", F.when(F.col("event_id") % 23 != 0, pid.cast("bigint")))
        .select(
            "contest_id", "season", "set_number", "rally_number", F.col("seq").cast("int").alias("seq"),
            F.when(term, "terminal")
            .when(F.col("event_id") % 17 == 0, "sub_in")
            .when(F.col("event_id") % 19 == 0, "sub_out")
            .when(F.col("_first") == 1, "serve")
            .when(F.col("event_type") == "view", "reception")
            .when(F.col("event_type") == "click", "attack")
            .otherwise("set").alias("touch_type"),
            F.when(F.col("player_id").isNotNull(), F.concat(
                F.lit("Player "), F.col("player_id").cast("string"),
                F.when(F.col("event_id") % 29 == 0, ", Player Z").otherwise(""),
            )).alias("player_name"),
            "player_id",
            F.when(even, home).otherwise(away).alias("team_id"),
            term.alias("is_terminal"),
            F.when(F.col("event_type") == "purchase", F.when(F.col("event_id") % 5 == 0, "ace")
                   .when(F.col("event_id") % 7 == 0, "block").otherwise("kill"))
            .when(F.col("event_type") == "error", F.when(F.col("event_id") % 5 == 0, "service_error")
                  .when(F.col("event_id") % 7 == 0, "set_error").otherwise("attack_error"))
            .alias("terminal_type"),
            "scoring_team_id",
            F.when(term, F.sum((term & (F.col("scoring_team_id") == away)).cast("int")).over(score)).cast("int").alias("away_score"),
            F.when(term, F.sum((term & (F.col("scoring_team_id") == home)).cast("int")).over(score)).cast("int").alias("home_score"),
        )
    )


def _scraped(t: Tables) -> DataFrame:
    """Season lines as a second source would report them: some off, some missing, some extra."""
    from matchlens.operators.totals import season_totals

    own = season_totals(t.player_game_stats).filter("player_id % 11 <> 0").select(
        "player_id", "season", F.col("gp").cast("double").alias("gp"), (F.col("gp") - 1.0).alias("gs"), "sp",
        F.when(F.col("player_id") % 7 == 0, F.col("kills") + 1).otherwise(F.col("kills")).alias("kills"),
        "errors", "total_attacks", "assists", "aces", "serr",
        F.when(F.col("player_id") % 5 == 0, F.col("digs") + 0.5).otherwise(F.col("digs")).alias("digs"),
        "retatt", "rerr", "block_solos", "block_assists", "berr", "pts", "bhe",
    )
    extra = t.players.filter("id % 17 = 0").select(F.col("id").alias("player_id"), "season").join(
        t.player_game_stats.select("player_id", "season"), ["player_id", "season"], "left_anti"
    )
    return own.unionByName(extra, allowMissingColumns=True)


def _starters(t: Tables) -> DataFrame:
    """Given line-ups for some team-sets: the even-numbered players seen in them."""
    return (
        t.pbp_events.filter("cast(contest_id as bigint) % 4 = 0 and player_id % 2 = 0 and set_number = 1")
        .select("contest_id", "team_id", "set_number", "player_id", "season").distinct()
    )


def adapted_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """All tables over the Parquet files of one test-data directory."""
    makers: dict = {n: (lambda t, _n=n: t.spark.read.parquet(f"{sf_dir}/{_n}.parquet")) for n in RAW}
    makers |= {n: (lambda t, _n=n: _portable(t, _n)) for n in (*PORTABLE, *STAGED) if n != "ranking_weeks"}
    makers |= {
        "teams": _teams,
        "contests": _contests,
        "team_season_ids": _per_season("team_season_ids", "nation"),
        "players": _players,
        "player_game_stats": _player_game_stats,
        "ranking_snapshots": _per_season("ranking_snapshots", "nation", months=True),
        "pbp_events": _pbp_events,
        "player_season_stats_scraped": _scraped,
        "contest_set_starters": _starters,
    }
    return Tables(spark, makers)
