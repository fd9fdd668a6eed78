"""Tables that Spark must not take for smaller than they are."""

from matchlens.sources.adapter import adapted_tables


def _stored(spark, path, parts=2000):
    spark.range(parts).selectExpr(
        "id as p_partkey", "'name' as p_name", "'Brand' as p_brand", "'type' as p_type", "cast(id % 50 as int) as p_size", "1.0D as p_retailprice",
    ).coalesce(1).write.parquet(f"{path}/part.parquet")
    spark.sql(
        """select o_orderkey, cast(day as timestamp) as o_orderdate from values
           (1, '1996-02-01'), (2, '1996-03-01'), (3, null), (4, '1995-01-01'), (4, '1998-12-31') as v(o_orderkey, day)"""
    ).coalesce(1).write.parquet(f"{path}/orders.parquet")
    return adapted_tables(spark, str(path))


def test_players_are_not_estimated_below_their_size(spark, tmp_path):
    people = _stored(spark, tmp_path).players.select("id", "season", "position")
    estimate = people._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert int(str(estimate)) >= 2000 * 3 * 16


def test_every_part_plays_once_in_every_season(spark, tmp_path):
    people = _stored(spark, tmp_path, 30).players
    assert people.count() == 90
    assert {(r["id"], r["season"]) for r in people.collect()} == {(p * 100 + s - 1995, s) for p in range(30) for s in (1995, 1996, 1998)}


def _lines(spark, path, matches=40, parts=25):
    _stored(spark, path, 3)
    spark.range(matches).selectExpr(
        "id as o_orderkey", "cast('1996-02-01' as timestamp) as o_orderdate", "id % 7 as o_custkey", "'F' as o_orderstatus", "1.0D as o_totalprice",
    ).coalesce(1).write.mode("overwrite").parquet(f"{path}/orders.parquet")
    spark.range(7).selectExpr("id as c_custkey", "cast(id as int) as c_nationkey").coalesce(1).write.parquet(f"{path}/customer.parquet")
    spark.range(matches * parts).selectExpr(
        f"case when id % 50 <> 49 then id div {parts} end as l_orderkey", f"id % {parts} as l_partkey", "id % 3 as l_suppkey", "cast(id % 4 + 1 as int) as l_linenumber",
        "2.0D as l_quantity", "0.05D as l_discount", "0.02D as l_tax", "'A' as l_returnflag", "'F' as l_linestatus",
    ).coalesce(1).write.parquet(f"{path}/lineitem.parquet")
    return adapted_tables(spark, str(path))


def test_box_lines_are_dealt_by_rows(spark, tmp_path, monkeypatch):
    whole = _lines(spark, tmp_path).player_game_stats
    monkeypatch.setattr("matchlens.sources.adapter.LINES_PER_TASK", 50)
    broadcast = "spark.sql.autoBroadcastJoinThreshold"
    limit = spark.conf.get(broadcast)
    try:
        spark.conf.set(broadcast, "-1")
        dealt = adapted_tables(spark, str(tmp_path)).player_game_stats
        assert dealt.rdd.getNumPartitions() == 1000 // 50
    finally:
        spark.conf.set(broadcast, limit)
    assert dealt.schema == whole.schema and dealt.count() == whole.count() == 980
    assert dealt.exceptAll(whole).isEmpty()
