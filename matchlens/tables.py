"""Table schemas and the container every operator reads from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COUNTERS = (
    "kills", "errors", "total_attacks", "assists", "aces", "serr", "digs", "retatt", "rerr",
    "block_solos", "block_assists", "berr", "pts", "bhe",
)

_COUNTER_DDL = ", ".join(f"{c} double" for c in COUNTERS)

SCHEMAS: dict[str, str] = {
    "conferences": ("id int not null, name string not null, short_name string, logo string"),
    "teams": (
        "id int not null, name string not null, short_name string, conference_id int, city string,"
        " state string, latitude double, longitude double, aliases array<string>, rpi_rank int,"
        " rpi_record string, avca_rank int"
    ),
    "team_season_ids": (
        "team_id int not null, season int not null, ncaa_team_id string not null, conference_id int"
    ),
    "coaches": (
        "id bigint not null, team_id int not null, season int, name string not null, title string,"
        " sort_order int, ncaa_coach_id string, seasons string, record string"
    ),
    "players": (
        "id bigint not null, team_id int not null, season int not null, ncaa_player_id string,"
        " name string not null, number int, position string, class_year string, height_inches int,"
        " hometown string, high_school string"
    ),
    "contests": (
        "contest_id string not null, season int not null, date string, home_team_id int,"
        " away_team_id int, home_sets_won int, away_sets_won int,"
        " set_scores struct<away:array<int>,home:array<int>>, ncaa_game_id string,"
        " location string, attendance int"
    ),
    "schedule": (
        "season int not null, team_id int not null, opponent_team_id int,"
        " opponent_name string not null, date string not null, game_time string, site string,"
        " neutral_location string, result_raw string, contest_id string, ncaa_game_id string"
    ),
    "ranking_snapshots": (
        "season int not null, as_of date not null, team_id int not null, rpi_rank int,"
        " rpi_record string, avca_rank int"
    ),
    "broadcasts": (
        "season int not null, game_date string not null, team_a_id int not null,"
        " team_b_id int not null, network string not null, logo_key string, source string not null,"
        " is_live boolean not null, raw_channel string, channel_no string, start_utc timestamp"
    ),
    "player_game_stats": (
        "contest_id string not null, player_id bigint not null, team_id int not null,"
        f" season int not null, sets double, {_COUNTER_DDL}"
    ),
    "player_season_stats_scraped": (
        "player_id bigint not null, season int not null, gp double, gs double, sp double,"
        f" {_COUNTER_DDL}, hit_pct double, trpl_dbl double"
    ),
    "pbp_events": (
        "contest_id string not null, season int not null, set_number int not null,"
        " rally_number int not null, seq int not null, touch_type string not null,"
        " player_name string, player_id bigint, team_id int, is_terminal boolean not null,"
        " terminal_type string, scoring_team_id int, away_score int, home_score int"
    ),
    "contest_set_starters": (
        "contest_id string not null, team_id int not null, set_number int not null,"
        " player_id bigint not null, season int not null"
    ),
    "favorites": ("user_id bigint, entity_type string, entity_id bigint, season int"),
    "users": ("user_id bigint, created_at timestamp"),
}


class Tables:
    """Named, lazily built DataFrames: ``t.contests`` is the table.

    Joins carry no hints: adaptive execution picks the strategy from the bytes it meets.
    """

    def __init__(self, spark: SparkSession, makers: dict[str, Callable[[Tables], DataFrame]]):
        self.spark = spark
        self._makers = makers
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name not in self._makers:
                raise AttributeError(f"no table {name!r}")
            self._made[name] = self._makers[name](self)
        return self._made[name]

    def replace(self, **tables: DataFrame) -> Tables:
        """A copy with some tables swapped, used by loads and tests."""
        makers = dict(self._makers)
        for name, df in tables.items():
            makers[name] = lambda _t, _df=df: _df
        return Tables(self.spark, makers)


def stored_tables(spark: SparkSession, root: str) -> Tables:
    """Tables kept as Parquet below ``root`` (facts partitioned by season)."""
    return Tables(
        spark,
        {
            name: (lambda _t, _n=name, _s=schema: spark.read.schema(_s).parquet(f"{root}/{_n}"))
            for name, schema in SCHEMAS.items()
        },
    )


def frames(spark: SparkSession, **rows: list[tuple]) -> Tables:
    """Tables from literal rows (tests); tables not named are empty."""
    return Tables(
        spark,
        {
            name: (lambda _t, _n=name, _s=schema: spark.createDataFrame(rows.get(_n, []), _s))
            for name, schema in SCHEMAS.items()
        },
    )


def one_season(df: DataFrame, season: int | None) -> DataFrame:
    """Keep one season, or all of them when ``season`` is None."""
    return df if season is None else df.filter(F.col("season") == season)
