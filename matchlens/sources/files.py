"""Reading staged files, and appending to them without silent drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Ids stay text, so that 624845 never turns into 624845.0.
BOX_CSV = (
    "TeamID string, Season int, ContestID string, TeamSide string, PlayerID string, Date string, AwayTeamNcaaId string,"
    " HomeTeamNcaaId string, AwaySetsWon string, HomeSetsWon string, SetScores string, Name string, S string, Kills string,"
    " Errors string, `Total Attacks` string, Assists string, Aces string, SErr string, Digs string, RetAtt string, RErr string,"
    " `Block Solos` string, `Block Assists` string, BErr string, PTS string, BHE string"
)
PBP_CSV = (
    "ContestID string, Season int, `Set` int, Rally int, Seq int, TouchType string, PlayerName string, Side string, IsTerminal boolean,"
    " TerminalType string, ScoringSide string, AwayScore int, HomeScore int, AwayNcaaId string, HomeNcaaId string, Location string, Attendance int"
)
ROSTER_CSV = (
    "TeamID string, Team string, PlayerID string, Player string, Number string, Pos string, Yr string, Ht string, Hometown string, `High School` string"
)
SCHEDULE_CSV = (
    "Season int, TeamNcaaId string, Date string, Time string, OpponentName string, OpponentNcaaId string, Site string, NeutralLocation string,"
    " ResultRaw string, ContestId string"
)
COACH_CSV = "TeamID string, Team string, CoachName string, CoachId string, Seasons string, Record string"
TEAM_JSON = (
    "team string, short_name string, conference string, city string, state string, lat double, lon double, team_name_aliases array<string>,"
    " ncaa_team_ids map<string,string>"
)


def read_csv(spark: SparkSession, path: str, schema: str, corrupt: str | None = None) -> DataFrame:
    """A staged CSV with a stated schema; ``corrupt`` names a column that keeps unreadable lines."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("quote", '"').option("escape", '"')
    if corrupt:
        return reader.schema(f"{schema}, `{corrupt}` string").option("columnNameOfCorruptRecord", corrupt).csv(path)
    return reader.schema(schema).csv(path)


def read_team_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TEAM_JSON).option("multiLine", True).json(path)


def season_id(season: int) -> object:
    """A team's outside id in one season, from its map of ids."""
    return F.try_element_at("ncaa_team_ids", F.lit(str(season)))


def logos(text: DataFrame, json_col: str) -> DataFrame:
    """Conference → logo from a JSON map of objects."""
    parsed = F.from_json(F.col(json_col), "map<string, struct<logo: string>>")
    return text.select(F.explode(parsed).alias("name", "v")).select("name", F.nullif(F.trim("v.logo"), F.lit("")).alias("logo"))


def with_logos(conferences: DataFrame, found: DataFrame) -> DataFrame:
    new = found.filter("logo is not null").groupBy("name").agg(F.max("logo").alias("_logo"))
    base = conferences if "logo" in conferences.columns else conferences.withColumn("logo", F.lit(None).cast("string"))
    return base.join(new, "name", "left").withColumn("logo", F.coalesce("_logo", "logo")).drop("_logo")


def not_yet_seen(df: DataFrame, key: str, *stored: DataFrame) -> DataFrame:
    """Rows whose key none of the stored tables holds."""
    for old in stored:
        df = df.join(old.select(key).distinct(), key, "left_anti")
    return df


class SchemaDrift(RuntimeError):
    """The stored columns differ from the ones to append."""


def append_checked(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Append to a Parquet table, refusing when its columns differ from ``df``'s."""
    spark = df.sparkSession
    try:
        stored = {(f.name, f.dataType.simpleString()) for f in spark.read.parquet(path).schema}
    except Exception as err:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(err) and "UNABLE_TO_INFER_SCHEMA" not in str(err):
            raise
        stored = None
    incoming = {(f.name, f.dataType.simpleString()) for f in df.schema}
    if stored is not None and stored != incoming:
        raise SchemaDrift(f"{path}: stored only {sorted(stored - incoming)}, incoming only {sorted(incoming - stored)}")
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
