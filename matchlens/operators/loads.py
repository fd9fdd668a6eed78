"""Staged rows to table rows: resolve teams and players, normalise, and merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlens.constants import ROSTER_OVERRIDES
from matchlens.functions.parse import eastern_time, set_scores, time_unset
from matchlens.functions.text import (
    clean_str, height_inches, normalize_class, num, num_int, school_key, school_slug, strip_vote_suffix,
)
from matchlens.operators.entities import (
    assign_starters, match_players_on_team, resolve_by_id_or_name, resolve_conference, team_by_outside_id, team_keys,
)
from matchlens.operators.schedule import day_of, pair_key
from matchlens.sources.files import season_id
from matchlens.sources.versioned import Manifest, VersionedTable
from matchlens.sources.merge import KEEP_NEW, KEEP_OLD, keep_real_time, prune, replace_keys, upsert
from matchlens.tables import Tables

BOX_COLUMNS = {
    "S": "sets", "Kills": "kills", "Errors": "errors", "Total Attacks": "total_attacks", "Assists": "assists", "Aces": "aces",
    "SErr": "serr", "Digs": "digs", "RetAtt": "retatt", "RErr": "rerr", "Block Solos": "block_solos",
    "Block Assists": "block_assists", "BErr": "berr", "PTS": "pts", "BHE": "bhe",
}

# Columns that a season file has beside those of a box score.
SEASON_COLUMNS = {"GP": "gp", "GS": "gs", "Hit Pct": "hit_pct", "Trpl Dbl": "trpl_dbl"}


def once_per_player(staged: DataFrame) -> DataFrame:
    """A page lists every player twice; one line per (contest, player, name) stays."""
    return staged.dropDuplicates(["ContestID", "PlayerID", "Name"])


def players_by_outside_id(df: DataFrame, t: Tables, id_col: str = "PlayerID") -> DataFrame:
    ids = t.players.filter("ncaa_player_id is not null").select(
        F.col("ncaa_player_id").alias("_pid"), F.col("season").alias("Season"), F.col("id").alias("player_id"), F.col("team_id").alias("_team"))
    return df.withColumn("_pid", clean_str(id_col)).join(ids, ["_pid", "Season"], "left").drop("_pid")


def box_lines(staged: DataFrame, t: Tables) -> DataFrame:
    """Box-score rows of players we know, on the team of their roster."""
    stats = [num(F.col(f"`{h}`")).alias(c) for h, c in BOX_COLUMNS.items() if h in staged.columns]
    rows = players_by_outside_id(staged.filter(clean_str("ContestID").isNotNull()), t).filter("player_id is not null")
    return rows.select(
        clean_str("ContestID").alias("contest_id"), "player_id", F.col("_team").alias("team_id"), F.col("Season").alias("season"), *stats
    ).dropDuplicates(["contest_id", "player_id"])


def box_contests(staged: DataFrame, t: Tables) -> DataFrame:
    """One contest row per contest of a box-score file."""
    rows = staged.withColumn("season", F.col("Season")).filter(clean_str("ContestID").isNotNull())
    first = rows.groupBy("season", clean_str("ContestID").alias("contest_id")).agg(
        *[F.max(clean_str(c)).alias(c) for c in ("Date", "HomeTeamNcaaId", "AwayTeamNcaaId", "HomeSetsWon", "AwaySetsWon", "SetScores")])
    first = team_by_outside_id(team_by_outside_id(first, t, "HomeTeamNcaaId", "home_team_id"), t, "AwayTeamNcaaId", "away_team_id")
    return first.select(
        "contest_id", "season", F.col("Date").alias("date"), "home_team_id", "away_team_id",
        num_int("HomeSetsWon").cast("int").alias("home_sets_won"), num_int("AwaySetsWon").cast("int").alias("away_sets_won"),
        set_scores("SetScores").alias("set_scores"))


def load_box(staged: DataFrame, t: Tables) -> Tables:
    """Merge a box-score file: contests keep values the file lacks, lines are replaced by key."""
    staged = once_per_player(staged)
    new = box_contests(staged, t)
    contests = upsert(t.contests, new, ["contest_id"], {c: KEEP_NEW for c in new.columns if c not in ("contest_id", "season")})
    return t.replace(contests=contests, player_game_stats=upsert(t.player_game_stats, box_lines(staged, t), ["contest_id", "player_id"]))


def pbp_rows(staged: DataFrame, t: Tables) -> DataFrame:
    """Play-by-play rows with team and player ids; scores and order as staged."""
    rows = staged.withColumn("season", F.col("Season"))
    rows = team_by_outside_id(team_by_outside_id(rows, t, "AwayNcaaId", "_away"), t, "HomeNcaaId", "_home")
    side = lambda c: F.when(F.col(c) == "away", F.col("_away")).when(F.col(c) == "home", F.col("_home"))
    rows = rows.withColumns({"team_id": side("Side"), "player_name": clean_str("PlayerName")})
    rows = match_players_on_team(rows, t, "player_name", "player_id")
    return rows.select(
        F.col("ContestID").alias("contest_id"), "season", F.col("Set").alias("set_number"), F.col("Rally").alias("rally_number"),
        F.col("Seq").alias("seq"), clean_str("TouchType").alias("touch_type"), "player_name", "player_id", "team_id",
        F.col("IsTerminal").alias("is_terminal"), clean_str("TerminalType").alias("terminal_type"), side("ScoringSide").alias("scoring_team_id"),
        F.col("AwayScore").alias("away_score"), F.col("HomeScore").alias("home_score"))


def pbp_contests(staged: DataFrame, t: Tables) -> DataFrame:
    """Teams and venue of each contest in a play-by-play file."""
    one = staged.groupBy(F.col("Season").alias("season"), F.col("ContestID").alias("contest_id")).agg(
        *[F.max(c).alias(c) for c in ("AwayNcaaId", "HomeNcaaId", "Location", "Attendance")])
    one = team_by_outside_id(team_by_outside_id(one, t, "AwayNcaaId", "away_team_id"), t, "HomeNcaaId", "home_team_id")
    return one.select("contest_id", "season", "home_team_id", "away_team_id", clean_str("Location").alias("location"), F.col("Attendance").alias("attendance"))


def load_pbp(staged: DataFrame, t: Tables) -> Tables:
    """Replace the events of every contest in the file; contest teams are filled only where missing."""
    contests = upsert(t.contests, pbp_contests(staged, t), ["contest_id"], {
        "home_team_id": KEEP_OLD, "away_team_id": KEEP_OLD, "season": KEEP_OLD, "location": KEEP_NEW, "attendance": KEEP_NEW})
    return t.replace(contests=contests, pbp_events=replace_keys(t.pbp_events, pbp_rows(staged, t), ["contest_id"]))


def apply_overrides(players: DataFrame) -> DataFrame:
    """Force known corrections over scraped height and position."""
    table = lambda i: F.create_map(*[F.lit(x) for o in ROSTER_OVERRIDES if o[i] is not None for x in (o[0], o[i])])
    fix = lambda i: F.try_element_at(table(i), F.coalesce("ncaa_player_id", F.lit("")))
    return players.withColumns({"height_inches": F.coalesce(fix(1), "height_inches"), "position": F.coalesce(fix(2), "position")})


def roster_rows(staged: DataFrame, t: Tables, season_col: str = "Season") -> DataFrame:
    """Roster rows, normalised. Ids of stored players are kept; see :func:`load_roster`."""
    rows = staged.withColumns({"season": F.col(season_col), "_tid": clean_str("TeamID")})
    rows = team_by_outside_id(rows, t, "_tid", "team_id").filter(F.col("team_id").isNotNull() & clean_str("Player").isNotNull())
    return apply_overrides(rows.select(
        "season", "team_id", clean_str("PlayerID").alias("ncaa_player_id"), clean_str("Player").alias("name"), num_int("Number").cast("int").alias("number"),
        clean_str("Pos").alias("position"), F.nullif(normalize_class("Yr"), F.lit("")).alias("class_year"), height_inches("Ht").alias("height_inches"),
        clean_str("Hometown").alias("hometown"), clean_str(F.col("`High School`")).alias("high_school")))


def load_roster(staged: DataFrame, t: Tables) -> DataFrame:
    """Players after merging a roster: by outside id, or by team and name where there is none."""
    key = F.when(F.col("ncaa_player_id").isNotNull(), F.concat(F.lit("id:"), F.col("ncaa_player_id"))).otherwise(
        F.concat_ws(":", F.lit("name"), F.col("team_id").cast("string"), F.col("name")))
    new = roster_rows(staged, t).withColumn("_key", key).dropDuplicates(["season", "_key"])
    old = t.players.withColumn("_key", key)
    merged = upsert(old, new, ["season", "_key"])
    return merged.withColumn("id", F.coalesce("id", key_id(13, "season", "_key"))).drop("_key")


def key_id(digits: int, *key: str) -> Column:
    """An id made from a key, so that a second run gives the same one: so many hex digits of its hash."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *key)), 1, digits), 16, 10).cast("bigint")


def season_lines(staged: DataFrame, t: Tables) -> DataFrame:
    """Season lines of the second source, keyed by player."""
    columns = {h: "sp" if c == "sets" else c for h, c in BOX_COLUMNS.items()} | SEASON_COLUMNS
    stats = [num(F.col(f"`{h}`")).alias(c) for h, c in columns.items() if h in staged.columns]
    return players_by_outside_id(staged, t).filter("player_id is not null").select(
        "player_id", F.col("Season").alias("season"), *stats).dropDuplicates(["player_id", "season"])


def load_season_lines(staged: DataFrame, t: Tables) -> DataFrame:
    """Stored season lines after merging a file; columns that it lacks stay as they are."""
    return upsert(t.player_season_stats_scraped, season_lines(staged, t), ["player_id", "season"])


def coach_rows(staged: DataFrame, t: Tables, season: int) -> DataFrame:
    """Head coaches of a season."""
    rows = team_by_outside_id(staged.withColumns({"season": F.lit(season), "_tid": F.col("TeamID")}), t, "_tid", "team_id")
    return rows.filter(clean_str("CoachName").isNotNull() & F.col("team_id").isNotNull()).select(
        "team_id", "season", clean_str("CoachName").alias("name"), F.lit("Head Coach").alias("title"), F.lit(0).alias("sort_order"),
        clean_str("CoachId").alias("ncaa_coach_id"), clean_str("Seasons").alias("seasons"), clean_str("Record").alias("record"))


def load_coaches(staged: DataFrame, t: Tables, season: int) -> DataFrame:
    """Coaches after a load: those of the season give way to the file's, other seasons stay."""
    new = coach_rows(staged, t, season).withColumn("id", key_id(13, "season", "team_id", "name"))
    return t.coaches.filter(~F.col("season").eqNullSafe(F.lit(season))).unionByName(new, allowMissingColumns=True)


def schedule_rows(staged: DataFrame, t: Tables) -> DataFrame:
    rows = staged.withColumns({"season": F.col("Season"), "_tid": clean_str("TeamNcaaId"), "opponent_name": clean_str("OpponentName"), "date": clean_str("Date")})
    rows = team_by_outside_id(rows, t, "_tid", "team_id").filter("team_id is not null and date is not null and opponent_name is not null")
    rows = resolve_by_id_or_name(rows.withColumn("_oid", clean_str("OpponentNcaaId")), t, "_oid", "opponent_name", "opponent_team_id")
    return rows.select(
        "season", "team_id", "opponent_team_id", "opponent_name", "date", clean_str("Time").alias("game_time"), clean_str("Site").alias("site"),
        clean_str("NeutralLocation").alias("neutral_location"), clean_str("ResultRaw").alias("result_raw"), clean_str("ContestId").alias("contest_id"),
    ).dropDuplicates(["season", "team_id", "date", "opponent_name"])


SCHEDULE_KEYS = ["season", "team_id", "date", "opponent_name"]


def merged_schedule(old: DataFrame, new: DataFrame) -> DataFrame:
    """Stored rows after a scrape. Contest ids survive a blank cell and start times survive "not set". Rows a
    scraped team no longer lists go; teams the scrape lacks keep theirs."""
    times = old.select(*SCHEDULE_KEYS, F.col("game_time").alias("_old_time"))
    new = new.join(times, SCHEDULE_KEYS, "left").withColumn(
        "game_time", keep_real_time(F.col("game_time"), F.col("_old_time"), time_unset("game_time"))).drop("_old_time")
    return prune(upsert(old, new, SCHEDULE_KEYS, {"contest_id": KEEP_NEW}), new, ["season", "team_id"], SCHEDULE_KEYS)


def load_schedule(staged: DataFrame, t: Tables) -> DataFrame:
    """The schedule after merging a scrape."""
    return merged_schedule(t.schedule, schedule_rows(staged, t))


def load_schedule_into(table: VersionedTable, staged: DataFrame, t: Tables) -> Manifest:
    """The same on a table bucketed by season and team: buckets without a scraped team are left alone."""
    return table.merge(schedule_rows(staged, t), merged_schedule)


def team_rows(entries: DataFrame, t: Tables) -> DataFrame:
    """Teams of the team file with their conference, first entry per name."""
    named = entries.withColumn("name", F.coalesce(clean_str("team"), clean_str("short_name"))).filter("name is not null")
    found = resolve_conference(named.withColumn("_c", clean_str("conference")), t, "_c")
    return found.select(
        "name", clean_str("short_name").alias("short_name"), "conference_id", clean_str("city").alias("city"), clean_str("state").alias("state"),
        F.col("team_name_aliases").alias("aliases")).dropDuplicates(["name"])


def load_teams(entries: DataFrame, t: Tables, season: int) -> Tables:
    """Teams by name and their outside ids of the season after merging a team file.

    A team keeps its id and what the file does not say. New ones are numbered on from the largest id, in order of
    name; they are no more than a team file lists. A team keeps its conference of the season.
    """
    teams = upsert(t.teams, team_rows(entries, t), ["name"], {"conference_id": KEEP_NEW})
    every = Window.partitionBy(F.lit(0))
    teams = teams.withColumns({"_largest": F.coalesce(F.max("id").over(every), F.lit(0)), "_no": F.row_number().over(Window.partitionBy(F.col("id").isNull()).orderBy("name"))})
    teams = teams.withColumn("id", F.coalesce("id", (F.col("_largest") + F.col("_no")).cast("int"))).drop("_largest", "_no")
    named = entries.select(F.coalesce(clean_str("team"), clean_str("short_name")).alias("name"), clean_str(season_id(season)).alias("ncaa_team_id"))
    ids = named.filter("ncaa_team_id is not null").join(teams.select("name", F.col("id").alias("team_id")), "name").select(
        "team_id", F.lit(season).alias("season"), "ncaa_team_id").dropDuplicates(["team_id"])
    return t.replace(teams=teams, team_season_ids=upsert(t.team_season_ids, ids, ["team_id", "season"]))


def season_memberships(t: Tables, membership: DataFrame) -> DataFrame:
    """Set each team-season's conference from (``season``, ``ncaa_team_id``, ``label``)."""
    found = resolve_conference(membership.withColumn("label", clean_str("label")).filter("label is not null"), t, "label", "_new")
    one = found.groupBy("season", "ncaa_team_id").agg(F.max("_new").alias("conference_id"))
    return upsert(t.team_season_ids, one, ["season", "ncaa_team_id"], {"conference_id": KEEP_NEW}).filter("team_id is not null")


def rank_columns(columns: list[str]) -> tuple[str | None, str | None, str | None]:
    """Rank, team and record columns of a ranking table, by words in their headings."""
    low = {c: c.strip().lower() for c in columns}
    rank = next((c for c, x in low.items() if "rank" in x and "previous" not in x), None)
    team = next((c for c, x in low.items() if any(w in x for w in ("team", "school", "institution"))), None)
    return rank, team, next((c for c, x in low.items() if "record" in x), None)


def enrich_ranks(t: Tables, table: DataFrame, poll: str) -> DataFrame:
    """Teams with their rank from a ranking table.

    A poll ranks few teams, so every earlier poll rank is cleared; the other ranking keeps teams
    the table lacks.
    """
    rank, team, record = rank_columns(table.columns)
    if team is None or (poll == "avca" and rank is None):
        return t.teams
    name = strip_vote_suffix(F.col(f"`{team}`")) if poll == "avca" else F.col(f"`{team}`")
    value = F.trim(F.col(f"`{rank}`").cast("string")).try_cast("int") if rank else F.lit(None).cast("int")
    rows = table.select(name.alias("_name"), value.alias("_rank"), (clean_str(F.col(f"`{record}`")) if record else F.lit(None).cast("string")).alias("_record"))
    keys = team_keys(t, school_key(F.col("spelling")))
    found = rows.withColumn("key", school_key("_name")).join(keys, "key").groupBy(F.col("found_team_id").alias("id")).agg(
        F.max(F.struct("_rank", "_record")).alias("_r"), F.lit(True).alias("_hit"))
    out = t.teams.join(found, "id", "left")
    if poll == "avca":
        return out.withColumn("avca_rank", F.col("_r._rank")).drop("_r", "_hit")
    hit = F.coalesce("_hit", F.lit(False))
    out = out.withColumn("rpi_rank", F.when(hit, F.col("_r._rank")).otherwise(F.col("rpi_rank")) if rank else F.col("rpi_rank"))
    return out.withColumn("rpi_record", F.when(hit, F.col("_r._record")).otherwise(F.col("rpi_record")) if record else F.col("rpi_record")).drop("_r", "_hit")


def resolve_listed_games(games: DataFrame, t: Tables) -> DataFrame:
    """Outside scoreboard games with our two teams, by slug, else by the slug of the short name."""
    keys = team_keys(t, school_slug(F.col("spelling")), short_first=True)
    for i in (0, 1):
        seo, short = F.col("seonames")[i], school_slug(F.col("name_shorts")[i])
        games = games.withColumns({"_a": seo, "_b": short})
        games = games.join(keys.select(F.col("key").alias("_a"), F.col("found_team_id").alias("_ia")), "_a", "left")
        games = games.join(keys.select(F.col("key").alias("_b"), F.col("found_team_id").alias("_ib")), "_b", "left")
        games = games.withColumn(f"team_{i}", F.coalesce("_ia", "_ib")).drop("_a", "_b", "_ia", "_ib")
    known = F.col("team_0").isNotNull() & F.col("team_1").isNotNull() & (F.col("team_0") != F.col("team_1"))
    return games.withColumn("pair", F.when(known, pair_key("team_0", "team_1")))


def map_games(t: Tables, games: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contests and schedule with outside ids, and start times where the outside one differs."""
    found = resolve_listed_games(games, t).filter("pair is not null").withColumn("et", eastern_time("start_epoch"))
    best = found.groupBy("season", F.col("date").alias("_day"), F.col("pair").alias("_pair")).agg(F.max(F.struct("ncaa_game_id", "et")).alias("g"))
    contests = t.contests.withColumns({"_day": day_of("date"), "_pair": pair_key("home_team_id", "away_team_id")}).join(best, ["season", "_day", "_pair"], "left")
    contests = contests.withColumn("ncaa_game_id", F.coalesce("g.ncaa_game_id", "ncaa_game_id")).drop("_day", "_pair", "g")
    plan = t.schedule.withColumns({"_day": F.col("date"), "_pair": F.when(F.col("opponent_team_id").isNotNull(), pair_key("team_id", "opponent_team_id"))})
    plan = plan.join(best, ["season", "_day", "_pair"], "left")
    changed = F.col("g.et").isNotNull() & ~F.col("game_time").eqNullSafe(F.col("g.et"))
    plan = plan.withColumns({
        "time_change": F.when(changed & time_unset("game_time"), "filled").when(changed, "corrected"),
        "game_time": F.coalesce("g.et", "game_time"), "ncaa_game_id": F.coalesce("g.ncaa_game_id", "ncaa_game_id"),
    }).drop("_day", "_pair", "g")
    return contests, plan


def load_starters(lines: DataFrame, t: Tables) -> DataFrame:
    """Given starters after a load: each team-set in the lines is replaced as a whole."""
    new = assign_starters(lines, t).select("contest_id", "team_id", "set_number", "player_id", "season")
    return replace_keys(t.contest_set_starters, new, ["contest_id", "team_id", "set_number"])


def report(df: DataFrame, **conditions: Column) -> DataFrame:
    """Counts of rows meeting each condition, in one pass."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.when(c, 1)).alias(n) for n, c in conditions.items()])


