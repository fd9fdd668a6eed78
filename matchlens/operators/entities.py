"""Which of our teams, players and conferences a text means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlens.constants import CONFERENCE_ALIASES
from matchlens.functions.text import (
    canonical_name, default_conference_short, initial_and_surname, name_tokens, normalize_player_name, plain_name, school_key,
    school_slug, surname,
)
from matchlens.sources.merge import upsert
from matchlens.tables import Tables


def team_names(t: Tables, short_first: bool = False) -> DataFrame:
    """Every known spelling of every team with its precedence."""
    first, second = ("short_name", "name") if short_first else ("name", "short_name")
    listed = F.concat(F.array(first, second), F.coalesce("aliases", F.array().cast("array<string>")))
    return t.teams.select("id", F.posexplode(listed).alias("pos", "spelling")).filter(F.coalesce("spelling", F.lit("")) != "")


def team_keys(t: Tables, *keys: Column, short_first: bool = False) -> DataFrame:
    """Key → team; the team with the smallest id that spells it, earliest spelling first.

    ``keys`` are expressions over ``spelling``. One row per key, bounded by the teams' spellings.
    """
    rows = team_names(t, short_first).select("id", "pos", F.explode(F.array(*keys)).alias("key")).filter("key <> ''")
    return rows.groupBy("key").agg(F.min(F.struct("id", "pos")).alias("m")).select("key", F.col("m.id").alias("found_team_id"))


def resolve_team(df: DataFrame, t: Tables, text: str, out: str, *, by_slug: bool = False, short_first: bool = False) -> DataFrame:
    """Add ``out``: the team a text means, by its key (or by slug first, then key).

    The text should be cleaned of prefixes before. Each distinct text is resolved once.
    """
    spelled = F.col("spelling")
    kinds = {"_slug": school_slug, "_key": school_key} if by_slug else {"_key": school_key}
    known = team_keys(t, *[f(spelled) for f in kinds.values()], short_first=short_first)
    texts = df.select(text).filter(F.col(text).isNotNull()).distinct().withColumns({n: f(text) for n, f in kinds.items()})
    for name in kinds:
        texts = texts.join(known.select(F.col("key").alias(name), F.col("found_team_id").alias(f"{name}_id")), name, "left")
    return df.join(texts.select(text, F.coalesce(*[F.col(f"{n}_id") for n in kinds]).alias(out)), text, "left")


def find_team(t: Tables, text: str) -> DataFrame:
    """The team a caller's text means: by key of any spelling, else a name that contains it."""
    from matchlens.functions.predicates import contains

    rows = team_names(t)
    exact = (school_key("spelling") == school_key(F.lit(text))) & (school_key(F.lit(text)) != "")
    part = (F.col("pos") < 2) & contains("spelling", text)
    ranked = rows.withColumn("tier", F.when(exact, 0).when(part, 1)).filter("tier is not null")
    return ranked.agg(F.min(F.struct("tier", "id")).alias("m")).select(F.lit(text).alias("text"), F.col("m.id").alias("team_id"))


def resolve_by_id_or_name(df: DataFrame, t: Tables, id_col: str, name_col: str, out: str) -> DataFrame:
    """Outside id of the season first, then the name."""
    ids = t.team_season_ids.select(F.col("season"), F.col("ncaa_team_id").alias(id_col), F.col("team_id").alias("_by_id"))
    df = df.join(ids, ["season", id_col], "left")
    return resolve_team(df, t, name_col, "_by_name").withColumn(out, F.coalesce("_by_id", "_by_name")).drop("_by_id", "_by_name")


def team_by_outside_id(df: DataFrame, t: Tables, id_col: str, out: str) -> DataFrame:
    ids = t.team_season_ids.select("season", F.col("ncaa_team_id").alias(id_col), F.col("team_id").alias(out))
    return df.join(ids, ["season", id_col], "left")


def resolve_conference(df: DataFrame, t: Tables, label: str, out: str = "conference_id") -> DataFrame:
    """Feed label → conference: aliased full name, then the label as name, then as short name."""
    alias = F.create_map(*[F.lit(x) for pair in CONFERENCE_ALIASES.items() for x in pair])
    df = df.withColumn("_full", F.coalesce(F.try_element_at(alias, F.col(label)), F.col(label)))
    conf = t.conferences
    by_name = conf.groupBy("name").agg(F.min("id").alias("_i"))
    by_short = conf.groupBy("short_name").agg(F.min("id").alias("_i"))
    df = df.join(by_name.select(F.col("name").alias("_full"), F.col("_i").alias("_1")), "_full", "left")
    df = df.join(by_name.select(F.col("name").alias(label), F.col("_i").alias("_2")), label, "left")
    df = df.join(by_short.select(F.col("short_name").alias(label), F.col("_i").alias("_3")), label, "left")
    return df.withColumn(out, F.coalesce("_1", "_2", "_3")).drop("_1", "_2", "_3").withColumnRenamed("_full", f"{out}_name")


def new_conferences(df: DataFrame, t: Tables, label: str) -> DataFrame:
    """Conferences to create for labels that resolve to none."""
    missing = resolve_conference(df.filter(F.coalesce(F.trim(label), F.lit("")) != ""), t, label, "_id").filter(F.col("_id").isNull())
    return missing.select(F.col("_id_name").alias("name")).distinct().withColumn("short_name", default_conference_short("name"))


# --- people ----------------------------------------------------------------------------------------

NAME_TIERS = ("full", "tokens", "initial", "surname")


def _tier_key(tier: str) -> Column:
    """The key of a tier, from the plain name in ``full``."""
    return {"full": F.col("full"), "tokens": F.array_join(name_tokens("full"), " "), "initial": initial_and_surname("full"), "surname": surname("full")}[tier]


def _name_keys(df: DataFrame, name: str) -> DataFrame:
    df = df.withColumn("full", plain_name(name))
    return df.withColumns({tier: _tier_key(tier) for tier in NAME_TIERS[1:]})


def _word_pairs(plain: str) -> Column:
    """All pairs of words of a name, each in alphabetical order: a handful per name."""
    words = name_tokens(plain)
    pair = lambda w: F.transform(F.filter(words, lambda v: v > w), lambda v: F.concat_ws(" ", w, v))
    return F.flatten(F.transform(words, pair))


def match_names(asked: DataFrame, roster: DataFrame, group: list[str]) -> DataFrame:
    """Match ``asked`` (``group``, ``name``) to ``roster`` (``group``, ``player_id``, ``name``).

    Tiers from strict to loose: full name, set of words, initial and surname, surname alone, and at
    least two shared words. A key two players share matches nobody; the next tier is then tried.
    Each distinct name is matched once per group, against keys reduced to their smallest and largest
    player beforehand. Sharing two words is sharing a pair of words, so the last tier needs no list
    of candidates either: the candidates over all pairs are one player when the extremes agree.
    """
    names = _name_keys(asked.select(*group, "name").distinct(), "name")
    people = _name_keys(roster.select(*group, "player_id", F.col("name").alias("roster_name")), "roster_name")
    ends = (F.min("player_id").alias("_a"), F.max("player_id").alias("_b"))
    for tier in NAME_TIERS:
        known = people.filter(F.coalesce(tier, F.lit("")) != "").groupBy(*group, tier).agg(*ends).filter("_a = _b")
        names = names.join(known.select(*group, tier, F.col("_a").alias(f"_{tier}")), [*group, tier], "left")
    names = names.withColumn("player_id", F.coalesce(*[F.col(f"_{x}") for x in NAME_TIERS]))
    # Names that are matched go along without a pair, so that the tiers are joined once.
    left = names.select(*group, "name", "player_id", F.explode_outer(F.when(F.col("player_id").isNull(), _word_pairs("full"))).alias("pair"))
    pairs = people.select(*group, "player_id", F.explode(_word_pairs("full")).alias("pair")).groupBy(*group, "pair").agg(*ends)
    found = left.join(pairs, [*group, "pair"], "left").groupBy(*group, "name").agg(
        F.max("player_id").alias("player_id"), F.min("_a").alias("_overlap"), F.max("_b").alias("_last"))
    only = F.when(F.col("_overlap") == F.col("_last"), F.col("_overlap"))
    return found.select(*group, "name", F.coalesce("player_id", only).alias("player_id"))


def match_names_on_teams(asked: DataFrame, roster: DataFrame) -> DataFrame:
    """:func:`match_names` for names asked of several teams: ``season``, ``name`` and the array ``teams`` that each is asked of.

    Gives ``season``, ``name`` and ``found``, an array of (``team_id``, ``player_id``) of the teams where it matched. A name
    moves once per tier with all of its teams, in place of once per tier and team; a key holds one entry per team
    that has it. Both arrays are bounded by the teams of a season.
    """
    names = asked.withColumns({"full": plain_name("name"), "found": F.expr("cast(array() as array<struct<team_id:int,player_id:bigint>>)")})
    people = _name_keys(roster.select("season", "team_id", "player_id", F.col("name").alias("roster_name")), "roster_name")
    ends = (F.min("player_id").alias("_a"), F.max("player_id").alias("_b"))
    # What of a key's entries the name is asked of and has not matched at a stricter tier.
    open_to = "filter(coalesce(_known, array()), x -> array_contains(teams, x.team_id))"
    for tier in NAME_TIERS:
        known = people.filter(F.coalesce(tier, F.lit("")) != "").groupBy("season", "team_id", tier).agg(*ends).filter("_a = _b")
        known = known.groupBy("season", tier).agg(F.collect_list(F.struct("team_id", F.col("_a").alias("player_id"))).alias("_known"))
        rows = names.withColumn("_key", _tier_key(tier)).join(known.withColumnRenamed(tier, "_key"), ["season", "_key"], "left").withColumn("_known", F.expr(open_to))
        names = rows.select("season", "name", "full", F.concat("found", "_known").alias("found"), F.expr("filter(teams, x -> not array_contains(transform(_known, y -> y.team_id), x))").alias("teams"))
    # Names with nothing left go along under a key that no pair has, so that the tiers are joined once.
    words = _word_pairs("full")
    left = names.select("season", "name", "teams", "found", F.posexplode(
        F.when(F.expr("size(teams) > 0") & (F.size(words) > 0), words).otherwise(F.array(F.concat(F.lit("- "), "name")))).alias("pos", "pair"))
    # What was found goes along once.
    left = left.select("season", "name", "teams", "pair", F.when(F.col("pos") == 0, F.col("found")).alias("found"))
    pairs = people.select("season", "team_id", "player_id", F.explode(_word_pairs("full")).alias("pair")).groupBy("season", "team_id", "pair").agg(*ends)
    pairs = pairs.groupBy("season", "pair").agg(F.collect_list(F.struct("team_id", "_a", "_b")).alias("_known"))
    met = left.join(pairs, ["season", "pair"], "left").select("season", "name", "found", F.expr(open_to).alias("_known")).filter("size(found) > 0 or size(_known) > 0")
    several = met.groupBy("season", "name").agg(F.first("found", ignorenulls=True).alias("found"), F.flatten(F.collect_list("_known")).alias("_met"))
    of_team = "filter(_met, y -> y.team_id = t)"
    only = f"""filter(transform(array_distinct(transform(_met, y -> y.team_id)), t -> struct(t as team_id, array_min(transform({of_team}, y -> y._a)) as _a,
        array_max(transform({of_team}, y -> y._b)) as _b)), x -> x._a = x._b)"""
    loose = F.expr(f"transform({only}, x -> struct(x.team_id as team_id, x._a as player_id))")
    return several.select("season", "name", F.when(F.col("found").isNull(), loose).otherwise(F.concat("found", loose)).alias("found")).filter("size(found) > 0")


def assign_starters(lines: DataFrame, t: Tables) -> DataFrame:
    """Give each starters line to a side.

    ``lines`` has one row per name: ``season``, ``contest_id``, ``set_number``, ``line_no``, ``name``. The side whose roster matches more of the names gets the line; the home side on a tie, and
    nobody when no name matches.
    """
    games = t.contests.select("contest_id", F.col("home_team_id").alias("home"), F.col("away_team_id").alias("away"))
    line = ["season", "contest_id", "set_number", "line_no"]
    named = lines.filter(" and ".join(f"{c} is not null" for c in [*line, "name"])).join(games, "contest_id").select(*line, "name", "home", "away")
    asked = named.select("season", "name", F.explode(F.array("home", "away")).alias("team_id")).filter("team_id is not null")
    asked = asked.groupBy("season", "name").agg(F.collect_set("team_id").alias("teams"))
    roster = t.players.select("season", "team_id", F.col("id").alias("player_id"), "name")
    found = match_names_on_teams(asked, roster)
    sides = F.expr("""flatten(transform(array(struct(0 as turn, home as team_id), struct(1 as turn, away as team_id)), s ->
        transform(filter(found, x -> x.team_id = s.team_id), x -> struct(s.turn as turn, x.team_id as team_id, x.player_id as player_id))))""")
    hits = named.join(found, ["season", "name"]).select(*line, F.explode(sides).alias("hit"))
    # A line names six players of one of two sides.
    whole = hits.groupBy(*line).agg(F.collect_set("hit").alias("hits"))
    best = """array_max(transform(array_distinct(transform(hits, x -> struct(x.turn as turn, x.team_id as team_id))), s ->
        struct(size(filter(hits, x -> x.turn = s.turn and x.team_id = s.team_id)) as n, -s.turn as o, s.team_id as team_id))).team_id"""
    return whole.withColumn("team_id", F.expr(best)).select(
        "season", "contest_id", "team_id", "set_number", F.explode(F.expr("transform(filter(hits, x -> x.team_id = team_id), x -> x.player_id)")).alias("player_id")).distinct()


def match_players_on_team(df: DataFrame, t: Tables, text: str, out: str) -> DataFrame:
    """The player of ``team_id`` and ``season`` whose name has the same words as the first of 'A, B'."""
    roster = t.players.select(
        "season", "team_id", F.col("id").alias("_pid"), canonical_name(normalize_player_name("name")).alias("_key")
    ).filter("_key <> ''").groupBy("season", "team_id", "_key").agg(F.min("_pid").alias(out))
    first = F.split(F.col(text), ",")[0]
    return df.withColumn("_key", F.nullif(canonical_name(normalize_player_name(first)), F.lit(""))).join(
        roster, ["season", "team_id", "_key"], "left").drop("_key")


def match_photos(hits: DataFrame, t: Tables) -> DataFrame:
    """Roster photo → player: same words in the name, else a jersey number worn by one player only."""
    people = t.players.select("season", "team_id", F.col("id").alias("player_id"), canonical_name("name").alias("_key"), "number")
    by_name = people.groupBy("season", "team_id", "_key").agg(F.max("player_id").alias("_n"))
    by_jersey = people.filter("number is not null").groupBy("season", "team_id", "number").agg(
        F.min("player_id").alias("_j"), F.count(F.lit(1)).alias("_c")).filter("_c = 1").drop("_c").withColumnRenamed("number", "jersey")
    return (
        hits.withColumn("_key", canonical_name("name")).join(by_name, ["season", "team_id", "_key"], "left")
        .join(by_jersey, ["season", "team_id", "jersey"], "left").withColumn("player_id", F.coalesce("_n", "_j")).drop("_key", "_n", "_j")
    )


def diff_conferences(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Compare membership (``outside_id``, ``team``, ``conference``) with a second source.

    What a foreign conference is called here is inferred as the most common name among its members.
    """
    label = F.trim(F.coalesce(F.col("o.conference"), F.lit("")))
    both = theirs.alias("x").join(ours.alias("o"), "outside_id", "full_outer")
    votes = both.filter(F.col("x.conference").isNotNull() & (label != "")).groupBy(F.col("x.conference").alias("foreign"), label.alias("own")).agg(F.count(F.lit(1)).alias("n"))
    named = votes.groupBy("foreign").agg(F.max(F.struct("n", "own")).alias("m")).select("foreign", F.col("m.own").alias("expected"))
    rows = both.select(
        "outside_id", F.coalesce("o.team", "x.team").alias("team"), F.col("o.conference").alias("own"), F.col("x.conference").alias("foreign"),
        F.col("o.team").isNotNull().alias("_o"), F.col("x.conference").isNotNull().alias("_x"),
    ).join(named, "foreign", "left")
    kind = F.when(~F.col("_o"), "missing_here").when(~F.col("_x"), "missing_there").when(
        F.col("expected").isNotNull() & (F.trim(F.coalesce("own", F.lit(""))) != F.col("expected")), "mismatch")
    return rows.withColumn("kind", kind).filter("kind is not null").select("kind", "outside_id", "team", "own", "foreign", "expected")


def backfill_ids(t: Tables, harvested: DataFrame, min_match: int = 340) -> tuple[DataFrame, Column]:
    """Teams with the outside id (``outside_id``, ``name``) their spellings match, and the write guard.

    The second value is an aggregate over the first: whether enough teams matched to write.
    """
    keyed = harvested.withColumn("key", school_key("name")).groupBy("key").agg(F.max(F.struct("outside_id", "name")).alias("h"))
    mine = team_names(t).select("id", "pos", school_key("spelling").alias("key")).filter("key <> ''")
    hit = mine.join(keyed, "key").groupBy("id").agg(F.min_by("h", F.struct("pos", "key")).alias("h"))
    rows = t.teams.join(hit, "id", "left").select("id", "name", F.col("h.outside_id").alias("outside_id"), F.col("h.name").alias("harvested_name"))
    return rows, F.count("outside_id") >= min_match


class TooFewMatched(RuntimeError):
    """A harvest matched fewer teams than a write needs."""


def backfill(t: Tables, harvested: DataFrame, season: int, min_match: int = 340) -> tuple[Tables, DataFrame]:
    """Season ids with the harvested ones, and a report of what did not match on either side.

    Refuses when fewer than ``min_match`` teams matched. Only matched teams change.
    """
    rows, enough = backfill_ids(t, harvested, min_match)
    found, ok = rows.agg(F.count("outside_id"), enough).first()
    if not ok:
        raise TooFewMatched(f"only {found} matched (< {min_match}); refusing to write")
    ids = rows.filter("outside_id is not null").select(F.col("id").alias("team_id"), F.lit(season).alias("season"), F.col("outside_id").alias("ncaa_team_id"))
    left = rows.filter("outside_id is null").select(F.lit("unmatched").alias("kind"), F.lit(None).cast("string").alias("outside_id"), "name")
    spare = harvested.join(rows.select("outside_id"), "outside_id", "left_anti").select(F.lit("unmapped").alias("kind"), "outside_id", "name")
    return t.replace(team_season_ids=upsert(t.team_season_ids, ids, ["team_id", "season"])), left.unionByName(spare)


def backfill_short_names(t: Tables, harvested: DataFrame, season: int | None = None) -> DataFrame:
    """Teams whose short name differs from the harvested one, by exact outside id."""
    ids = t.team_season_ids if season is None else t.team_season_ids.filter(F.col("season") == season)
    return (
        ids.join(harvested.select(F.col("outside_id").alias("ncaa_team_id"), F.col("name").alias("new_short")), "ncaa_team_id")
        .join(t.teams.select(F.col("id").alias("team_id"), F.col("short_name").alias("old_short")), "team_id")
        .filter(~F.col("old_short").eqNullSafe(F.col("new_short"))).select("team_id", "season", "old_short", "new_short")
    )


def name_gaps(t: Tables, season: int | None = None) -> DataFrame:
    """Play-by-play names without a player id: a variant of a roster name, or missing from it."""
    from matchlens.tables import one_season

    rows = one_season(t.pbp_events, season).filter("player_id is null and player_name is not null and touch_type <> 'terminal' and team_id is not null")
    gaps = rows.groupBy("season", "team_id", F.col("player_name").alias("name")).agg(
        F.count(F.lit(1)).alias("occurrences"), F.count_distinct("contest_id").alias("contests"))
    roster = t.players.select("season", "team_id", F.col("id").alias("player_id"), "name")
    found = match_names(gaps, roster, ["season", "team_id"])
    return gaps.join(found, ["season", "team_id", "name"]).withColumn("kind", F.when(F.col("player_id").isNull(), "ROSTER_GAP").otherwise("VARIANT"))
