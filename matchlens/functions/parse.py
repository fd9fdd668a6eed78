"""Dates, times, scores and short play texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchlens.constants import BANDS, TERMINAL_WORDS, TOUCH_WORDS
from matchlens.functions.numbers import round_to
from matchlens.functions.text import normalize_text


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def league_datetime(col: Column | str) -> Column:
    """'9/7/2026 08:00 PM' → '2026-09-07 20:00'; the time may be missing."""
    s = normalize_text(col)
    day = F.regexp_extract(s, r"([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})", 1)
    clock = F.upper(F.regexp_extract(s, r"(?i)[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\s+([0-9]{1,2}:[0-9]{2}\s*[AP]M)", 1))
    half = F.regexp_replace(clock, r"\s*([AP]M)$", " $1")
    both = F.try_to_timestamp(F.concat_ws(" ", day, half), F.lit("M/d/yyyy h:mm a"))
    date = F.try_to_timestamp(day, F.lit("M/d/yyyy"))
    return F.when(day != "", F.coalesce(F.when(clock != "", F.date_format(both, "yyyy-MM-dd HH:mm")), F.date_format(date, "yyyy-MM-dd")))


def time_unset(col: Column | str) -> Column:
    """No start time published: blank, midnight on a 12-hour clock, or 00:00."""
    return F.upper(normalize_text(col)).isin("", "12:00 AM", "00:00")


def eastern_time(epoch: Column | str) -> Column:
    """Epoch seconds as a US-Eastern 12-hour time; midnight means unknown."""
    at = F.from_utc_timestamp(F.timestamp_seconds(_c(epoch)), "America/New_York")
    return F.when((_c(epoch) != 0) & ~((F.hour(at) == 0) & (F.minute(at) == 0)), F.date_format(at, "hh:mm a"))


def clean_opponent(col: Column) -> Column:
    name = F.regexp_replace(F.trim(col), r"(?i)^(?:#\s*[0-9]+|RV|NR)\s+", "")
    return F.trim(F.regexp_replace(name, r"\s*\([^)]*\)\s*$", ""))


def opponent_cell(col: Column | str) -> Column:
    """``struct(site, opponent, location)`` of '@ Team', 'Team @ Hall' or 'Team'."""
    s = normalize_text(col)
    at = F.instr(s, " @")
    away = F.struct(F.lit("away").alias("site"), clean_opponent(F.substring(s, F.lit(2), F.length(s))).alias("opponent"), F.lit(None).cast("string").alias("location"))
    hall = F.nullif(F.trim(F.substring(s, at + 2, F.length(s))), F.lit(""))
    neutral = F.struct(F.lit("neutral").alias("site"), clean_opponent(F.substring(s, F.lit(1), at - 1)).alias("opponent"), hall.alias("location"))
    home = F.struct(F.lit("home").alias("site"), clean_opponent(s).alias("opponent"), F.lit(None).cast("string").alias("location"))
    return F.when(s.startswith("@"), away).when(at > 0, neutral).otherwise(home)


def set_scores(text: Column | str) -> Column:
    """Set scores from their JSON text."""
    return F.from_json(_c(text), "away array<int>, home array<int>")


def played_sets(away: Column, home: Column) -> Column:
    """Scores of the sets both sides played; trailing blanks fall away."""
    pairs = F.filter(F.arrays_zip(away.alias("a"), home.alias("h")), lambda p: p["a"].isNotNull() & p["h"].isNotNull())
    return F.struct(F.transform(pairs, lambda p: p["a"]).alias("away"), F.transform(pairs, lambda p: p["h"]).alias("home"))


def starter_names(text: Column | str) -> Column:
    """Names of a '… starters: A; B; C.' line."""
    listed = F.regexp_extract(_c(text), r"(?i)starters:\s*(.+)$", 1)
    names = F.transform(F.split(listed, "[;,]"), lambda n: F.trim(F.regexp_replace(F.trim(n), r"\.+$", "")))
    return F.filter(names, lambda n: n != "")


def play_kind(text: Column | str, scoring: Column) -> Column:
    """``struct(touch, outcome, player, receiver)`` of one play text.

    ``scoring`` marks a scoring play. Errors are recognised before the words they contain. Texts
    that are no touch (breaks, challenges, markers) give a NULL touch.
    """
    s = normalize_text(F.translate(_c(text), " \u0001", "  "))
    low = F.lower(s)
    outcome = F.lit("other")
    for words, kind in reversed(TERMINAL_WORDS):
        outcome = F.when(F.contains(low, F.lit(words)), kind).otherwise(outcome)
    by = F.regexp_extract(s, r"(?i)^(.+?) by (.+)$", 1)
    done_by = F.regexp_extract(s, r"(?i)^(.+?) by (.+)$", 2)
    to = r"(?i)^(.+?) serves to (.+)$"
    alone = r"(?i)^(.+?) serves(?:\s+an\s+ace)?$"
    server = F.coalesce(F.nullif(F.regexp_extract(s, to, 1), F.lit("")), F.nullif(F.regexp_extract(s, alone, 1), F.lit("")))
    sub = F.lower(F.regexp_extract(s, r"(?i)^Sub (in|out) (.+)$", 1))
    touch = F.lit(None).cast("string")
    for word in reversed(TOUCH_WORDS):
        touch = F.when(F.lower(by).startswith(word), word).otherwise(touch)
    skip = s.isin("Match started", "Set started", "Match ended", "Set ended", "") | F.contains(low, F.lit("timeout")) | F.contains(low, F.lit("challenge"))
    kind = (
        F.when(scoring, "terminal").when(skip, None).when(sub != "", F.concat(F.lit("sub_"), sub))
        .when(server.isNotNull(), "serve").otherwise(touch)
    )
    who = F.when((sub != "") & ~scoring, F.regexp_extract(s, r"(?i)^Sub (in|out) (.+)$", 2)).when(by != "", done_by).otherwise(server)
    return F.struct(
        kind.alias("touch"), F.when(scoring, outcome).alias("outcome"), who.alias("player"),
        F.when(~scoring, F.nullif(F.regexp_extract(s, to, 2), F.lit(""))).alias("receiver"),
    )


def band(pct: Column) -> Column:
    """Adjective of a percentile."""
    out = F.lit("poor")
    for low, word in reversed(BANDS):
        out = F.when(pct >= low, word).otherwise(out)
    return F.when(pct.isNull(), "unremarkable").otherwise(out)


def ordinal(n: Column) -> Column:
    teen = (n % 100).between(10, 20)
    suffix = F.when(teen, "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), suffix)


def nationally(pct: Column) -> Column:
    return F.when(pct.isNull(), "").otherwise(F.concat(ordinal(F.bround(pct, 0).cast("int")), F.lit(" percentile nationally")))


def hit_text(v: Column) -> Column:
    """Hitting percentage without the leading zero: .245, -.050."""
    s = F.regexp_replace(F.format_string("%.3f", round_to(F.abs(v), 3)), "^0+", "")
    return F.when(v.isNull(), "—").when(v < 0, F.concat(F.lit("-"), s)).otherwise(s)


def rate_text(v: Column) -> Column:
    return F.when(v.isNull(), "—").otherwise(F.format_string("%.1f", round_to(v, 1)))


def share_text(v: Column) -> Column:
    return F.when(v.isNull(), "—").otherwise(F.concat(F.bround(v * 100, 0).cast("int").cast("string"), F.lit("%")))


def value_text(kind: Column, v: Column) -> Column:
    return (
        F.when(kind == "pct3", hit_text(v)).when(kind == "pctshare", share_text(v))
        .when(kind == "int", F.coalesce(v.cast("int").cast("string"), F.lit("—"))).otherwise(rate_text(v))
    )
