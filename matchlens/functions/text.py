"""Text normalisation as column expressions."""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchlens.constants import CLASS_ORDINALS, SCHOOL_STOP_WORDS, STAFF_WORDS

# Characters of code page 1252 outside Latin-1 and the bytes they stand for.
CP1252_CHARS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
CP1252_BYTES = CP1252_CHARS.encode("cp1252").decode("latin-1")


@functools.cache
def folding() -> tuple[str, str, dict[str, str]]:
    """What compatibility decomposition without combining marks does to single characters.

    Characters that become one other, those others, and a map of the characters that become several.
    Marks themselves stand last in the first text, without a counterpart. Hangul syllables, which fall
    into their letters by a rule, stay whole.
    """
    one, marks, several = [], [], {}
    for point in range(0x80, sys.maxunicode + 1):
        char = chr(point)
        if unicodedata.combining(char):
            marks.append(char)
        elif unicodedata.decomposition(char):
            plain = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
            if len(plain) == 1 and plain != char:
                one.append((char, plain))
            elif plain != char:
                several[char] = plain
    return "".join(c for c, _ in one) + "".join(marks), "".join(p for _, p in one), several


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def normalize_text(col: Column | str) -> Column:
    """Whitespace runs become one space; missing text is empty."""
    return F.trim(F.regexp_replace(F.coalesce(_c(col), F.lit("")), r"(?U)\s+", " "))


def clean_str(col: Column | str) -> Column:
    """Trimmed text, NULL when blank."""
    return F.nullif(F.trim(_c(col).cast("string")), F.lit(""))


def num(col: Column | str) -> Column:
    """A number from a cell; blanks, dashes and words give NULL."""
    text = F.trim(_c(col).cast("string"))
    return F.when(
        ~F.lower(text).isin("", "nan", "none", "-", "/"), F.regexp_replace(text, ",", "").try_cast("double")
    )


def num_int(col: Column | str) -> Column:
    return num(col).cast("bigint")


# Only texts with something beyond ASCII are looked at any closer.
BEYOND_ASCII = r"[^\x00-\x7F]"


def bound(col: Column, f: Callable[[Column], Column]) -> Column:
    """``f(col)`` with ``col`` worked out once, however often ``f`` uses it."""
    return F.transform(F.array(col), f)[0]


def fix_mojibake(col: Column | str) -> Column:
    """Undo UTF-8 that was read as Latin-1 or code page 1252; other text stays as it is.

    The characters, taken as bytes of either code page, must form valid UTF-8. Real accented text
    does not, and plain ASCII comes out unchanged.
    """

    def undone(c: Column) -> Column:
        fits = c.rlike(rf"^(?:[\x00-\xFF]*|[\x00-\x7F\xA0-\xFF{CP1252_CHARS}]*)$")
        raw = F.encode(F.when(fits, F.translate(c, CP1252_CHARS, CP1252_BYTES)), "ISO-8859-1")
        return F.when(c.rlike(BEYOND_ASCII), F.coalesce(F.try_validate_utf8(raw.cast("string")), c)).otherwise(c)

    return bound(_c(col), undone)


def strip_accents(col: Column | str) -> Column:
    """Accented and compatibility letters of any script as plain ones, inside the JVM."""
    single, plain, several = folding()
    # Ligatures, fractions and the like are rare: only texts that hold one are taken apart.
    table = F.str_to_map(F.lit("\uf8ff".join(f"{c}\uf8fe{p}" for c, p in several.items())), F.lit("\uf8ff"), F.lit("\uf8fe"))

    def spelled(c: Column) -> Column:
        letters = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")
        # The long class is asked of what is left beyond ASCII, not of the whole text.
        return F.when(F.regexp_replace(c, r"[\x00-\x7F]+", "").rlike(_any_of(several)), letters).otherwise(c)

    return bound(_c(col), lambda c: F.when(c.rlike(BEYOND_ASCII), bound(F.translate(c, single, plain), spelled)).otherwise(c))


def _any_of(chars) -> str:
    """A character class of the given characters, as ranges."""
    points = sorted(map(ord, chars))
    starts = [p for i, p in enumerate(points) if i == 0 or p != points[i - 1] + 1]
    ends = [p for i, p in enumerate(points) if i + 1 == len(points) or p != points[i + 1] - 1]
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(starts, ends)) + "]"


def normalize_player_name(col: Column | str) -> Column:
    """Jersey numbers dropped, 'Last, First' turned round."""
    text = normalize_text(F.regexp_replace(normalize_text(col), r"\b[0-9]+\b", ""))
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p))
    return F.when(F.size(parts) == 2, F.concat_ws(" ", F.element_at(parts, 2), F.element_at(parts, 1))).otherwise(text)


def _folded(col: Column | str) -> Column:
    return F.lower(normalize_text(strip_accents(fix_mojibake(F.coalesce(_c(col), F.lit(""))))))


def _words(col: Column) -> Column:
    return F.filter(F.split(col, " "), lambda w: w != "")


def school_key(col: Column | str) -> Column:
    """School name without case, accents, punctuation and filler words."""
    words = _words(F.regexp_replace(_folded(col), r"[^a-z0-9 ]", " "))
    return F.array_join(F.filter(words, lambda w: ~w.isin(*SCHOOL_STOP_WORDS)), " ")


def school_slug(col: Column | str) -> Column:
    """School name as a hyphenated slug; abbreviations stay."""
    return F.regexp_replace(F.trim(F.regexp_replace(_folded(col), r"[^a-z0-9]+", " ")), r"\s+", "-")


def canonical_name(col: Column | str) -> Column:
    """Sorted distinct lower-case words; anything but a-z separates."""
    words = _words(F.regexp_replace(F.lower(normalize_text(col)), r"[^a-z ]", " "))
    return F.array_join(F.array_sort(F.array_distinct(words)), " ")


def plain_name(col: Column | str) -> Column:
    """Lower-case name: apostrophes and full stops close up, other punctuation separates."""
    closed = F.regexp_replace(F.lower(strip_accents(fix_mojibake(F.coalesce(_c(col), F.lit(""))))), "[.'`’]", "")
    return F.trim(F.regexp_replace(closed, r"[^a-z0-9]+", " "))


def name_tokens(plain: Column | str) -> Column:
    """Sorted distinct words of a plain name."""
    return F.array_sort(F.array_distinct(_words(_c(plain))))


def initial_and_surname(plain: Column | str) -> Column:
    """First initial and last word of a plain name of at least two words."""
    words = _words(_c(plain))
    return F.when(F.size(words) >= 2, F.concat_ws(" ", F.substring(words[0], 1, 1), F.element_at(words, -1)))


def surname(plain: Column | str) -> Column:
    words = _words(_c(plain))
    return F.when(F.size(words) >= 2, F.element_at(words, -1))


def normalize_class(col: Column | str) -> Column:
    """Class text as Fr, So, Jr, Sr (with R- for a redshirt), Gr or Fifth; empty when unknown."""
    s = normalize_text(F.regexp_replace(F.lower(normalize_text(col)), r"[^a-z0-9\s\-]", " "))
    base = (
        F.when(s.rlike(r"fresh|\bfr\b|first year|\bfy\b"), "Fr")
        .when(s.rlike(r"soph|\bso\b"), "So")
        .when(s.rlike(r"junior|\bjr\b"), "Jr")
        .when(s.rlike(r"senior|\bsr\b"), "Sr")
        .when(s.rlike(r"fifth|5th|6th|sixth"), "Fifth")
        .when(s.rlike(r"grad|\bgr\b"), "Gr")
    )
    shirt = F.contains(s, F.lit("redshirt")) | s.startswith("r ")
    return (
        F.when(s.isin("fy", "first year", "first-year", "firstyear"), "Fr")
        .when(s.isin("rfr", "r-fy", "r fy", "rf", "rfy", "r-fr"), "R-Fr")
        .when(base.isNull(), "")
        .when(shirt & ~base.isin("Gr", "Fifth"), F.concat(F.lit("R-"), base))
        .otherwise(base)
    )


def normalize_height(col: Column | str) -> Column:
    """Height as feet-inches; empty when it cannot be one."""
    s = F.translate(normalize_text(col), "’`", "''")
    s = F.lower(F.trim(F.regexp_replace(F.regexp_replace(s, '"', ""), "in", "")))
    marked = F.regexp_extract_all(F.regexp_extract(s, r"^([0-9]+\s*'\s*[0-9]+|[0-9]+\s*-\s*[0-9]+)", 1), F.lit("([0-9]+)"), 1)
    every = F.regexp_extract_all(s, F.lit("([0-9]+)"), 1)

    def usable(pair: Column) -> Column:
        feet, inches = F.try_element_at(pair, F.lit(1)).try_cast("int"), F.try_element_at(pair, F.lit(2)).try_cast("int")
        return F.when((F.size(pair) == 2) & feet.between(4, 7) & inches.between(0, 11),
                      F.concat_ws("-", feet.cast("string"), inches.cast("string")))

    return F.coalesce(usable(marked), usable(every), F.lit(""))


def height_inches(col: Column | str) -> Column:
    parts = F.split(normalize_height(col), "-")
    return F.when(F.size(parts) == 2, parts[0].try_cast("int") * 12 + F.try_element_at(parts, F.lit(2)).try_cast("int"))


def position_codes(col: Column | str) -> Column:
    """Sorted codes DS, MB, OH, RS, S named by a roster position; none for staff."""
    raw = F.trim(F.regexp_replace(F.lower(normalize_text(col)), r"\.", " "))
    staff = F.lit(False)
    for word in STAFF_WORDS:
        staff = staff | F.contains(raw, F.lit(word))
    joined = normalize_text(F.regexp_replace(raw, "[/,;]+", " "))
    opp = F.contains(joined, F.lit("opp"))
    utility = joined.rlike(r"utility|\butl\b|\buu\b")
    found = {
        "DS": joined.rlike(r"libero|defensive specialist|\bds\b|(^| )(l|lib)( |$)") | utility,
        "MB": joined.rlike(r"middle|\bmb\b|\bmh\b"),
        "OH": joined.rlike(r"outside|pin|left|\boh\b|\bls\b") | utility,
        "RS": opp | joined.rlike(r"right side|rightside|\brs\b|\brh\b"),
        "S": joined.rlike(r"setter|\bs\b"),
    }
    codes = F.array_compact(F.array(*[F.when(hit, code) for code, hit in found.items()]))
    return F.when(staff, F.array().cast("array<string>")).otherwise(codes)


def default_conference_short(col: Column | str) -> Column:
    return F.regexp_replace(_c(col), r"\s+Conference$", "")


def strip_rank_prefix(col: Column | str) -> Column:
    """'#5 Team', 'No. 5 Team' and '(5) Team' without the rank."""
    return F.trim(F.regexp_replace(_c(col), r"(?i)^\s*(?:#|No\.?\s*|\(\s*)[0-9]+\)?\s*", ""))


def strip_vote_suffix(col: Column | str) -> Column:
    """'Team (57)' and 'Team [57]' without the first-place votes."""
    return F.regexp_replace(F.trim(_c(col)), r"\s*[\[(][0-9]+[\])]\s*$", "")


CLASS_CODES = tuple(CLASS_ORDINALS)
