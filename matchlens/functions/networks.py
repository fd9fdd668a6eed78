"""Channel texts to network labels, and match titles to team names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlens.constants import (
    AFFILIATED_NETWORKS, DROPPED_CHANNELS, NETWORK_HINTS, NETWORK_RULES, TITLE_PREFIXES, TITLE_SEPARATORS,
)
from matchlens.functions.text import bound

CALL_SIGN = r"\b[KW][A-Z]{2,3}(?:-[A-Z0-9]+)?\b"
STATE_THEN_CITY = r"^[A-Z]{2}\s*\|"
HOST_ONLY = r"^[a-z0-9][a-z0-9.-]*\.[a-z]{2,}$"


def _first(rules: list[tuple[Column, int]]) -> Column:
    """The number of the first rule that fits."""
    out = F.when(*[rules[0][0], F.lit(rules[0][1])])
    for fits, no in rules[1:]:
        out = out.when(fits, F.lit(no))
    return out


def _at(values: list[str | None], no: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(v).cast("string") for v in values]), no)


def with_network(df: DataFrame, channel: str, label: str = "network", logo: str = "logo_key") -> DataFrame:
    """Add the label and logo of a channel text; both NULL when it is not to be listed.

    Order matters: dropped texts, then local stations as their parent, then the rules, then a bare
    host name as a web stream. Rules are asked in order up to the first that fits, row by row.
    """
    found = df.withColumn("_found", bound(F.nullif(F.trim(F.col(channel)), F.lit("")), _network))
    return found.withColumns({label: F.col("_found.label"), logo: F.col("_found.logo")}).drop("_found")


def _network(raw: Column) -> Column:
    """Label and logo of one text. Each step is bound, so that no later one repeats it."""
    upper, low = F.upper(raw), F.lower(raw)
    # A station is local when it has a call sign, a place or a channel number beside its network.
    station = raw.rlike(CALL_SIGN) | raw.rlike(STATE_THEN_CITY)
    local = [(upper.rlike(rf"\b{w}\d*\b") & (station | upper.rlike(rf"\b{w}\s?\d{{1,2}}\b")), i) for i, (w, _) in enumerate(AFFILIATED_NETWORKS, 1)]
    dropped = F.exists(F.array(*[F.lit(x) for x in DROPPED_CHANNELS]), lambda x: F.contains(low, x))
    host = low.rlike(HOST_ONLY) & ~F.contains(low, F.lit("urldefense."))

    def ruled(source: Column) -> Column:
        return _first([(source.rlike(f"(?i){p}"), i) for i, (p, _, _) in enumerate(NETWORK_RULES, 1)])

    def told(net: Column) -> Column:
        return bound(ruled(F.coalesce(net, raw)), lambda no: F.struct(
            F.coalesce(_at([n for _, n, _ in NETWORK_RULES], no), net, F.when(host, "Web stream")).alias("label"),
            _at([k for _, _, k in NETWORK_RULES], no).alias("logo")))

    return F.when(raw.isNotNull() & ~dropped, bound(_at([n for _, n in AFFILIATED_NETWORKS], _first(local)), told))


def clean_title(col: Column | str) -> Column:
    """A programme title without markers, channel prefixes and trailing notes."""
    t = F.col(col) if isinstance(col, str) else col
    t = F.trim(F.regexp_replace(F.regexp_replace(t, "[ʰ-˿ᴀ-ᶿ⁰-₟]+", ""), "🏐", ""))
    # Prefixes nest, up to six deep; at each depth the first one that fits is taken.
    one = "|".join(f"(?:{p.removeprefix('^')})" for p in TITLE_PREFIXES)
    t = F.regexp_replace(t, f"^(?:{one}){{1,6}}", "")
    t = F.regexp_replace(t, r"\s*@.*$", "")
    t = F.regexp_replace(t, r"\s+(?:Sun|Mon|Tue|Wed|Thu|Fri|Sat)\b\.?$", "")
    t = F.regexp_replace(t, r"\s*[-–]\s*(?:Women's|Men's).*$", "")
    inner = F.trim(F.regexp_extract(t, r"\s*\(([^()]*)\)\s*$", 1))
    note = (inner != "") & (F.contains(inner, F.lit(" ")) | inner.rlike(r"\b(vs|at)\b") | F.lower(inner).isin(*NETWORK_HINTS))
    t = F.when(note, F.regexp_replace(t, r"\s*\([^()]*\)\s*$", "")).otherwise(t)
    return F.regexp_replace(t, r"^[ .\-–]+|[ .\-–]+$", "")


def matchup(col: Column | str) -> Column:
    """``struct(team_a, team_b)`` of a cleaned title, split at the first separator that fits.

    Pass the result of :func:`clean_title` kept in its own column, so that it is worked out once.
    """
    t = F.col(col) if isinstance(col, str) else col
    edge = lambda x: F.regexp_replace(x, r"^[ .\-–]+|[ .\-–]+$", "")
    out = F.lit(None)
    for sep in reversed(TITLE_SEPARATORS):
        at = F.instr(t, sep)
        a, b = edge(F.substring(t, F.lit(1), at - 1)), edge(F.substring(t, at + len(sep), F.length(t)))
        out = F.when((at > 0) & (a != "") & (b != ""), F.struct(a.alias("team_a"), b.alias("team_b"))).otherwise(out)
    return out
