"""Sentences of a scouting report, as column expressions over its nested row."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchlens.functions.parse import band, hit_text, nationally, rate_text, share_text, value_text

# Wording of the team profile.
PROFILE = {
    "in_conference": "{name} is {w}-{l} this season, {cw}-{cl} in the {conf}",
    "of_conference": "{name} ({conf}) is {w}-{l} this season",
    "plain": "{name} is {w}-{l} this season",
    "winning": "on a {n}-match win streak",
    "losing": "having lost {n} straight",
    "one_setter": " They run a 5-1 with {one} running the offense.",
    "two_setters": " They run a 6-2, splitting setting duties between {one} and {two}.",
    "attacking_setter": " {one} is an aggressive second-ball threat, swinging {rate} times per set{hitting}.",
    "and_hitting": " and hitting {hit}",
    "passing_setter": " {one} is a traditional set-first setter who rarely attacks the second ball.",
    "offense": "Offensively they're {band}{extras}.",
    "team_hitting": "hitting {hit} as a team ({place})",
    "kills": "{rate} kills per set",
    "weapon": " {who}{pos} is the primary weapon at {rate} kills/set on {hit}{tier}.",
    "elite": ", an elite mark",
    "strong": ", a strong mark",
    "others": " Secondary options: {list}.",
    "middles": "Their middles{who} take {share} of the team's swings ({band} middle usage, {place}){tail}",
    "middle_focus": " — the middle is a genuine focal point of their attack.",
    "pin_focus": " — a pin-dominant attack that leans on the outside hitters.",
    "defense": "Defensively, {bits}.",
    "hold": "they hold opponents to {hit} ({band} defense, {place})",
    "block": "block {rate}/set ({band})",
    "also": "Also standing out: {list}.",
    "early": "Note: this is an early-season read on only {n} matches — treat it as a first impression.",
}
# Wording of the advice on how to beat a team.
KEYS = {
    "lead": "How to beat {name}:{early}",
    "early": " (Early sample — these reads may shift as the season develops.)",
    "weak_rotation": "Target rotation R{no} — they side out just {so}% there, their most vulnerable rotation. Serve tough to hold them in it.",
    "soft_rotation": "Their softest receiving rotation is R{no} ({so}% sideout) — the best spot to press with your serve, though they hold up well across the board.",
    "score": "You can score on them — they let opponents hit {hit} ({band} defense). Run your offense with confidence.",
    "low_block": "Their block is modest ({rate}/set) — swing over and around it, and your middles should find room.",
    "high_block": "They block well ({rate}/set, {place}) — don't hit into it. Tool the block off the outside hand and mix in tips and roll shots over the top to keep them off balance.",
    "middle": "They're susceptible in the middle — opposing middles hit {hit} on {rate} swings/set against them, both well above the national norm. Get your middles running quick tempo and make them defend the slide.",
    "pins": "They're susceptible on the pins — opposing outsides and right sides hit {hit} on {rate} swings/set against them, both well above average. Set your pins with confidence in transition.",
    "leaky_pass": "Their serve-receive leaks — they give up {rate} aces/set ({band} passing). Serve aggressively and go after their weaker passers.",
    "aces": "They get aced {rate} times per set.",
    "errors": "They give points away with hitting errors — keep balls in play and make them beat you across a long rally.",
    "system": "Serve them off the net — they're notably sharper in system than out, so first-contact pressure pays off.",
    "rounded": "This is a well-rounded team with few obvious holes — their least dominant area is {label} ({place}), so that's where to apply pressure.",
    "unknown": "Not enough data yet to identify clear weaknesses.",
    "no_pbp": "Rotation-level detail isn't available for this team yet (no play-by-play), so these keys are based on box-score trends.",
}
# Metrics the profile already tells, left out of its list of standouts.
TOLD = ("hit_pct", "kills_per_set", "opp_hit_pct", "blocks_per_set", "middle_share", "win_pct", "set_pct", "opp_kills_per_set")


def say(wording: str, **values: Column) -> Column:
    """A wording with its places filled; a missing value leaves its place empty."""
    parts = [p for p in re.split(r"(\{\w+\})", wording) if p]
    return F.concat(*[F.coalesce(values[p[1:-1]].cast("string"), F.lit("")) if p.startswith("{") else F.lit(p) for p in parts])


def _pct(key: str) -> Column:
    return F.try_element_at("pct", F.lit(key))["pct"]


def _value(key: str) -> Column:
    return F.try_element_at("pct", F.lit(key))["value"]


def short_name(name: Column | str) -> Column:
    """Name without a trailing note of several words in brackets."""
    name = F.col(name) if isinstance(name, str) else name
    note = F.trim(F.regexp_extract(name, r"\(([^()]*)\)\s*$", 1))
    return F.when(F.contains(note, F.lit(" ")), F.trim(F.regexp_replace(name, r"\s*\([^()]*\)\s*$", ""))).otherwise(name)


def _first(array: str) -> Column:
    return F.try_element_at(array, F.lit(1))


def _record_line() -> Column:
    rec = {"w": "wins", "l": "losses", "cw": "conf_wins", "cl": "conf_losses", "conf": "conference"}
    fields = {k: F.col(f"record.{v}") for k, v in rec.items()} | {"name": short_name("team")}
    known, in_league = fields["w"].isNotNull(), fields["conf"].isNotNull()
    opening = F.when(known, F.when(in_league & (fields["cw"] + fields["cl"] > 0), say(PROFILE["in_conference"], **fields))
                     .when(in_league, say(PROFILE["of_conference"], **fields)).otherwise(say(PROFILE["plain"], **fields)))
    run = F.col("record.win_streak")
    streak = F.when(run >= 3, say(PROFILE["winning"], n=run)).when(run <= -3, say(PROFILE["losing"], n=-run))
    return F.concat(F.coalesce(F.nullif(F.concat_ws(", ", opening, streak), F.lit("")), fields["name"]), F.lit("."))


def _system_line() -> Column:
    one, two = (F.try_element_at("system.setters", F.lit(i)) for i in (1, 2))
    swings, place, hit = F.col("system.attacks_per_set"), F.col("system.attack_pct"), F.col("system.setter_hit_pct")
    hitting = F.when(hit.isNotNull(), say(PROFILE["and_hitting"], hit=hit_text(hit)))
    style = F.when(swings.isNotNull(), F.when(place >= 80, say(PROFILE["attacking_setter"], one=one, rate=rate_text(swings), hitting=hitting))
                   .when(place <= 40, say(PROFILE["passing_setter"], one=one)))
    kind = F.col("system.type")
    return F.when(kind == "5-1", F.concat(say(PROFILE["one_setter"], one=one), F.coalesce(style, F.lit("")))).when(
        kind == "6-2", say(PROFILE["two_setters"], one=one, two=two))


def _hitter(h: Column) -> Column:
    pos = F.nullif(h["position"], F.lit(""))
    return F.concat(h["name"], F.lit(" ("), F.concat_ws(", ", pos, F.concat(rate_text(h["kills_per_set"]), F.lit("/set"))), F.lit(")"))


def _offense_line() -> Column:
    hit, kills = _value("hit_pct"), _value("kills_per_set")
    extras = F.concat_ws(" and ", F.when(hit.isNotNull(), say(PROFILE["team_hitting"], hit=hit_text(hit), place=nationally(_pct("hit_pct")))),
                         F.when(kills.isNotNull(), say(PROFILE["kills"], rate=rate_text(kills))))
    top = _first("hitters")
    pos = F.when(F.coalesce(top["position"], F.lit("")) != "", F.concat(F.lit(" ("), top["position"], F.lit(")")))
    tier = F.when(top["nat_pct"] >= 85, PROFILE["elite"]).when(top["nat_pct"] >= 65, PROFILE["strong"])
    star = F.when(top.isNotNull(), say(PROFILE["weapon"], who=top["name"], pos=pos, rate=rate_text(top["kills_per_set"]), hit=hit_text(top["hit_pct"]), tier=tier))
    rest = F.array_join(F.transform(F.slice("hitters", 2, 2), _hitter), ", ")
    more = F.when(F.size("hitters") > 1, say(PROFILE["others"], list=rest))
    said = F.when(extras != "", F.concat(F.lit(" — "), extras))
    return F.concat(say(PROFILE["offense"], band=band(_pct("hit_pct")), extras=said), F.coalesce(star, F.lit("")), F.coalesce(more, F.lit("")))


def _middle_line() -> Column:
    pct = _pct("middle_share")
    who = F.when(F.size("middles") > 0, F.concat(F.lit(" ("), F.array_join(F.transform("middles", lambda m: m["name"]), " and "), F.lit(")")))
    tail = F.when(pct >= 75, PROFILE["middle_focus"]).when(pct <= 25, PROFILE["pin_focus"]).otherwise(".")
    return F.when(pct.isNotNull(), say(PROFILE["middles"], who=who, share=share_text(_value("middle_share")), band=band(pct), place=nationally(pct), tail=tail))


def _defense_line() -> Column:
    opp, block = _pct("opp_hit_pct"), _pct("blocks_per_set")
    bits = F.concat_ws(" and ", F.when(opp.isNotNull(), say(PROFILE["hold"], hit=hit_text(_value("opp_hit_pct")), band=band(opp), place=nationally(opp))),
                       F.when(block.isNotNull(), say(PROFILE["block"], rate=rate_text(_value("blocks_per_set")), band=band(block))))
    return F.when(bits != "", say(PROFILE["defense"], bits=bits))


def profile_paragraphs() -> Column:
    """Who the team is and how it plays."""
    new = F.slice(F.filter("strengths", lambda s: ~s["key"].isin(*TOLD)), 1, 3)
    told = F.array_join(F.transform(new, lambda s: F.concat(s["label"], F.lit(" ("), value_text(s["kind"], s["value"]), F.lit(", "), nationally(s["pct"]), F.lit(")"))), "; ")
    return F.array_compact(F.array(
        F.concat(_record_line(), F.coalesce(_system_line(), F.lit(""))), _offense_line(), _middle_line(), _defense_line(),
        F.when(F.size(new) > 0, say(PROFILE["also"], list=told)), F.when(F.col("low_sample"), say(PROFILE["early"], n=F.col("matches"))),
    ))


def _levers() -> list[Column]:
    no = F.col("rotations.weakest")
    so = F.try_element_at(F.filter("rotations.table", lambda r: r["rotation"] == no), F.lit(1))["sideout_pct"]
    opp, block, ace = _pct("opp_hit_pct"), _pct("blocks_per_set"), _pct("opp_aces_per_set")
    block_rate, ace_rate = rate_text(_value("blocks_per_set")), rate_text(_value("opp_aces_per_set"))
    lane = lambda side: F.when((_pct(f"opp_{side}_hit_pct") >= 65) & (_pct(f"opp_{side}_atks_per_set") >= 60), say(
        KEYS["middle" if side == "mid" else "pins"], hit=hit_text(_value(f"opp_{side}_hit_pct")), rate=rate_text(_value(f"opp_{side}_atks_per_set"))))
    return [
        F.when(so < 55, say(KEYS["weak_rotation"], no=no, so=so)).when(so.isNotNull(), say(KEYS["soft_rotation"], no=no, so=so)),
        F.when(opp <= 40, say(KEYS["score"], hit=hit_text(_value("opp_hit_pct")), band=band(opp))),
        F.when(block <= 30, say(KEYS["low_block"], rate=block_rate)).when(block >= 70, say(KEYS["high_block"], rate=block_rate, place=nationally(block))),
        lane("mid"), lane("pin"),
        F.when(ace <= 30, say(KEYS["leaky_pass"], rate=ace_rate, band=band(ace))).when(ace.isNotNull(), say(KEYS["aces"], rate=ace_rate)),
        F.when(_pct("hit_errors_per_set") <= 25, KEYS["errors"]),
    ]


def key_paragraphs() -> Column:
    """How to beat the team: a heading, then one sentence per lever found."""
    noted = F.transform(F.filter("notes", lambda n: n["kind"] == "weakness"), lambda n: n["text"])
    found = F.concat(F.array_compact(F.array(*_levers())), F.coalesce(noted, F.array().cast("array<string>")))
    said = F.exists(found, lambda k: k.rlike("out of (system|it)"))
    found = F.concat(found, F.array_compact(F.array(F.when((F.col("phase.in_out_gap") >= 0.080) & ~said, KEYS["system"]))))
    order = F.array_sort(F.transform(F.map_values("pct"), lambda v: F.struct(v["pct"].alias("pct"), v["no"].alias("no"), v["label"].alias("label"))))
    soft = F.try_element_at(order, F.lit(1))
    none = F.when(soft.isNotNull(), say(KEYS["rounded"], label=soft["label"], place=nationally(soft["pct"]))).otherwise(KEYS["unknown"])
    lead = say(KEYS["lead"], name=short_name("team"), early=F.when(F.col("low_sample"), KEYS["early"]))
    return F.concat(
        F.array(lead), F.when(F.size(found) > 0, found).otherwise(F.array(none)), F.array_compact(F.array(F.when(~F.col("has_pbp"), KEYS["no_pbp"]))))
