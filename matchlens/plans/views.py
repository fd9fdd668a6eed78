"""The tables of ``sources.adapter`` as common table expressions for the check queries."""

from __future__ import annotations

import re

from matchlens.sources.adapter import PER_SEASON, PORTABLE, RAW
from matchlens.sources.staged import STAGED

_SEASONS = "(select distinct cast(year(o_orderdate) as int) as season from orders)"


def _plain(text: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", text)


def _seasoned(name: str, rows: str) -> str:
    return PER_SEASON[name].replace("{season_rows}", rows)


VIEWS: dict[str, str] = {n: _plain(s) for n, s in (PORTABLE | STAGED).items()}
VIEWS |= {
    "seasons": _SEASONS.strip("()"),
    "teams": """
        select cast(n_nationkey as int) as id, n_name as name, concat('N-', cast(n_nationkey as string)) as short_name,
          cast(n_regionkey as int) as conference_id, case when n_nationkey % 2 = 0 then 'IN' else 'TX' end as state,
          [concat('The ', n_name, ' University'), concat('Nat''l Sch. ', n_nationkey)] as aliases,
          case when n_nationkey % 5 <> 0 then cast(n_nationkey + 1 as int) end as rpi_rank,
          concat(cast(n_nationkey as string), '-1') as rpi_record,
          case when n_nationkey < 10 then cast(10 - n_nationkey as int) end as avca_rank
        from nation""",
    "team_season_ids": _seasoned("team_season_ids", f"nation cross join {_SEASONS} y"),
    "players": _seasoned("players", f"part cross join {_SEASONS} y"),
    "ranking_snapshots": _seasoned(
        "ranking_snapshots", f"nation cross join {_SEASONS} y cross join ranking_weeks w"
    ),
    "pbp_seq": """
        select e.*, row_number() over (partition by user_id order by ts, event_id) as seq,
          case when event_type in ('purchase', 'error') then 1 else 0 end as is_term from events e""",
    "pbp_rally": """
        select s.*, cast(1 + coalesce(sum(is_term) over (partition by user_id order by seq rows between unbounded preceding and 1 preceding), 0) as int) as rally_number
        from pbp_seq s""",
    "pbp_base": """
        select k.contest_id, k.season, cast(1 + floor((rally_number - 1) / 25) as int) as set_number, rally_number,
          cast(seq as int) as seq,
          case when is_term = 1 then 'terminal' when event_id % 17 = 0 then 'sub_in' when event_id % 19 = 0 then 'sub_out'
               when row_number() over (partition by user_id, rally_number order by seq) = 1 then 'serve'
               when event_type = 'view' then 'reception' when event_type = 'click' then 'attack' else 'set' end as touch_type,
          case when event_id % 23 <> 0 then cast((event_id % 2) * 100 + cast(floor(value) as int) % 8 as bigint) end as player_id,
          event_id,
          case when event_id % 2 = 0 then k.home_team_id else k.away_team_id end as team_id,
          is_term = 1 as is_terminal,
          case when event_type = 'purchase' then case when event_id % 5 = 0 then 'ace' when event_id % 7 = 0 then 'block' else 'kill' end
               when event_type = 'error' then case when event_id % 5 = 0 then 'service_error' when event_id % 7 = 0 then 'set_error' else 'attack_error' end end as terminal_type,
          case when is_term = 1 then case when (event_id % 2 = 0) = (event_type = 'purchase') then k.home_team_id else k.away_team_id end end as scoring_team_id,
          k.home_team_id, k.away_team_id
        from pbp_rally r join contests k on k.contest_id = cast(r.user_id as string)""",
    "pbp_events": """
        select contest_id, season, set_number, rally_number, seq, touch_type,
          case when player_id is not null then concat('Player ', cast(player_id as string), case when event_id % 29 = 0 then ', Player Z' else '' end) end as player_name,
          player_id, team_id, is_terminal, terminal_type, scoring_team_id,
          case when is_terminal then cast(sum(case when scoring_team_id = away_team_id then 1 else 0 end) over (partition by contest_id, set_number order by seq) as int) end as away_score,
          case when is_terminal then cast(sum(case when scoring_team_id = home_team_id then 1 else 0 end) over (partition by contest_id, set_number order by seq) as int) end as home_score
        from pbp_base""",
    "contest_set_starters": """
        select distinct contest_id, team_id, set_number, player_id, season from pbp_events
        where cast(contest_id as bigint) % 4 = 0 and player_id % 2 = 0 and set_number = 1""",
}


def half_even(text: str) -> str:
    """``round(x, n)`` for n of 1 to 3 as rounding of the binary value with halves to even.

    DuckDB's own ``round`` takes halves up; published figures are rounded half to even.
    """
    out, at = "", 0
    while (i := text.find("round(", at)) >= 0:
        if i and (text[i - 1].isalnum() or text[i - 1] == "_"):
            out, at = out + text[at : i + 6], i + 6
            continue
        depth, j, comma = 1, i + 6, -1
        while depth:
            depth += {"(": 1, ")": -1}.get(text[j], 0)
            comma = j if text[j] == "," and depth == 1 else comma
            j += 1
        digits = text[comma + 1 : j - 1].strip()
        inner = half_even(text[i + 6 : comma])
        plain = f"round({inner}, {digits})"
        exact = f"cast(format('{{:.{digits}f}}', cast({inner} as double)) as double)"
        out += text[at:i] + (exact if digits in ("1", "2", "3") else plain)
        at = j
    return out + text[at:]


def check_sql(body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` preceded by the views it uses, directly or through others, as one statement."""
    library = VIEWS | {n: half_even(v) for n, v in (extra or {}).items()}
    body = half_even(body)
    wanted: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for word in re.findall(r"[a-z_][a-z0-9_]*", text):
            if word in library and word not in seen:
                seen.add(word)
                visit(library[word])
                wanted.append(word)

    visit(body)
    if not wanted:
        return body
    parts = ",\n".join(f"{n} as ({library[n].strip()})" for n in wanted)
    body = body.strip()
    if body[:5].lower() == "with ":
        return f"with {parts},\n{body[5:]}"
    return f"with {parts}\n{body}"


__all__ = ["RAW", "VIEWS", "check_sql"]
