"""State per match that puts its events into order and counts on, over any number of batches.

``seq`` counts a match's events from 1. Events may come in any order, several times, over several batches.
The state of a match keeps what is ahead of a hole in a buffer, and counters of the set being played; it lets go of
every event whose predecessors are all there. Each comes out once, with its rally, the score and the lead
changes up to it, so nothing is ever recomputed. A timer of event time gives up on holes: when the watermark
is past the match's last event by ``patience``, the buffer is let go in order and the rows are marked.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from matchlens.streaming.jobs import LATE

KEY = ["season", "contest_id"]
OUT = (
    "season int, contest_id string, set_number int, seq int, touch_type string, rally_number int, scoring_team_id int, side string,"
    " home_points int, away_points int, team_points int, ties int, lead_changes int, after_hole boolean"
)
STATE = "next_seq int, set_number int, rally int, home int, away int, held int, ties int, changes int, buffer binary, newest long"
FIELDS = ["set_number", "seq", "touch_type", "scoring_team_id", "side"]


class Match:
    """The counters of a match and its buffer. A buffer holds no more than a match has events."""

    def __init__(self, kept: tuple | None):
        if kept is None:
            self.next_seq, self.newest, self.buffer = 1, 0, {}
            self._new_set(None)
            self.rally = 0
        else:
            self.next_seq, self.set_number, self.rally, self.home, self.away, self.held, self.ties, self.changes, held, self.newest = kept
            self.buffer: dict[int, tuple] = pickle.loads(held)

    def _new_set(self, number: int | None) -> None:
        self.set_number, self.rally = number, 0
        self.home = self.away = self.held = self.ties = self.changes = 0

    def kept(self) -> tuple:
        return (self.next_seq, self.set_number, self.rally, self.home, self.away, self.held, self.ties, self.changes, pickle.dumps(self.buffer), self.newest)

    def add(self, events: pd.DataFrame) -> None:
        for row in events[FIELDS].itertuples(index=False, name=None):
            seq = int(row[1])
            # An event that was let go, or waits already, is a repeat.
            if seq >= self.next_seq:
                self.buffer.setdefault(seq, tuple(None if v is None or v != v else v for v in row))

    def ready(self, hole: bool = False) -> Iterator[tuple]:
        """Events in order: up to the first hole, or all of them."""
        for seq in sorted(self.buffer):
            if seq != self.next_seq:
                if not hole:
                    return
                self.next_seq = seq
            yield self._counted(self.buffer.pop(seq), hole)
            self.next_seq += 1

    def _counted(self, event: tuple, hole: bool) -> tuple:
        number, seq, touch, scorer, side = event
        if number != self.set_number:
            self._new_set(int(number))
        self.rally += touch == "serve"
        points = None
        if side is not None:
            self.home += side == "home"
            self.away += side == "away"
            points = self.home if side == "home" else self.away
            lead = (self.away > self.home) - (self.away < self.home)
            self.ties += lead == 0
            self.changes += lead != 0 and self.held not in (0, lead)
            self.held = lead or self.held
        return (int(number), int(seq), touch, self.rally, scorer, side, self.home, self.away, points, self.ties, self.changes, hole)


def in_order(events: DataFrame, time: str = "at", late: str = LATE, patience: str = "1 day") -> DataFrame:
    """Every event of a stream once, in order per match (append mode).

    ``events`` has the columns of ``KEY`` and ``FIELDS`` and an event time; ``side`` is ``home`` or ``away`` on events that
    score and null on others. Rows later than the watermark are not taken: split them off before with
    :func:`matchlens.streaming.late.marked`.
    """
    wait = int(pd.Timedelta(patience).total_seconds() * 1000)
    names = [c.split()[0] for c in OUT.split(", ")]

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        match = Match(state.get if state.exists else None)
        if state.hasTimedOut:
            waited = bool(match.buffer)
            rows = list(match.ready(hole=True))
        else:
            for part in parts:
                match.add(part)
                match.newest = max(match.newest, int(part["_at"].max()))
            rows, waited = list(match.ready()), True
        if waited:
            state.update(match.kept())
            state.setTimeoutTimestamp(max(match.newest, state.getCurrentWatermarkMs()) + wait)
        else:
            # Nothing came since the last timer: the match is over.
            state.remove()
        # A frame of objects keeps whole numbers whole beside missing ones.
        yield pd.DataFrame([(*key, *r) for r in rows], columns=names, dtype=object)

    marked = events.withWatermark(time, late).select(*KEY, *FIELDS, time, F.unix_millis(F.col(time)).alias("_at"))
    return marked.groupBy(*KEY).applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def set_lines(ordered: DataFrame) -> DataFrame:
    """Per set the score, ties and lead changes, from the stored output of :func:`in_order`."""
    last = F.max_by(F.struct("home_points", "away_points", "ties", "lead_changes"), "seq")
    return ordered.groupBy(*KEY, "set_number").agg(last.alias("l"), F.count("side").alias("n")).select(*KEY, "set_number", "l.*", "n")


def running_points(ordered: DataFrame) -> DataFrame:
    """Points per (contest, set, scoring team) so far."""
    return ordered.filter("side is not null").groupBy(*KEY, "set_number", "scoring_team_id").agg(F.max("team_points").cast("long").alias("points"))
