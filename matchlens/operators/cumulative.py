"""Season lines kept up to date from what changed, in place of being summed up anew.

The view holds sums per (player, season, team): every counter's sum and how many lines had it, and matches. All of
these can be taken back. A refresh reads the box-line buckets that differ between the version it last saw and the
newest one, as they were and as they are, and adds the difference. Readers see the view's last
version until the refresh commits. Where the last version seen is gone, or another refresh came first and
left none to build on, the view is summed up in full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructType

from matchlens.operators.totals import with_rates
from matchlens.sources.versioned import Conflict, Manifest, VersionedTable
from matchlens.tables import COUNTERS

KEYS = ["player_id", "season", "team_id"]
SUMMED = ["sets", *COUNTERS]
SOURCE = "box lines"


def partial_sums(lines: DataFrame, sign: str = "1") -> DataFrame:
    """Sums per (player, season, team). A match counts once per player, for the larger team should there be two;
    all lines of a match lie in one bucket, so sums of buckets add up. Lines are counted ``sign`` times, which
    tells those to take back (-1) from those to add. They move once, by player, before they are widened into sums."""
    dealt = lines.withColumn("_sign", F.expr(sign).cast("int")).repartition("player_id", "season")
    match = dealt.groupBy("_sign", "player_id", "season", "contest_id").agg(F.max("team_id").alias("team_id"), *[f(c).alias(f"{k}_{c}") for c in SUMMED for k, f in (("sum", F.sum), ("n", F.count))])
    sums = [F.coalesce(F.sum(F.col("_sign") * F.col(f"sum_{c}")), F.lit(0.0)).alias(f"sum_{c}") for c in SUMMED]
    counts = [F.sum(F.col("_sign") * F.col(f"n_{c}")).alias(f"n_{c}") for c in SUMMED]
    return match.groupBy(*KEYS).agg(F.sum("_sign").alias("matches"), *sums, *counts)


def _schema() -> StructType:
    made = StructType().add("player_id", LongType()).add("season", IntegerType()).add("team_id", IntegerType()).add("matches", LongType())
    for c in SUMMED:
        made = made.add(f"sum_{c}", DoubleType())
    for c in SUMMED:
        made = made.add(f"n_{c}", LongType())
    return made


class SeasonView:
    """Season lines of the box lines in ``lines``, a table bucketed by ``contest_id``, kept at ``path``.

    Counters are multiples of one half, so that adding and taking back is exact.
    """

    def __init__(self, spark: SparkSession, path: str, lines: VersionedTable, buckets: int = 64):
        if lines.by != ["contest_id"]:
            raise ValueError("box lines have to be bucketed by contest_id")
        self.lines = lines
        self.table = VersionedTable(spark, path, _schema(), ["player_id"], buckets)

    def read(self) -> DataFrame:
        """One line per (player, season), as :func:`matchlens.operators.totals.season_totals` gives them."""
        whole = lambda c: F.when(F.sum(f"n_{c}") > 0, F.sum(f"sum_{c}"))
        sums = self.table.read().groupBy("player_id", "season").agg(
            F.max("team_id").alias("team_id"), F.sum("matches").alias("gp"), whole("sets").alias("sp"), *[whole(c).alias(c) for c in COUNTERS])
        return with_rates(sums)

    def refresh(self) -> str:
        """Bring the view to the newest version of the lines. Tells how: ``current``, ``changes`` or ``full``."""
        for _ in range(2):
            seen, until = self.table.manifest(), self.lines.manifest().version
            since = int(seen.notes.get(SOURCE, -1))
            if since == until:
                return "current"
            if since not in self.lines.versions():
                break
            try:
                self._add_changes(seen, since, until)
                return "changes"
            except Conflict:
                # Another refresh was first; what it left is the base now.
                continue
        until = self.lines.manifest().version
        self.table.replace_all(partial_sums(self.lines.read(until)), {SOURCE: str(until)})
        return "full"

    def _add_changes(self, seen: Manifest, since: int, until: int) -> None:
        changed = self.lines.changed(since, until)
        was, now = (self.lines.read(v, only=changed).withColumn("_times", F.lit(times)) for v, times in ((since, -1), (until, 1)))
        difference = partial_sums(was.unionByName(now), "_times")
        numbers = [c for c in difference.columns if c not in KEYS]
        difference = difference.filter(" or ".join(f"{c} <> 0" for c in numbers))
        add = lambda old, new: self._sum(old.unionByName(new), numbers).filter("matches <> 0")
        self.table.merge(difference, add, notes={SOURCE: str(until)}, based_on=seen.version)

    @staticmethod
    def _sum(rows: DataFrame, numbers: list[str]) -> DataFrame:
        return rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in numbers])
