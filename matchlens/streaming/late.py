"""What the watermark would drop, kept aside.

Spark drops rows that are older than the watermark without a word. Here the state of a stream sees every
row, together with the watermark, and marks it: in time, a repeat, or late. Keys are remembered until the
watermark passes them, in hash groups, so that a task handles many keys per call.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, StructField, StructType

from matchlens.streaming.jobs import LATE

#: Hash groups of keys. The state of a group holds the keys of its share of the trailing window.
GROUPS = 256


def marked(stream: DataFrame, keys: list[str], time: str, late: str = LATE, groups: int = GROUPS) -> DataFrame:
    """The rows of ``stream`` without repeats within the window, and ``late``: whether the row was older than the
    watermark when it came. A late row cannot be told from a repeat of one that was forgotten; the batch job
    that takes the late rows up compares them with the stored ones. Rows without a time are late.
    """
    out = StructType([*stream.schema.fields, StructField("late", BooleanType())])
    names = stream.columns

    def step(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen: dict[tuple, int] = pickle.loads(state.get[0]) if state.exists else {}
        mark = state.getCurrentWatermarkMs()
        for part in parts:
            old = part["_ms"].isna() | (part["_ms"] < mark)
            taken = []
            for i, key in enumerate(zip(*(part[k] for k in keys))):
                if old.iat[i]:
                    taken.append(True)
                else:
                    taken.append(key not in seen)
                    seen.setdefault(key, int(part["_ms"].iat[i]))
            yield part.assign(late=old)[taken][[*names, "late"]]
        state.update((pickle.dumps({k: ms for k, ms in seen.items() if ms >= mark}),))

    group = F.pmod(F.xxhash64(*keys), F.lit(groups)).cast("int").alias("_group")
    given = stream.withWatermark(time, late).select(*names, group, F.unix_millis(F.col(time).cast("timestamp")).alias("_ms"))
    # Without a time-out of event time the state function gets the rows that are behind the watermark too.
    return given.groupBy("_group").applyInPandasWithState(step, out, "seen binary", "append", GroupStateTimeout.NoTimeout)
