"""The anchored rate cap of a stream, in order of event time whatever order records come in.

Records wait in the state store until the watermark has passed their time; timers then take the times in order. What waits is bounded: of the records
of one millisecond no more than the limit can pass, so the others are only counted. Tasks count so before the shuffle: a key that owns
all records sends limit records for each millisecond and task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MOST_TIMES = 100_000         # times that a task counts before it starts anew

_WAITING = T.StructType([T.StructField("key", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("t", T.LongType()),
                         T.StructField("body", T.StringType()), T.StructField("n", T.LongType())])


class Cap(StatefulProcessor):
    """State of a key: the start and count of its window, and for each time that isn't over the first records and the number of all."""

    def __init__(self, limit: int, seconds: int, idle: int):
        self.limit, self.length, self.idle = limit, seconds * 1000, idle * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "anchor long, count long")
        self.waiting = handle.getMapState("waiting", "t long", "n long, bodies string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for t, own in frame.groupby("t"):
                at = (int(t),)
                known = self.waiting.containsKey(at)
                n, bodies = self.waiting.getValue(at) if known else (0, "[]")
                held = json.loads(bodies)
                held += [b for b in own["body"] if b is not None][:self.limit - len(held)]
                self.waiting.updateValue(at, (int(n + own["n"].sum()), json.dumps(held)))
                if not known:
                    self.handle.registerTimer(at[0] + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() - 1
        anchor, count = self.window.get() if self.window.exists() else (None, 0)
        if self.waiting.containsKey((now,)):
            n, bodies = self.waiting.getValue((now,))
            self.waiting.removeKey((now,))
            if anchor is None or now - anchor >= self.length:
                anchor, count = now, 0
                self.handle.registerTimer(anchor + self.idle + 1)
            passed = json.loads(bodies)[:max(0, self.limit - count)]
            self.window.update((anchor, count + n))
            if passed:
                yield pd.DataFrame({"body": passed})
        elif anchor is not None and now - anchor >= self.idle:
            self.window.clear()                          # no window for so long: the next record starts one in any case

    def close(self) -> None:
        pass


def counted(records: DataFrame, limit: int) -> DataFrame:
    """key, ts, t, body, n: of each key and time the first limit records of a task, and rows without a body for the number of others."""
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[str, int], int] = {}

        def others() -> pd.DataFrame:
            rest = [(k, pd.Timestamp(t, unit="ms"), t, None, n - limit) for (k, t), n in seen.items() if n > limit]
            return pd.DataFrame(rest, columns=_WAITING.names)
        for frame in frames:
            keep = []
            for at in zip(frame["key"], frame["t"], strict=True):
                seen[at] = seen.get(at, 0) + 1
                keep.append(seen[at] <= limit)
            yield frame[keep]
            if len(seen) > MOST_TIMES:
                yield others()
                seen = {}
        yield others()
    return records.mapInPandas(count, _WAITING)


def anchored_cap(records: DataFrame, key: str, limit: int = 60, seconds: int = 60, late: str = "10 minutes", idle: int = 3600) -> DataFrame:
    """The records that pass limit records per window and key; a window starts at the first record that the previous one doesn't hold.

    Needs created_at, the time as text; records without a readable time, and those later than `late`, don't pass. Of records of the same millisecond
    those that come first do. A record is passed on once the watermark is beyond its time. The state store must be RocksDB.
    """
    ts = F.try_to_timestamp("created_at")
    body = F.to_json(F.struct(*(F.col(c) for c in records.columns)))
    timed = records.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), ts.alias("ts"), F.unix_millis(ts).alias("t"), body.alias("body"),
                           F.lit(1).cast("long").alias("n")).where("ts is not null")
    waiting = counted(timed, limit).withWatermark("ts", late).groupBy("key")
    passed = waiting.transformWithStateInPandas(Cap(limit, seconds, max(idle, seconds)), "body string", "Append", "EventTime")
    return passed.select(F.from_json("body", records.schema).alias("r")).select("r.*")
