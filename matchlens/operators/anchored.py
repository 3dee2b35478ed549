"""A rate cap whose windows are anchored: a window starts at the first record that the previous one doesn't hold.

Where a window starts depends on all windows before it. A chunk of time turns the open window it is given into the one it leaves: a
function with a few steps, found for every chunk on its own. Functions of neighbouring chunks compose to one of the same kind, and
composing is associative, so a tree of them tells every chunk which window is open; the chunks are then replayed side by side.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FAN_IN = 256                 # chunks whose functions are composed at once
CHUNK_TIMES = 1 << 20        # distinct times of a chunk, about; a chunk of one window's length holds as many as there are
CHUNK_WINDOWS = 4096         # windows of a chunk at most
NEVER = -(1 << 62)           # the end of no window


def leap(times: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The function of a chunk with the sorted times: (until, anchor) steps.

    A window open until some time that is no later than until[k] (and later than until[k - 1]) leaves anchor[k] as the last start of a window; one open
    until after all of them stays open. Only times of the first window's length can be steps, and the first after these.
    """
    following = np.searchsorted(times, times + length)
    last = np.arange(len(times))
    inside = following < len(times)
    while inside.any():                                          # by doubling: from each start to the chunk's last one
        last[inside] = last[following[inside]]
        following[inside] = following[following[inside]]
        inside &= following < len(times)
    steps = min(len(times), int(np.searchsorted(times, times[0] + length)) + 1)
    return merged(times[:steps], times[last[:steps]])


def merged(until: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same function with one step for each stretch of equal anchors."""
    ends = np.concatenate([anchor[1:] != anchor[:-1], [True]]) if len(anchor) else np.zeros(0, bool)
    return until[ends], anchor[ends]


def left_by(steps: tuple[np.ndarray, np.ndarray], anchor: int, length: int) -> int:
    """The last start of a window after the chunk, given the one before it (NEVER for none)."""
    until, anchors = steps
    at = int(np.searchsorted(until, anchor + length if anchor != NEVER else NEVER))
    return int(anchors[at]) if at < len(until) else anchor


def composed(first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """The function of two neighbouring chunks: each step of the first goes on through the second, and so do windows open beyond it."""
    until, anchor = first
    at = np.searchsorted(second[0], anchor + length)
    beyond = at < len(second[0])
    through = anchor.copy()
    through[beyond] = second[1][at[beyond]]
    more = second[0] > (until[-1] if len(until) else NEVER)
    return merged(np.concatenate([until, second[0][more]]), np.concatenate([through, second[1][more]]))


def _steps(frame: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.asarray(u, np.int64), np.asarray(a, np.int64)) for u, a in zip(frame["until"], frame["anchor"], strict=True)]


def _given(frame: pd.DataFrame, first: int, length: int) -> list[int]:
    """The last start of a window before each of the neighbouring chunks."""
    out = [first]
    for steps in _steps(frame)[:-1]:
        out.append(left_by(steps, out[-1], length))
    return out


def anchors(times: DataFrame, key: str, length: int) -> DataFrame:
    """key, t and anchor, the start of the window that holds t, for distinct rows (key, t): t a long, length in its units.

    A task holds the distinct times of a chunk, or one step function for each of FAN_IN chunks or, last, of FAN_IN ** 2 chunks.
    """
    kind = times.schema[key].dataType.simpleString()
    widest = length * CHUNK_WINDOWS
    start = F.col("t") - F.pmod("t", F.lit(widest))
    # Stretches with many times get chunks as short as they need; none is shorter than a window.
    crowd = times.groupBy(key, start.alias("start")).agg(F.count(F.lit(1)).alias("crowd"))
    width = F.greatest(F.lit(length), F.floor(F.lit(widest) / F.ceil(F.col("crowd") / CHUNK_TIMES))).cast("long")
    crowd = crowd.select(F.col(key).alias("_key"), F.col("start").alias("_start"), width.alias("width"))
    placed = times.join(crowd, F.col(key).eqNullSafe(F.col("_key")) & (start == F.col("_start")))
    # A rest at the end of a stretch, shorter than a chunk, goes to the chunk before it.
    nth = F.least(F.floor((F.col("t") - F.col("_start")) / F.col("width")), F.floor(F.lit(widest) / F.col("width")) - 1)
    placed = placed.select(key, "t", (F.col("_start") + nth * F.col("width")).cast("long").alias("chunk"))

    def function(frame: pd.DataFrame) -> pd.DataFrame:
        until, anchor = leap(np.sort(frame["t"].to_numpy(np.int64)), length)
        return pd.DataFrame({key: frame[key].iloc[:1].array, "chunk": frame["chunk"].iloc[:1].array, "until": [until], "anchor": [anchor]})

    def compose(frame: pd.DataFrame) -> pd.DataFrame:
        until, anchor = reduce(lambda f, g: composed(f, g, length), _steps(frame.sort_values("chunk")))
        return pd.DataFrame({key: frame[key].iloc[:1].array, "part": frame["part"].iloc[:1].array, "until": [until], "anchor": [anchor]})

    def from_root(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part")
        return pd.DataFrame({"_key": frame[key], "_part": frame["part"], "given": _given(frame, NEVER, length)})

    def from_part(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("chunk")
        return pd.DataFrame({"_key": frame[key], "_chunk": frame["chunk"], "given": _given(frame, int(frame["given"].iloc[0]), length)})

    def replay(frame: pd.DataFrame) -> pd.DataFrame:
        t, given = np.sort(frame["t"].to_numpy(np.int64)), int(frame["given"].iloc[0])
        found = np.full(len(t), given)
        at = int(np.searchsorted(t, given + length)) if given != NEVER else 0
        while at < len(t):
            to = int(np.searchsorted(t, t[at] + length))
            found[at:to] = t[at]
            at = to
        return pd.DataFrame({key: frame[key].array, "t": t, "anchor": found})

    steps = "until array<long>, anchor array<long>"
    leaps = placed.groupBy(key, "chunk").applyInPandas(function, f"{key} {kind}, chunk long, {steps}")
    rank = F.row_number().over(Window.partitionBy(key).orderBy("chunk"))
    leaps = leaps.withColumn("part", F.floor((rank - 1) / FAN_IN))
    parts = leaps.groupBy(key, "part").applyInPandas(compose, f"{key} {kind}, part long, {steps}")
    root = parts.groupBy(key).applyInPandas(from_root, f"_key {kind}, _part long, given long")
    same = F.col(key).eqNullSafe(F.col("_key"))
    chunks = leaps.join(root, same & (F.col("part") == F.col("_part"))).drop("_key", "_part")
    chunks = chunks.groupBy(key, "part").applyInPandas(from_part, f"_key {kind}, _chunk long, given long")
    opened = placed.join(chunks, same & (F.col("chunk") == F.col("_chunk"))).select(key, "t", "chunk", "given")
    return opened.groupBy(key, "chunk").applyInPandas(replay, f"{key} {kind}, t long, anchor long")


def anchored_cap(rows: DataFrame, key: str, ts: str, order: tuple[str, ...] = (), limit: int = 60, seconds: int = 60) -> DataFrame:
    """The rows that a cap of limit rows per anchored window and key passes: by time, ties by order.

    Rows without a time don't pass; a null key is a key. A key may own all rows: equal times are counted before the shuffle, and of these no
    more than limit rows leave a task.
    """
    timed = rows.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp"))).where(F.col("_t").isNotNull())
    counts = timed.groupBy(F.col(key).alias("key"), F.col("_t").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    window = Window.partitionBy("key", "anchor").orderBy("t")
    found = anchors(counts.select("key", "t"), "key", seconds * 1_000_000)
    held = counts.join(found.withColumnsRenamed({"key": "_key", "t": "_at"}), F.col("key").eqNullSafe(F.col("_key")) & (F.col("t") == F.col("_at")))
    before = held.select("key", "t", (F.sum("n").over(window) - F.col("n")).alias("before")).where(F.col("before") < limit)
    nth = F.row_number().over(Window.partitionBy(key, "_t").orderBy(*(order or (ts,))))
    few = timed.withColumn("_nth", nth).where(F.col("_nth") <= limit)
    passed = few.join(before, F.col(key).eqNullSafe(F.col("key")) & (F.col("_t") == F.col("t")) & (F.col("_nth") <= limit - F.col("before")))
    return passed.select(*(few[c] for c in rows.columns))
