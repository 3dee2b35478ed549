"""Mixing of sources to target weights by pivotal dependent rounding.

A document of a source of s words with target t gets t / s copies. The whole part is certain; the fractions are rounded
in pairs: mass, counted in words, moves at random from one of two documents to the other until one of them is 0 or 1. A large
document that would stay open is settled against many small ones. The words of a source so stay at the target, up to the last fraction, a small
document's. Documents meet in buckets of some thousand; each bucket leaves one fraction, and these meet again, 64 at a time, in the next level of a tree.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlens.llm.common import free_names, word_count, written

BUCKET = 4096
FAN_IN = 64
RESERVE = 4                  # times the mass of an open document that smaller ones can take or give: then it may meet the next one


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: int = 3) -> DataFrame:
    """source, source_size, n_docs, target from rows (source, size): one row per source, also for the null one.

    Sources by code point, null last, weigh `weights` in turn and share `share` of all words. A target stops at `most` times the
    source; what is over goes to the others by weight. Filling by ascending size per weight finds who stops: source i stops if its
    limit is below its part of what all before it leave. No words at all: targets are 0.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("n").alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("long"))
    per = per.withColumn("limit", F.col("source_size") * most)
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    per = (per.withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
           .withColumn("limits_before", F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
           .withColumn("weight_left", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))))
    per = per.withColumn("stops", F.col("limit").cast("double") * F.col("weight_left")
                         < (F.col("total") - F.col("limits_before")) * F.col("weight"))
    free = F.sum(F.when(~F.col("stops"), F.col("weight"))).over(every)
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("stops"), F.col("limit"))).over(every), F.lit(0))
    return per.select("source", "source_size", "n_docs", F.when(F.col("stops"), F.col("limit").cast("double"))
                      .otherwise(left * F.col("weight") / free).alias("target"))


def _transfer(part: np.ndarray, size: np.ndarray, a: int, b: int, draw: float) -> None:
    """Moves words at random between the fractions of a and b until one of them is 0 or 1; each keeps its expectation."""
    up = min((1 - part[a]) * size[a], part[b] * size[b])         # words that may move from b to a
    down = min(part[a] * size[a], (1 - part[b]) * size[b])       # and from a to b
    to_a = draw * (up + down) < down
    moved = up if to_a else -down
    # The one that reaches its bound is set to it, so that no rest of rounding keeps it open.
    if to_a:
        a_done, b_done = up >= (1 - part[a]) * size[a], up >= part[b] * size[b]
    else:
        a_done, b_done = down >= part[a] * size[a], down >= (1 - part[b]) * size[b]
    new_a = (1.0 if to_a else 0.0) if a_done else part[a] + moved / size[a]
    new_b = (0.0 if to_a else 1.0) if b_done else part[b] - moved / size[b]
    part[a], part[b] = min(1.0, max(0.0, new_a)), min(1.0, max(0.0, new_b))


def _shares(part: np.ndarray, size: np.ndarray, a: int, reserve: np.ndarray) -> np.ndarray:
    """What share of a's mass each document of the reserve can take or give, whichever way it goes."""
    up, down = (1 - part[a]) * size[a], part[a] * size[a]
    return np.minimum(part[reserve] * size[reserve] / up, (1 - part[reserve]) * size[reserve] / down)


def _settle(part: np.ndarray, size: np.ndarray, a: int, reserve: np.ndarray, draw: float) -> None:
    """Settles a against the reserve at once: its mass moves from or to documents of the reserve, each by the same share of it either way."""
    up, down = (1 - part[a]) * size[a], part[a] * size[a]
    share = _shares(part, size, a, reserve)
    share = share / share.sum()
    to_a = draw * (up + down) < down
    moved = -up if to_a else down
    part[a] = 1.0 if to_a else 0.0
    part[reserve] = np.clip(part[reserve] + moved * share / size[reserve], 0.0, 1.0)


def _too_large(part: np.ndarray, size: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Of the fractions of a whole source, by descending size: settles documents larger than all mass there is to take or to leave out.

    Nothing near the target is left if such a document is drawn; its mass goes to the smaller ones, by what they can take or give.
    """
    while len(rest) > 1:
        taken, left = part[rest] * size[rest], (1 - part[rest]) * size[rest]
        if size[rest[0]] > taken.sum():
            part[rest[1:]] += taken[0] * left[1:] / left[1:].sum() / size[rest[1:]] if taken[0] <= left[1:].sum() else 0
            part[rest[0]] = 0.0
        elif size[rest[0]] > left.sum():
            part[rest[1:]] -= left[0] * taken[1:] / taken[1:].sum() / size[rest[1:]] if left[0] <= taken[1:].sum() else 0
            part[rest[0]] = 1.0
        else:
            break
        np.clip(part, 0.0, 1.0, out=part)
        rest = rest[1:]
        rest = rest[(part[rest] > 0) & (part[rest] < 1)]
    return rest


def _round_group(frame: pd.DataFrame, level: int, seed: int) -> pd.DataFrame:
    """Settles all fractions of a group but one at most, which stays a fraction.

    Documents pair off by descending size. What stays open of a pair is mostly the larger one, so before the smaller ones become too few
    to take its mass, they settle it together, and go on among themselves: the last fraction is a small document's.
    """
    frame = frame.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable", na_position="first").reset_index(drop=True)
    source = frame["source"].iloc[0]
    name = b"" if source is None or source != source else str(source).encode("utf-8", "surrogatepass")
    random = np.random.default_rng([seed, level, zlib.crc32(name), int(frame["bucket"].iloc[0])])
    part, size = frame["part"].to_numpy(dtype=float, copy=True), frame["size"].to_numpy(dtype=float)
    rest = np.flatnonzero((part > 0) & (part < 1))
    if frame["alone"].iloc[0]:
        rest = _too_large(part, size, rest)
    while len(rest) > 1:
        draws = random.random(len(rest))
        open_at, at = rest[0], 1
        while at < len(rest) and open_at >= 0:
            behind = rest[at + 1:]
            enough = all(_shares(part, size, a, behind).sum() >= RESERVE for a in (open_at, rest[at]))
            if not enough and _shares(part, size, open_at, rest[at:]).sum() >= 1:
                _settle(part, size, open_at, rest[at:], draws[at])
                break
            _transfer(part, size, open_at, rest[at], draws[at])
            open_at = next((i for i in (open_at, rest[at]) if 0 < part[i] < 1), -1)
            at += 1
        # Settled by the smaller ones, or nothing open: they go on. Else the open one is the last.
        rest = rest[at:]
        rest = rest[(part[rest] > 0) & (part[rest] < 1)]
    frame["part"] = part
    return frame


_ROWS = "doc_id long, source string, size long, n long, whole long, part double, bucket long, alone boolean"


def _round_level(rows: DataFrame, level: int, seed: int) -> DataFrame:
    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        return _round_group(frame, level, seed)
    return rows.groupBy("source", "bucket").applyInPandas(settle, _ROWS)


def copies(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: int = 3, seed: int = 20) -> DataFrame:
    """doc_id, source, size, n, source_size, target, total: the copies that all n equal rows get together."""
    sizes = sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")).withColumn("words", F.col("size") * F.col("n"))
    sizes = written(sizes, "mixing-sizes")
    aims = written(targets(sizes.select("source", F.col("words").alias("size"), "n"), weights, share, most), "mixing-targets")
    rows = sizes.join(aims, sizes["source"].eqNullSafe(aims["source"])).select(
        "doc_id", sizes["source"], "size", "n", "n_docs",
        (F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0) * F.col("n")).alias("wanted"))
    buckets = F.ceil(F.col("n_docs") / BUCKET)
    rows = rows.select("doc_id", "source", "size", "n", F.floor("wanted").alias("whole"), F.when(F.col("size") > 0, F.col("wanted") - F.floor("wanted")).otherwise(0.0).alias("part"),
                       F.pmod(F.xxhash64("doc_id", "size"), buckets).alias("bucket"), (buckets == 1).alias("alone"))
    widest = aims.agg(F.max("n_docs")).first()[0] or 0
    levels, left = [], -(-widest // BUCKET)
    fraction = (F.col("part") > 0) & (F.col("part") < 1) & (F.col("size") > 0)
    while True:
        level = written(_round_level(rows, len(levels), seed), "mixing-level")
        done = left <= 1
        levels.append(level if done else level.where(~fraction))
        if done:
            break
        rows = level.where(fraction).withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
        left = -(-left // FAN_IN)
    settled = levels[0]
    for level in levels[1:]:
        settled = settled.unionByName(level)
    # The last fraction of a source is drawn by a hash of its document.
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    total = F.col("whole") + F.when(fraction, (drawn < F.col("part")).cast("long")).otherwise(F.round("part").cast("long"))
    settled = settled.select("doc_id", F.col("source").alias("_source"), "size", "n", total.cast("long").alias("total"))
    return settled.join(aims, F.col("_source").eqNullSafe(aims["source"])).select(
        "doc_id", "source", "size", "n", "source_size", "target", "total")


def _shared(total: str, n: str, k: str) -> Column:
    """Copies of the k-th of n equal rows."""
    return F.floor(F.col(total) / F.col(n)).cast("long") + (F.col(k) <= F.col(total) % F.col(n)).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: int = 3, seed: int = 20) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, copies, taken (size times copies).

    Size is the number of words; a null text has 0 and so nothing to take. Equal rows (document, source and size) get their
    copies together and share them evenly. Reruns draw the same. No documents: no rows.
    """
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"))
    return copies(sizes, weights, share, most, seed).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select(
        "doc_id", "source", "size", "source_size", "target", _shared("total", "n", "k").alias("copies")).withColumn(
        "taken", F.col("size") * F.col("copies"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: int = 3, seed: int = 20) -> DataFrame:
    """The mix itself: the rows of docs with all their columns, as often as they are taken."""
    columns = docs.columns
    size, doc, of, name, n, total, k, copy = free_names(docs, "size", "doc", "of", "name", "n", "total", "k", "copy")
    keyed = docs.withColumn(size, word_count(F.col("text")))
    got = copies(keyed.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.col(size).alias("size")), weights, share, most, seed)
    got = got.where("total > 0").select(F.col("doc_id").alias(doc), F.col("source").alias(name), F.col("size").alias(of),
                                        F.col("n").alias(n), F.col("total").alias(total))
    keys = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & F.col("source").eqNullSafe(F.col(name)) & (F.col(size) == F.col(of))
    joined = keyed.join(got, keys)
    joined = joined.withColumn(k, F.row_number().over(Window.partitionBy(doc, name, of).orderBy(F.xxhash64("text"))))
    times = F.array_repeat(F.lit(0), _shared(total, n, k).cast("int"))
    return joined.withColumn(copy, F.explode(times)).select(*columns)
