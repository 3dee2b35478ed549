"""A table of versions: a log of batches, and per bucket of keys an index of the rows that count.

An upsert writes its batch once, by buckets, and then works on keys only: of the touched buckets' keys, old and new, the winner is found and its place (file
and row) noted; places that lose are dead. One small manifest says which batches, index and dead places make up each bucket, and is replaced whole, so a
reader sees all of an upsert or nothing of it. Reading is a scan that leaves out dead places: documents meet no exchange and no aggregate.
A bucket with many batches or dead rows is compacted: its rows are written anew, without the dead.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchlens.streaming.store import Record, Store

MOST_BATCHES = 16            # of a bucket, before it is compacted
MOST_DEAD = 0.25             # of its rows
BROADCAST_DEAD = 500_000     # places, some 100 bytes each; more of them meet the rows by a shuffle

#: Where a row is: numbers instead of its file's path, which would be most of a key's bytes. A path is named by turn, part and piece (and the bucket).
_PLACE = ["of_turn", "part", "piece", "row"]
_STORED = ", ".join(["file string", "row long", "of_turn int", "part int", "piece int", "bucket int"])      # file: in tables of before


def _place(path: Column, row: Column) -> list[Column]:
    """The place of a row from the path that Spark gives a written file: .../turn=<turn>/bucket=<bucket>/part-<part>-....c<piece>.<...>"""
    name = F.substring_index(path, "/", -1)
    found = (F.substring_index(F.substring_index(path, "/turn=", -1), "/", 1), F.substring(F.substring_index(name, "-", 2), 6, 20),
             F.substring(F.substring_index(F.substring_index(name, ".", 2), ".", -1), 2, 20))
    return [c.cast("int").alias(n) for c, n in zip(found, _PLACE, strict=False)] + [row.alias("row")]


def _stored_place(names: list[str]) -> list[Column]:
    old = _place(F.col("file"), F.col("row"))
    return [F.coalesce(n, c).alias(a) for n, c, a in zip(_PLACE, old, names, strict=True)]



def _of(columns: str) -> T.StructType:
    return T.StructType.fromDDL(columns)


class VersionedTable:
    """Rows with a key, of which one counts: a final one beats any other, then the newest by recency (ties: the last place).

    Buckets go by the column `by` (the key itself, if none is named); rows of a key must agree in it. One writer at a time. Rows without a key are the caller's to keep out; bucket and turn are the table's own names. keep_seconds: how long replaced files stay for readers under way.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, final: Callable[[], Column], recency: list[str], buckets: int = 64, keep_seconds: float = 3600.0,
                 by: str | None = None):
        self._spark, self._path, self._key, self._final, self._recency, self._buckets = spark, path.rstrip("/"), key, final, recency, buckets
        self._by = by or key
        self._store = Store(spark, self._path)
        self._manifest, self._keep = Record(self._store, "manifest"), keep_seconds

    def manifest(self) -> dict:
        return self._manifest.get({"epoch": -1, "turn": 0, "schema": None, "buckets": {}, "old": []})

    # --- writing

    def upsert(self, batch: DataFrame, epoch: int) -> None:
        """A foreachBatch writer: a batch that was taken already is left alone."""
        now = self.manifest()
        if epoch <= now["epoch"]:
            return
        now["epoch"], now["schema"] = epoch, batch.schema.json()
        self._add(batch, now)
        crowded = [b for b, x in now["buckets"].items() if len(x["batches"]) > MOST_BATCHES or x["dead_rows"] > MOST_DEAD * x["rows"]]
        if crowded:
            self.compact(crowded)

    def _add(self, batch: DataFrame, now: dict) -> None:
        turn = now["turn"] = now["turn"] + 1
        self._write_rows(batch, turn)
        touched = self._written(f"data/turn={turn}")
        for b in touched:
            now["buckets"].setdefault(b, {"batches": [], "live": None, "dead": [], "rows": 0, "dead_rows": 0})["batches"].append(turn)
        self._index(touched, {b: [turn] for b in touched}, now)

    def _bucket(self, by: Column) -> Column:
        return F.pmod(F.xxhash64(by), F.lit(self._buckets)).cast("int")

    def _write_rows(self, rows: DataFrame, turn: int) -> None:
        """Sorted within files, so that a filter on the bucketing column skips most of them. A bucket that outgrows a task is written by several."""
        placed = rows.withColumn("bucket", self._bucket(F.col(self._by))).hint("rebalance", "bucket").sortWithinPartitions("bucket", self._by, *self._recency)
        placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self._path}/data/turn={turn}")

    def _index(self, touched: list[str], fresh: dict[str, list[int]], now: dict) -> None:
        """New index and dead places of the touched buckets, from their old index and the keys of fresh batches; then the manifest."""
        if touched:
            turn = now["turn"]
            rank = F.struct("final", *(f"r{k}" for k in range(len(self._recency))), *_PLACE)
            candidates = self._keys(fresh, now)
            old = [f"{self._path}/live/turn={now['buckets'][b]['live']}/bucket={b}" for b in touched if now["buckets"][b]["live"] is not None]
            if old:
                kept = self._spark.read.schema(T.StructType([*(x for x in candidates.schema if x.name not in _PLACE), *(x for x in _of(_STORED) if x.name != "bucket")]))
                kept = kept.option("basePath", f"{self._path}/live").parquet(*old)
                candidates = candidates.unionByName(kept.select(*(c for c in candidates.columns if c not in _PLACE), *_stored_place(_PLACE)))
            best = candidates.groupBy("bucket", "key").agg(F.max(rank).alias("best")).select("bucket", "key", "best.*")
            best.write.mode("overwrite").partitionBy("bucket").parquet(f"{self._path}/live/turn={turn}")
            live = self._spark.read.parquet(f"{self._path}/live/turn={turn}")
            dead = candidates.join(live.select("bucket", *_PLACE), ["bucket", *_PLACE], "left_anti").select("bucket", *_PLACE)
            dead.write.mode("overwrite").partitionBy("bucket").parquet(f"{self._path}/dead/turn={turn}")
            counts = {str(r["bucket"]): r["n"] for r in live.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}      # a row a bucket
            lost = {}
            for b in self._written(f"dead/turn={turn}"):
                now["buckets"][b]["dead"].append(turn)
                lost[b] = 0
            if lost:
                rows = self._spark.read.parquet(f"{self._path}/dead/turn={turn}").groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()
                lost = {str(r["bucket"]): r["n"] for r in rows}
            for b in touched:
                entry = now["buckets"][b]
                if entry["live"] is not None:
                    now["old"].append([time.time(), f"live/turn={entry['live']}/bucket={b}"])
                entry["live"], entry["dead_rows"] = turn, entry["dead_rows"] + lost.get(b, 0)
                entry["rows"] = counts.get(b, 0) + entry["dead_rows"]
        self._manifest.put(now)
        self._drop_old()

    def _keys(self, batches: dict[str, list[int]], now: dict) -> DataFrame:
        """bucket, key, final, recency and place of the rows of batches: a scan of these columns alone."""
        rows = self._scan(batches, now)
        return rows.select("bucket", F.col(self._key).alias("key"), self._final().cast("int").alias("final"), *(F.col(c).alias(f"r{k}") for k, c in enumerate(self._recency)),
                           *_place(F.col("_metadata.file_path"), F.col("_metadata.row_index")))

    def compact(self, buckets: list[str] | None = None) -> None:
        """Writes the rows that count of the buckets (all, if none are named) into one batch each. Other buckets are not touched."""
        now = self.manifest()
        chosen = sorted(buckets if buckets is not None else now["buckets"])
        if not chosen:
            return
        rows = self._live_rows({b: now["buckets"][b] for b in chosen}, now)
        turn = now["turn"] = now["turn"] + 1
        self._write_rows(rows, turn)
        for b in chosen:
            entry = now["buckets"][b]
            stale = [f"data/turn={t}/bucket={b}" for t in entry["batches"]] + [f"dead/turn={t}/bucket={b}" for t in entry["dead"]] + [f"live/turn={entry['live']}/bucket={b}"]
            now["old"] += [[time.time(), name] for name in stale]
            now["buckets"][b] = {"batches": [turn], "live": None, "dead": [], "rows": 0, "dead_rows": 0}
        self._index(chosen, {b: [turn] for b in chosen}, now)

    def _written(self, folder: str) -> list[str]:
        return [n.removeprefix("bucket=") for n in self._store.names(folder) if n.startswith("bucket=")]

    def _drop_old(self) -> None:
        """Files that no manifest names any more go when readers had time to finish."""
        now, until = self.manifest(), time.time() - self._keep
        gone = [name for at, name in now["old"] if at <= until]
        for name in gone:
            self._store.delete(name)
        if gone:
            now["old"] = [x for x in now["old"] if x[1] not in set(gone)]
            self._manifest.put(now)

    # --- reading

    def _scan(self, batches: dict[str, list[int]], now: dict) -> DataFrame:
        paths = [f"{self._path}/data/turn={t}/bucket={b}" for b, turns in sorted(batches.items()) for t in turns]
        schema = T.StructType.fromJson(json.loads(now["schema"])).add("bucket", T.IntegerType())
        return self._spark.read.schema(schema).option("basePath", f"{self._path}/data").parquet(*paths)

    def _live_rows(self, buckets: dict[str, dict], now: dict) -> DataFrame:
        rows = self._scan({b: x["batches"] for b, x in buckets.items()}, now)
        dead = [f"{self._path}/dead/turn={t}/bucket={b}" for b, x in sorted(buckets.items()) for t in x["dead"]]
        columns = [c for c in rows.columns if c not in ("bucket", "turn")]
        if not dead:
            return rows.select(*columns)
        mine, gone = [f"_{n}_here" for n in _PLACE], [f"_{n}_dead" for n in _PLACE]
        places = self._spark.read.schema(_STORED).option("basePath", f"{self._path}/dead").parquet(*dead).select(F.col("bucket").alias("_bucket_dead"), *_stored_place(gone))
        if sum(x["dead_rows"] for x in buckets.values()) <= BROADCAST_DEAD:
            places = F.broadcast(places)
        at = _place(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
        placed = rows.select("*", *(c.alias(n) for c, n in zip(at, mine, strict=True)))
        same = [F.col(a) == F.col(b) for a, b in zip(["bucket", *mine], ["_bucket_dead", *gone], strict=True)]
        return placed.join(places, same, "left_anti").select(*columns)

    def read(self, of: DataFrame | None = None) -> DataFrame:
        """The rows that count, one per key, as the last manifest has them; or those whose bucketing column is among of's, read from their buckets alone."""
        now = self.manifest()
        if not now["buckets"]:
            raise ValueError(f"{self._path} has no rows yet")
        if of is None:
            return self._live_rows(now["buckets"], now)
        kind = T.StructType.fromJson(json.loads(now["schema"]))[self._by].dataType
        wanted = of.select(F.col(self._by).cast(kind)).distinct()
        chosen = {str(r["bucket"]) for r in wanted.select(self._bucket(F.col(self._by)).alias("bucket")).distinct().collect()}     # a row a bucket
        held = {b: x for b, x in now["buckets"].items() if b in chosen} or dict([next(iter(now["buckets"].items()))])
        return self._live_rows(held, now).join(wanted, self._by, "left_semi")
