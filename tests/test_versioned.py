"""The versioned table: upserts by bucket, replays, compaction, and reading without moving documents."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from matchlens.sources import versioned
from matchlens.sources.versioned import VersionedTable

SCHEMA = "id long, parsed boolean, at int, players array<struct<name:string,gold:long>>"


def table(spark, path, **options):
    return VersionedTable(spark, str(path), "id", lambda: F.col("parsed"), ["at"], **{"buckets": 8, "keep_seconds": 0.0, **options})


def batch(spark, rows):
    return spark.createDataFrame([(i, p, at, [(f"player of {i} at {at}", at)]) for i, p, at in rows], SCHEMA)


def found(t):
    assert t.read().columns == ["id", "parsed", "at", "players"]
    return sorted((r.id, r.parsed, r.at, r.players[0].gold) for r in t.read().collect())


def files(path, folder="data"):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path / folder) for f in names if f.startswith("part-")}


def test_upserts_equal_the_plain_rule(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versioned, "MOST_BATCHES", 3)
    shuffled, t, best = random.Random(2), table(spark, tmp_path), {}
    for epoch in range(5):
        rows = [(shuffled.randrange(40), shuffled.random() < 0.3, 1000 * epoch + k) for k in range(20)]
        t.upsert(batch(spark, rows), epoch)
        for i, p, at in rows:
            best[i] = max(best.get(i, (False, -1)), (p, at))
        assert found(t) == sorted((i, p, at, at) for i, (p, at) in best.items())
    assert max(len(b["batches"]) for b in t.manifest()["buckets"].values()) <= 3
    t.compact()
    assert found(t) == sorted((i, p, at, at) for i, (p, at) in best.items())
    assert all(b["dead_rows"] == 0 and b["rows"] for b in t.manifest()["buckets"].values())


def test_only_touched_buckets_are_written(spark, tmp_path):
    t = table(spark, tmp_path, keep_seconds=3600.0)
    t.upsert(batch(spark, [(i, False, 1) for i in range(50)]), 0)
    before, entries = files(tmp_path), t.manifest()["buckets"]
    t.upsert(batch(spark, [(7, True, 2)]), 1)
    after = t.manifest()["buckets"]
    changed = [b for b in after if after[b] != entries[b]]
    assert len(changed) == 1 and {f: m for f, m in files(tmp_path).items() if f in before} == before
    assert all(f"bucket={changed[0]}/" in f for f in set(files(tmp_path)) - set(before))
    t.upsert(batch(spark, [(7, False, 3)]), 2)                               # a parsed copy is final
    assert [r for r in found(t) if r[0] == 7] == [(7, True, 2, 2)] and len(found(t)) == 50


def test_replays_and_broken_writes_change_nothing(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    t.upsert(batch(spark, [(1, False, 1), (2, True, 1)]), 0)
    t.upsert(batch(spark, [(1, True, 9)]), 0)                                # the same batch number again
    assert found(t) == [(1, False, 1, 1), (2, True, 1, 1)]
    put = versioned.Record.put
    monkeypatch.setattr(versioned.Record, "put", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        t.upsert(batch(spark, [(1, True, 2), (3, False, 2)]), 1)
    assert found(t) == [(1, False, 1, 1), (2, True, 1, 1)]                   # nothing of it is seen
    monkeypatch.setattr(versioned.Record, "put", put)
    table(spark, tmp_path).upsert(batch(spark, [(1, True, 2), (3, False, 2)]), 1)
    assert found(t) == [(1, True, 2, 2), (2, True, 1, 1), (3, False, 2, 2)]


def test_documents_meet_no_exchange(spark, tmp_path):
    t = table(spark, tmp_path, keep_seconds=3600.0)
    t.upsert(batch(spark, [(i, False, 1) for i in range(200)]), 0)
    t.upsert(batch(spark, [(1, True, 2), (9, True, 2)]), 1)
    plan = t.read()._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "players" in plan and not re.search("Exchange (hash|range|Round|Single)", plan) and "Aggregate" not in plan
    keys = t._keys({b: x["batches"] for b, x in t.manifest()["buckets"].items()}, t.manifest())
    assert "players" not in keys._jdf.queryExecution().executedPlan().toString()


def test_places_are_numbers_and_tables_of_before_go_on(spark, tmp_path):
    t = table(spark, tmp_path, keep_seconds=3600.0)
    t.upsert(batch(spark, [(i, False, 1) for i in range(12)]), 0)
    t.upsert(batch(spark, [(i, True, 2) for i in range(2)]), 1)
    for folder in ("live", "dead"):
        assert "string" not in [kind for _, kind in spark.read.parquet(str(tmp_path / folder)).dtypes]
    now = t.manifest()
    scanned = t._scan({b: x["batches"] for b, x in now["buckets"].items()}, now)
    path = F.col("_metadata.file_path")
    files_of = scanned.select("bucket", *versioned._place(path, F.col("_metadata.row_index")), path.alias("file"))
    for folder, turns in (("live", {x["live"] for x in now["buckets"].values()}), ("dead", {d for x in now["buckets"].values() for d in x["dead"]})):
        for turn in turns:                                                   # as they were: the path itself
            where = str(tmp_path / folder / f"turn={turn}")
            old = spark.read.parquet(where).join(files_of, ["bucket", *versioned._PLACE]).drop("of_turn", "part", "piece")
            spark.createDataFrame(old.collect(), old.schema).write.mode("overwrite").partitionBy("bucket").parquet(where)
    kept = [(i, i < 2, 1 + (i < 2), 1 + (i < 2)) for i in range(12)]
    assert found(t) == kept
    t.upsert(batch(spark, [(i, True, 3) for i in range(1, 5)]), 2)
    assert found(t) == [(i, True, 3, 3) if 1 <= i < 5 else k for i, k in enumerate(kept)]


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    key, before = "spark.sql.adaptive.advisoryPartitionSizeInBytes", spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set(key, "64k")
    try:
        t = VersionedTable(spark, str(tmp_path), "id", lambda: F.col("id") < 0, ["at"], buckets=1)
        t.upsert(spark.range(0, 40_000, 1, 4).select("id", F.sha2(F.col("id").cast("string"), 256).alias("at")), 0)
    finally:
        spark.conf.set(key, before)
    assert len([f for f in files(tmp_path) if f.endswith(".parquet")]) > 1 and t.read().count() == 40_000
