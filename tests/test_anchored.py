"""The anchored cap over chunks against the plain loop."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlens.operators import anchored


def plain(times, length):
    out, anchor = [], None
    for t in times:
        if anchor is None or t - anchor >= length:
            anchor = t
        out.append(anchor)
    return out


def some_times(random, n, span):
    return np.unique(random.integers(0, span, n))


@pytest.mark.parametrize(("n", "span"), [(1, 10), (5, 1000), (300, 900), (2000, 3000), (50, 100000)])
def test_functions_of_chunks_compose_to_that_of_the_whole(n, span):
    random = np.random.default_rng(n)
    for _ in range(20):
        times, length = some_times(random, n, span), int(random.integers(1, 70))
        edges = np.unique(np.concatenate([[0], random.integers(0, span, 4) // length * length, [span + length]]))
        chunks = [times[(times >= a) & (times < b)] for a, b in zip(edges, edges[1:], strict=False)]
        functions = [anchored.leap(c, length) for c in chunks if len(c)]
        left = functions[0]
        for f in functions[1:]:
            left = anchored.composed(left, f, length)
        right = functions[-1]
        for f in functions[-2::-1]:
            right = anchored.composed(f, right, length)
        for given in (anchored.NEVER, *(-int(x) for x in random.integers(0, 2 * length, 10))):
            one = given
            for f in functions:
                one = anchored.left_by(f, one, length)
            loop = plain(times if given == anchored.NEVER else [given, *times], length)[-1]
            assert one == loop == anchored.left_by(left, given, length) == anchored.left_by(right, given, length)


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, mode string, s double, n int").withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("long")))


def expected(rows, limit, seconds):
    out = []
    for mode in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == mode and r[2] is not None), key=lambda r: (r[2], r[0]))
        anchor = plain([round(r[2] * 1e6) for r in own], seconds * 1_000_000)
        held = {}
        for r, a in zip(own, anchor, strict=True):
            held[a] = held.get(a, 0) + 1
            out += [r[0]] if held[a] <= limit else []
    return sorted(out)


@pytest.mark.parametrize("chunk", [(1, 4), (3, 50), (4096, 1 << 20)])
def test_cap_equals_the_loop(spark, monkeypatch, chunk):
    """One key owns nearly all rows, spread over many chunks; equal times, a null key and a null time."""
    monkeypatch.setattr(anchored, "CHUNK_WINDOWS", chunk[0])
    monkeypatch.setattr(anchored, "CHUNK_TIMES", chunk[1])
    monkeypatch.setattr(anchored, "FAN_IN", 3)
    random = np.random.default_rng(1)
    seconds = np.concatenate([random.integers(0, 3000, 600), np.full(40, 777), random.random(200) * 20 + 100, np.array([-70.5, -10.0, 9000.0])])
    rows = [(k, "match", float(s), k) for k, s in enumerate(seconds)]
    rows += [(5000, "profile", 3.0, 1), (5001, None, 3.0, 1), (5002, None, 3.0, 1), (5003, None, 63.0, 1), (5004, "match", None, 1)]
    for limit in (1, 7):
        found = anchored.anchored_cap(frame(spark, rows), "mode", "ts", ("id",), limit, 60)
        assert found.columns == ["id", "mode", "s", "n", "ts"]
        assert sorted(r.id for r in found.collect()) == expected(rows, limit, 60)


def test_one_key_is_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(anchored, "CHUNK_WINDOWS", 10)
    rows = spark.range(20_000).select("id", F.lit("match").alias("mode"), F.timestamp_seconds(F.col("id") * 5).alias("ts"))
    times = rows.select(F.col("mode").alias("key"), F.unix_micros("ts").alias("t"))
    anchors = anchored.anchors(times, "key", 60_000_000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert anchors.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert anchors.select("anchor").distinct().count() == -(-20_000 // 12)
    assert anchored.anchored_cap(rows, "mode", "ts", limit=5).count() == 5 * (20_000 // 12) + 5


def test_no_rows(spark):
    assert anchored.anchored_cap(frame(spark, []), "mode", "ts").collect() == []


def test_start_of_time_does_not_matter(spark):
    start = datetime(1969, 12, 31, 23, 59, 1)
    rows = spark.createDataFrame([(k, "m", start + timedelta(seconds=20 * k)) for k in range(7)], "id long, mode string, ts timestamp")
    assert sorted(r.id for r in anchored.anchored_cap(rows, "mode", "ts", limit=1).collect()) == [0, 3, 6]
