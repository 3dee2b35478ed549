"""Series cut into chunks against the plain windows."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from matchlens.operators import carry, events as E, series as S
from matchlens.params import DEFAULTS


@pytest.fixture(scope="module")
def adv(spark):
    shuffled = random.Random(3)
    points = []
    for match_id in (1, 2, 3):
        gold = 0
        for m in range(-2, 200):
            gold = shuffled.choice([0, 0, gold + shuffled.randrange(-3000, 3000)])
            if shuffled.random() < 0.9:
                points.append((match_id, m, gold if shuffled.random() < 0.95 else None))
    return spark.createDataFrame(points + [(9, 0, 5)], "match_id long, m long, gold long").repartition(3)


@pytest.mark.parametrize("chunk", [1, 7, 50, 1000])
def test_chunks_change_nothing(spark, adv, chunk):
    assert rows(S.sign_swings(adv, chunk)) == rows(S.sign_swings(adv)) != []
    assert rows(S.worst_drop(adv, DEFAULTS, chunk)) == rows(S.worst_drop(adv)) != []


@pytest.mark.parametrize("chunk", [1, 13, 1000])
def test_stalls_over_chunks(spark, chunk):
    shuffled = random.Random(4)
    points = []
    for idx in range(3):
        gold = 0
        for m in range(150):
            gold += 10 if 40 + 20 * idx <= m < 70 + 21 * idx else shuffled.randrange(200, 900)
            points.append((1, idx, m, gold))
    minutes = spark.createDataFrame(points, "match_id long, idx long, m long, gold long")
    found = rows(S.longest_stall(minutes, DEFAULTS, chunk))
    assert found == rows(S.longest_stall(minutes)) and [(r[2], r[3]) for r in found] == [(40 + 20 * i, 69 + 21 * i) for i in range(3)]


def test_one_long_series_is_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        one = spark.range(300_000).select(F.lit(1).alias("match_id"), F.col("id").alias("m"), F.when(F.col("id") % 1000 < 990, 0).otherwise(
            F.when(F.floor(F.col("id") / 1000) % 2 == 0, 1).otherwise(-1)).cast("long").alias("gold"))
        swings = S.sign_swings(one, 20_000)
        assert swings.count() == 2 * 299 and swings.select(F.spark_partition_id()).distinct().count() > 1
        known, cut = S.in_chunks(one, 20_000)
        away = carry.rows_away(known, ["match_id"], ["m"], "m", "later", 5, cut)
        assert away.where("later = m + 5").count() == 299_995 and away.where("later is null").count() == 5
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_many_windows_meet_events_near_them(spark):
    """Windows of all widths against a plain join; the pairs that meet follow the result, not events times windows."""
    shuffled = random.Random(5)
    events = [(k % 2, k, shuffled.randrange(-500, 100_000)) for k in range(1500)] + [(0, 9000, None)]
    windows = [(k % 2, k, lo, lo + shuffled.choice([0, 1, 3, 60, 61, 900]), k) for k in range(800) for lo in [shuffled.randrange(-500, 100_000)]]
    windows += [(0, 9001, -10 ** 6, 10 ** 6, 1), (0, 9002, 50, 40, 1)]
    e = spark.createDataFrame(events, "match_id long, id long, t long").repartition(3)
    w = spark.createDataFrame(windows, "match_id long, win long, lo long, hi long, depth int").repartition(3)
    assert rows(E.inside_many(e, w).select("match_id", "id", "win")) == rows(E.inside(e, w).select("match_id", "id", "win")) != []
    assert sorted(E.inside_many(e, w).columns) == sorted(E.inside(e, w).columns)
    met = E.inside_many(e, w.where("hi - lo < 1000").withColumns({"real_lo": F.col("lo"), "real_hi": F.col("hi")}))
    narrow = E.inside(e, w.where("hi - lo < 1000")).count()
    cells = w.where("hi - lo < 1000 and lo <= hi").withColumn("_level", E._level(F.col("hi") - F.col("lo"))).withColumn("width", F.pow(F.lit(2.0), "_level"))
    near = E.inside(e, cells.withColumns({"lo": F.col("lo") - F.col("width"), "hi": F.col("hi") + F.col("width")})).count()
    assert met.count() == narrow and near <= 4 * narrow + 50                          # what can share a cell is no further away than a cell
    spans = spark.createDataFrame([(m, k, a, a + d if d is not None else None) for k in range(300) for m in [k % 2] for a in [shuffled.randrange(0, 100_000)]
                                   for d in [shuffled.choice([None, 0, 40, 5000])]], "match_id long, fight_no long, start int, end int")
    pick = ["match_id", "fight_no", "win", "start", "end", "lo", "hi"]
    assert rows(E.overlapping_many(spans, w), *pick) == rows(E.overlapping(spans, w.where("lo <= hi")), *pick) != []
