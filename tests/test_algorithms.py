"""Window formulations against plain loops, with and without chunking."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from conftest import rows
from matchlens.operators import build as B, carry, series as S
from matchlens.params import DEFAULTS

PARTS = {"a": [], "b": [], "c": ["a", "b", "b"], "d": ["c", "a"], "e": ["d", "d"]}


def naive_absorbed(log):
    taken = [False] * len(log)
    for i, key in enumerate(log):
        for need in PARTS[key]:
            for j in range(i - 1, -1, -1):
                if log[j] == need and not taken[j]:
                    taken[j] = True
                    break
    return taken


@pytest.mark.parametrize("chunk", [None, "chunk"])
def test_absorption_equals_backward_scan(spark, chunk):
    rnd = random.Random(7)
    logs = {i: [rnd.choice("aabbbccde") for _ in range(rnd.randint(1, 40))] for i in range(60)}
    items = spark.createDataFrame([(k, k, 100, "", v) for k, v in PARTS.items()],
                                  "key string, dname string, cost int, qual string, components array<string>")
    data = [(i, 0, pos, pos // 7, pos * 10, key) for i, log in logs.items() for pos, key in enumerate(log)]
    df = spark.createDataFrame(data, "match_id long, idx long, pos int, chunk long, t long, key string")
    got = B.absorb_components(B.with_items(df, items), ["pos"], chunk)
    want = sorted((i, pos, flag) for i, log in logs.items() for pos, flag in enumerate(naive_absorbed(log)))
    assert sorted(tuple(r) for r in got.select("match_id", "pos", "absorbed").collect()) == want


@pytest.mark.parametrize("chunk", [None, "chunk"])
def test_prefix_sum_and_numbers(spark, chunk):
    rnd = random.Random(1)
    data = [(k, i, i // 5, rnd.randint(-9, 9)) for k in range(4) for i in range(rnd.randint(1, 40))]
    df = spark.createDataFrame(data, "k int, i int, chunk int, v int")
    got = carry.row_numbers(carry.prefix_sum(df, ["k"], ["i"], F.col("v"), "s", chunk), ["k"], ["i"], "n", chunk)
    for k in range(4):
        mine = [d for d in data if d[0] == k]
        assert rows(got.filter(f"k = {k}").orderBy("i"), "i", "s", "n") == sorted(
            [(d[1], sum(x[3] for x in mine[:n]), n) for n, d in enumerate(mine, 1)], key=repr)


@pytest.mark.parametrize("chunked", [False, True])
def test_median(spark, chunked):
    rnd = random.Random(3)
    data = [(k, rnd.choice([rnd.uniform(-50, 50), float(rnd.randint(-3, 3))])) for k in range(8) for _ in range(k + 1)]
    df = spark.createDataFrame(data, "k int, v double")
    got = {r.k: (r.m, r.n) for r in carry.with_median(df, ["k"], "v", "m", "n", chunked).collect()}
    for k in range(8):
        mine = [v for q, v in data if q == k]
        assert got[k][0] == pytest.approx(statistics.median(mine)) and got[k][1] == len(mine)


def test_median_rule(spark):
    df = spark.createDataFrame([(1, v) for v in (1, 2, 4, 10)], "k int, v int")
    assert carry.with_median(df, ["k"], "v", "m", "n").first().m == 3.0


def test_percent_rank(spark):
    rnd = random.Random(5)
    data = [(i, "m", rnd.randint(0, 12)) for i in range(50)] + [(99, "lone", 3)]
    df = spark.createDataFrame(data, "id int, metric string, value long")
    got = {r.id: r.pct for r in carry.percent_rank(df, ["metric"], "value", "pct").collect()}
    values = [v for _, m, v in data if m == "m"]
    assert got[99] == 0.0
    for i, m, v in data[:50]:
        assert got[i] == sum(x < v for x in values) / 49


def test_value_range_is_monotone(spark):
    df = spark.createDataFrame([(float(v),) for v in (-1e9, -7.5, -1, -0.2, 0, 0.2, 1, 7.5, 1e9, 1e18)], "v double")
    cells = [r[0] for r in df.select(carry.value_range(F.col("v"))).collect()]
    assert cells == sorted(cells)


def naive_cluster(times, span):
    best, left = (0, 0, 0), 0
    for right, t in enumerate(times):
        while t - times[left] > span:
            left += 1
        if right - left + 1 > best[0]:
            best = (right - left + 1, times[left], t)
    return best


def test_densest_span(spark):
    rnd = random.Random(11)
    sets = {k: sorted(rnd.randint(0, 4000) for _ in range(rnd.randint(1, 30))) for k in range(40)}
    sets[40] = [100, 100, 100, 400, 400, 401]           # equal times, closed interval
    df = spark.createDataFrame([(k, t) for k, ts in sets.items() for t in ts], "k int, t long")
    got = {r.k: (r.n, r.start, r.end, r.total) for r in carry.densest_span(df, ["k"], "t", 300).collect()}
    for k, ts in sets.items():
        assert got[k] == (*naive_cluster(ts, 300), len(ts))


def naive_stall(gold):
    if len(gold) < 13:
        return None
    deltas = [b - a for a, b in zip(gold, gold[1:])]
    mean = sum(deltas) / len(deltas)
    best, start = None, None
    for m, d in enumerate(deltas, 1):
        if mean > 0 and d < mean * 0.6 and m >= 8:
            start = start or m
            if best is None or m - start > best[1] - best[0]:
                best = (start, m)
        else:
            start = None
    return best if best and best[1] - best[0] >= 3 else None


def test_longest_stall(spark):
    rnd = random.Random(2)
    logs = {}
    for k in range(60):
        total, gold = 0, []
        for _ in range(rnd.randint(5, 45)):
            total += rnd.choice([0, 50, 50, 400, 500])
            gold.append(total)
        logs[k] = gold
    df = spark.createDataFrame([(k, 0, m, g) for k, gs in logs.items() for m, g in enumerate(gs)],
                               "match_id long, idx long, m int, gold long")
    got = {r.match_id: (r.start, r.end) for r in S.longest_stall(df).collect()}
    assert got == {k: s for k, gs in logs.items() if (s := naive_stall(gs))}


def series(spark, values, match_id=1):
    return spark.createDataFrame([(match_id, m, v, v) for m, v in enumerate(values)],
                                 "match_id long, m int, gold long, xp long")


def test_swings_ignore_zeros(spark):
    got = S.sign_swings(series(spark, [0, 5, 0, -3, 0, -2, 4]))
    assert rows(got.filter("is_radiant"), "m", "gold", "swing") == [(3, -3, "behind"), (6, 4, "ahead")]
    assert rows(got.filter("not is_radiant"), "m", "gold", "swing") == [(3, 3, "ahead"), (6, -4, "behind")]


def test_top_swings_prefer_size_then_minute(spark):
    got = S.top_swings(S.sign_swings(series(spark, [1, -5, 5, -9, 9, -1])), 3)
    assert rows(got.filter("is_radiant"), "m") == [(1,), (3,), (4,)]


def test_peak_takes_first(spark):
    best = S.peak_trough(series(spark, [0, 7, -4, 7, -4])).filter("is_radiant").first()
    assert (best.best_m, best.best_gold, best.worst_m, best.worst_gold) == (1, 7, 2, -4)
    dire = S.peak_trough(series(spark, [0, 7, -4, 7, -4])).filter("not is_radiant").first()
    assert (dire.best_m, dire.best_gold, dire.worst_m, dire.worst_gold) == (2, 4, 1, -7)


def test_thin_series_keeps_last(spark):
    assert rows(S.thin_series(series(spark, range(13)), ["match_id"]), "m") == [(0,), (10,), (12,), (5,)]


def test_series_of_a_match_share_one_grid(spark):
    df = spark.createDataFrame([(1, i, m, 10 * m) for i, n in ((0, 17), (1, 14)) for m in range(n)], "match_id int, idx int, m int, gold long")
    got = S.thin_series(df, ["match_id", "idx"])
    assert rows(got.filter("idx = 1"), "m", "gold") == [(0, 0), (10, 100), (15, None), (16, None), (5, 50)]
    assert rows(got.filter("idx = 0"), "m") == [(0,), (10,), (15,), (16,), (5,)]


def test_supplied_experience_beside_rebuilt_gold(spark):
    minutes = spark.createDataFrame([(x, i, i == 0, m, 100 * m * (i + 1)) for x in (1, 2) for i in (0, 1) for m in range(4)],
                                    "match_id int, idx int, is_radiant boolean, m int, gold long")
    supplied = spark.createDataFrame([(1, m, None, 5 * m) for m in range(6)] + [(2, m, 7 * m, m) for m in range(3)],
                                     "match_id int, m int, gold long, xp long")
    got = S.advantage(supplied, minutes)
    assert rows(got.filter("match_id = 1"), "m", "gold", "xp") == sorted(
        [(m, -100 * m if m < 4 else None, 5 * m) for m in range(6)], key=repr)
    assert rows(got.filter("match_id = 2"), "m", "gold", "xp") == [(m, 7 * m, m) for m in range(3)]


def test_stages_end_with_the_gold(spark):
    lead = spark.createDataFrame([(1, m, 100 * m if m < 7 else None, m) for m in range(16)], "match_id int, m int, gold long, xp long")
    assert rows(S.stage_changes(lead), "start", "change") == [(0, 500), (5, 100)]


def test_worst_drop(spark):
    got = S.worst_drop(series(spark, [0, 9000, 9000, 8000, 3000, 2000, 2500, 2000]))
    assert rows(got, "is_radiant", "start", "end", "loss") == [(True, 2, 7, 7000)] or rows(
        got, "is_radiant", "start", "end", "loss") == [(True, 1, 6, 6500)]
    assert S.worst_drop(series(spark, [9000, 0, 0, 0, 0])).count() == 0        # too short


def test_stage_changes(spark):
    got = S.stage_changes(series(spark, [m * 10 for m in range(13)]))
    assert rows(got, "start", "change") == [(0, 50), (10, 20), (5, 50)]
    late = S.stage_changes(series(spark, list(range(60))))
    assert late.agg(F.max("start")).first()[0] == 40                             # later minutes are ignored
    assert S.stage_changes(series(spark, [5])).count() == 0


def build_log(spark, *items):
    data = [(1, 0, n, t, key, key, cost) for n, (key, cost, t) in enumerate(items)]
    return spark.createDataFrame(data, "match_id long, idx long, pos int, t long, key string, item string, cost long")


@pytest.mark.parametrize("chunk", [None, "pos"])
def test_pace_lag(spark, chunk):
    gpm = spark.createDataFrame([(1, 0, 500)], "match_id long, idx long, gpm long")
    late = build_log(spark, ("boots", 500, 180), ("blade", 2000, 600), ("sange", 2000, 1020), ("bkb", 4000, 2400))
    got = B.pace_lag(late, gpm, ["pos"], DEFAULTS, chunk)
    assert rows(got, "item", "at") == [("bkb", "40:00")]
    shifted = build_log(spark, ("boots", 500, 780), ("blade", 2000, 1200), ("sange", 2000, 1620), ("bkb", 4000, 2000))
    assert B.pace_lag(shifted, gpm, ["pos"], DEFAULTS, chunk).count() == 0
    assert B.pace_lag(late, gpm.withColumn("gpm", F.lit(0)), ["pos"], DEFAULTS, chunk).count() == 0

