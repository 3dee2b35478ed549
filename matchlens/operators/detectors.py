"""Statistical deviations of one player in one match.

Every detector returns (match_id, idx, det_no, rnk, key, axis, severity, params) and no
row where its input is missing. ``rnk`` orders the rows of one detector, ``det_no`` the
detectors; both break severity ties.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlens.functions import text as X
from matchlens.operators import bench, players as P
from matchlens.params import DEFAULTS, Thresholds

KEY = ["match_id", "idx"]


def finding(det_no: int, key: Column, axis: Column, severity: Column, params: dict[str, Column],
            rnk: Column | None = None) -> Column:
    """One deviation as a struct."""
    pairs = [x for name, value in params.items() for x in (F.lit(name), value.cast("string"))]
    return F.struct(F.lit(det_no).alias("det_no"), (F.lit(1) if rnk is None else rnk).cast("int").alias("rnk"),
                    key.alias("key"), axis.alias("axis"), X.clamp01(severity).alias("severity"),
                    F.create_map(*pairs).alias("params"))


def emit(df: DataFrame, *findings: Column) -> DataFrame:
    """One row per finding that is not null; each argument is an array of findings."""
    return df.select(*KEY, F.inline(F.array_compact(F.concat(*findings))))


def item_lag(late_items: DataFrame, p: Thresholds = DEFAULTS) -> DataFrame:
    """Rows of ``build.pace_lag``."""
    return emit(late_items, F.array(finding(
        1, F.lit("item_lag"), F.lit("build"), F.col("severity"),
        {"item": F.col("item"), "at": F.col("at"), "excess": F.col("excess"), "gpm": F.col("gpm"),
         "expected": X.clock(F.col("expected"))}, F.col("ord"))))


# --- benchmark percentiles: expressions over bench.metric_list ---------------------------

def _edges(p: Thresholds) -> Column:
    """Percentiles at the edges: up to three low ones and the highest one, most severe first."""
    def side(key: str, hit, severity, most: int, after: int) -> Column:
        ordered = F.sort_array(F.transform(F.filter("metrics", hit), lambda m: F.struct(
            (-X.clamp01(severity(m["pct"]))).alias("s"), m["rank"].alias("rank"), m["metric"].alias("metric"),
            m["pct"].alias("pct"), m["axis"].alias("axis"))))
        return F.transform(F.slice(ordered, 1, most), lambda m, i: finding(
            2, F.lit(key), m["axis"], -m["s"], {"metric": m["metric"], "pct": m["pct"]}, i + after + 1))

    return F.concat(
        side("bench_low", lambda m: m["pct"] <= p.pct_low, lambda pct: 0.45 + (p.pct_low - pct) / 30.0, p.max_low, 0),
        side("bench_high", lambda m: (m["pct"] >= p.pct_high) & (m["pct"] > p.pct_low),
             lambda pct: 0.25 + (pct - p.pct_high) / 60.0, p.max_high, p.max_low))


def _spread(p: Thresholds) -> Column:
    """Best against worst metric when they lie far apart; the first in metric order on ties."""
    def first(sign: int) -> Column:
        return F.get(F.sort_array(F.transform("metrics", lambda m: F.struct(
            (sign * m["pct"]).alias("s"), m["rank"].alias("rank"), m["metric"].alias("metric"), m["pct"].alias("pct")))), 0)

    hi, lo = first(-1), first(1)
    spread = hi["pct"] - lo["pct"]
    return F.array(F.when((F.size("metrics") >= 2) & (spread >= p.pct_spread), finding(
        3, F.lit("bench_spread"), F.lit("fights"), 0.3 + (spread - p.pct_spread) / 50.0,
        {"high_metric": hi["metric"], "high": hi["pct"], "low_metric": lo["metric"], "low": lo["pct"]})))


def bench_edges(benchmarks: DataFrame, p: Thresholds = DEFAULTS) -> DataFrame:
    return emit(bench.metric_list(benchmarks), _edges(p))


def bench_spread(benchmarks: DataFrame, p: Thresholds = DEFAULTS) -> DataFrame:
    return emit(bench.metric_list(benchmarks), _spread(p))


def bench_both(benchmarks: DataFrame, p: Thresholds = DEFAULTS) -> DataFrame:
    """Edges and spread from one pass over the percentiles."""
    return emit(bench.metric_list(benchmarks), _edges(p), _spread(p))


def farm_stall(stalls: DataFrame, p: Thresholds = DEFAULTS) -> DataFrame:
    """Rows of ``series.longest_stall``."""
    return emit(stalls, F.array(finding(
        4, F.lit("farm_stall"), F.lit("farm"), 0.3 + (F.col("end") - F.col("start")) / 12.0,
        {c: F.col(c) for c in ("start", "end", "rate", "average")})))


def death_cluster(clusters: DataFrame, p: Thresholds = DEFAULTS) -> DataFrame:
    """Rows of ``events.death_cluster``."""
    return emit(clusters, F.array(finding(
        5, F.lit("death_cluster"), F.lit("position"), 0.35 + (F.col("n") - p.cluster_min) / 5.0,
        {"count": F.col("n"), "start": X.clock(F.col("start")), "end": X.clock(F.col("end")), "total": F.col("total")})))


# --- a player among the ten of the match: expressions over windows by match ------------------

def array_median(values: Column) -> Column:
    """Mean of the two middle elements of a short array, null when it is empty."""
    ordered, n = F.sort_array(values), F.size(values)
    lo, hi = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return F.when(n > 0, (F.get(ordered, lo) + F.get(ordered, hi)) / 2.0)


def median_of_others(players: DataFrame, value: str, out: str) -> DataFrame:
    """Median of the non-zero values of the other players of the match."""
    others = F.transform(F.filter(out, lambda o: (o["idx"] != F.col("idx")) & (o[value] != 0)),
                         lambda o: o[value].cast("bigint"))
    return players.withColumn(out, P.match_list(value)).withColumn(out, array_median(others))


def lane_median(players: DataFrame, value: str, out: str) -> DataFrame:
    """Rounded median of the lane opponents' known values."""
    known = F.filter(F.transform("opponents", lambda o: o[value].cast("bigint")), lambda v: v.isNotNull())
    return P.lane_opponents(players, value).withColumn(out, X.half_even(array_median(known))).drop("opponents")


def _dead_share(p: Thresholds) -> Column:
    dead, typical = F.col("seconds_dead"), F.col("_typical")
    share = dead / F.nullif(F.col("_length"), F.lit(0))
    return F.array(F.when((dead > 0) & (share >= p.dead_share) & (dead >= typical * p.dead_factor), finding(
        6, F.lit("dead_share"), F.lit("position"), 0.3 + share,
        {"dead": X.clock(dead), "pct": X.half_even(share * 100), "typical": X.clock(F.floor(typical))})))


def _lane_gap(p: Thresholds) -> Column:
    gap = F.col("lane_eff") - F.col("_theirs")
    return F.array(F.when(F.abs(gap) >= p.lane_gap, finding(
        7, F.when(gap > 0, "lane_gap_ahead").otherwise("lane_gap_behind"), F.lit("lane"), 0.3 + F.abs(gap) / 60.0,
        {"mine": F.col("lane_eff"), "theirs": F.col("_theirs"), "gap": F.abs(gap)})))


def _kill_share(p: Thresholds) -> Column:
    kp = F.col("kp")
    return F.array(F.when((F.col("team_kills") > 0) & ((kp <= p.kp_low) | (kp >= p.kp_high)), finding(
        8, F.when(kp <= p.kp_low, "kp_low").otherwise("kp_high"), F.lit("fights"), 0.3 + F.abs(kp - 60) / 60.0,
        {"pct": kp, "kills": F.col("kills"), "assists": F.col("assists"), "team_kills": F.col("team_kills")})))


def _with_length(players: DataFrame, matches: DataFrame) -> DataFrame:
    return players.join(matches.select("match_id", F.col("duration").alias("_length")), "match_id")


def dead_share(players: DataFrame, matches: DataFrame, p: Thresholds = DEFAULTS) -> DataFrame:
    return emit(_with_length(median_of_others(players, "seconds_dead", "_typical"), matches), _dead_share(p))


def lane_gap(players: DataFrame, p: Thresholds = DEFAULTS) -> DataFrame:
    return emit(lane_median(players, "lane_eff", "_theirs"), _lane_gap(p))


def kill_share(players_kp: DataFrame, p: Thresholds = DEFAULTS) -> DataFrame:
    """Rows of ``players.kill_participation`` at either edge."""
    return emit(players_kp, _kill_share(p))


def among_players(players: DataFrame, matches: DataFrame, p: Thresholds = DEFAULTS) -> DataFrame:
    """Dead share, lane gap and kill share from one pass over the players."""
    seen = lane_median(median_of_others(P.kill_participation(players), "seconds_dead", "_typical"), "lane_eff", "_theirs")
    return emit(_with_length(seen, matches), _dead_share(p), _lane_gap(p), _kill_share(p))


def gold_collapse(drops: DataFrame, players: DataFrame, p: Thresholds = DEFAULTS) -> DataFrame:
    """Rows of ``series.worst_drop`` given to every player of the side."""
    rows = players.select(*KEY, "is_radiant").join(drops, ["match_id", "is_radiant"])
    return emit(rows, F.array(finding(
        9, F.lit("gold_collapse"), F.lit("fights"), 0.35 + F.col("loss") / p.collapse_scale,
        {"start": F.col("start"), "end": F.col("end"), "gold": F.col("loss")})))


def top_deviations(found: list[DataFrame], p: Thresholds = DEFAULTS) -> DataFrame:
    """The most severe rows of all detectors per player; each detector yields a handful."""
    w = Window.partitionBy(*KEY).orderBy(F.col("severity").desc(), "det_no", "rnk")
    return (reduce(DataFrame.unionByName, found)
            .withColumn("ord", F.row_number().over(w)).filter(F.col("ord") <= p.max_deviations))
