"""Benchmark percentiles and the rows a player is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlens.functions import text as X
from matchlens.operators import carry
from matchlens.params import GENERAL_BENCH, METRIC_AXIS, ROLE_BENCH

KEY = ["match_id", "idx"]


def metric_percentiles(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Percentile of ``value`` among all rows of its group, for tables that bring none."""
    return carry.percent_rank(metrics, by, "value", "pct")


def shown_metrics(role: Column) -> Column:
    """Ordered metric names for a role, the general list where there is none."""
    lists = F.create_map(*[x for r, ms in ROLE_BENCH.items() for x in (
        F.lit(r), F.array(*[F.lit(m) for m in ms]))])
    return F.coalesce(F.try_element_at(lists, role), F.array(*[F.lit(m) for m in GENERAL_BENCH]))


def benchmark_rows(benchmarks: DataFrame, players: DataFrame) -> DataFrame:
    """Rows of the focal player in the order of its role; metrics without a value are left out."""
    keys = [*KEY, *[c for c in ("request_id",) if c in players.columns]]
    wanted = players.select(*keys, F.posexplode(shown_metrics(F.col("role"))).alias("_pos", "metric"))
    return (wanted.join(benchmarks.filter(F.col("raw").isNotNull()), KEY + ["metric"])
            .select(*keys, (F.col("_pos") + 1).cast("bigint").alias("ord"), "metric",
                    X.half_even(F.col("raw"), 1).alias("raw"),
                    X.half_even(F.col("pct") * 100).alias("pct")))


def percentiles(benchmarks: DataFrame) -> DataFrame:
    """Known metrics as whole percentiles with their axis and rank: the document's order where it is known."""
    axis = F.create_map(*[F.lit(x) for kv in METRIC_AXIS.items() for x in kv])
    rank = (F.col("pos").cast("bigint") if "pos" in benchmarks.columns
            else F.array_position(F.array(*[F.lit(m) for m in METRIC_AXIS]), F.col("metric")))
    return (benchmarks.filter(F.col("metric").isin(*METRIC_AXIS) & F.col("pct").isNotNull())
            .select(*KEY, "metric", X.half_even(F.col("pct") * 100).alias("pct"),
                    F.try_element_at(axis, F.col("metric")).alias("axis"), rank.alias("rank")))


def metric_list(benchmarks: DataFrame) -> DataFrame:
    """One row per player: the known metrics as an array, eight at most."""
    item = F.struct("rank", "metric", "pct", "axis")
    return percentiles(benchmarks).groupBy(*KEY).agg(F.sort_array(F.collect_list(item)).alias("metrics"))
