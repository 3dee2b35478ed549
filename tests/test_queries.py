"""Registered queries against their SQL in DuckDB, and the shape of their plans."""

import math
import os
import re

import pytest

import __spark_entry__ as entry
from matchlens.plans.oracle import oracle_sql
from matchlens.plans.queries import REGISTRY
from matchlens.sources.bind import Bound

DATA = "/root/testdata/sf0.001"
TABLES = """region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels
conversations""".split()
QUERIES, SQL = dict(REGISTRY), oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not mounted")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def table(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return sorted(columns), sorted((repr(tuple(clean(r[i]) for i in order)) for r in data))


def spark_table(spark, name):
    df = QUERIES[name](spark, DATA)
    return table(df.columns, df.collect())


def duck_table(duck, name):
    cursor = duck.execute(SQL[name])
    return table([d[0] for d in cursor.description], cursor.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    assert spark_table(spark, name) == duck_table(duck, name)


def test_entry_registers_them():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", ["absorb_components", "full_log", "pace_lag", "role_items", "recent_n_per_account", "team_advantage"])
def test_no_job_runs_while_a_query_is_built(spark, name):
    before = spark.sparkContext.statusTracker().getJobIdsForGroup()
    spark.sparkContext.setJobGroup("building", name)
    try:
        frame = QUERIES[name].__wrapped__(Bound(spark, DATA)) if hasattr(QUERIES[name], "__wrapped__") else QUERIES[name](spark, DATA)
        # Reading a file's schema runs a job of its own; nothing else may.
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("building")) <= len(TABLES)
        assert frame.columns and before is not None
    finally:
        spark.sparkContext.setJobGroup("", "")


def test_late_steps_stay_in_the_series(spark, tmp_path):
    """Events moved to day 45 and one before day 0: totals and series agree."""
    from pyspark.sql import functions as F
    events = spark.read.parquet(f"{DATA}/events.parquet")
    moved = events.withColumn("ts", F.when(F.col("event_id") % 3 == 0, F.col("ts") + F.expr("INTERVAL 45 DAYS")).otherwise(F.col("ts")))
    moved = moved.withColumn("ts", F.when(F.col("event_id") == 1, F.lit("2023-12-29").cast("timestamp_ntz")).otherwise(F.col("ts")))
    moved.write.parquet(f"{tmp_path}/events.parquet")
    b = Bound(spark, str(tmp_path))
    ends = b.minutes.groupBy("match_id", "idx").agg(F.max_by("gold", "m").alias("gold"), F.max("m").alias("to"), F.min("m").alias("from"))
    joined = b.totals.join(ends, ["match_id", "idx"]).collect()
    assert joined and all(r.gold == r.total_gold for r in joined)
    assert max(r.to for r in joined) >= 45 and min(r["from"] for r in joined) == -3


def test_recent_returns_as_many_as_asked(spark):
    from matchlens.operators.career import recent
    df = spark.range(100).selectExpr("1 as a", "id")
    assert recent(df, "a", [df["id"].desc()], 60).count() == 60


def plan(spark, name):
    return QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plans_stay_distributed(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "Python" not in text and "Exchange SinglePartition" not in text


def test_scans_are_pruned(spark):
    text = plan(spark, "kill_participation")
    assert re.findall(r"ReadSchema: (\S+)", QUERIES["text_bytes"](spark, DATA)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))) == ["struct<doc_id:bigint,text:string>"]
    assert "WindowGroupLimit" not in text


@pytest.mark.parametrize("name", ["recent_n_per_account", "cap_per_window", "capped_sample"])
def test_rankings_are_limited_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(spark, name) and "Partial" in plan(spark, name)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["match_id", "idx", "ord", "det_no", "key", "axis", "severity", "params"]
    assert df.count() > 0
