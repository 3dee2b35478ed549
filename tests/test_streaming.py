"""Streams driven to completion over files."""

import json
import os
import threading
import time

from pyspark.sql import functions as F

from conftest import match, rows
from matchlens.sources import sinks
from matchlens.sources.landing import read_matches, rejected
from matchlens.streaming import feedback as FB, landing


def record(n, at="2024-01-01T00:00:00+00:00", **extra):
    return {"rating": 1, "mode": "match", "lang": "en", "model": "claude", "created_at": at, "match_id": n, "followup": False, **extra}


def write(path, *docs):
    path.write_text("\n".join(json.dumps(d) for d in docs))


def stamp(seconds):
    return f"2024-01-01T00:{seconds // 60:02d}:{seconds % 60:02d}+00:00"


class Switched:
    """A sink that is down while its switch is off, or for certain batches."""

    def __init__(self, sink, up=True, refuses=()):
        self.sink, self.up, self.refuses, self.offered = sink, up, set(refuses), []

    def __call__(self, batch, epoch):
        self.offered.append(epoch)
        if not self.up or epoch in self.refuses:
            raise RuntimeError("down")
        self.sink(batch, epoch)


def one_by_one(spark, where):
    return spark.readStream.schema(FB.FEEDBACK).option("maxFilesPerTrigger", 1).json(where)


BEGAN = time.time() - 1000


def feed(path, first, batches):
    for k in range(first, first + batches):
        write(path / f"{k:03}.json", record(2 * k + 2), record(2 * k + 1, rating=5))
        os.utime(path / f"{k:03}.json", (BEGAN + k, BEGAN + k))      # the source takes files by age, and those of one tick in any order


def ids(spark, path):
    return sorted(r.match_id for r in spark.read.parquet(str(path)).collect())


def test_ingest_splits_good_and_bad(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in/a.json", record(1, comment="  hi "), record(2, rating=5), record(3, mode="x"), record(4, account_id=9))
    query, fan = FB.ingest(spark, FB.read_feedback(spark, str(tmp_path / "in")),
                           {"table": FB.folder_sink(str(tmp_path / "out"), "parquet"), "lines": FB.folder_sink(str(tmp_path / "lines"), "json")},
                           FB.folder_sink(str(tmp_path / "bad"), "parquet"), str(tmp_path / "work"))
    query.awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "out")), "match_id", "comment") == [(1, "hi"), (4, None)]
    assert rows(spark.read.json(str(tmp_path / "lines")), "match_id") == [(1,), (4,)]
    assert rows(spark.read.parquet(str(tmp_path / "bad")), "match_id", "problem") == [(2, "rating"), (3, "mode")]
    assert "account_id" not in spark.read.parquet(str(tmp_path / "out")).columns
    assert all(fan.pending(n) is None for n in ("table", "lines", "quarantine"))


def test_a_broken_sink_falls_behind_alone(spark, tmp_path):
    (tmp_path / "in").mkdir()
    feed(tmp_path / "in", 0, 3)
    good, down = FB.folder_sink(str(tmp_path / "good"), "parquet"), Switched(FB.folder_sink(str(tmp_path / "back"), "parquet"), up=False)

    def go():
        query, fan = FB.ingest(spark, one_by_one(spark, str(tmp_path / "in")), {"good": good, "down": down},
                               FB.folder_sink(str(tmp_path / "bad"), "parquet"), str(tmp_path / "work"))
        assert query.awaitTermination(120) and query.exception() is None
        return fan
    fan = go()
    assert ids(spark, tmp_path / "good") == [2, 4, 6] and ids(spark, tmp_path / "bad") == [1, 3, 5]
    assert not (tmp_path / "back").exists()
    assert set(down.offered) == {0} and fan.state("down").failures >= 2      # the circuit: later batches aren't offered
    assert sorted(r.match_id for r in fan.pending("down").filter("problem is null").collect()) == [2, 4, 6]
    assert [fan.state(n).upto for n in ("good", "down", "quarantine")] == [2, -1, 2]
    # Back again, after a restart of the driver: it catches up in order, nobody gets anything twice.
    down.up, down.offered = True, []
    feed(tmp_path / "in", 3, 3)
    fan = go()
    assert down.offered == [0, 1, 2, 3, 4, 5]
    assert ids(spark, tmp_path / "back") == ids(spark, tmp_path / "good") == [2, 4, 6, 8, 10, 12]
    assert fan.pending("down") is None and fan._spooled() == [5]


def test_refused_batches_become_dead_letters(spark, tmp_path):
    (tmp_path / "in").mkdir()
    picky = Switched(FB.folder_sink(str(tmp_path / "out"), "parquet"), refuses=[1])
    feed(tmp_path / "in", 0, 6)
    query, fan = FB.ingest(spark, one_by_one(spark, str(tmp_path / "in")), {"picky": picky}, FB.folder_sink(str(tmp_path / "bad"), "parquet"),
                           str(tmp_path / "work"), most_attempts=2)
    query.awaitTermination(120)
    assert fan.state("picky").dead == [1] and ids(spark, tmp_path / "out") == [2, 6, 8, 10, 12]
    assert fan.replay("picky") == 1 and 1 in fan._spooled()
    picky.refuses.clear()
    assert fan.replay("picky") == 0 and ids(spark, tmp_path / "out") == [2, 4, 6, 8, 10, 12]
    assert fan._spooled() == [5]


def test_a_slow_sink_holds_nobody_up(spark, tmp_path):
    (tmp_path / "in").mkdir()
    feed(tmp_path / "in", 0, 3)
    gate, quick = threading.Event(), FB.folder_sink(str(tmp_path / "quick"), "parquet")

    def slow(batch, epoch):
        assert gate.wait(60)
        FB.folder_sink(str(tmp_path / "slow"), "parquet")(batch, epoch)
    query, fan = FB.ingest(spark, one_by_one(spark, str(tmp_path / "in")), {"quick": quick, "slow": slow}, FB.folder_sink(str(tmp_path / "bad"), "parquet"),
                           str(tmp_path / "work"), patience=1.0)
    assert query.awaitTermination(120)
    assert fan.state("slow").upto == -1
    gate.set()
    assert fan.wait(60) and fan.replay("quick") == 0 and ids(spark, tmp_path / "slow") == ids(spark, tmp_path / "quick") == [2, 4, 6]


def test_records_survive_broken_writes(spark, tmp_path):
    from matchlens.streaming.store import Record, Store
    store = Store(spark, str(tmp_path))
    one = Record(store, "ledger/a")
    assert one.get({"x": 0}) == {"x": 0}
    for k in range(3):
        one.put({"x": k})
    store.write("ledger/a/9.json", "{")                                      # the driver died while it wrote
    assert one.get({}) == {"x": 2}
    one.put({"x": 3})
    assert Record(store, "ledger/a").get({}) == {"x": 3} and store.names("ledger/a") == ["10.json"]


def run(stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return query


def test_tally_emits_closed_periods(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in/a.json", record(1), record(2, rating=-1), record(3, followup=True), record(4, "2024-01-03T00:00:00+00:00"))
    run(FB.tally_stream(FB.validate_feedback(FB.read_feedback(spark, str(tmp_path / "in")))), "tally")
    assert rows(spark.table("tally"), F.to_date("start").cast("string"), "votes", "balance") == [("2024-01-01", 2, 0)]


def test_tally_survives_bad_times(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in/a.json", record(1), record(2, "yesterday"), record(3, None), record(4, rating=7), record(5, "2024-01-03T00:00:00+00:00"))
    run(FB.tally_stream(FB.validate_feedback(FB.read_feedback(spark, str(tmp_path / "in")))), "tally_bad")
    assert rows(spark.table("tally_bad"), "votes", "balance") == [(1, 1)]


def test_landing_quarantines_broken_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps(match(1)) + "\n{broken\n" + json.dumps({"duration": 5}))
    where = str(tmp_path / "landed")
    landing.land(landing.read_stream(spark, str(tmp_path / "in")), where, str(tmp_path / "cp")).awaitTermination(120)
    assert rows(landing.current(spark, where), "match_id") == [(1,)]
    assert rows(spark.read.parquet(f"{where}_quarantine"), "_bad") == [("{broken",), (None,)]
    assert read_matches(spark, str(tmp_path / "in")).count() == 1
    assert rejected(spark, str(tmp_path / "in")).count() == 2


def test_cap_per_aligned_minute(spark):
    df = spark.createDataFrame([(n, "match", n) for n in range(130)], "id int, mode string, s int").withColumn(
        "ts", F.timestamp_seconds("s"))
    got = FB.cap_per_window(df, ["mode"], order=("id",), limit=50)
    assert [r.id for r in got.orderBy("id").collect()] == [*range(50), *range(60, 110), *range(120, 130)]


def test_landing_keeps_parsed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in/a.json", match(1), match(2, version=None))
    where, cp = str(tmp_path / "landed"), str(tmp_path / "cp")
    landing.land(landing.read_stream(spark, str(tmp_path / "in")), where, cp).awaitTermination(120)
    write(tmp_path / "in/b.json", match(1, version=None, duration=1), match(2, duration=777))
    landing.land(landing.read_stream(spark, str(tmp_path / "in")), where, cp).awaitTermination(120)
    assert rows(landing.current(spark, where), "match_id", "duration", "version") == [(1, 900, 21), (2, 777, 21)]


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([(7, "a\nb\n")], "match_id long, document string").withColumn(
        "filename", sinks.match_filename(F.col("match_id"), F.lit(3), F.lit(0)))
    sinks.write_documents(docs, str(tmp_path / "docs"))
    assert rows(spark.read.parquet(str(tmp_path / "docs"))) == [("7_3_0.txt", "a\nb\n")]
    sinks.write_text_files(docs, str(tmp_path / "text"))
    assert (tmp_path / "text/7_3_0.txt").read_text() == "a\nb\n"
    for _ in range(2):
        sinks.write_json_lines(docs.select("match_id"), str(tmp_path / "log"))
    assert rows(spark.read.json(str(tmp_path / "log"))) == [(7,), (7,)]
    name = spark.range(1).select(sinks.profile_filename(F.lit(42), F.lit(3))).first()[0]
    assert name == "profile_42_3.txt"
