"""The anchored cap in event time: any order of arrival, restarts, one key with nearly all records."""

import json
import random

from matchlens.schemas import FEEDBACK
from matchlens.streaming import cap


def stamp(seconds):
    return f"2024-01-01T{int(seconds) // 3600:02d}:{int(seconds) // 60 % 60:02d}:{seconds % 60:06.3f}+00:00"


def write(path, records):
    path.write_text("\n".join(json.dumps({"rating": 1, "mode": m, "match_id": n, "created_at": at, "followup": False}) for n, m, at in records))


def go(spark, tmp_path, **limits):
    stream = spark.readStream.schema(FEEDBACK).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = (cap.anchored_cap(stream, "mode", **limits).writeStream.format("json").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start())
    assert query.awaitTermination(300) and query.exception() is None
    return sorted(r.match_id for r in spark.read.schema(FEEDBACK).json(str(tmp_path / "out")).collect())


def passing(times, limit, length=60):
    out, anchor, count = [], None, 0
    for n, t in sorted(times, key=lambda x: x[1]):
        if anchor is None or t - anchor >= length:
            anchor, count = t, 0
        count += 1
        out += [n] if count <= limit else []
    return sorted(out)


def test_order_of_arrival_and_restarts_do_not_matter(spark, tmp_path):
    (tmp_path / "in").mkdir()
    shuffled = random.Random(1)
    times = [(n, round(shuffled.random() * 900, 3) + n / 1e6) for n in range(1, 300)]
    times = [(n, round(t, 3)) for n, t in times]
    assert len({t for _, t in times}) == len(times)
    halves = [[x for x in times if x[1] < 500], [x for x in times if x[1] >= 500]]
    for k, half in enumerate(halves):
        shuffled.shuffle(half)
        write(tmp_path / f"in/{k}0.json", [(n, "match", stamp(t)) for n, t in half[::2]] + [(9000 + k, "match", "yesterday")])
        write(tmp_path / f"in/{k}1.json", [(n, "match", stamp(t)) for n, t in half[1::2]] + [(9100 + k, None, stamp(100 + 600 * k))])
        found = go(spark, tmp_path, limit=7, late="15 minutes")
        assert not found                                 # nothing is passed before its time is over
    write(tmp_path / "in/90.json", [(9999, "match", stamp(80000))])
    found = go(spark, tmp_path, limit=7, late="15 minutes")
    assert [n for n in found if n < 9000] == passing(times, 7) and [n for n in found if n >= 9000] == [9100, 9101]


def test_what_waits_is_bounded(spark, tmp_path):
    """Of many records of one millisecond each task sends no more than the limit."""
    rows = spark.range(0, 5000, 1, 4).selectExpr("'match' as key", "timestamp_millis(id % 3) as ts", "id % 3 as t", "cast(id as string) as body", "1L as n")
    kept = cap.counted(rows, 10).collect()
    assert len(kept) == 4 * 3 * 11 and sum(r.n for r in kept) == 5000
    (tmp_path / "in").mkdir()
    write(tmp_path / "in/0.json", [(n, "match", stamp(5)) for n in range(1, 1000)] + [(n, "match", stamp(64)) for n in range(2000, 2010)]
          + [(n, "match", stamp(65)) for n in range(3000, 3010)])
    write(tmp_path / "in/1.json", [(9999, "match", stamp(80000))])
    found = go(spark, tmp_path, limit=4)
    assert len([n for n in found if n < 2000]) == 4 and not [n for n in found if 2000 <= n < 3000] and len([n for n in found if n >= 3000]) == 4
