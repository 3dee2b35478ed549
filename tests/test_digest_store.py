"""Profiles from stored digests against those from match documents."""

import re

from conftest import match, person, rows
from matchlens.plans.account_profile import AccountProfile
from matchlens.plans.digest_store import DigestStore

RAMP = [m * 100 if m < 30 else 3000 - (m - 30) * 400 for m in range(50)]


def document(match_id, win, deaths, pct, hero_id, **extra):
    me = person(0, hero_id, account_id=42, deaths=deaths, benchmarks={"gold_per_min": {"raw": 1.0, "pct": pct}, "xp_per_min": {"raw": 1.0, "pct": pct}})
    return match(match_id, radiant_win=win, radiant_gold_adv=RAMP, players=[me, person(1, 2, lane_role=1), person(128, 3, account_id=None), person(129, 4)], **extra)


def test_stored_profiles_equal_those_of_documents(silver, spark, dims, tmp_path):
    docs = [document(303, False, 9, 0.08, 1), document(302, False, 7, 0.10, 1), document(301, True, 2, 0.95, 3, patch=4)]
    early = [document(302, True, 1, 0.5, 1, version=None), docs[2]]
    store = DigestStore(spark, str(tmp_path / "digests"), dims, buckets=8)
    for epoch, part in enumerate((early, docs)):
        store.add(silver(*part).raw, epoch)
    wanted = spark.createDataFrame([(42, 5, None, "claude")], "account_id long, n int, role string, model string")
    stored, plain = store.profile(wanted), AccountProfile(silver(*docs), wanted)
    for section in ("averages", "trends", "stages", "heroes", "caveats"):
        a, b = getattr(stored, section)(), getattr(plain, section)()
        assert a.columns == b.columns and rows(a) == rows(b), section
    pick = ["key", "axis", "count", "total", "share"]
    assert rows(stored.patterns(), *pick) == rows(plain.patterns(), *pick) != []
    assert rows(stored.digests, "rec_no", "match_id", "hero", "win", "kp", "cs10", "axes") == rows(plain.digests, "rec_no", "match_id", "hero", "win", "kp", "cs10", "axes")
    plan = store.table.read(wanted)._jdf.queryExecution().executedPlan().toString()
    assert max(int(n) for n in re.findall(r"InMemoryFileIndex\((\d+) paths\)", plan)) <= 2 < len(store.table.manifest()["buckets"])
