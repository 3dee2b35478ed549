"""Detectors, profile operators and the plans on match documents."""

import json

import pytest
from pyspark.sql import functions as F

from conftest import match, person, rows
from matchlens.operators import bench, career as C, detectors as D, players as P, series as S
from matchlens.params import GENERAL_BENCH, PROFILE_RULES
from matchlens.plans.account_profile import AccountProfile
from matchlens.plans.deviations import anomaly_topk
from matchlens.plans.match_facts import MatchFacts
from matchlens.plans.role_impact import role_inputs
from matchlens.sources.landing import read_matches
from matchlens.sources.silver import Silver


def benches(spark, **pcts):
    return spark.createDataFrame([(1, 0, m, 1.0, p) for m, p in pcts.items()],
                                 "match_id long, idx long, metric string, raw double, pct double")


def test_bench_edges_cap_and_ties(spark):
    df = benches(spark, gold_per_min=0.01, xp_per_min=0.02, kills_per_min=0.03, tower_damage=0.19,
                 stuns_per_min=0.95, hero_damage_per_min=0.90, unknown_metric=0.0)
    got = D.bench_edges(df)
    # three lows saturate at severity 1: the fixed metric order decides, and one high stays
    assert rows(got, "rnk", "key", F.col("params")["metric"], F.col("params")["pct"]) == [
        (1, "bench_low", "gold_per_min", "1"), (2, "bench_low", "xp_per_min", "2"),
        (3, "bench_low", "kills_per_min", "3"), (4, "bench_high", "stuns_per_min", "95")]


def test_bench_half_even_and_null(spark):
    df = benches(spark, gold_per_min=0.205, xp_per_min=None)
    assert rows(bench.percentiles(df), "metric", "pct") == [("gold_per_min", 20)]


def test_bench_spread(spark):
    wide = D.bench_spread(benches(spark, gold_per_min=0.9, xp_per_min=0.4)).first()
    assert wide.params == {"high_metric": "gold_per_min", "high": "90", "low_metric": "xp_per_min", "low": "40"}
    assert wide.severity == pytest.approx(0.4)
    assert D.bench_spread(benches(spark, gold_per_min=0.9)).count() == 0


def test_dead_share(silver):
    docs = [person(0, 1, life_state={"2": 180}), person(1, 2, life_state={}), person(128, 3, life_state={"2": 40}),
            person(129, 4, life_state={"2": 60})]
    t = silver(match(players=docs))
    got = D.dead_share(t.players, t.matches)
    assert rows(got, "idx", "params") == [(0, {"dead": "3:00", "pct": "20", "typical": "0:50"})]


def test_lane_gap_null_is_not_zero(silver):
    docs = [person(0, 1, lane_efficiency_pct=80), person(128, 3, lane_efficiency_pct=0), person(129, 4, lane_efficiency_pct=None)]
    t = silver(match(players=docs))
    got = rows(D.lane_gap(t.players), "idx", "key", F.col("params")["theirs"])
    assert got == [(0, "lane_gap_ahead", "0"), (1, "lane_gap_behind", "80")]


def test_kill_share(silver):
    t = silver(match())
    got = rows(D.kill_share(P.kill_participation(t.players)), "idx", "key", F.col("params")["pct"])
    assert (0, "kp_high", "100") in got and (1, "kp_low", "0") in got
    none = silver(match(players=[person(0, 1, kills=0, assists=3)]))
    assert P.kill_participation(none.players).first().kp == 0
    assert D.kill_share(P.kill_participation(none.players)).count() == 0


def test_gold_collapse_is_per_side(silver):
    lead = [0, 0, 0, 0, 0, 0, 0, 0, 0, -9000]
    t = silver(match(radiant_gold_adv=lead))
    got = D.gold_collapse(S.worst_drop(t.supplied_adv), t.players)
    assert rows(got, "idx", F.col("params")["gold"]) == [(0, "9000"), (1, "9000")]


def test_top_keeps_seven_in_order(silver, dims):
    t = silver(match())
    found = anomaly_topk(t, dims["items"], t.supplied_adv, t.order)
    per = {}
    for r in found.collect():
        per.setdefault(r.idx, []).append(r)
    for rs in per.values():
        rs.sort(key=lambda r: r.ord)
        assert len(rs) <= 7 and [r.ord for r in rs] == list(range(1, len(rs) + 1))
        assert [(-r.severity, r.det_no, r.rnk) for r in rs] == sorted((-r.severity, r.det_no, r.rnk) for r in rs)
    assert any(r.key == "kp_high" for r in per[0])


def test_roles(silver, spark):
    t = silver(match())
    asked = spark.createDataFrame([(1, 0, "5")], "match_id long, idx int, role string")
    got = rows(P.with_roles(t.players, asked), "idx", "role", "role_source")
    assert got == [(0, "5", "selected"), (1, "1", "heuristic"), (2, "2", "heuristic"), (3, None, "auto")]
    assert rows(t.players, "idx", "position")[0] == (0, "2")                  # the match itself is unchanged
    metrics = [r.metric for r in P.role_metrics(role_inputs(t, asked)).filter("idx = 0").orderBy("ord").collect()]
    assert metrics[:3] == ["assists", "kill_participation", "wards"] and "gpm" not in metrics
    wards = P.role_metrics(role_inputs(t, asked)).filter("idx = 0 and metric = 'wards'").first()
    assert wards.value == "3/4"


def test_role_benchmarks(spark):
    df = benches(spark, **{m: 0.5 for m in GENERAL_BENCH})
    who = spark.createDataFrame([(1, 0, "5")], "match_id long, idx long, role string")
    assert "gold_per_min" not in [r.metric for r in bench.benchmark_rows(df, who).collect()]
    nobody = who.withColumn("role", F.lit(None).cast("string"))
    ordered = bench.benchmark_rows(df, nobody).orderBy("ord").collect()
    assert [r.metric for r in ordered] == list(GENERAL_BENCH)


# --- several matches ------------------------------------------------------------------

RAMP = [m * 300 for m in range(26)] + [7500 - (m + 1) * 1200 for m in range(10)]


def career_docs():
    def one(match_id, win, deaths, pct, hero_id, patch):
        me = person(0, hero_id, account_id=42, deaths=deaths, benchmarks={
            "gold_per_min": {"raw": 1.0, "pct": pct}, "xp_per_min": {"raw": 1.0, "pct": pct}})
        return match(match_id, radiant_win=win, radiant_gold_adv=RAMP, patch=patch,
                     players=[me, person(1, 2, lane_role=1), person(128, 3, account_id=None), person(129, 4)])
    return [one(303, False, 9, 0.08, 1, 3), one(302, False, 7, 0.10, 1, 3), one(301, True, 2, 0.95, 3, 4)]


def wanted(spark, n=5, role=None, account=42):
    return spark.createDataFrame([(account, n, role, "claude")], "account_id long, n int, role string, model string")


def test_profile(silver, spark):
    profile = AccountProfile(silver(*career_docs()), wanted(spark))
    avg = profile.averages().first()
    assert (avg.matches, avg.winrate, avg.deaths, avg.deaths_max, avg.cs10) == (3, 33, 6.0, 9, 50)
    patterns = {r.key: r for r in profile.patterns().collect()}
    assert (patterns["bench_low"]["count"], patterns["bench_low"].share) == (2, 67)
    assert len(patterns["bench_low"].examples) == 2 and "bench_high" not in patterns
    trend = profile.trends().filter("metric = 'gold_per_min'").first()
    assert (trend.low, trend.high, trend.direction, trend.samples) == (8, 95, "flat", 3)
    verdict = profile.verdicts().first()
    assert (verdict.coverage, verdict.thin) == (3, False)
    assert [(w.start, w.end) for w in verdict.weak] == [(25, 30), (30, 35)]
    assert (verdict.strong.start, verdict.strong.change) == (0, 1500)
    assert rows(profile.heroes(), "ord", "hero", "games", "wins") == [(1, "Hero 1", 2, 0), (2, "Hero 3", 1, 1)]
    caveat = profile.caveats().first()
    assert (caveat.requested, caveat.analyzed, caveat.unparsed, caveat.patches, caveat.warning) == (
        5, 3, 0, "4, 7.36", "short")
    text = profile.documents().first()
    assert text.filename == "profile_42_3.txt" and text.document.startswith("<profile_data>\n## AVERAGES\n")
    assert "2 of 3" in text.document and "weak: 25-30, 30-35" in text.document


def test_profile_single_match_has_no_patterns(silver, spark):
    profile = AccountProfile(silver(career_docs()[0]), wanted(spark))
    assert profile.patterns().count() == 0 and profile.verdicts().first().thin


def test_sample_rules(silver, spark):
    docs = career_docs()
    docs[1]["players"][0]["lane_role"] = 1            # position 1 or 5 there
    t = silver(*docs)
    ids = lambda **k: [r.match_id for r in C.capped_sample(t.players, wanted(spark, **k)).orderBy("rec_no").collect()]
    assert ids(n=2) == [303, 302] and ids(n=1) == [303, 302]        # at least two
    assert ids(n=2, role="2") == [303, 301]                         # refilled past the other position
    gone = t.matches.filter("match_id <> 303")
    assert [r.match_id for r in C.capped_sample(t.players, wanted(spark, n=2), gone).collect()] == [302]  # not refilled
    assert ids(account=7) == []
    twice = t.players.unionByName(t.players.filter("account_id = 42").withColumn("idx", F.lit(9)))
    assert rows(C.capped_sample(twice, wanted(spark)), "rec_no", "match_id", "idx") == [(1, 303, 0), (2, 302, 0), (3, 301, 0)]
    hero = wanted(spark).withColumn("hero_id", F.lit(3))
    assert [r.match_id for r in C.capped_sample(t.players, hero).collect()] == [301]


def test_trend_direction(spark):
    sample = spark.createDataFrame([(1, i, 0, i) for i in range(1, 5)], "account_id long, match_id long, idx long, rec_no int")

    def trend(*pcts):
        df = spark.createDataFrame([(i, 0, "xp_per_min", p) for i, p in enumerate(pcts, 1)],
                                   "match_id long, idx long, metric string, pct double")
        return C.profile_trends(df, sample).first()
    assert (trend(0.5, 0.5, 0.4, 0.4).direction, trend(0.4, 0.4, 0.5, 0.5).direction) == ("up", "down")
    assert trend(0.5, 0.5, 0.45, 0.45).direction == "flat"


def test_pattern_axis_is_last_seen(spark):
    devs = spark.createDataFrame(
        [(m, 0, o, "bench_low", axis, {"n": f"{m}{o}"}) for m, o, axis in
         ((1, 1, "farm"), (1, 2, "farm"), (2, 1, "fights"))],
        "match_id long, idx long, ord int, key string, axis string, params map<string,string>")
    sample = spark.createDataFrame([(1, 1, 0, 1), (1, 2, 0, 2)], "account_id long, match_id long, idx long, rec_no int")
    row = C.profile_patterns(devs, sample).first()
    assert (row.axis, row["count"], row.share, [e["n"] for e in row.examples]) == ("fights", 2, 100, ["11", "12"])


# --- documents about one match -------------------------------------------------------------

ASK = ("match_id long, idx int, depth string, focus string, role string, model string, has_window boolean, "
       "lo_m int, hi_m int, note string, mmr string")


SETTINGS = {
    "plain": dict(note=" why did\n we lose? "), "deep": dict(depth="deep"), "xml": dict(model="claude"),
    "zoom": dict(depth="deep", window=(8, 10)), "quiet": dict(window=(80, 90)), "draft": dict(focus="draft"),
    "farm": dict(focus="farm")}


def ask(match_id, depth="quick", focus="full", model="chatgpt", window=None, note=None, role=None):
    lo, hi = window or (None, None)
    return (match_id, 0, depth, focus, role, model, window is not None, lo, hi, note, None)


@pytest.fixture(scope="module")
def texts(spark, dims, tmp_path_factory):
    """One job for all settings, each with its own copy of the match."""
    path = tmp_path_factory.mktemp("docs") / "raw.json"
    path.write_text("\n".join(json.dumps(match(n)) for n in range(1, len(SETTINGS) + 1)))
    asked = spark.createDataFrame([ask(n, **kw) for n, kw in enumerate(SETTINGS.values(), 1)], ASK)
    tables = Silver(read_matches(spark, str(path)), dims)
    found = {r.match_id: r for r in MatchFacts(tables, asked).documents().collect()}
    return {name: found[n] for n, name in enumerate(SETTINGS, 1)}


def test_document_markdown(texts):
    doc = texts["plain"]
    text = doc.document
    assert doc.filename == "1_0_0.txt" and text.startswith("## MATCH\n1 | 7.36 | all draft")
    for part in ("## SCOREBOARD\n★ [R] Hero 1 | 20 | 9/3/2", "## ITEMS\n★ [R] Hero 1: 4:00 Treads, 7:00 Blink Dagger",
                 "## DRAFT", "pick 1 of 4; first", "## LANE", "5:30 killed by Hero 3", "## FIGHTS\n8:40-9:20 | 0:2 | win",
                 "## QUESTION\nwhy did\nwe lose?", "1. note_priority", "## UNUSUAL IN THE DATA", "## OBJECTIVES\n1:10 firstblood"):
        assert part in text, (part, text)
    assert "courier" not in text and "## DAMAGE" not in text and text.endswith("\n") and not text.endswith("\n\n")


def test_requests_for_one_player_do_not_mix(spark, dims, tmp_path, texts):
    (tmp_path / "raw.json").write_text(json.dumps(match(1)))
    tables = Silver(read_matches(spark, str(tmp_path / "raw.json")), dims)
    names = ["plain", "deep", "farm"]
    asked = spark.createDataFrame([(k, *ask(1, **SETTINGS[n])) for k, n in enumerate(names)], "request_id int, " + ASK)
    found = {r.request_id: r for r in MatchFacts(tables, asked).documents().collect()}
    assert {r.filename for r in found.values()} == {f"1_0_{k}.txt" for k in range(3)}
    first = lambda text: text.split("\n")[1].split(" | ")[1:]
    for k, n in enumerate(names):
        assert found[k].document.split("\n")[2:] == texts[n].document.split("\n")[2:]
        assert first(found[k].document) == first(texts[n].document)


def test_requests_for_one_account_do_not_mix(spark, silver):
    one = wanted(spark).withColumn("request_id", F.lit(1))
    two = one.withColumn("request_id", F.lit(2)).withColumn("n", F.lit(2))
    none = one.withColumn("request_id", F.lit(3)).withColumn("account_id", F.lit(-5).cast(one.schema["account_id"].dataType)).withColumn("n", F.lit(50))
    profile = AccountProfile(silver(*career_docs()), one.union(two.select(*one.columns)).union(none.select(*one.columns)))
    assert rows(profile.sample.groupBy("request_id").count()) == [(1, 3), (2, 2)]
    caveats = {r.request_id: r for r in profile.caveats().collect()}
    assert (caveats[1].analyzed, caveats[2].analyzed, caveats[2].warning) == (3, 2, None)
    assert (caveats[3].requested, caveats[3].analyzed, caveats[3].warning) == (20, 0, "empty")
    texts = {r.request_id: r for r in profile.documents().collect()}
    assert "aggregate of 3 matches" in texts[1].document and "aggregate of 2 matches" in texts[2].document
    assert texts[1].filename == "profile_42_3_1.txt" and texts[2].filename == "profile_42_2_2.txt"


def test_equal_percentiles_go_by_document_order(spark):
    df = spark.createDataFrame([(1, 0, "xp_per_min", 1.0, 0.99, 0), (1, 0, "gold_per_min", 1.0, 0.99, 1)],
                               "match_id int, idx int, metric string, raw double, pct double, pos int")
    found = D.bench_edges(df).collect()
    assert [r.params["metric"] for r in found if r.key == "bench_high"] == ["xp_per_min"]


def test_documents_are_parsed_once(spark, dims, tmp_path):
    (tmp_path / "raw.json").write_text(json.dumps(match(1)))
    tables = Silver(read_matches(spark, str(tmp_path / "raw.json")), dims)
    tables.write(str(tmp_path / "silver"))
    (tmp_path / "raw.json").write_text("")
    again = Silver.read(spark, str(tmp_path / "silver"), dims)
    assert again.players.count() == 4 and again.fight_players.count() > 0


def test_deep_document_is_larger(texts):
    quick, deep = texts["plain"].document, texts["deep"].document
    assert len(deep) > len(quick) and "courier" in deep and "## DAMAGE" in deep and "## BUFFS" in deep


def test_document_xml(texts):
    text = texts["xml"].document
    assert text.startswith("<match_data>\n## MATCH\n") and "<data_limitations>\nseries have" in text
    assert text.rstrip().endswith("</method>")


def test_document_window(texts):
    text = texts["zoom"].document
    assert "## WINDOW\nm 8: gold +700" in text and "m 9" in text and "9:20 | 0:2 | win" in text
    assert "## BUFFS" in text                                          # other sections shrink to summaries
    assert "courier" not in text[text.index("## OBJECTIVES"):]
    assert "quiet: no events" in texts["quiet"].document


def test_focus_hides_sections(texts):
    text = texts["draft"].document
    assert "## COMBAT" not in text and "## UNUSUAL IN THE DATA" in text
    assert "0:00 Tango" in texts["farm"].document                       # the full purchase log


def test_profile_documents_have_question_and_rules(spark, silver):
    plain = wanted(spark).withColumn("request_id", F.lit(1)).withColumns({"note": F.lit(None).cast("string"), "mmr": F.lit(None).cast("string")})
    asked = wanted(spark, role="2").withColumn("request_id", F.lit(2)).withColumns({"note": F.lit("  why do I lose\n late? "), "mmr": F.lit("4200")})
    texts = {r.request_id: r.document for r in AccountProfile(silver(*career_docs()), plain.union(asked)).documents().collect()}
    method = lambda t: [x.split(". ")[1] for x in t.split("<method>")[1].split("</method>")[0].strip().split("\n")]
    assert "player_question" not in texts[1] and "<player_question>\nwhy do I lose\nlate?\n</player_question>" in texts[2]
    everyone = [key for key, need in PROFILE_RULES if need is None]
    assert [x for x in method(texts[1]) if x in everyone] == everyone == method(texts[1])
    assert method(texts[2]) == ["note_priority", "role.2", *everyone[:-1], "calibrate", "language"]
    assert "request_id" not in wanted(spark).columns and "<method>" in AccountProfile(silver(*career_docs()), wanted(spark)).documents().first().document
