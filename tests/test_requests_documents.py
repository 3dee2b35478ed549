"""Look-ups, requests, rendering and assembling."""

from pyspark.sql import functions as F

from conftest import rows
from matchlens.functions import lookup as L, text as X
from matchlens.operators import documents as T, requests as Q, resolve as R
from matchlens.params import FOCUSES, SECTION_BASE
from matchlens.sources.landing import latest_version


def test_strip_tokens(spark):
    cases = {"+{s:bonus_x}% Rot Slow": "Rot Slow", "-{s:cd}s Hook Cooldown": "Hook Cooldown", "{s:r} AoE Laser": "AoE Laser",
             "+8% Lifesteal": "+8% Lifesteal", "+{s:x} slow duration": "slow duration", "plain": "plain"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.x for r in df.select("t", X.strip_tokens(F.col("t")).alias("x")).collect()} == cases


def test_range_text(spark):
    df = spark.createDataFrame([("5-10",), (" 30 – 40 ",), ("5",), ("a-b",), ("1-2-3",), (None,)], "t string")
    lo, hi = X.range_bounds(F.col("t"))
    assert [tuple(r) for r in df.select(lo, hi).collect()] == [(5, 10), (30, 40), (None, None), (None, None), (None, None), (None, None)]


def test_resolve_name(spark):
    names = spark.createDataFrame([("Phantom Lancer", 1), ("Phantom Assassin", 2), ("Pudge", 3), ("Pud", 4)], "name string, id int")
    asked = spark.createDataFrame([(i, n) for i, n in enumerate(
        ["phantom", "Phantom_Lancer", "  lancer ", "pud", "udge", "", "nobody"])], "request_id int, needle string")
    assert {r.request_id: r.id for r in R.resolve_name(asked, names).collect()} == {
        0: None, 1: 1, 2: 1, 3: 4, 4: 3, 5: None, 6: None}


def test_resolve_focal(spark):
    players = spark.createDataFrame([(1, 0, None, "Axe"), (1, 1, 7, "Drow Ranger"), (1, 2, 8, "Phantom Ranger")],
                                    "match_id int, idx int, account_id long, hero_name string")
    asked = spark.createDataFrame([(1, 1, 8, "axe"), (2, 1, 99, "RANGER"), (3, 1, None, None), (4, 5, 7, "axe"), (5, 1, None, "axe")],
                                  "request_id int, match_id int, account_id long, hero string")
    got = R.resolve_focal(asked, players)
    assert rows(got, "request_id", "idx", "how") == [(1, 2, "account"), (2, 1, "hero"), (3, None, "unresolved"),
                                                     (4, None, "unresolved"), (5, 0, "hero")]
    assert rows(R.unresolved(got), "request_id") == [(3,), (4,)]


def test_lookup_fallbacks(spark, dims):
    df = spark.createDataFrame([(22,), (5,), (None,)], "k int")
    assert rows(L.mode_names(df, dims["game_mode"], "k", "game_mode_", "n"), "n") == [("all draft",), ("mode_5",), ("mode_None",)]
    assert rows(L.mode_names(df, dims["lobby_type"], "k", "lobby_type_", "n"), "n") == [("lobby_22",), ("lobby_5",), ("lobby_None",)]
    buffs = spark.createDataFrame([(1,), (2,), (9,)], "k int")
    named = L.buff_names(buffs, dims["permanent_buffs"], dims["items"], dims["abilities"], "k")
    assert rows(named, "k", "buff") == [(1, "Soul Steal"), (2, "Blink Dagger"), (9, "buff#9")]


def test_latest_version(spark):
    df = spark.createDataFrame([(1, 1, True, "a"), (1, 2, False, "b"), (2, 1, False, "c"), (2, 2, False, "d")],
                               "match_id int, ts int, parsed boolean, body string")
    got = latest_version(df, "match_id", F.col("parsed"), [F.col("ts")])
    assert rows(got, "match_id", "body") == [(1, "a"), (2, "d")]


def levels(spark, depth, focus, window=False):
    df = spark.createDataFrame([(depth, focus, window)], "depth string, focus string, has_window boolean")
    return {r.section: r.level for r in Q.section_levels(df).collect()}


def test_levels(spark):
    full = levels(spark, "deep", "full")
    assert (full["meta"], full["combat"], full["buffs"], full["window"]) == (1, 2, 1, 0)
    farm = levels(spark, "quick", "farm")
    assert (farm["items"], farm["damage"], farm["draft"]) == (3, 0, 1)
    zoomed = levels(spark, "deep", "fights", True)
    assert zoomed["window"] == 3 and all(v <= 1 for k, v in zoomed.items() if k != "window")
    for focus in FOCUSES:
        assert levels(spark, "quick", focus)["anomalies"] == 1
    assert set(full) == {*SECTION_BASE, "window"}


def test_validate_requests(spark):
    cols = "request_id int, depth string, focus string, role string, model string, window string, lang string, note string, mmr string"
    ok = (1, "quick", "full", None, "claude", "5-10", "en", " a ", " 3 500 ")
    bad = [(2, "odd", "full", None, "claude", None, "en", None, None), (3, "deep", "x", None, "claude", None, "en", None, None),
           (4, "deep", "full", "6", "claude", None, "en", None, None), (5, "deep", "full", "1", "gpt", "", "xx", "  ", ""),
           (6, "deep", "full", "1", "claude", "9-9", "en", None, None), (7, "deep", "full", "1", "claude", "x", "en", None, None)]
    got = {r.request_id: r for r in Q.validate_requests(spark.createDataFrame([ok, *bad], cols)).collect()}
    assert {k: r.problem for k, r in got.items()} == {1: None, 2: "depth", 3: "focus", 4: "role", 5: "model", 6: "window_order", 7: "window_text"}
    assert (got[1].start, got[1].end, got[1].note, got[1].mmr) == (5, 10, "a", "3 500")
    assert (got[5].lang, got[5].note, got[5].mmr, got[5].suggested[:2]) == ("ru", None, None, ["full", "farm"])


def test_rules(spark):
    df = spark.createDataFrame([(1, True, "3", "4k"), (2, False, None, None)], "request_id int, has_note boolean, role string, mmr string")
    got = {}
    for r in Q.rule_list(df).orderBy("request_id", "n").collect():
        got.setdefault(r.request_id, []).append(r.rule)
    assert got[1][:3] == ["note_priority", "role.3", "evidence"] and got[2][0] == "evidence"
    assert "calibrate" in got[1] and "calibrate" not in got[2] and got[2][-1] == "language"


def test_rendering(spark):
    df = spark.createDataFrame([("en", "bench_low", {"metric": "gold", "pct": "3"}), ("uk", "bench_low", {})],
                               "lang string, key string, params map<string,string>")
    assert rows(T.render_templates(df, T.templates(spark)), "lang", "text") == [
        ("en", "gold in the bottom of the distribution: percentile 3"), ("uk", "[bench_low?]")]


def test_missing_templates(spark):
    df = spark.createDataFrame([("en", "a"), ("en", "b"), ("uk", "a"), ("uk", "only_uk")], "lang string, key string")
    assert rows(T.missing_templates(df, ["en", "uk", "ru"], "en")) == [("a", "ru"), ("b", "ru"), ("b", "uk")]


def lines(spark, wrapper):
    data = [(1, wrapper, 1, "data", 1, "A", 2, "a2"), (1, wrapper, 1, "data", 1, "A", 1, "a1"), (1, wrapper, 1, "data", 2, "B", 1, "b1"),
            (1, wrapper, 2, "limits", 1, "L", 1, "l1")]
    return spark.createDataFrame(data, "doc int, wrapper string, group_ord int, group_tag string, section_ord int, "
                                       "heading string, ord int, line string")


def test_assemble(spark):
    assert T.assemble(lines(spark, "markdown"), ["doc"]).first().document == "## A\na1\na2\n\n## B\nb1\n\n## L\nl1\n"
    assert T.assemble(lines(spark, "xml"), ["doc"]).first().document == (
        "<data>\n## A\na1\na2\n\n## B\nb1\n</data>\n\n<limits>\nl1\n</limits>\n")
