"""Raw documents to tables, and the operators that read them."""

from pyspark.sql import functions as F

from conftest import hero, match, person, rows
from matchlens.functions import text as X
from matchlens.sources.silver import Silver
from matchlens.operators import build as B, draft, events as E, fights as G, players as P, series as S

ME = "match_id = 1 and idx = 0"


def test_match_header_uses_names(silver):
    assert rows(silver(match()).matches, "mode", "lobby", "patch", "parsed", "duration") == [
        ("all draft", "ranked", "7.36", True, 900)]


def test_missing_fields_default(silver):
    t = silver({"match_id": 5, "players": [{"player_slot": 130, "hero_id": 77}]})
    p = t.players.first()
    assert (p.is_radiant, p.hero_name, p.kills, p.net_worth, p.seconds_dead, p.damage_taken) == (
        False, "hero_77", 0, 0, 0, 0)
    assert p.account_id is None and p.lane_eff is None and p.win is True
    m = t.matches.first()
    assert (m.parsed, m.mode, m.patch) == (False, "mode_None", "None")
    for name in ("minutes", "purchases", "kills", "fights", "objectives", "picks", "benchmarks", "adv"):
        assert getattr(t, name).count() == 0


def test_bad_document_is_kept_apart(spark, tmp_path):
    from matchlens.sources.landing import read_matches
    (tmp_path / "x.json").write_text('{"match_id": 1}\n{"match_id": oops\n')
    from matchlens.sources.landing import rejected
    assert rows(read_matches(spark, str(tmp_path)), "match_id") == [(1,)]
    assert rows(rejected(spark, str(tmp_path))) == [('{"match_id": oops',)]


def test_player_projection(silver):
    p = silver(match()).players.filter(ME).first()
    assert (p.net_worth, p.damage_taken, p.seconds_dead, p.win, p.hero_npc) == (12000, 1000, 40, True, hero(1))
    other = silver(match()).players.filter("idx = 1").first()
    assert other.net_worth == 15 * 300                # final and total are 0: the series decides


def test_positions(silver):
    got = rows(silver(match()).players, "idx", "lane_key", "is_core", "position")
    assert got == [(0, "mid", True, "2"), (1, "safe", True, "1"), (2, "mid", True, "2"), (3, "roaming", False, "support")]


def test_position_ties_go_to_list_order(silver):
    team = [person(s, 1, lane_role=1, net_worth=5000) for s in (0, 1)]
    assert rows(silver(match(players=team)).players, "idx", "position") == [(0, "1"), (1, "5")]


def test_damage_keeps_heroes_only(silver):
    top = P.top_targets(silver(match()).damage.filter(ME))
    assert rows(top, "ord", "target", "damage") == [(1, "Hero 2", 900), (2, "Hero 1", 500)]


def test_combat_counters(silver, dims):
    row = P.combat_counters(silver(match()).players, dims["heroes"]).filter(ME).first()
    assert (row.best_streak, row.best_multikill, row.stuns_sec, row.time_dead, row.max_hit) == (
        7, 2, 8.2, "0:40", "512 on Hero 2")


def test_zero_stacks_are_dropped(silver):
    assert rows(silver(match()).buffs.filter(ME), "buff", "stacks", "since") == [("Soul Steal", 7, 600)]


def test_abilities_cascade(silver):
    assert rows(silver(match()).abilities.filter(ME), "n", "ability", "talent") == [
        (1, "Bolt", False), (2, "Health", True), (3, "ability_99", False)]


def test_objectives(silver, dims):
    got = rows(E.classify_objectives(silver(match()).objectives, dims["heroes"]),
               "t", "kind", "victim", "attacker", "building", "short", "hero", "by_creeps", "side", "minor")
    assert got == sorted([
        (70, "firstblood", None, None, None, None, None, None, None, False),
        (500, "building", "Dire", "Radiant", "tower", "tower1_mid", "Hero 1", False, None, False),
        (600, "building", "Radiant", "Dire", "rax", "melee_rax_top", None, True, None, False),
        (650, "courier", None, None, None, None, None, None, "Dire", True),
        (700, "roshan", None, None, None, None, None, None, "Radiant", False)], key=repr)


def test_absorption(silver, dims):
    t = silver(match())
    built = B.assembled(B.absorb_components(B.with_items(t.purchases, dims["items"]), ["pos"]), 1000).filter(ME)
    assert rows(built, "item", "t") == [("Blink Dagger", 420), ("Treads", 240)]


def test_deaths(silver):
    t = silver(match())
    assert rows(E.death_times(t.kills, t.players), "idx", "t", "killer") == [(0, 2450, 2), (0, 330, 2), (2, 200, 0)]
    assert rows(E.early_deaths(t.kills, t.players), "idx", "t") == [(0, 330), (2, -5), (2, 200)]
    got = rows(E.early_late_times(t.kills, E.death_times(t.kills, t.players)), "idx", "kind", "t")
    assert got == [(0, "early_kill", 200), (0, "late_death", 2450), (2, "early_kill", 330)]


def test_fight(silver):
    t = silver(match())
    won = G.fight_outcome(t.fights, t.fight_players, t.players).filter(ME).first()
    assert (won.my_losses, won.enemy_losses, won.verdict, won.fallen, won.my_damage, won.killed, won.in_lane) == (
        0, 2, "win", [2], 700, [hero(3)], True)
    lost = G.fight_outcome(t.fights, t.fight_players, t.players).filter("idx = 3").first()
    assert (lost.verdict, lost.my_losses, lost.enemy_losses) == ("lose", 2, 0)
    # healing counts as involvement, not as participation
    assert rows(G.fight_involvement(t.fight_players), "idx", "involved") == [(0, 1), (1, 1), (2, 1), (3, 0)]
    assert rows(G.participants(t.fight_players), "idx") == [(0,), (2,)]


def test_draft(silver):
    t = silver(match(), match(2, picks_bans=[]), match(3, picks_bans=[
        {"order": 1, "is_pick": True, "hero_id": 1, "team": 0}, {"order": 2, "is_pick": False, "hero_id": 2, "team": 1}]))
    assert rows(draft.draft_flag(t.matches, t.picks)) == [(1, True), (2, False), (3, False)]
    mine = draft.draft_my_pick(t.picks, t.players)
    assert rows(mine.filter("match_id = 1 and idx = 1"), "order", "total", "tag", "enemies_before", "allies_before",
                "enemies_after") == [(3, 4, "mid", ["Hero 3"], ["Hero 1"], ["Hero 4"])]
    assert rows(mine.filter("match_id = 3"), "idx", "tag") == [(0, "first")]


def test_opponents(silver):
    t = silver(match())
    ids = F.transform("opponents", lambda o: o["idx"])
    assert rows(P.opponents(t.players).select("idx", ids)) == [(0, [2, 3]), (1, [2, 3]), (2, [0, 1]), (3, [0, 1])]
    assert rows(P.lane_opponents(t.players).select("idx", ids)) == [(0, [2]), (1, []), (2, [0]), (3, [])]


def test_advantage_falls_back_to_players(silver):
    gold = [0, 100, 200]
    docs = [person(0, 1, gold_t=gold), person(128, 2, gold_t=[0, 40])]
    t = silver(match(), match(2, radiant_gold_adv=[], radiant_xp_adv=[], players=docs))
    assert rows(t.adv.filter("match_id = 2"), "m", "gold", "xp") == [(0, 0, None), (1, 60, None), (2, 200, None)]
    assert t.adv.filter("match_id = 1").count() == 16


def test_window(silver):
    t = silver(match())
    spans = t.matches.select("match_id", F.lit(500).alias("lo"), F.lit(600).alias("hi"))
    found = E.window_events(spans, t.kills, t.purchases, t.fights, E.classify_objectives(t.objectives))
    assert rows(found, "kind", "t") == [("fight", 520), ("objective", 500), ("objective", 600)]
    quiet = t.matches.select("match_id", F.lit(5000).alias("lo"), F.lit(6000).alias("hi"))
    assert E.window_summary(quiet, E.window_events(
        quiet, t.kills, t.purchases, t.fights, E.classify_objectives(t.objectives))).first().empty


def test_early_grid_keeps_missing_minutes(silver):
    t = silver(match(players=[person(0, 1, gold_t=[0, 1], xp_t=[0], lh_t=[], dn_t=[])]))
    grid = S.early_grid(t.players, t.minutes)
    assert rows(grid.filter("m <= 2"), "m", "gold", "lh") == [(1, 1, None), (2, None, None)] and grid.count() == 10


def test_write_and_reread(spark, silver, dims, tmp_path):
    t = silver(match())
    t.write(str(tmp_path / "silver"))
    again = Silver.read(spark, str(tmp_path / "silver"), dims)
    assert rows(again.players, "idx", "position") == rows(t.players, "idx", "position")
    assert rows(again.adv) == rows(t.adv)


def test_buckets_need_no_exchange(spark, silver, dims, tmp_path):
    silver(match(), match(2)).save_bucketed("silver_test", str(tmp_path / "b"), 4)
    t = Silver.bucketed(spark, "silver_test", dims)
    share = P.kill_participation(t.players).join(t.matches.hint("merge"), "match_id")
    assert "Exchange" not in share._jdf.queryExecution().executedPlan().toString()
    assert share.count() == 8


def test_utility_first_purchases(silver):
    log = [{"time": 10, "key": "item_blink"}, {"time": 5, "key": "blink"}, {"time": 6, "key": "boots"}]
    t = silver(match(players=[person(0, 1, purchase_log=log)]))
    assert rows(B.first_per_key(t.purchases, ["pos"]), "key", "t") == [("blink", 10)]   # log order, not time


def test_full_log(silver):
    log = B.full_log(silver(match()).purchases, ["pos"]).filter(ME)
    assert [r[0] for r in log.orderBy("pos").select("key").collect()][:2] == ["tango", "boots"]


def test_clock_texts(spark):
    df = spark.sql("SELECT explode(array(-65, 0, 59, 3601, NULL)) AS t")
    assert [r[0] for r in df.select(X.mmss(F.col("t"))).collect()] == ["-1:05", "0:00", "0:59", "60:01", "?"]
    assert [r[0] for r in df.select(X.signed(F.col("t"))).collect()] == ["-65", "0", "+59", "+3601", "?"]
