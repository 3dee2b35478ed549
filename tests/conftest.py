import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from matchlens import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session.build("matchlens-tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.default.parallelism": "4", "spark.driver.memory": "6g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(autouse=True)
def release():
    yield
    from matchlens.plans import share
    share.release()


def rows(df, *cols):
    """Rows as sorted tuples."""
    picked = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)


def hero(n):
    return f"npc_dota_hero_h{n}"


def person(slot, hero_id, **extra):
    """A player document with enough of everything to reach every section."""
    doc = {
        "player_slot": slot, "hero_id": hero_id, "account_id": 1000 + slot, "lane": 2, "lane_role": 2,
        "is_roaming": False, "lane_efficiency_pct": 60, "level": 20, "kills": 4, "deaths": 3, "assists": 5,
        "last_hits": 150, "denies": 5, "gold_per_min": 400, "xp_per_min": 450, "net_worth": 9000,
        "hero_damage": 11000, "tower_damage": 900, "hero_healing": 30, "damage_taken": {"x": 700, "y": 300},
        "damage": {hero(1): 500, hero(2): 900, "npc_dota_creep": 4000},
        "gold_t": [m * 300 for m in range(16)], "xp_t": [m * 350 for m in range(16)],
        "lh_t": [m * 5 for m in range(16)], "dn_t": [m for m in range(16)],
        "purchase_log": [], "kills_log": [], "ability_upgrades_arr": [10, 11, 99],
        "permanent_buffs": [{"permanent_buff": 1, "stack_count": 7, "grant_time": 600},
                            {"permanent_buff": 2, "stack_count": 0, "grant_time": 1}],
        "kill_streaks": {"3": 1, "7": 1}, "multi_kills": {"2": 3}, "life_state": {"0": 900, "2": 40}, "stuns": 8.25,
        "max_hero_hit": {"value": 512, "key": hero(2)}, "obs_placed": 3, "sen_placed": 4,
        "benchmarks": {"gold_per_min": {"raw": 400.0, "pct": 0.5}, "xp_per_min": {"raw": 450.0, "pct": 0.6}},
    }
    doc.update(extra)
    return doc


def match(match_id=1, **extra):
    """Two sides of two; player 0 is the usual focal one."""
    doc = {
        "match_id": match_id, "duration": 900, "game_mode": 22, "lobby_type": 7, "patch": 3, "version": 21,
        "region": 1, "radiant_win": True,
        "radiant_gold_adv": [0, 100, -50, 0, 300, 500, 900, 800, 700, 600, 500, 400, 300, 200, 100, 50],
        "radiant_xp_adv": [0] * 16,
        "picks_bans": [{"order": 1, "is_pick": False, "hero_id": 9, "team": 1},
                       {"order": 2, "is_pick": True, "hero_id": 1, "team": 0},
                       {"order": 3, "is_pick": True, "hero_id": 3, "team": 1},
                       {"order": 4, "is_pick": True, "hero_id": 2, "team": 0},
                       {"order": 5, "is_pick": True, "hero_id": 4, "team": 1}],
        "objectives": [{"type": "CHAT_MESSAGE_FIRSTBLOOD", "time": 70, "key": 3},
                       {"type": "building_kill", "time": 500, "key": "npc_dota_badguys_tower1_mid", "unit": hero(1)},
                       {"type": "building_kill", "time": 600, "key": "npc_dota_goodguys_melee_rax_top", "unit": "npc_creep"},
                       {"type": "CHAT_MESSAGE_COURIER_LOST", "time": 650, "team": 3},
                       {"type": "CHAT_MESSAGE_UNHEARD_OF", "time": 660},
                       {"type": "CHAT_MESSAGE_ROSHAN_KILL", "time": 700, "team": 2}],
        "teamfights": [{"start": 520, "end": 560, "deaths": 2, "players": [
            {"deaths": 0, "damage": 700, "healing": 0, "gold_delta": 300, "xp_delta": 200, "killed": {hero(3): 1, "npc_x": 2}},
            {"deaths": 0, "damage": 0, "healing": 50, "gold_delta": 10, "xp_delta": 10},
            {"deaths": 2, "damage": 100, "healing": 0, "gold_delta": -200, "xp_delta": 0},
            {"deaths": 0, "damage": 0, "healing": 0, "gold_delta": 20, "xp_delta": 5}]}],
        "players": [
            person(0, 1, net_worth=12000, kills=9, assists=2, kills_log=[{"time": -5, "key": hero(3)}, {"time": 200, "key": hero(3)}],
                   purchase_log=[{"time": 0, "key": "tango"}, {"time": 60, "key": "boots"}, {"time": 120, "key": "gloves"},
                                 {"time": 180, "key": "belt"}, {"time": 240, "key": "item_treads"},
                                 {"time": 300, "key": "recipe_x"}, {"time": 420, "key": "blink"}]),
            person(1, 2, lane=1, lane_role=1, net_worth=0, total_gold=0, kills=0, assists=0),
            person(128, 3, lane_efficiency_pct=30, kills_log=[{"time": 330, "key": hero(1)}, {"time": 2450, "key": hero(1)}]),
            person(129, 4, lane=None, lane_role=3, is_roaming=True)],
    }
    doc.update(extra)
    return doc


HEROES = [(n, hero(n), f"Hero {n}") for n in range(1, 5)]
ITEMS = [("boots", "Boots", 500, "component", []), ("gloves", "Gloves", 450, "component", []),
         ("belt", "Belt", 450, "component", []), ("treads", "Treads", 1400, "common", ["boots", "gloves", "belt", ""]),
         ("tango", "Tango", 90, "consumable", []), ("blink", "Blink Dagger", 2250, "component", [])]


@pytest.fixture(scope="session")
def dims(spark):
    from matchlens.schemas import DIMENSIONS
    data = {
        "heroes": HEROES, "items": ITEMS,
        "abilities": [("bolt", "Bolt"), ("special_bonus_hp", "+{s:value} Health"), ("soul", "{s:x}Soul Steal")],
        "ability_ids": [(10, "bolt"), (11, "special_bonus_hp")], "game_mode": [(22, "game_mode_all_draft")],
        "lobby_type": [(7, "lobby_type_ranked")], "patch": [(3, "7.36")],
        "permanent_buffs": [(1, "soul"), (2, "blink")]}
    return {n: spark.createDataFrame(data[n], s) for n, s in DIMENSIONS.items()}


@pytest.fixture()
def silver(spark, dims, tmp_path):
    """Builds the tables from match documents written as JSON lines."""
    from matchlens.sources.landing import read_matches
    from matchlens.sources.silver import Silver

    def build(*docs):
        path = tmp_path / "raw.json"
        path.write_text("\n".join(json.dumps(d) for d in docs))
        return Silver(read_matches(spark, str(path)), dims)
    return build
