"""Explicit schemas: raw match documents, look-up tables and feedback records."""

from __future__ import annotations

# --- Fixed values: field names and types of the input documents
_FIGHT = """struct<start:int,end:int,deaths:int,players:array<struct<deaths:int,damage:bigint,
healing:bigint,gold_delta:bigint,xp_delta:bigint,killed:map<string,int>>>>"""

_PLAYER = """struct<account_id:bigint,player_slot:int,hero_id:int,personaname:string,
lane_role:int,lane:int,is_roaming:boolean,lane_efficiency_pct:int,
level:int,kills:int,deaths:int,assists:int,last_hits:int,denies:int,
gold_per_min:int,xp_per_min:int,net_worth:bigint,total_gold:bigint,
hero_damage:bigint,tower_damage:bigint,hero_healing:bigint,
damage:map<string,bigint>,damage_taken:map<string,bigint>,
gold_t:array<bigint>,xp_t:array<bigint>,lh_t:array<int>,dn_t:array<int>,
purchase_log:array<struct<time:int,key:string>>,kills_log:array<struct<time:int,key:string>>,
ability_upgrades_arr:array<int>,
permanent_buffs:array<struct<permanent_buff:int,stack_count:int,grant_time:int>>,
kill_streaks:map<string,int>,multi_kills:map<string,int>,life_state:map<string,int>,
stuns:double,max_hero_hit:struct<value:bigint,key:string>,
camps_stacked:int,creeps_stacked:int,rune_pickups:int,obs_placed:int,sen_placed:int,
buyback_count:int,pings:int,actions_per_min:int,
neutral_kills:int,ancient_kills:int,tower_kills:int,roshan_kills:int,courier_kills:int,
observer_kills:int,sentry_kills:int,
benchmarks:map<string,struct<raw:double,pct:double>>>"""

RAW_MATCH = f"""match_id bigint, duration int, game_mode int, lobby_type int, patch int,
version int, region int, radiant_win boolean,
radiant_gold_adv array<bigint>, radiant_xp_adv array<bigint>,
picks_bans array<struct<order:int,is_pick:boolean,hero_id:int,team:int>>,
objectives array<struct<type:string,time:int,key:string,unit:string,team:int>>,
teamfights array<{_FIGHT}>, players array<{_PLAYER}>, _bad string""".replace("\n", "")

DIMENSIONS = {
    "heroes": "id int, name string, localized_name string",
    "items": "key string, dname string, cost int, qual string, components array<string>",
    "abilities": "internal string, dname string",
    "ability_ids": "id int, internal string",
    "game_mode": "id int, name string",
    "lobby_type": "id int, name string",
    "patch": "id int, name string",
    "permanent_buffs": "id int, internal string",
}

FEEDBACK = """rating int, mode string, lang string, model string, created_at string,
comment string, match_id bigint, role string, depth string, focus string, window string,
matches int, prompt_bytes bigint, followup boolean""".replace("\n", "")
# ---
