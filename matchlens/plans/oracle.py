"""The registered queries as SQL over the same tables, written independently of the operators.

``PARTS`` are common table expressions; a query names the ones it needs and they are put in
front of it, dependencies first.
"""

from __future__ import annotations

import re

from matchlens.operators.documents import GROUP_OF, HEADINGS, TEMPLATES
from matchlens.params import (DEPTHS, FOCUSES, FOCUS_LEVELS, GENERAL_BENCH, LANGUAGES, MATCH_RULES, METRIC_AXIS, MODELS,
                              ROLE_BENCH, ROLE_FOCUSES, ROLE_LANE, ROLE_METRICS, ROLES, SECTION_BASE,
                              TREND_METRICS, WRAPPERS)
from matchlens.sources.bind import ITEM_ROWS, LIMITS as P

PARTS: dict[str, str] = {}
QUERIES: dict[str, str] = {}


def text(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def items(values) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def table(rows, columns: str) -> str:
    body = ", ".join("(" + ", ".join(str(v) if isinstance(v, (int, float)) else v if v.startswith("[")
                                     else text(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS v({columns})"


def clock(x: str) -> str:
    s = f"abs({x})"
    return (f"CASE WHEN {x} IS NULL THEN '?' ELSE CASE WHEN {x} < 0 THEN '-' ELSE '' END || ({s} // 60)"
            f" || ':' || lpad(CAST({s} % 60 AS VARCHAR), 2, '0') END")


def half(x: str, digits: int = 0) -> str:
    out = f"round_even(CAST({x} AS DOUBLE), {digits})"
    return out if digits else f"CAST({out} AS BIGINT)"


def clamp(x: str) -> str:
    return f"greatest(0e0, least(1e0, {x}))"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


# --- bindings ------------------------------------------------------------------------------

PARTS["ev"] = """
SELECT event_id, ts, user_id, user_id // 10 AS match_id, user_id % 10 AS idx, user_id % 2 = 0 AS is_radiant,
       CAST((user_id % 10) // 2 % 3 + 1 AS BIGINT) AS lane,
       date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS m,
       date_diff('second', TIMESTAMP '2024-01-01', ts) AS t,
       CAST(round(value * 100) AS BIGINT) AS cents,
       CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k, event_type
FROM events"""
PARTS["days"] = """
SELECT match_id, idx, m, sum(cents) AS gold, sum(k) AS xp, count(*) FILTER (event_type = 'view') AS lh,
       count(*) FILTER (event_type = 'signup') AS dn FROM ev GROUP BY ALL"""
PARTS["minutes"] = """
SELECT g.match_id, g.idx, g.is_radiant, g.m, CAST(sum(coalesce(d.gold, 0)) OVER w AS BIGINT) AS gold,
       CAST(sum(coalesce(d.xp, 0)) OVER w AS BIGINT) AS xp, CAST(sum(coalesce(d.lh, 0)) OVER w AS BIGINT) AS lh,
       CAST(sum(coalesce(d.dn, 0)) OVER w AS BIGINT) AS dn
FROM (SELECT match_id, idx, is_radiant, unnest(range(lo, hi + 1)) AS m
      FROM (SELECT DISTINCT match_id, idx, is_radiant FROM ev)
      JOIN (SELECT match_id, least(min(m), 0) AS lo, greatest(max(m), 0) AS hi FROM ev GROUP BY match_id) USING (match_id)) g
LEFT JOIN days d ON d.match_id = g.match_id AND d.idx = g.idx AND d.m = g.m
WINDOW w AS (PARTITION BY g.match_id, g.idx ORDER BY g.m)"""
PARTS["adv"] = """
SELECT match_id, m, CAST(sum(CASE WHEN is_radiant THEN gold ELSE -gold END) AS BIGINT) AS gold
FROM minutes GROUP BY match_id, m"""
PARTS["sided"] = """
SELECT match_id, s.is_radiant, m, CASE WHEN s.is_radiant THEN gold ELSE -gold END AS gold
FROM adv, (VALUES (true), (false)) s(is_radiant)"""
PARTS["totals"] = """
SELECT match_id, idx, is_radiant, lane, count(*) FILTER (event_type = 'purchase') AS kills,
       count(*) FILTER (event_type = 'error') AS deaths, count(*) FILTER (event_type = 'click') AS assists,
       count(*) FILTER (event_type = 'view') AS last_hits, count(*) FILTER (k < 10) AS denies,
       count(*) FILTER (event_type = 'signup') AS level, CAST(sum(cents) AS BIGINT) AS total_gold,
       CAST(sum(k) AS BIGINT) AS xp,
       CAST(coalesce(sum(cents) FILTER (event_type = 'purchase'), 0) AS BIGINT) AS hero_damage,
       CAST(coalesce(sum(cents) FILTER (event_type = 'click'), 0) AS BIGINT) AS tower_damage,
       CAST(coalesce(sum(cents) FILTER (event_type = 'signup'), 0) AS BIGINT) AS hero_healing,
       CAST(coalesce(sum(cents) FILTER (event_type = 'error'), 0) AS BIGINT) AS damage_taken,
       CAST(coalesce(sum(k * 500) FILTER (event_type = 'error'), 0) AS BIGINT) AS seconds_dead,
       greatest(max(max(t)) OVER (PARTITION BY match_id) // 86400 + 1, 1) AS steps
FROM ev GROUP BY match_id, idx, is_radiant, lane"""
PARTS["lanes"] = """
SELECT *, match_id * 10 + idx AS uid, idx AS account_id, 'hero_' || ((match_id * 10 + idx) % 25) AS hero_name,
       CASE WHEN (match_id * 10 + idx) % 11 = 0 THEN NULL ELSE lane END AS lane_role,
       CASE WHEN last_hits + assists > 0
            THEN CAST(round_even(100 * last_hits / CAST(last_hits + assists AS DOUBLE), 0) AS BIGINT) END AS lane_eff,
       total_gold // (steps * 1440) AS gpm, xp // steps AS xpm, seconds_dead / 1000e0 AS stuns, total_gold AS net_worth,
       CASE WHEN (match_id * 10 + idx) % 13 = 0 THEN 'roaming'
            WHEN (match_id * 10 + idx) % 11 = 0 THEN 'unknown'
            ELSE ['safe', 'mid', 'off'][lane] END AS lane_key FROM totals"""
PARTS["cores"] = """
SELECT *, lane_key = 'mid' OR (lane_key IN ('safe', 'off') AND row_number() OVER (
         PARTITION BY match_id, is_radiant, lane_key ORDER BY net_worth DESC, idx) = 1) AS is_core FROM lanes"""
PARTS["players"] = """
SELECT *, CASE WHEN lane_key = 'mid' THEN '2' WHEN lane_key = 'safe' THEN CASE WHEN is_core THEN '1' ELSE '5' END
               WHEN lane_key = 'off' THEN CASE WHEN is_core THEN '3' ELSE '4' END ELSE 'support' END AS position
FROM cores"""
PARTS["matches"] = """
SELECT match_id, sum(CASE WHEN is_radiant THEN cents ELSE -cents END) > 0 AS radiant_win, max(t) AS duration,
       'mode_' || (match_id % 3) AS mode, 'lobby_' || (match_id % 2) AS lobby,
       '7.' || (30 + match_id % 4) AS patch, match_id % 5 <> 0 AS parsed FROM ev GROUP BY match_id"""
PARTS["kills"] = """
SELECT match_id, idx AS killer, is_radiant AS killer_radiant, t, event_id, k % 10 AS victim
FROM ev WHERE event_type = 'purchase' AND k % 10 <> idx"""
PARTS["deaths"] = """
SELECT k.match_id, k.victim AS idx, k.t, k.killer FROM kills k
JOIN players p ON p.match_id = k.match_id AND p.idx = k.victim
WHERE p.is_radiant <> k.killer_radiant AND k.t >= 0"""
PARTS["fight_players"] = """
SELECT match_id, m AS fight_no, idx, is_radiant, count(*) FILTER (event_type = 'error') AS deaths,
       CAST(coalesce(sum(cents) FILTER (event_type = 'purchase'), 0) AS BIGINT) AS damage,
       CAST(coalesce(sum(cents) FILTER (event_type = 'signup'), 0) AS BIGINT) AS healing,
       CAST(sum(cents) AS BIGINT) AS gold_delta, CAST(sum(k) AS BIGINT) AS xp_delta FROM ev GROUP BY 1, 2, 3, 4"""
PARTS["fights"] = """
SELECT match_id, m AS fight_no, min(t) AS start, max(t) AS "end", count(*) FILTER (event_type = 'error') AS deaths
FROM ev GROUP BY 1, 2"""
PARTS["picks"] = """
SELECT match_id, idx, is_radiant, 'hero_' || ((match_id * 10 + idx) % 25) AS hero_name,
       event_type <> 'error' AS is_pick, row_number() OVER (PARTITION BY match_id ORDER BY ts, event_id) AS ord
FROM (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY match_id, idx ORDER BY ts, event_id) = 1)"""
PARTS["objectives"] = """
SELECT match_id, event_id, t,
       CASE event_type WHEN 'purchase' THEN 'building' WHEN 'signup' THEN 'roshan' WHEN 'error' THEN 'aegis'
            ELSE 'courier' END AS kind,
       CASE WHEN event_type = 'purchase' THEN ['Radiant', 'Dire', '?'][k % 3 + 1] END AS victim,
       CASE WHEN event_type = 'purchase' THEN ['Dire', 'Radiant', '?'][k % 3 + 1] END AS attacker,
       CASE WHEN event_type = 'purchase' THEN ['throne', 'rax', 'tower', 'tower'][k % 4 + 1] END AS building,
       CASE WHEN event_type = 'purchase'
            THEN ['fort', 'melee_rax_top', 'tower1_mid', 'tower2_bot'][k % 4 + 1] END AS short,
       CASE WHEN event_type = 'purchase' AND k % 5 = 0 THEN CAST(k % 25 AS VARCHAR) END AS hero,
       CASE WHEN event_type = 'purchase' THEN k % 5 = 1 END AS by_creeps,
       CASE WHEN event_type IN ('signup', 'click') THEN CASE WHEN is_radiant THEN 'Radiant' ELSE 'Dire' END END AS side,
       event_type = 'click' AS minor FROM ev WHERE event_type <> 'view'"""
SOURCES = {"gold_per_min": "total_gold", "xp_per_min": "xp", "kills_per_min": "kills",
           "last_hits_per_min": "last_hits", "hero_damage_per_min": "hero_damage",
           "hero_healing_per_min": "hero_healing", "tower_damage": "tower_damage", "stuns_per_min": "seconds_dead"}
PARTS["metrics"] = " UNION ALL ".join(
    f"SELECT match_id, idx, '{m}' AS metric, {c} AS value FROM totals" for m, c in SOURCES.items())
PARTS["bench"] = "SELECT *, percent_rank() OVER (PARTITION BY metric ORDER BY value) AS pct FROM metrics"
PARTS["axes"] = table([(m, a, i) for i, (m, a) in enumerate(METRIC_AXIS.items())], "metric, axis, place")
PARTS["percentile"] = f"SELECT match_id, idx, metric, axis, place, {half('pct * 100')} AS pct FROM bench JOIN axes USING (metric)"


def chosen(options, step: int) -> str:
    return f"{items(options)}[CAST(uid // {step} % {len(options)} AS BIGINT) + 1]"


PARTS["requests"] = f"""
SELECT match_id, idx, {chosen(DEPTHS, 1)} AS depth, {chosen(FOCUSES, 1)} AS focus,
       CASE WHEN uid % 3 = 0 THEN {chosen(ROLES, 3)} END AS role, {chosen(MODELS, 2)} AS model,
       uid % 4 = 1 AS has_window, uid % 5 = 2 AS has_note, uid % 6 = 0 AS has_mmr FROM lanes"""
PARTS["inferred"] = f"""
SELECT *, CASE WHEN position IN {ROLES} THEN position END AS own_role FROM players"""
PARTS["roles"] = """
SELECT i.*, coalesce(r.role, i.own_role) AS role, CASE WHEN r.role IS NOT NULL THEN 'selected'
       WHEN i.own_role IS NOT NULL THEN 'heuristic' ELSE 'auto' END AS role_source
FROM inferred i JOIN requests r USING (match_id, idx)"""
PARTS["kp"] = f"""
SELECT *, CASE WHEN team_kills > 0 THEN least(100, {half('100 * (kills + assists) / CAST(team_kills AS DOUBLE)')})
               ELSE 0 END AS kp
FROM (SELECT *, CAST(sum(kills) OVER (PARTITION BY match_id, is_radiant) AS BIGINT) AS team_kills FROM players)"""
PARTS["windows"] = """
SELECT match_id, match_id % 20 AS lo_m, match_id % 20 + 5 AS hi_m, match_id % 20 * 86400 AS lo,
       (match_id % 20 + 5) * 86400 AS hi FROM matches"""
PARTS["item_dim"] = table([(k, n, c, q, items(p)) for k, n, c, q, p in ITEM_ROWS], "key, dname, cost, qual, comps")
PARTS["moves"] = """
SELECT e.event_id, match_id, idx, ts, t, event_type AS key, event_type AS part, 1 AS d, 1 AS phase, 0 AS ordinal FROM ev e
UNION ALL
SELECT e.event_id, match_id, idx, ts, t, event_type, i.comps[n.i], -1, 0, n.i
FROM ev e JOIN item_dim i ON i.key = e.event_type JOIN range(1, 9) n(i) ON n.i <= len(i.comps)"""
# Stack matching with explicit depth: a push is taken when the next move on its depth is a pop.
PARTS["depths"] = """
SELECT *, s - least(0, min(s) OVER (PARTITION BY match_id, idx, part ORDER BY ts, event_id, phase, ordinal)) AS depth
FROM (SELECT *, sum(d) OVER (PARTITION BY match_id, idx, part ORDER BY ts, event_id, phase, ordinal) AS s FROM moves)"""
PARTS["levels"] = """
SELECT *, CASE WHEN d = 1 THEN depth ELSE before END AS level
FROM (SELECT *, lag(depth, 1, 0) OVER (PARTITION BY match_id, idx, part ORDER BY ts, event_id, phase, ordinal) AS before
      FROM depths) WHERE d = 1 OR before > 0"""
PARTS["absorbed"] = """
SELECT event_id, match_id, idx, ts, t, key, coalesce(next_d = -1, false) AS absorbed
FROM (SELECT *, lead(d) OVER (PARTITION BY match_id, idx, part, level ORDER BY ts, event_id, phase, ordinal) AS next_d
      FROM levels) WHERE d = 1"""
PARTS["assembled"] = """
SELECT a.*, i.dname AS item, i.cost FROM absorbed a JOIN item_dim i USING (key)
WHERE NOT absorbed AND i.qual <> 'consumable'"""
PARTS["paced"] = """
SELECT b.*, p.gpm, t / 60e0 AS actual, sum(b.cost) OVER (PARTITION BY b.match_id, b.idx ORDER BY ts, event_id)
       / CAST(p.gpm AS DOUBLE) AS expected
FROM assembled b JOIN players p USING (match_id, idx) WHERE p.gpm > 0 AND b.cost > 0"""
PARTS["lags"] = """
SELECT *, actual - expected AS lag, median(actual - expected) OVER (PARTITION BY match_id, idx) AS base,
       count(*) OVER (PARTITION BY match_id, idx) AS n FROM paced"""
PARTS["late"] = f"""
SELECT *, {clamp(f'(lag - base) / {P.lag_scale}e0')} AS severity,
       row_number() OVER (PARTITION BY match_id, idx ORDER BY {clamp(f'(lag - base) / {P.lag_scale}e0')} DESC, ts, event_id) AS ord
FROM lags WHERE n >= 3 AND cost >= {P.lag_min_cost} AND lag - base >= {P.lag_minutes}e0
  AND actual >= expected * {P.lag_factor}e0 QUALIFY ord <= {P.max_lags}"""
PARTS["swings"] = """
SELECT match_id, is_radiant, m, gold, CASE WHEN gold > 0 THEN 'ahead' ELSE 'behind' END AS swing
FROM (SELECT *, last_value(CASE WHEN gold <> 0 THEN sign(gold) END IGNORE NULLS) OVER (
        PARTITION BY match_id, is_radiant ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
      FROM sided) WHERE gold <> 0 AND sign(gold) <> before"""
PARTS["incomes"] = """
SELECT *, avg(delta) OVER (PARTITION BY match_id, idx) AS mean
FROM (SELECT *, gold - lag(gold) OVER (PARTITION BY match_id, idx ORDER BY m) AS delta FROM minutes)"""
PARTS["low_runs"] = f"""
SELECT match_id, idx, min(m) AS start, max(m) AS "end", count(*) AS n, sum(delta) AS span, any_value(mean) AS mean
FROM (SELECT *, m - row_number() OVER (PARTITION BY match_id, idx ORDER BY m) AS run FROM incomes
      WHERE m >= {P.stall_from} AND mean > 0 AND delta < mean * {P.stall_ratio}e0) GROUP BY match_id, idx, run"""
PARTS["stalls"] = f"""
SELECT match_id, idx, start, "end", {half('span / CAST(n AS DOUBLE)')} AS rate, {half('mean')} AS average
FROM low_runs WHERE n >= {P.stall_length} QUALIFY row_number() OVER (PARTITION BY match_id, idx ORDER BY n DESC, start) = 1"""


def cluster(source: str) -> str:
    return f"""
SELECT match_id, idx, n, start, "end", total
FROM (SELECT match_id, idx, t AS "end", count(*) OVER w AS n, min(t) OVER w AS start,
             count(*) OVER (PARTITION BY match_id, idx) AS total FROM {source}
      WINDOW w AS (PARTITION BY match_id, idx ORDER BY t RANGE BETWEEN {P.cluster_span} PRECEDING AND CURRENT ROW))
WHERE n >= {P.cluster_min} QUALIFY row_number() OVER (PARTITION BY match_id, idx ORDER BY n DESC, "end") = 1"""


PARTS["errors"] = "SELECT match_id, idx, t FROM ev WHERE event_type = 'error'"
PARTS["clusters"] = cluster("deaths")
PARTS["drops"] = f"""
SELECT match_id, is_radiant, m AS start, m + {P.collapse_window} AS "end", -change AS loss
FROM (SELECT *, lead(gold, {P.collapse_window}) OVER (PARTITION BY match_id, is_radiant ORDER BY m) - gold AS change
      FROM sided) WHERE change IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY match_id, is_radiant ORDER BY change, m) = 1 AND loss >= {P.collapse_loss}"""
PARTS["typical"] = """
SELECT p.match_id, p.idx, p.seconds_dead, (SELECT median(o.seconds_dead) FROM players o
       WHERE o.match_id = p.match_id AND o.idx <> p.idx AND o.seconds_dead <> 0) AS typical FROM players p"""
PARTS["facing"] = f"""
SELECT p.match_id, p.idx, p.lane_eff, {half('median(o.lane_eff)')} AS theirs FROM players p
JOIN players o ON o.match_id = p.match_id AND o.is_radiant <> p.is_radiant AND o.lane = p.lane
WHERE p.lane_eff IS NOT NULL AND o.lane_eff IS NOT NULL GROUP BY ALL"""


def filled(key: str, values: dict[str, str]) -> str:
    out = text(TEMPLATES[key])
    for name, sql in values.items():
        out = f"replace({out}, '{{{name}}}', CAST({sql} AS VARCHAR))"
    return out


def detector(no: int, rnk: str, keys: dict[str, str], axis: str, severity: str, values: dict[str, str], rest: str) -> str:
    """One detector: ``keys`` maps a condition (or 'true') to the key it yields."""
    joined = " || ';' || ".join(f"'{n}=' || CAST({v} AS VARCHAR)" for n, v in sorted(values.items()))
    case = " ".join(f"WHEN {c} THEN {text(k)}" for c, k in keys.items())
    words = " ".join(f"WHEN {c} THEN {filled(k, values)}" for c, k in keys.items())
    return (f"SELECT match_id, idx, {big(no)} AS det_no, {big(rnk)} AS rnk, CASE {case} END AS key, {axis} AS axis, "
            f"{clamp(severity)} AS severity, {joined} AS params, CASE {words} END AS text {rest}")


PARTS["det1"] = detector(1, "ord", {"true": "item_lag"}, "'build'", "severity",
                         {"item": "item", "at": clock("t"), "excess": half("lag - base"), "gpm": "gpm",
                          "expected": clock("CAST(floor((expected + base) * 60) AS BIGINT)")}, "FROM late")
PARTS["edges"] = f"""
SELECT *, pct <= {P.pct_low} AS low, {clamp(f'CASE WHEN pct <= {P.pct_low} THEN 0.45e0 + ({P.pct_low} - pct) / 30e0 '
                                            f'ELSE 0.25e0 + (pct - {P.pct_high}) / 60e0 END')} AS severity
FROM percentile WHERE pct <= {P.pct_low} OR pct >= {P.pct_high}"""
PARTS["ranked"] = "SELECT *, row_number() OVER (PARTITION BY match_id, idx, low ORDER BY severity DESC, place) AS n FROM edges"
PARTS["det2"] = detector(2, f"n + CASE WHEN low THEN 0 ELSE {P.max_low} END", {"low": "bench_low", "true": "bench_high"},
                         "axis", "severity", {"metric": "metric", "pct": "pct"},
                         f"FROM ranked WHERE n <= CASE WHEN low THEN {P.max_low} ELSE {P.max_high} END")
PARTS["ends"] = """
SELECT match_id, idx, first(metric ORDER BY pct DESC, place) AS hi, max(pct) AS hi_pct,
       first(metric ORDER BY pct, place) AS lo, min(pct) AS lo_pct FROM percentile GROUP BY ALL"""
PARTS["det3"] = detector(3, "1", {"true": "bench_spread"}, "'fights'", f"0.3e0 + (hi_pct - lo_pct - {P.pct_spread}) / 50e0",
                         {"high_metric": "hi", "high": "hi_pct", "low_metric": "lo", "low": "lo_pct"},
                         f"FROM ends WHERE hi_pct - lo_pct >= {P.pct_spread}")
PARTS["det4"] = detector(4, "1", {"true": "farm_stall"}, "'farm'", '0.3e0 + ("end" - start) / 12e0',
                         {"start": "start", "end": '"end"', "rate": "rate", "average": "average"}, "FROM stalls")
PARTS["det5"] = detector(5, "1", {"true": "death_cluster"}, "'position'", f"0.35e0 + (n - {P.cluster_min}) / 5e0",
                         {"count": "n", "start": clock("start"), "end": clock('"end"'), "total": "total"}, "FROM clusters")
PARTS["det6"] = detector(6, "1", {"true": "dead_share"}, "'position'", "0.3e0 + seconds_dead / CAST(duration AS DOUBLE)",
                         {"dead": clock("seconds_dead"), "pct": half("seconds_dead / CAST(duration AS DOUBLE) * 100"),
                          "typical": clock("CAST(floor(typical) AS BIGINT)")},
                         f"""FROM typical JOIN matches USING (match_id)
WHERE duration > 0 AND seconds_dead > 0 AND seconds_dead / CAST(duration AS DOUBLE) >= {P.dead_share}e0
  AND seconds_dead >= typical * {P.dead_factor}e0""")
PARTS["det7"] = detector(7, "1", {"lane_eff > theirs": "lane_gap_ahead", "true": "lane_gap_behind"}, "'lane'",
                         "0.3e0 + abs(lane_eff - theirs) / 60e0",
                         {"mine": "lane_eff", "theirs": "theirs", "gap": "abs(lane_eff - theirs)"},
                         f"FROM facing WHERE abs(lane_eff - theirs) >= {P.lane_gap}")
PARTS["det8"] = detector(8, "1", {f"kp <= {P.kp_low}": "kp_low", "true": "kp_high"}, "'fights'",
                         "0.3e0 + abs(kp - 60) / 60e0",
                         {"pct": "kp", "kills": "kills", "assists": "assists", "team_kills": "team_kills"},
                         f"FROM kp WHERE team_kills > 0 AND (kp <= {P.kp_low} OR kp >= {P.kp_high})")
PARTS["det9"] = detector(9, "1", {"true": "gold_collapse"}, "'fights'", f"0.35e0 + loss / {P.collapse_scale}e0",
                         {"start": "start", "end": '"end"', "gold": "loss"},
                         "FROM players JOIN drops USING (match_id, is_radiant)")


def top(parts: str) -> str:
    union = " UNION ALL ".join(f"SELECT * FROM {d}" for d in parts.split())
    return f"""
SELECT *, row_number() OVER (PARTITION BY match_id, idx ORDER BY severity DESC, det_no, rnk) AS ord
FROM ({union}) QUALIFY ord <= {P.max_deviations}"""


PARTS["devs"] = top("det1 det2 det3 det4 det5 det6 det7 det8 det9")
PARTS["sample"] = """
SELECT idx AS account_id, match_id, idx, row_number() OVER (PARTITION BY idx ORDER BY match_id DESC) AS rec_no
FROM players QUALIFY rec_no <= 10 + idx"""
PARTS["digest"] = """
SELECT s.account_id, s.rec_no, s.match_id, s.idx, k.hero_name AS hero, k.position AS role,
       k.is_radiant = m.radiant_win AS win, m.duration, k.kills, k.deaths, k.assists, k.gpm, k.xpm, c.lh AS cs10,
       k.net_worth, k.kp, k.lane_eff, m.patch, m.parsed
FROM sample s JOIN kp k ON k.match_id = s.match_id AND k.idx = s.idx JOIN matches m ON m.match_id = s.match_id
LEFT JOIN minutes c ON c.match_id = s.match_id AND c.idx = s.idx AND c.m = 10"""
PARTS["changes"] = f"""
SELECT match_id, is_radiant, m AS start,
       coalesce(lead(gold, {P.stage_step}) OVER w, last_value(gold) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) - gold AS change
FROM sided WINDOW w AS (PARTITION BY match_id, is_radiant ORDER BY m)
QUALIFY m % {P.stage_step} = 0 AND m < least(max(m) OVER (PARTITION BY match_id), {P.stage_last})"""
PARTS["stages"] = f"""
SELECT s.account_id, c.start, least(c.start + {P.stage_step}, {P.stage_last}) AS "end", {half('avg(c.change)')} AS change,
       count(*) AS samples
FROM sample s JOIN players p ON p.match_id = s.match_id AND p.idx = s.idx
JOIN changes c ON c.match_id = s.match_id AND c.is_radiant = p.is_radiant GROUP BY s.account_id, c.start"""

# --- queries ----------------------------------------------------------------------------------

QUERIES["scan_events"] = "SELECT event_id, user_id, event_type, cents, k FROM ev"
QUERIES["latest_version_per_key"] = """
SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (
  PARTITION BY o_custkey ORDER BY o_orderstatus = 'F' DESC, o_orderdate DESC, o_orderkey DESC) = 1"""
QUERIES["upserted_versions"] = QUERIES["latest_version_per_key"]
QUERIES["recent_n_per_account"] = """
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rec_no
FROM orders QUALIFY rec_no <= 5"""
QUERIES["explode_props"] = "SELECT event_id, 'k' AS key, k AS val FROM ev"
QUERIES["explode_series"] = """
SELECT vec_id, CAST(i AS BIGINT) AS pos, CAST(embedding[i + 1] AS DOUBLE) AS val
FROM embeddings, unnest(range(len(embedding))) r(i)"""
QUERIES["player_projection"] = """
SELECT match_id, idx, hero_name, is_radiant, kills, deaths, assists, last_hits, denies, gpm, xpm, net_worth,
       damage_taken, seconds_dead, lane_eff FROM players"""
QUERIES["net_worth_fallback"] = """
SELECT t.match_id, t.idx, CASE WHEN t.idx % 3 = 0 THEN 0 ELSE total_gold END AS net_worth_final,
       CASE WHEN t.idx % 3 = 0 OR total_gold = 0 THEN m.gold ELSE total_gold END AS net_worth
FROM totals t JOIN minutes m ON m.match_id = t.match_id AND m.idx = t.idx
QUALIFY m.m = max(m.m) OVER (PARTITION BY t.match_id)"""
QUERIES["assign_positions"] = "SELECT match_id, idx, lane_key, is_core, position FROM players"
QUERIES["classify_events"] = "SELECT * FROM objectives"
QUERIES["major_events"] = "SELECT match_id, event_id, t, kind FROM objectives WHERE NOT minor"
QUERIES["early_events"] = f"SELECT event_id, match_id, idx, t FROM ev WHERE t <= {P.lane_phase}"
QUERIES["early_late_times"] = f"""
SELECT match_id, killer AS idx, 'early_kill' AS kind, t FROM kills WHERE t BETWEEN 0 AND {P.early_kills_until}
UNION ALL SELECT match_id, idx, 'late_death', t FROM deaths WHERE t >= {P.late_deaths_from}"""
QUERIES["first_per_key"] = """
SELECT match_id, idx, event_type AS key, t FROM ev WHERE event_type IN ('purchase', 'signup', 'view')
QUALIFY row_number() OVER (PARTITION BY match_id, idx, event_type ORDER BY ts, event_id) = 1"""
QUERIES["kill_participation"] = "SELECT match_id, idx, kills, assists, team_kills, kp FROM kp"
QUERIES["scoreboard"] = """
SELECT match_id, idx, hero_name, is_radiant, level AS lvl, kills || '/' || deaths || '/' || assists AS kda,
       last_hits || '/' || denies AS lh_dn, gpm || '/' || xpm AS gpm_xpm, net_worth AS nw, hero_damage AS hd,
       tower_damage AS td, hero_healing AS heal, damage_taken AS dt FROM players"""
PARTS["meta"] = f"""
SELECT match_id, idx, patch, mode, lobby, {clock('duration')} AS duration, is_radiant = radiant_win AS win,
       CASE WHEN is_radiant THEN 'Radiant' ELSE 'Dire' END AS my_side,
       CASE WHEN radiant_win THEN 'Radiant' ELSE 'Dire' END AS winner, hero_name, position, lane_key, level, kills,
       deaths, assists, parsed FROM players JOIN matches USING (match_id)"""
QUERIES["match_meta"] = "SELECT * FROM meta"
QUERIES["combat_counters"] = f"""
SELECT match_id, idx, kills + level + 1 AS best_streak, level + 2 AS best_multikill, {half('stuns', 1)} AS stuns_sec,
       level AS camps_stacked, denies AS runes, kills AS obs, deaths AS sen, assists % 3 AS buybacks,
       {clock('seconds_dead')} AS time_dead, last_hits AS neutral_kills, level % 4 AS ancient_kills,
       kills % 3 AS tower_kills, kills % 2 AS roshan_kills, level % 2 AS courier_kills, deaths % 3 AS observer_kills,
       deaths % 2 AS sentry_kills, xpm AS apm, denies AS pings,
       CASE WHEN hero_damage <> 0 THEN hero_damage || ' on ' || idx END AS max_hit FROM players"""
PARTS["early_count"] = f"""
SELECT match_id, killer AS idx, count(*) AS n FROM kills WHERE t BETWEEN 0 AND {P.early_kills_until} GROUP BY 1, 2"""
PARTS["involvement"] = """
SELECT match_id, idx, count(*) FILTER (deaths <> 0 OR damage <> 0 OR healing <> 0) AS involved,
       CAST(sum(deaths) AS BIGINT) AS fight_deaths FROM fight_players GROUP BY 1, 2"""
ROLE_VALUES = {
    "cs10": "c.lh", "gpm": "r.gpm", "networth": "r.net_worth", "hero_damage": "r.hero_damage",
    "kill_participation": "k.kp", "xpm": "r.xpm", "early_kills": "coalesce(e.n, 0)", "damage_taken": "r.damage_taken",
    "stuns": half("r.stuns", 1), "fight_involvement": "coalesce(i.involved, 0)",
    "fight_deaths": "coalesce(i.fight_deaths, 0)", "assists": "r.assists", "healing": "r.hero_healing"}
PARTS["role_lists"] = table([(r, i, m) for r, ms in ROLE_METRICS.items() for i, m in enumerate(ms, 1)], "role, ord, metric")
QUERIES["role_metrics"] = f"""
SELECT r.match_id, r.idx, r.role, {big('l.ord')} AS ord, l.metric,
       CASE l.metric {' '.join(f"WHEN '{m}' THEN CAST({v} AS VARCHAR)" for m, v in ROLE_VALUES.items())} END AS value
FROM roles r JOIN role_lists l ON l.role = r.role JOIN kp k ON k.match_id = r.match_id AND k.idx = r.idx
LEFT JOIN minutes c ON c.match_id = r.match_id AND c.idx = r.idx AND c.m = 10
LEFT JOIN early_count e ON e.match_id = r.match_id AND e.idx = r.idx
LEFT JOIN involvement i ON i.match_id = r.match_id AND i.idx = r.idx"""
PARTS["bench_lists"] = table([(r, i, m) for r, ms in {**ROLE_BENCH, "-": GENERAL_BENCH}.items()
                              for i, m in enumerate(ms, 1)], "role, ord, metric")
PARTS["bench_rows"] = f"""
SELECT p.match_id, p.idx, {big('l.ord')} AS ord, l.metric, {half('b.value', 1)} AS raw, {half('b.pct * 100')} AS pct
FROM inferred p JOIN bench_lists l ON l.role = coalesce(p.own_role, '-')
JOIN bench b ON b.match_id = p.match_id AND b.idx = p.idx AND b.metric = l.metric"""
QUERIES["benchmark_rows"] = "SELECT * FROM bench_rows"
QUERIES["full_log"] = f"""
SELECT match_id, idx, row_number() OVER (PARTITION BY match_id, idx ORDER BY ts, event_id) AS pos, event_id,
       {clock('t')} AS at, i.dname AS item FROM ev JOIN item_dim i ON i.key = ev.event_type"""
QUERIES["role_items"] = f"""
SELECT match_id, idx, a.key, a.t, p.own_role AS role, 'key_items' AS kind FROM assembled a JOIN inferred p USING (match_id, idx)
WHERE p.own_role IN ('1', '2') AND a.cost >= {P.own_item_cost}
UNION ALL
SELECT match_id, idx, event_type, t, p.own_role, 'utility_items'
FROM (SELECT * FROM ev WHERE event_type IN ('purchase', 'view')
      QUALIFY row_number() OVER (PARTITION BY match_id, idx, event_type ORDER BY ts, event_id) = 1)
JOIN (SELECT match_id, idx, own_role FROM inferred) p USING (match_id, idx) WHERE p.own_role IN ('3', '4', '5')"""
QUERIES["fight_involvement"] = "SELECT * FROM involvement"
QUERIES["clock_text"] = f"""
SELECT event_id, {clock('(t - 86400)')} AS clock,
       CASE WHEN k > 50 THEN '+' ELSE '' END || (k - 50) AS signed,
       CASE WHEN k > 50 THEN '★ ' ELSE '' END || CASE WHEN is_radiant THEN '[R] ' ELSE '[D] ' END || event_type AS tag FROM ev"""
QUERIES["strip_tokens"] = r"""
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(
         '+{s:bonus_' || source || '}% ' || text || ' -{d:value}s slow, {s:other}s',
         '[+-]?\{[sfvd]:[^}]*\}(%|s(\s|$))?', ' \2', 'g'), '\s{2,}', ' ', 'g'), '^\s+|\s+$', '', 'g'), ' +-/,') AS name
FROM documents"""
QUERIES["squeeze_text"] = r"""
SELECT conv_id, turn, nullif(trim(regexp_replace(text, '\s+', ' ', 'g')), '') AS text FROM conversations"""
QUERIES["prettify_names"] = """
SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '),
       lambda w: upper(w[1]) || lower(w[2:])), ' ') AS name FROM part"""
QUERIES["parse_ranges"] = """
SELECT event_id, CASE WHEN k % 4 < 2 THEN k END AS lo, CASE k % 4 WHEN 0 THEN m WHEN 1 THEN t END AS hi FROM ev"""
QUERIES["text_bytes"] = "SELECT doc_id, strlen(text) AS bytes FROM documents"
QUERIES["lookup_fallback"] = """
SELECT event_id, k, coalesce(n_name, 'hero_' || k) AS name FROM ev LEFT JOIN nation ON n_nationkey = k"""
QUERIES["lookup_cascade"] = """
SELECT event_id, k, CASE WHEN n_nationkey IS NULL THEN 'ability_' || k WHEN k % 2 = 0 THEN r_name
                         WHEN k % 3 = 0 THEN 'special_bonus_' || n_name ELSE n_name END AS ability,
       n_nationkey IS NOT NULL AND k % 3 = 0 AS talent
FROM ev LEFT JOIN nation ON n_nationkey = k LEFT JOIN region ON r_regionkey = n_regionkey"""
PARTS["asked"] = """
SELECT event_id AS request_id, match_id, CASE WHEN k % 3 > 0 THEN k % 13 END AS account_id,
       CASE WHEN k % 5 > 0 THEN 'ro_' || (k % 25) END AS needle FROM ev"""
PARTS["hits"] = """
SELECT a.request_id, a.match_id, min(p.idx) FILTER (p.account_id = a.account_id) AS by_account,
       min(p.idx) FILTER (contains(p.hero_name, a.needle)) AS by_hero
FROM asked a LEFT JOIN players p ON p.match_id = a.match_id GROUP BY 1, 2"""
QUERIES["resolve_focal"] = """
SELECT request_id, match_id, coalesce(by_account, by_hero) AS idx,
       CASE WHEN by_account IS NOT NULL THEN 'account' WHEN by_hero IS NOT NULL THEN 'hero' ELSE 'unresolved' END AS how
FROM hits"""
PARTS["names"] = """
SELECT lower(p_name) AS label, min(p_partkey) AS id FROM part GROUP BY p_name
UNION ALL SELECT lower(replace(n_name, '_', ' ')), CAST(n_nationkey + 1000000000 AS BIGINT) FROM nation"""
PARTS["needles"] = """
SELECT p_partkey AS request_id, CASE p_partkey % 3 WHEN 0 THEN upper(replace(p_name, ' ', '_'))
       WHEN 1 THEN split_part(p_name, ' ', 1) ELSE ' nation_' || (p_partkey % 30) END AS needle FROM part"""
QUERIES["resolve_name"] = """
SELECT request_id, needle, CASE WHEN count(id) FILTER (label = norm) > 0 THEN max(id) FILTER (label = norm)
       WHEN count(DISTINCT id) = 1 THEN min(id) END AS id
FROM (SELECT *, lower(trim(replace(needle, '_', ' '))) AS norm FROM needles)
LEFT JOIN names ON contains(label, norm) GROUP BY request_id, needle"""
QUERIES["opponents"] = """
SELECT p.match_id, p.idx, coalesce(string_agg(o.idx, ',' ORDER BY o.idx), '') AS opponents FROM players p
LEFT JOIN players o ON o.match_id = p.match_id AND o.is_radiant <> p.is_radiant GROUP BY 1, 2"""
QUERIES["lane_opponents"] = """
SELECT p.match_id, p.idx, coalesce(string_agg(o.idx, ',' ORDER BY o.idx), '') AS opponents FROM players p
LEFT JOIN players o ON o.match_id = p.match_id AND o.is_radiant <> p.is_radiant AND o.lane = p.lane GROUP BY 1, 2"""
QUERIES["death_times"] = "SELECT match_id, idx, t, killer FROM deaths"
QUERIES["early_deaths"] = f"""
SELECT k.match_id, k.victim AS idx, k.t, k.killer FROM kills k
JOIN players p ON p.match_id = k.match_id AND p.idx = k.victim WHERE k.t <= {P.lane_phase}"""
PARTS["sides"] = """
SELECT match_id, fight_no, CAST(sum(deaths) FILTER (is_radiant) AS BIGINT) AS r, CAST(sum(deaths) FILTER (NOT is_radiant) AS BIGINT) AS d,
       coalesce(string_agg(idx, ',' ORDER BY idx) FILTER (deaths > 0), '') AS fallen FROM fight_players GROUP BY 1, 2"""
PARTS["losses"] = """
SELECT p.match_id, p.idx, s.fight_no, s.fallen, coalesce(CASE WHEN p.is_radiant THEN r ELSE d END, 0) AS mine,
       coalesce(CASE WHEN p.is_radiant THEN d ELSE r END, 0) AS theirs FROM sides s JOIN players p USING (match_id)"""
QUERIES["fight_outcome"] = f"""
SELECT l.match_id, l.idx, l.fight_no, f.start, f."end", f.deaths, mine AS my_losses, theirs AS enemy_losses,
       CASE WHEN mine < theirs THEN 'win' WHEN mine > theirs THEN 'lose' ELSE 'even' END AS verdict, fallen,
       coalesce(x.deaths, 0) AS my_deaths, coalesce(x.damage, 0) AS my_damage, coalesce(x.gold_delta, 0) AS my_gold_delta,
       coalesce(x.xp_delta, 0) AS my_xp_delta, f.start <= {P.lane_phase} AS in_lane
FROM losses l JOIN fights f USING (match_id, fight_no) LEFT JOIN fight_players x USING (match_id, fight_no, idx)"""
QUERIES["fight_participants"] = """
SELECT match_id, fight_no, idx, deaths, damage, healing FROM fight_players WHERE deaths <> 0 OR damage <> 0"""
QUERIES["interval_overlap"] = """
SELECT match_id, fight_no, start, "end" FROM fights JOIN windows USING (match_id) WHERE "end" >= lo AND start <= hi"""
QUERIES["skip_missing"] = """
SELECT c_custkey AS account_id, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
       THEN 'kept' ELSE 'skipped' END AS status FROM customer"""
PARTS["ranked_picks"] = """
SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY ord) AS rank, count(*) OVER (PARTITION BY match_id) AS total
FROM picks WHERE is_pick"""


def others(same: bool, earlier: bool) -> str:
    return (f"coalesce(string_agg(o.hero_name, ',' ORDER BY o.rank) FILTER (o.is_radiant {'=' if same else '<>'} p.is_radiant "
            f"AND o.rank {'<' if earlier else '>'} p.rank), '')")


QUERIES["draft_my_pick"] = f"""
SELECT p.match_id, p.idx, p.rank AS "order", p.total,
       CASE WHEN p.rank = 1 THEN 'first' WHEN p.rank = p.total THEN 'last' ELSE 'mid' END AS tag,
       {others(False, True)} AS enemies_before, {others(True, True)} AS allies_before,
       {others(False, False)} AS enemies_after, {others(True, False)} AS allies_after
FROM ranked_picks p JOIN ranked_picks o ON o.match_id = p.match_id GROUP BY p.match_id, p.idx, p.rank, p.total"""
QUERIES["draft_chronological"] = """
SELECT match_id, coalesce(max(ord) FILTER (is_pick) > min(ord) FILTER (NOT is_pick), true) AS chronological
FROM picks GROUP BY match_id"""
QUERIES["roster"] = """
SELECT match_id, idx, CASE WHEN is_radiant THEN 'Radiant' ELSE 'Dire' END AS side, hero_name,
       coalesce(role, position) AS position, lane_key FROM roles"""
QUERIES["team_advantage"] = "SELECT match_id, m, gold FROM adv"
QUERIES["sign_swings"] = "SELECT * FROM swings"
QUERIES["top_swings"] = """
SELECT * FROM swings QUALIFY row_number() OVER (PARTITION BY match_id, is_radiant ORDER BY abs(gold) DESC, m) <= 8"""
QUERIES["peak_trough"] = """
SELECT match_id, is_radiant, first(m ORDER BY gold DESC, m) AS best_m, max(gold) AS best_gold,
       first(m ORDER BY gold, m) AS worst_m, min(gold) AS worst_gold FROM sided GROUP BY 1, 2"""
QUERIES["thin_series"] = "SELECT match_id, idx, m, gold FROM minutes QUALIFY m % 5 = 0 OR m = max(m) OVER (PARTITION BY match_id)"
QUERIES["longest_stall"] = "SELECT * FROM stalls"
QUERIES["densest_cluster"] = cluster("errors")
QUERIES["worst_drop"] = "SELECT * FROM drops"
QUERIES["early_grid"] = "SELECT match_id, idx, m, lh, dn, gold, xp FROM minutes WHERE m BETWEEN 1 AND 10"
QUERIES["absorb_components"] = "SELECT event_id, match_id, idx, key, absorbed FROM absorbed"
QUERIES["pace_lag"] = f"""
SELECT match_id, idx, ord, item, {clock('t')} AS at, {half('lag - base')} AS excess, gpm,
       CAST(floor((expected + base) * 60) AS BIGINT) AS expected, CAST(floor(severity * 1e6 + 0.5e0) AS BIGINT) AS severity FROM late"""
PARTS["dump"] = """
SELECT match_id, 'kill' AS kind, t, CAST(killer AS VARCHAR) AS who, 'npc_' || victim AS what
FROM kills JOIN windows USING (match_id) WHERE t BETWEEN lo AND hi
UNION ALL SELECT match_id, 'purchase', t, CAST(idx AS VARCHAR), event_type
FROM ev JOIN windows USING (match_id) WHERE t BETWEEN lo AND hi
UNION ALL SELECT match_id, 'fight', start, NULL, CAST(fight_no AS VARCHAR)
FROM fights JOIN windows USING (match_id) WHERE "end" >= lo AND start <= hi
UNION ALL SELECT match_id, 'objective', t, coalesce(side, attacker), kind
FROM objectives JOIN windows USING (match_id) WHERE t BETWEEN lo AND hi"""
QUERIES["window_dump"] = "SELECT * FROM dump"
QUERIES["window_series"] = """
SELECT match_id, idx, m, gold, xp, lh, dn FROM minutes JOIN windows USING (match_id) WHERE m BETWEEN lo_m AND hi_m"""
QUERIES["window_summary"] = """
SELECT w.match_id, count(*) FILTER (kind = 'kill') AS n_kill, count(*) FILTER (kind = 'purchase') AS n_purchase,
       count(*) FILTER (kind = 'fight') AS n_fight, count(*) FILTER (kind = 'objective') AS n_objective,
       count(kind) = 0 AS empty FROM windows w LEFT JOIN dump d ON d.match_id = w.match_id GROUP BY w.match_id"""
QUERIES["top_targets"] = """
SELECT match_id, idx, damage, 'npc_' || pos AS target, row_number() OVER (PARTITION BY match_id, idx ORDER BY damage DESC, pos) AS ord
FROM (SELECT match_id, idx, k % 10 AS pos, CAST(sum(cents) AS BIGINT) AS damage FROM ev WHERE event_type = 'purchase' GROUP BY 1, 2, 3)
QUALIFY ord <= 5"""
QUERIES["hero_damage"] = """
SELECT match_id, idx, 'npc_dota_hero_' || (k % 10) AS npc, CAST(sum(cents) AS BIGINT) AS damage FROM ev WHERE k % 3 = 0 GROUP BY 1, 2, 3"""
QUERIES["positive_stacks"] = """
SELECT event_id, match_id, idx, k % 4 AS stack_count, nullif(t % 7, 0) AS since FROM ev WHERE k % 4 > 0"""
QUERIES["pick_side"] = "SELECT event_id, k % 4 = 0 AS is_radiant FROM ev"
QUERIES["file_names"] = """
SELECT match_id, idx, match_id || '_' || idx || '_' || deaths || '.txt' AS of_match,
       'profile_' || idx || '_' || kills || '_' || match_id || '.txt' AS of_profile FROM totals"""
QUERIES["json_lines"] = """
SELECT event_id, '{"match_id":' || match_id || ',"idx":' || idx || ',"event_type":"' || event_type || '"}' AS line FROM ev"""
QUERIES["metric_percentiles"] = "SELECT metric, value, match_id, idx, pct FROM bench"
QUERIES["median_of_others"] = "SELECT * FROM typical"
for name, part in {"det_bench_edges": 2, "det_bench_spread": 3, "det_dead_share": 6, "det_lane_gap": 7, "det_kp": 8}.items():
    QUERIES[name] = f"SELECT match_id, idx, det_no, rnk, key, axis, severity, params FROM det{part}"
QUERIES["anomaly_topk"] = "SELECT match_id, idx, ord, det_no, key, axis, CAST(floor(severity * 1e6 + 0.5e0) AS BIGINT) AS severity, params FROM devs"
SAMPLE_ROLES = ["1", None, "2", "3", None, "4", "5", None, "1", None]
PARTS["wishes"] = table([(i, 20 if i == 9 else 4, r or "", ROLE_LANE.get(r, 0)) for i, r in enumerate(SAMPLE_ROLES)],
                        "account_id, n, role, lane_role")
PARTS["tried"] = """
SELECT p.account_id, p.match_id, p.idx, p.position, w.n, w.role, row_number() OVER (PARTITION BY p.account_id ORDER BY p.match_id DESC) AS tried
FROM players p JOIN wishes w ON w.account_id = p.account_id WHERE w.role = '' OR p.lane_role = w.lane_role
QUALIFY tried <= CASE WHEN w.role = '' THEN w.n ELSE 2 * w.n END"""
QUERIES["capped_sample"] = """
SELECT account_id, match_id, idx, row_number() OVER (PARTITION BY account_id ORDER BY tried) AS rec_no
FROM tried JOIN matches USING (match_id) WHERE parsed AND (role = '' OR position = role) QUALIFY rec_no <= n"""
QUERIES["hero_sample"] = """
SELECT account_id, match_id, idx, row_number() OVER (PARTITION BY account_id ORDER BY match_id DESC) AS rec_no
FROM players WHERE uid % 25 = account_id % 5 QUALIFY rec_no <= 4"""
QUERIES["match_digest"] = f"""
SELECT account_id, rec_no, d.match_id, hero, role, win, {clock('duration')} AS duration,
       kills || '/' || deaths || '/' || assists AS kda, gpm, xpm, cs10, net_worth, kp, lane_eff, parsed,
       coalesce((SELECT string_agg(DISTINCT v.axis, ',' ORDER BY v.axis) FROM devs v
                 WHERE v.match_id = d.match_id AND v.idx = d.idx), '') AS axes FROM digest d"""
QUERIES["profile_averages"] = f"""
SELECT account_id, count(*) AS matches, count(*) FILTER (win) AS wins, count(*) FILTER (NOT win) AS losses,
       {half('100 * count(*) FILTER (win) / CAST(count(*) AS DOUBLE)')} AS winrate, {half('avg(gpm)')} AS gpm,
       {half('avg(xpm)')} AS xpm, {half('avg(cs10)')} AS cs10, {half('avg(kills)', 1)} AS kills,
       {half('avg(deaths)', 1)} AS deaths, {half('avg(assists)', 1)} AS assists, max(deaths) AS deaths_max,
       {half('avg(kp)')} AS kp, {half('avg(lane_eff)')} AS lane_eff, {clock(half('avg(duration)'))} AS duration,
       {half('avg(net_worth)')} AS net_worth FROM digest GROUP BY account_id"""
PARTS["trend_rows"] = f"""
SELECT s.account_id, b.metric, {half('b.pct * 100')} AS pct, row_number() OVER (PARTITION BY s.account_id, b.metric ORDER BY s.rec_no) AS i,
       count(*) OVER (PARTITION BY s.account_id, b.metric) AS n
FROM sample s JOIN bench b ON b.match_id = s.match_id AND b.idx = s.idx WHERE b.metric IN {tuple(TREND_METRICS)}"""
PARTS["trend_sums"] = """
SELECT account_id, metric, avg(pct) AS mean, min(pct) AS low, max(pct) AS high, count(*) AS samples,
       avg(pct) FILTER (i <= greatest(1, n // 2)) - avg(pct) FILTER (i > greatest(1, n // 2)) AS delta
FROM trend_rows GROUP BY 1, 2"""
QUERIES["profile_trends"] = f"""
SELECT account_id, metric, {half('mean')} AS avg, low, high, CASE WHEN samples < {P.trend_min_series} OR abs(delta) < {P.trend_min_delta} THEN 'flat'
       WHEN delta > 0 THEN 'up' ELSE 'down' END AS direction, {half('abs(delta)')} AS delta, samples
FROM trend_sums WHERE samples >= {P.min_matches}"""
PARTS["seen"] = """
SELECT s.account_id, s.rec_no, s.match_id, v.ord, v.key, v.axis, v.params,
       row_number() OVER (PARTITION BY s.account_id, v.key ORDER BY s.rec_no, v.ord) AS i
FROM devs v JOIN sample s ON s.match_id = v.match_id AND s.idx = v.idx"""
PARTS["sizes"] = "SELECT account_id, count(*) AS total FROM sample GROUP BY 1"
PARTS["found"] = """
SELECT account_id, key, count(DISTINCT match_id) AS count, last(axis ORDER BY rec_no, ord) AS axis,
       string_agg(params, ' / ' ORDER BY i) FILTER (i <= 2) AS examples FROM seen GROUP BY 1, 2"""
QUERIES["profile_patterns"] = f"""
SELECT account_id, key, axis, count, total, {half('100 * count / CAST(total AS DOUBLE)')} AS share, examples
FROM found JOIN sizes USING (account_id)
WHERE total >= {P.min_matches} AND count >= greatest({P.pattern_min}, {half(f'{P.pattern_share}e0 * total')})"""
QUERIES["stage_profile"] = "SELECT * FROM stages"
PARTS["covered"] = "SELECT *, max(samples) OVER (PARTITION BY account_id) AS coverage FROM stages"
PARTS["fair"] = f"""
SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY change, start) AS worst,
       row_number() OVER (PARTITION BY account_id ORDER BY change DESC, start) AS best
FROM covered WHERE coverage >= {P.stage_min_samples}
  AND samples >= greatest({P.stage_min_samples}, {half('coverage / 2e0')})"""
QUERIES["stage_verdict"] = f"""
SELECT c.account_id, c.coverage, c.coverage < {P.stage_min_samples} AS thin,
       coalesce(string_agg(f.start || '-' || f."end", ',' ORDER BY f.worst) FILTER (f.worst <= {P.max_weak_stages} AND f.change < 0), '') AS weak,
       max(f.start) FILTER (f.best = 1 AND f.change > 0) AS strong_start,
       max(f.change) FILTER (f.best = 1 AND f.change > 0) AS strong_change
FROM (SELECT DISTINCT account_id, coverage FROM covered) c LEFT JOIN fair f ON f.account_id = c.account_id GROUP BY 1, 2"""
QUERIES["hero_mix"] = """
SELECT account_id, hero, games, wins, row_number() OVER (PARTITION BY account_id ORDER BY games DESC, seen) AS ord
FROM (SELECT account_id, hero, count(*) AS games, count(*) FILTER (win) AS wins, min(rec_no) AS seen FROM digest GROUP BY 1, 2)"""
PARTS["profile_asks"] = """
SELECT a.account_id, r.request_id, CASE WHEN r.request_id = 1 THEN 10 + a.account_id WHEN a.account_id % 2 = 0 THEN 20 ELSE 2 END AS n
FROM (SELECT DISTINCT idx AS account_id FROM ev) a, (VALUES (1), (2)) r(request_id)
UNION ALL SELECT DISTINCT 99, 3, 20 FROM ev WHERE idx = 9"""
PARTS["by_recency"] = """
SELECT account_id, position, patch, parsed, row_number() OVER (PARTITION BY account_id ORDER BY p.match_id DESC) AS rk
FROM players p JOIN matches m ON m.match_id = p.match_id"""
QUERIES["sample_caveats"] = f"""
SELECT a.account_id, a.request_id, a.n AS requested, count(r.rk) AS analyzed, count(*) FILTER (NOT parsed) AS unparsed,
       nullif(nullif(count(DISTINCT position) FILTER (position IN {ROLES}), 1), 0) AS mixed_roles,
       CASE WHEN count(DISTINCT patch) > 1 THEN string_agg(DISTINCT patch, ', ' ORDER BY patch) END AS patches,
       CASE WHEN count(r.rk) = 0 THEN 'empty' WHEN count(*) FILTER (NOT parsed) > 0 THEN 'unparsed'
            WHEN count(r.rk) < a.n THEN 'short' END AS warning
FROM profile_asks a LEFT JOIN by_recency r ON r.account_id = a.account_id AND r.rk <= a.n GROUP BY a.account_id, a.request_id, a.n"""


def nth(options, at: str) -> str:
    return f"{items(options)}[CAST({at} AS BIGINT) + 1]"


PARTS["wide_asked"] = f"""
SELECT event_id AS request_id, k, event_type, {nth(['quick', 'deep', 'huge'], 'k % 3')} AS depth,
       {nth([*FOCUSES, 'other'], 'k % 10')} AS focus, {nth([None, '1', '2', '3', '4', '5', '9'], 'k % 7')} AS role,
       {nth([*MODELS, 'other'], 'k // 10 % 4')} AS model, k // 3 % 6 AS w FROM ev"""
QUERIES["validate_requests"] = f"""
SELECT request_id, depth, focus, role, model, CASE WHEN k % 4 = 3 THEN 'ru' ELSE {nth(LANGUAGES, 'k % 4')} END AS lang,
       CAST([NULL, 5, 7, 10, NULL, NULL][w + 1] AS BIGINT) AS start, CAST([NULL, 10, 9, 5, NULL, NULL][w + 1] AS BIGINT) AS "end",
       CASE WHEN k % 5 > 0 THEN event_type END AS note, k || ' mmr' AS mmr,
       CASE role {' '.join(f"WHEN '{r}' THEN '{','.join(f)}'" for r, f in ROLE_FOCUSES.items())} END AS suggested,
       CASE WHEN depth = 'huge' THEN 'depth' WHEN focus = 'other' THEN 'focus' WHEN role = '9' THEN 'role'
            WHEN w = 4 THEN 'window_text' WHEN w = 3 THEN 'window_order' WHEN model = 'other' THEN 'model' END AS problem
FROM wide_asked"""
QUERIES["effective_role"] = "SELECT match_id, idx, position, role, role_source FROM roles"
PARTS["base_levels"] = table([(s, q, d) for s, (q, d) in SECTION_BASE.items()] + [("window", 0, 0)], "section, quick, deep")
PARTS["focus_levels"] = table([(f, k, v) for f, levels in FOCUS_LEVELS.items() for k, v in levels.items()],
                              "focus, section, lvl")
PARTS["section_level"] = """
SELECT r.match_id, r.idx, r.depth, r.focus, r.has_window, b.section, CAST(CASE
         WHEN b.section = 'window' THEN CASE WHEN r.has_window THEN 3 ELSE 0 END
         WHEN r.has_window AND b.section <> 'anomalies'
         THEN least(1, coalesce(f.lvl, CASE r.depth WHEN 'deep' THEN b.deep ELSE b.quick END))
         ELSE coalesce(f.lvl, CASE r.depth WHEN 'deep' THEN b.deep ELSE b.quick END) END AS BIGINT) AS level
FROM requests r CROSS JOIN base_levels b LEFT JOIN focus_levels f ON f.focus = r.focus AND f.section = b.section"""
QUERIES["section_levels"] = "SELECT * FROM section_level"
RULES = [(key, need or "") for key, need in MATCH_RULES]
PARTS["rules"] = table([(i, k, n) for i, (k, n) in enumerate(RULES)], "place, rule, need")
QUERIES["rule_list"] = """
SELECT match_id, idx, CASE WHEN u.rule = 'role' THEN 'role.' || r.role ELSE u.rule END AS rule,
       row_number() OVER (PARTITION BY match_id, idx ORDER BY place) AS n FROM requests r CROSS JOIN rules u
WHERE need = '' OR (need = 'note' AND has_note) OR (need = 'role' AND role IS NOT NULL) OR (need = 'mmr' AND has_mmr)"""
PARTS["entries"] = "SELECT DISTINCT lang, source || ':' || (n_chars // 200) AS key FROM documents"
QUERIES["missing_templates"] = """
SELECT e.key, l.lang FROM entries e CROSS JOIN (VALUES ('de'), ('es'), ('fr')) l(lang)
WHERE e.lang = 'en' AND NOT EXISTS (SELECT 1 FROM entries o WHERE o.key = e.key AND o.lang = l.lang)"""
QUERIES["render_templates"] = f"""
SELECT match_id, idx, ord, {nth(LANGUAGES, 'idx % 3')} AS lang, key,
       CASE WHEN {nth(LANGUAGES, 'idx % 3')} = 'en' THEN text ELSE '[' || key || '?]' END AS text FROM devs"""
PARTS["some_devs"] = top("det6 det7 det8")
PARTS["top_swing"] = """
SELECT * FROM swings QUALIFY row_number() OVER (PARTITION BY match_id, is_radiant ORDER BY abs(gold) DESC, m) <= 8"""
PARTS["limits"] = table([(1, "series have one point per minute"), (2, "positions are inferred from lane and net worth"),
                         (3, "the replay is not parsed")], "ord, line")
PARTS["lines"] = """
SELECT match_id, idx, 'meta' AS section, 1 AS ord, concat_ws(' | ', match_id, patch, mode, lobby, duration,
       CASE WHEN win THEN 'won' ELSE 'lost' END, my_side, hero_name, position || '/' || lane_key) AS line FROM meta
UNION ALL SELECT match_id, idx, 'scoreboard', idx, concat_ws(' | ', '★ ' || CASE WHEN is_radiant THEN '[R] ' ELSE '[D] ' END || hero_name,
       level, kills || '/' || deaths || '/' || assists, last_hits || '/' || denies, gpm || '/' || xpm, net_worth, hero_damage,
       tower_damage, hero_healing, damage_taken) FROM players
UNION ALL SELECT match_id, idx, 'anomalies', ord, '- [' || axis || '] ' || text FROM some_devs
UNION ALL SELECT p.match_id, p.idx, 'networth', s.m, 'm' || lpad(CAST(s.m AS VARCHAR), 2, ' ') || ': ' || swing || ', '
       || CASE WHEN gold > 0 THEN '+' ELSE '' END || gold FROM players p JOIN top_swing s USING (match_id, is_radiant)
UNION ALL SELECT match_id, idx, 'benchmarks', ord, metric || ' ' || coalesce(CAST(pct AS VARCHAR), '?') FROM bench_rows
UNION ALL SELECT p.match_id, p.idx, 'limits', l.ord, l.line FROM players p JOIN matches m USING (match_id) CROSS JOIN limits l
WHERE l.ord < 3 OR NOT m.parsed"""
QUERIES["format_lines"] = "SELECT match_id, idx, section, CAST(ord AS BIGINT) AS ord, line FROM lines"
PARTS["shown"] = """
SELECT l.*, s.level FROM lines l JOIN (SELECT match_id, idx, section, level FROM section_level WHERE level > 0
  UNION ALL SELECT match_id, idx, 'limits', 1 FROM requests) s USING (match_id, idx, section)"""
QUERIES["gated_sections"] = "SELECT match_id, idx, section, CAST(level AS BIGINT) AS level, count(*) AS n_lines FROM shown GROUP BY ALL"
PARTS["places"] = table([(s, h, i, 2 if s in GROUP_OF else 1, GROUP_OF.get(s, "match_data"))
                         for i, (s, h) in enumerate(HEADINGS.items())], "section, heading, place, grp, tag")
PARTS["bodies"] = f"""
SELECT match_id, idx, {nth([WRAPPERS[m] for m in MODELS], "list_position(" + items(MODELS) + ", model) - 1")} AS wrapper,
       grp, tag, place, heading, string_agg(line, chr(10) ORDER BY ord, line) AS body,
       count(*) OVER (PARTITION BY match_id, idx, grp) AS parts, row_number() OVER (PARTITION BY match_id, idx, grp ORDER BY place) AS nth
FROM shown JOIN places USING (section) JOIN (SELECT match_id, idx, model FROM requests) USING (match_id, idx)
GROUP BY match_id, idx, model, grp, tag, place, heading"""
PARTS["groups"] = """
SELECT match_id, idx, wrapper, grp, CASE WHEN wrapper = 'xml' THEN '<' || tag || '>' || chr(10) || string_agg(
         CASE WHEN parts = 1 THEN body ELSE CASE WHEN nth > 1 THEN chr(10) ELSE '' END || '## ' || heading || chr(10) || body END,
         chr(10) ORDER BY place) || chr(10) || '</' || tag || '>' || chr(10)
       ELSE string_agg('## ' || heading || chr(10) || body || chr(10), chr(10) ORDER BY place) END AS part
FROM bodies GROUP BY match_id, idx, wrapper, grp, tag"""
QUERIES["assemble_documents"] = """
SELECT match_id, idx, wrapper, rtrim(string_agg(part, chr(10) ORDER BY grp), chr(10)) || chr(10) AS document
FROM groups GROUP BY 1, 2, 3"""
PARTS["feedback"] = f"""
SELECT event_id, m, ts, CASE WHEN k % 10 = 9 THEN 0 WHEN k % 2 = 0 THEN 1 ELSE -1 END AS rating,
       CASE WHEN k % 17 = 0 THEN 'other' WHEN is_radiant THEN 'match' ELSE 'profile' END AS mode, {nth(MODELS, 'k % 3')} AS model,
       k, match_id, event_type, event_type = 'click' AS followup FROM ev"""
QUERIES["validate_feedback"] = """
SELECT event_id, CAST(rating AS BIGINT) AS rating, mode, CASE WHEN k % 4 > 0 THEN event_type END AS comment, followup,
       CASE WHEN rating = 0 THEN 'rating' WHEN mode = 'other' THEN 'mode' WHEN match_id <= 0 THEN 'match_id'
            WHEN k % 3 = 2 THEN 'depth' WHEN k % 23 = 0 THEN 'created_at' END AS problem FROM feedback"""
QUERIES["cap_per_window"] = """
SELECT event_id, mode FROM feedback
QUALIFY row_number() OVER (PARTITION BY mode, CAST(ts AS DATE) ORDER BY ts, event_id) <= 60"""
QUERIES["fan_out_sinks"] = f"""
SELECT CASE WHEN problem IS NULL THEN sink ELSE 'quarantine' END AS sink, event_id, mode
FROM ({QUERIES["validate_feedback"]}) AS checked, (VALUES ('late'), ('steady')) AS s(sink) WHERE problem IS NULL OR sink = 'late'"""
QUERIES["anchored_cap"] = """
SELECT event_id, f.mode FROM feedback f ASOF JOIN (
  WITH RECURSIVE starts AS (SELECT mode, min(ts) AS anchor FROM feedback GROUP BY mode
    UNION ALL SELECT s.mode, (SELECT min(g.ts) FROM feedback g WHERE g.mode = s.mode AND g.ts >= s.anchor + INTERVAL 1 DAY) FROM starts s WHERE s.anchor IS NOT NULL)
  SELECT mode, anchor FROM starts WHERE anchor IS NOT NULL) s ON s.mode = f.mode AND f.ts >= s.anchor
QUALIFY row_number() OVER (PARTITION BY f.mode, s.anchor ORDER BY f.ts, event_id) <= 60"""
QUERIES["vote_tally"] = """
SELECT m, mode, model, count(*) AS votes, CAST(sum(rating) AS BIGINT) AS balance FROM feedback WHERE NOT followup GROUP BY 1, 2, 3"""


def needed(sql: str) -> list[str]:
    """Names of the parts a query uses, in definition order."""
    want, todo = set(), [sql]
    while todo:
        words = set(re.findall(r"[a-z_0-9]+", todo.pop()))
        new = [p for p in PARTS if p in words and p not in want]
        want.update(new)
        todo += [PARTS[p] for p in new]
    return [p for p in PARTS if p in want]


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, sql in QUERIES.items():
        parts = needed(sql)
        # a part that only shares its name with a column would be unused but harmless
        head = ",\n".join(f"{p} AS ({PARTS[p]})" for p in parts)
        out[name] = f"WITH {head}\n{sql}" if head else sql
    return out
