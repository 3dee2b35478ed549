"""Per-player projections, positions, participation and role metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlens.functions import text as X
from matchlens.params import DEFAULTS, LANE_KEYS, ROLES, ROLE_METRICS

KEY = ["match_id", "idx"]


def effective_net_worth(final: Column, total: Column, series: Column) -> Column:
    """Final net worth, else total gold, else the last point of the series, else 0."""
    last = F.when(F.size(series) > 0, F.get(series, F.size(series) - 1))
    return F.coalesce(F.nullif(final, F.lit(0)), F.nullif(total, F.lit(0)), last, F.lit(0)).cast("bigint")


def net_worth_fallback(players: DataFrame, minutes: DataFrame) -> DataFrame:
    """The same rule for a long-form series."""
    last = minutes.groupBy(*KEY).agg(F.max_by("gold", "m").alias("_last"))
    return (players.join(last, KEY, "left")
            .withColumn("net_worth", F.coalesce(
                F.nullif(F.col("net_worth_final"), F.lit(0)), "_last", F.lit(0)).cast("bigint"))
            .drop("_last"))


def lane_key(roaming: Column, lane_role: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in LANE_KEYS.items() for x in pair])
    known = F.try_element_at(names, lane_role.cast("int"))
    return F.when(roaming, "roaming").otherwise(F.coalesce(known, F.lit("unknown")))


def assign_positions(players: DataFrame) -> DataFrame:
    """Lane, core flag and position 1..5 from the net-worth rank inside side and lane."""
    w = (Window.partitionBy("match_id", "is_radiant", "lane_key")     # at most one side of a match
         .orderBy(F.col("net_worth").desc(), "idx"))
    richest = F.row_number().over(w) == 1
    lane, core = F.col("lane_key"), F.col("is_core")
    position = (F.when(lane == "mid", "2")
                .when((lane == "safe") & core, "1").when(lane == "safe", "5")
                .when((lane == "off") & core, "3").when(lane == "off", "4").otherwise("support"))
    return (players.repartition("match_id")          # one exchange serves every window inside a match
            .withColumn("lane_key", lane_key(F.col("is_roaming"), F.col("lane_role")))
            .withColumn("is_core", (lane == "mid") | (richest & lane.isin("safe", "off")))
            .withColumn("position", position))


def effective_role(position: Column, requested: Column | None = None) -> tuple[Column, Column]:
    """The requested role wins, else the inferred one if it is 1..5; and where it came from."""
    inferred = F.when(position.isin(*ROLES), position)
    asked = requested if requested is not None else F.lit(None).cast("string")
    source = F.when(asked.isNotNull(), "selected").when(inferred.isNotNull(), "heuristic").otherwise("auto")
    return F.coalesce(asked, inferred), source


def with_roles(players: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """Adds ``role`` and ``role_source`` of every player seen as the focal one."""
    if requests is None:
        role, source = effective_role(F.col("position"))
        return players.withColumn("role", role).withColumn("role_source", source)
    asked = requests.select(*KEY, F.col("role").alias("_asked"))
    role, source = effective_role(F.col("position"), F.col("_asked"))
    return (players.join(asked, KEY, "left").withColumn("role", role)
            .withColumn("role_source", source).drop("_asked"))


def kill_participation(players: DataFrame) -> DataFrame:
    """Share of the team's kills a player took part in, capped at 100, 0 without team kills."""
    team = F.sum("kills").over(Window.partitionBy("match_id", "is_radiant"))
    share = F.bround(100 * (F.col("kills") + F.col("assists")) / F.nullif(F.col("team_kills"), F.lit(0)))
    return (players.withColumn("team_kills", team)
            .withColumn("kp", F.when(F.col("team_kills") > 0, F.least(F.lit(100), share))
                        .otherwise(0).cast("bigint")))


def scoreboard(players: DataFrame) -> DataFrame:
    def pair(a: str, b: str) -> Column:
        return F.concat_ws("/", F.col(a).cast("string"), F.col(b).cast("string"))

    return players.select(
        *KEY, "hero_name", "is_radiant", F.col("level").cast("bigint").alias("lvl"),
        F.concat_ws("/", *[F.col(c).cast("string") for c in ("kills", "deaths", "assists")]).alias("kda"),
        pair("last_hits", "denies").alias("lh_dn"), pair("gpm", "xpm").alias("gpm_xpm"),
        F.col("net_worth").alias("nw"), F.col("hero_damage").alias("hd"),
        F.col("tower_damage").alias("td"), F.col("hero_healing").alias("heal"),
        F.col("damage_taken").alias("dt"))


def match_meta(matches: DataFrame, players: DataFrame) -> DataFrame:
    m = matches.select("match_id", "patch", "mode", "lobby", "duration", "radiant_win", "parsed")
    return players.join(m, "match_id").select(
        *KEY, "patch", "mode", "lobby", X.mmss(F.col("duration")).alias("duration"),
        (F.col("is_radiant") == F.col("radiant_win")).alias("win"),
        X.side(F.col("is_radiant")).alias("my_side"), X.side(F.col("radiant_win")).alias("winner"),
        "hero_name", "position", "lane_key", F.col("level").cast("bigint").alias("level"),
        F.col("kills").cast("bigint").alias("kills"), F.col("deaths").cast("bigint").alias("deaths"),
        F.col("assists").cast("bigint").alias("assists"), "parsed")


def best_key(counts: Column) -> Column:
    """Largest numeric key of a map of counters, 0 when empty."""
    keys = F.transform(F.map_keys(counts), lambda k: k.try_cast("bigint"))
    return F.coalesce(F.array_max(keys), F.lit(0)).cast("bigint")


def combat_counters(players: DataFrame, heroes: DataFrame | None = None) -> DataFrame:
    """Streaks, stuns, map work and kill types; the last three columns are the expanded level."""
    hit_hero = X.without(F.col("max_hero_hit.key"), X.HERO_PREFIX)
    df = players
    if heroes is not None:
        names = heroes.select(F.col("name").alias("_npc"), F.col("localized_name").alias("_hit_name"))
        df = df.join(names, F.col("max_hero_hit.key") == F.col("_npc"), "left")
        hit_hero = F.coalesce("_hit_name", hit_hero)
    hit = F.when(F.coalesce(F.col("max_hero_hit.value"), F.lit(0)) != 0,
                 F.concat_ws(" on ", F.col("max_hero_hit.value").cast("string"), hit_hero))
    kill_types = ["neutral", "ancient", "tower", "roshan", "courier", "observer", "sentry"]
    return df.select(
        *KEY, best_key(F.col("kill_streaks")).alias("best_streak"),
        best_key(F.col("multi_kills")).alias("best_multikill"),
        X.half_even(F.col("stuns"), 1).alias("stuns_sec"),
        "camps_stacked", F.col("rune_pickups").alias("runes"), F.col("obs_placed").alias("obs"),
        F.col("sen_placed").alias("sen"), F.col("buyback_count").alias("buybacks"),
        X.mmss(F.col("seconds_dead")).alias("time_dead"),
        *[F.col(f"{k}_kills") for k in kill_types],
        F.col("actions_per_min").alias("apm"), "pings", hit.alias("max_hit"))


def role_metrics(players: DataFrame) -> DataFrame:
    """One row per (player, metric of its role) with the position of the metric in the list.

    ``players`` carries one column per metric name; metrics it lacks come out as null.
    """
    names = sorted({m for ms in ROLE_METRICS.values() for m in ms})
    have = set(players.columns)
    values = F.create_map(*[x for n in names for x in (
        F.lit(n), (F.col(n) if n in have else F.lit(None)).cast("string"))])
    lists = F.create_map(*[x for role, ms in ROLE_METRICS.items() for x in (
        F.lit(role), F.array(*[F.lit(m) for m in ms]))])
    keys = [*KEY, *[c for c in ("request_id",) if c in have]]
    return (players.filter(F.col("role").isin(*ROLES))
            .select(*keys, "role", values.alias("_values"),
                    F.posexplode(F.try_element_at(lists, F.col("role"))).alias("_pos", "metric"))
            .select(*keys, "role", (F.col("_pos") + 1).cast("bigint").alias("ord"), "metric",
                    F.try_element_at("_values", F.col("metric")).alias("value")))


def on_heroes(damage: Column) -> Column:
    """The entries of a damage map that name heroes."""
    return F.map_filter(damage, lambda k, _: k.startswith(X.HERO_PREFIX))


def positive_stacks(buffs: DataFrame) -> DataFrame:
    """Stacking buffs with the time of the grant; a zero stack only says that an upgrade is owned, a zero time is unknown."""
    return buffs.filter("stack_count > 0").withColumn("since", F.nullif("grant_time", F.lit(0)))


def top_targets(damage: DataFrame, k: int = DEFAULTS.top_targets) -> DataFrame:
    """The k largest entries per player of (match_id, idx, target, damage, pos)."""
    w = Window.partitionBy(*KEY).orderBy(F.col("damage").desc(), "pos")
    return damage.withColumn("ord", F.row_number().over(w)).filter(F.col("ord") <= k).drop("pos")


def match_list(*columns: str) -> Column:
    """All players of the row's match in list order; ten at most by the data model."""
    return F.sort_array(F.collect_list(F.struct("idx", *columns)).over(Window.partitionBy("match_id")))


def opponents(players: DataFrame, *extra: str) -> DataFrame:
    """Each player with the other side's players as one array, never as pairs."""
    everyone = players.withColumn("opponents", match_list("is_radiant", *extra))
    return everyone.withColumn("opponents", F.filter(
        "opponents", lambda o: o["is_radiant"] != F.col("is_radiant")))


def lane_opponents(players: DataFrame, *extra: str) -> DataFrame:
    """The opponents on the same physical lane; a player without a lane has none."""
    return opponents(players, *dict.fromkeys(("lane", *extra))).withColumn(
        "opponents", F.filter("opponents", lambda o: F.coalesce(o["lane"] == F.col("lane"), F.lit(False))))


def roster(players: DataFrame) -> DataFrame:
    return players.select(*KEY, X.side(F.col("is_radiant")).alias("side"), "hero_name",
                          F.coalesce("role", "position").alias("position"), "lane_key")
