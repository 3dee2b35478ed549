"""Kills, deaths, objectives and everything inside a time window of a match."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlens.functions import text as X
from matchlens.operators import carry
from matchlens.params import DEFAULTS, Thresholds

KEY = ["match_id", "idx"]


# --- deaths read from the killers' logs -------------------------------------------

def _victims(kills: DataFrame, players: DataFrame) -> DataFrame:
    """Kills joined to the victim's row: a few players per match, so only kills can be skewed."""
    victim = players.select("match_id", F.col("hero_npc").alias("victim_npc"),
                            F.col("idx").alias("victim"), F.col("is_radiant").alias("victim_radiant"))
    return (kills.withColumnsRenamed({"idx": "killer", "is_radiant": "killer_radiant"})
            .join(victim, ["match_id", "victim_npc"]))


def death_times(kills: DataFrame, players: DataFrame) -> DataFrame:
    """(match_id, idx, t, killer): deaths by enemies at or after the horn."""
    rows = _victims(kills, players).filter(
        (F.col("victim_radiant") != F.col("killer_radiant")) & (F.coalesce("t", F.lit(0)) >= 0))
    return rows.select("match_id", F.col("victim").alias("idx"),
                       F.coalesce("t", F.lit(0)).cast("bigint").alias("t"), "killer")


def early_deaths(kills: DataFrame, players: DataFrame, p: Thresholds = DEFAULTS) -> DataFrame:
    """Deaths in the lane phase by any other player, allies included."""
    rows = _victims(kills, players).filter(
        (F.col("victim") != F.col("killer")) & (F.coalesce("t", F.lit(0)) <= p.lane_phase))
    return rows.select("match_id", F.col("victim").alias("idx"), F.col("t").cast("bigint").alias("t"), "killer")


def early_events(events: DataFrame, t: str, p: Thresholds = DEFAULTS) -> DataFrame:
    """Events of the lane phase, pre-game ones included."""
    return events.filter(F.coalesce(F.col(t), F.lit(0)) <= p.lane_phase)


def early_late_times(kills: DataFrame, deaths: DataFrame, p: Thresholds = DEFAULTS) -> DataFrame:
    """Own kills of the first minutes and own deaths late in the game, one row each."""
    t = F.coalesce("t", F.lit(0)).cast("bigint").alias("t")
    early = kills.select(*KEY, F.lit("early_kill").alias("kind"), t).filter(
        F.col("t").between(0, p.early_kills_until))
    late = deaths.select(*KEY, F.lit("late_death").alias("kind"), t).filter(
        F.col("t") >= p.late_deaths_from)
    return early.unionByName(late)


def death_cluster(deaths: DataFrame, p: Thresholds = DEFAULTS) -> DataFrame:
    return carry.densest_span(deaths, KEY, "t", p.cluster_span).filter(F.col("n") >= p.cluster_min)


# --- objectives -------------------------------------------------------------------

# Event type -> kind; anything else is not an objective.
OBJECTIVE_KINDS = {
    "CHAT_MESSAGE_FIRSTBLOOD": "firstblood", "building_kill": "building",
    "CHAT_MESSAGE_ROSHAN_KILL": "roshan", "CHAT_MESSAGE_AEGIS": "aegis",
    "CHAT_MESSAGE_MINIBOSS_KILL": "tormentor", "CHAT_MESSAGE_COURIER_LOST": "courier",
}
# ---


def classify_objectives(raw: DataFrame, heroes: DataFrame | None = None) -> DataFrame:
    """Typed objectives: who attacked whom, what fell and who gets the credit.

    A building's key names its owner; the attacker is the other side. Couriers are minor.
    """
    kinds = F.create_map(*[F.lit(x) for kv in OBJECTIVE_KINDS.items() for x in kv])
    kind = F.try_element_at(kinds, F.col("type"))
    key, unit = F.coalesce("key", F.lit("")), F.coalesce("unit", F.lit(""))
    building = F.col("kind") == "building"
    by_hero = unit.startswith(X.HERO_PREFIX)
    short = reduce(X.without, ("npc_dota_", "goodguys_", "badguys_"), key)
    df = raw.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    hero = X.without(unit, X.HERO_PREFIX)
    if heroes is not None:
        names = heroes.select(F.col("name").alias("_npc"), F.col("localized_name").alias("_name"))
        df = df.join(names, F.col("unit") == F.col("_npc"), "left")
        hero = F.coalesce("_name", hero)
    owner = F.when(key.contains("goodguys"), "Radiant").when(key.contains("badguys"), "Dire").otherwise("?")
    df = df.withColumns({
        "victim": F.when(building, owner),
        "attacker": F.when(building, F.when(owner == "Radiant", "Dire").when(owner == "Dire", "Radiant")
                           .otherwise("?")),
        "building": F.when(building, F.when(key.contains("fort"), "throne")
                           .when(key.contains("rax"), "rax").otherwise("tower")),
        "short": F.when(building, short),
        "hero": F.when(building & by_hero, hero),
        "by_creeps": F.when(building, (unit != "") & ~by_hero),
        "side": F.when(F.col("kind").isin("roshan", "tormentor", "courier"),
                       F.when(F.col("team") == 2, "Radiant").when(F.col("team") == 3, "Dire").otherwise("?")),
        "minor": F.col("kind") == "courier"})
    return df.drop("_npc", "_name", "type", "key", "unit", "team")


def major_only(objectives: DataFrame) -> DataFrame:
    return objectives.filter(~F.col("minor"))


# --- windows of a match -------------------------------------------------------------

def inside(events: DataFrame, windows: DataFrame, t: str = "t") -> DataFrame:
    """Events whose time lies in their match's window, both ends included."""
    return events.join(windows, "match_id").filter(F.col(t).between(F.col("lo"), F.col("hi")))


def _level(width: Column) -> Column:
    """The least level whose cells, of 2 ** level, are as wide as the window: it touches two of them at most."""
    return F.ceil(F.log2(F.greatest(width, F.lit(0)) + 1)).cast("int")


def _cell(t: Column, level: Column) -> Column:
    return F.floor(t / F.pow(F.lit(2.0), level)).cast("bigint")


def inside_many(events: DataFrame, windows: DataFrame, t: str = "t") -> DataFrame:
    """The same for matches with very many windows of any widths: an event meets only windows near it.

    Windows stand in the one or two cells that they touch at the level of their width; an event looks into one cell of each level that there is, at
    most one for every doubling of widths. So events and windows that meet are at most two cells apart, and their number follows the result.
    """
    placed = windows.where("lo <= hi").withColumn("_level", _level(F.col("hi") - F.col("lo")))
    placed = placed.withColumn("_cell", F.explode(F.sequence(_cell(F.col("lo"), F.col("_level")), _cell(F.col("hi"), F.col("_level")))))
    levels = placed.agg(F.collect_set("_level").alias("levels")).scalar()            # one number for each doubling
    looked = events.where(F.col(t).isNotNull()).withColumn("_level", F.explode(levels)).withColumn("_cell", _cell(F.col(t), F.col("_level")))
    met = looked.join(placed, ["match_id", "_level", "_cell"])
    return met.filter(F.col(t).between(F.col("lo"), F.col("hi"))).drop("_level", "_cell")


def overlapping_many(spans: DataFrame, windows: DataFrame) -> DataFrame:
    """Intervals that touch windows of matches with very many of both: one of the two starts inside the other."""
    ends = spans.withColumns({"_from": F.coalesce("start", F.lit(0)).cast("bigint"), "_to": F.coalesce("end", F.lit(0)).cast("bigint")})
    columns = [*spans.columns, *(c for c in windows.columns if c != "match_id")]
    begun = inside_many(ends, windows, "_from").where("_to >= lo").select("match_id", *(c for c in columns if c != "match_id"))
    # The window starts after the interval did and before it ended.
    own = ends.withColumnsRenamed({"_from": "lo", "_to": "hi"})
    later = inside_many(windows.withColumnsRenamed({"lo": "_lo", "hi": "_hi"}).where("_lo <= _hi"), own, "_lo").where("_lo > lo")
    later = later.drop("lo", "hi").withColumnsRenamed({"_lo": "lo", "_hi": "hi"})
    return begun.unionByName(later.select(begun.columns))


def overlapping(spans: DataFrame, windows: DataFrame) -> DataFrame:
    """Intervals that touch the window of their match."""
    start, end = F.coalesce("start", F.lit(0)), F.coalesce("end", F.lit(0))
    return spans.join(windows, "match_id").filter((end >= F.col("lo")) & (start <= F.col("hi")))


def window_events(windows: DataFrame, kills: DataFrame, purchases: DataFrame, fights: DataFrame,
                  objectives: DataFrame) -> DataFrame:
    """Everything inside each match's window: (match_id, kind, t, who, what).

    No cost threshold applies; recipes are left out, minor objectives stay in.
    """
    who = F.col("idx").cast("string")
    parts = [
        inside(kills, windows).select("match_id", F.lit("kill").alias("kind"), "t", who.alias("who"),
                                      F.col("victim_npc").alias("what")),
        inside(purchases.filter(~F.coalesce("key", F.lit("")).startswith("recipe_")), windows).select(
            "match_id", F.lit("purchase").alias("kind"), "t", who.alias("who"),
            X.without(F.coalesce("key", F.lit("")), X.ITEM_PREFIX).alias("what")),
        overlapping(fights, windows).select(
            "match_id", F.lit("fight").alias("kind"), F.col("start").alias("t"),
            F.lit(None).cast("string").alias("who"), F.col("fight_no").cast("string").alias("what")),
        inside(objectives, windows).select("match_id", F.lit("objective").alias("kind"), "t",
                                           F.coalesce("side", "attacker").alias("who"),
                                           F.col("kind").alias("what")),
    ]
    return reduce(DataFrame.unionByName, [d.withColumn("t", F.col("t").cast("bigint")) for d in parts])


def window_series(windows: DataFrame, minutes: DataFrame) -> DataFrame:
    """Every minute of the window for every player, not thinned."""
    return (minutes.join(windows, "match_id")
            .filter(F.col("m").between(F.col("lo_m"), F.col("hi_m")))
            .select(*KEY, "m", "gold", "xp", "lh", "dn"))


def window_summary(windows: DataFrame, events: DataFrame) -> DataFrame:
    """Rows per kind and whether the window is quiet."""
    counts = events.groupBy("match_id").agg(*[
        F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("kill", "purchase", "fight", "objective")])
    filled = windows.select("match_id").join(counts, "match_id", "left").fillna(0)
    total: Column = sum((F.col(c) for c in counts.columns if c != "match_id"), F.lit(0))
    return filled.withColumn("empty", total == 0)
