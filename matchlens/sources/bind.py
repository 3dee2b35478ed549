"""The general test tables read in match roles.

Ten consecutive users form a match, a day is one step of the match clock, and the five
event types play kills, deaths, assists and so on. All bindings are reductions with a
map-side combine, so one user or match that owns a large part of the events costs no
more than any other; anything kept per event carries ``chunk`` (see operators.carry).
"""

from __future__ import annotations

from dataclasses import replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchlens.params import DEFAULTS
from matchlens.operators import carry, players as P
from matchlens.plans.share import keep
from matchlens.sources.landing import values

CROWD = 200_000           # rows of a player's log, about, that one task orders; longer logs are cut by time
MOST_CROWDED = 10_000     # logs that are cut: the table of their chunks goes to every task

# The same rules on the scale of cents, days and seconds-in-a-month.
LIMITS = replace(DEFAULTS, cluster_span=172800, kp_high=50, collapse_loss=100000,
                 collapse_scale=400000.0, lag_minutes=4320.0, lag_scale=17280.0,
                 lane_phase=2 * 86400, early_kills_until=2 * 86400,
                 late_deaths_from=28 * 86400)



def radiant() -> Column:
    """Ten users per match: parity of the user and of its place agree."""
    return F.col("idx") % 2 == 0


ITEM_ROWS = [
    ("click", "Click Blade", 500, "component", []),
    ("error", "Error Tango", 90, "consumable", []),
    ("purchase", "Purchase Treads", 2200, "rare", ["click", "view", "view"]),
    ("signup", "Signup Crown", 4200, "epic", ["purchase", "error"]),
    ("view", "View Gloves", 450, "component", []),
]


def whole_seconds(ts: Column) -> Column:
    """Seconds since 2024-01-01 from the wall-clock fields, independent of the session zone."""
    days = F.date_diff(F.to_date(ts), F.lit("2024-01-01").cast("date"))
    return (days.cast("bigint") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
            + F.second(ts)).cast("bigint")


class Bound:
    """Lazy tables. ``shared`` keeps the reduction to one row per player for plans with many branches;
    ``only`` narrows the events to some matches before anything is computed. Logs are always read
    chunk by chunk, whatever their size.
    """

    chunk = "chunk"

    def __init__(self, spark: SparkSession, sf_dir: str, shared: bool = False,
                 only: DataFrame | None = None):
        self.spark, self.dir = spark, sf_dir.rstrip("/")
        self.shared, self.only = shared, only

    def narrowed(self, matches: DataFrame) -> Bound:
        """The same tables for the given match_ids; percentiles still compare with all players."""
        part = Bound(self.spark, self.dir, True, matches.select("match_id").distinct())
        part.benchmarks = self.benchmarks.join(part.only, "match_id", "left_semi")
        return part

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def ev(self) -> DataFrame:
        user, ts = F.col("user_id"), F.col("ts")
        rows = self.table("events").select(
            "event_id", "ts", "user_id",
            F.floor(user / 10).cast("bigint").alias("match_id"),
            (user % 10).alias("idx"),
            (user % 2 == 0).alias("is_radiant"),
            F.date_diff(F.to_date(ts), F.lit("2024-01-01").cast("date")).alias("m"),
            whole_seconds(ts).alias("t"),
            F.round(F.col("value") * 100).cast("bigint").alias("cents"),
            F.get_json_object("props", "$.k").cast("bigint").alias("k"),
            "event_type")
        return rows if self.only is None else keep(rows.join(self.only, "match_id", "left_semi"))

    # --- series -----------------------------------------------------------------

    @staticmethod
    def _dense(per: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
        """Running totals for every clock step of the match: from its start (0, or its first step if
        that is earlier) to the last step any of its players has. A row per step and player at most.
        """
        match = Window.partitionBy("match_id")
        points = F.map_from_entries(F.collect_list(F.struct("m", F.struct(*values))))
        spans = per.withColumns({"_from": F.least(F.min("m").over(match), F.lit(0)), "_to": F.max("m").over(match)})
        rows = (spans.groupBy(*keys, "_from", "_to").agg(points.alias("_points"))
                .select(*keys, "_points", F.explode(F.sequence("_from", F.greatest("_from", "_to"))).alias("m"))
                .select(*keys, "m", F.try_element_at("_points", F.col("m")).alias("_p")))
        w = Window.partitionBy(*keys).orderBy("m").rowsBetween(Window.unboundedPreceding, 0)
        return rows.select(*keys, "m", *[
            F.sum(F.coalesce(F.col(f"_p.{v}"), F.lit(0))).over(w).alias(v) for v in values])

    @cached_property
    def minutes(self) -> DataFrame:
        per = self.ev.groupBy("match_id", "idx", "m").agg(
            F.sum("cents").alias("gold"), F.sum("k").alias("xp"),
            F.count_if(F.col("event_type") == "view").alias("lh"),
            F.count_if(F.col("event_type") == "signup").alias("dn"))
        dense = self._dense(per, ["match_id", "idx"], ["gold", "xp", "lh", "dn"])
        return dense.withColumn("is_radiant", radiant())

    @cached_property
    def adv(self) -> DataFrame:
        """Radiant-relative gold and experience lead, straight from the team's daily sums."""
        sign = F.when(F.col("is_radiant"), 1).otherwise(-1)
        per = self.ev.groupBy("match_id", "m").agg(
            F.sum(sign * F.col("cents")).alias("gold"), F.sum(sign * F.col("k")).alias("xp"))
        return self._dense(per, ["match_id"], ["gold", "xp"])

    # --- players and matches ------------------------------------------------------

    @cached_property
    def totals(self) -> DataFrame:
        kind = F.col("event_type")

        def cents(of: str) -> Column:
            return F.sum(F.when(kind == of, F.col("cents")).otherwise(0))

        rows = self.ev.groupBy("match_id", "idx").agg(
            F.max("t").alias("last_t"),
            F.count_if(kind == "purchase").alias("kills"),
            F.count_if(kind == "error").alias("deaths"),
            F.count_if(kind == "click").alias("assists"),
            F.count_if(kind == "view").alias("last_hits"),
            F.count_if(F.col("k") < 10).alias("denies"),
            F.count_if(kind == "signup").alias("level"),
            F.sum("cents").alias("total_gold"),
            F.sum("k").alias("xp"),
            cents("purchase").alias("hero_damage"),
            cents("click").alias("tower_damage"),
            cents("signup").alias("hero_healing"),
            cents("error").alias("damage_taken"),
            F.sum(F.when(kind == "error", F.col("k") * 500).otherwise(0)).alias("seconds_dead"))
        rows = rows.withColumns({"is_radiant": radiant(),
                                 "steps": F.greatest(F.floor(F.max("last_t").over(Window.partitionBy("match_id")) / 86400) + 1, F.lit(1)),
                                 "lane": (F.floor(F.col("idx") / 2) % 3 + 1).cast("int")})
        return keep(rows) if self.shared else rows

    @cached_property
    def players(self) -> DataFrame:
        t = self.totals
        user = F.col("match_id") * 10 + F.col("idx")
        lane_sum = F.col("last_hits") + F.col("assists")
        base = t.select(
            "*", F.col("idx").alias("account_id"),
            (user % 25).alias("hero_id"),
            F.concat(F.lit("hero_"), (user % 25).cast("string")).alias("hero_name"),
            F.concat(F.lit("npc_"), F.col("idx").cast("string")).alias("hero_npc"),
            F.when(user % 11 == 0, None).otherwise(F.col("lane")).alias("lane_role"),
            (user % 13 == 0).alias("is_roaming"),
            F.when(lane_sum > 0, F.bround(100 * F.col("last_hits") / F.nullif(lane_sum, F.lit(0)))
                   .cast("bigint")).alias("lane_eff"),
            F.floor(F.col("total_gold") / (F.col("steps") * 1440)).cast("bigint").alias("gpm"),
            F.floor(F.col("xp") / F.col("steps")).cast("bigint").alias("xpm"),
            (F.col("seconds_dead") / 1000.0).alias("stuns"))
        return P.assign_positions(base.withColumn("net_worth", F.col("total_gold")))

    @cached_property
    def matches(self) -> DataFrame:
        sign = F.when(F.col("is_radiant"), 1).otherwise(-1)
        return self.totals.groupBy("match_id").agg(
            (F.sum(sign * F.col("total_gold")) > 0).alias("radiant_win"),
            F.max("last_t").alias("duration")).select(
            "*", F.concat(F.lit("mode_"), (F.col("match_id") % 3).cast("string")).alias("mode"),
            F.concat(F.lit("lobby_"), (F.col("match_id") % 2).cast("string")).alias("lobby"),
            F.concat(F.lit("7."), (30 + F.col("match_id") % 4).cast("string")).alias("patch"),
            (F.col("match_id") % 5 != 0).alias("parsed"))

    @cached_property
    def results(self) -> DataFrame:
        """Players with the outcome of their match."""
        m = self.matches.select("match_id", "radiant_win", "duration", "patch", "parsed")
        return self.players.join(m, "match_id").withColumn(
            "win", F.col("is_radiant") == F.col("radiant_win"))

    # --- logs ---------------------------------------------------------------------

    @cached_property
    def crowded(self) -> DataFrame:
        """Players whose log is cut, with its start and the width of a chunk. Beyond MOST_CROWDED of them, the others have less than a MOST_CROWDEDth of all rows each."""
        logs = self.ev.groupBy("match_id", "idx").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("_from"), F.max("t").alias("_to"))
        top = logs.where(F.col("n") > CROWD).orderBy(F.desc("n"), "match_id", "idx").limit(MOST_CROWDED)
        return keep(top.select("match_id", "idx", "_from", F.greatest(F.floor((F.col("_to") - F.col("_from") + 1) * CROWD / F.col("n")), F.lit(1)).alias("_width")))

    @cached_property
    def purchases(self) -> DataFrame:
        cut = F.coalesce(F.floor((F.col("t") - F.col("_from")) / F.col("_width")), F.lit(0))
        rows = self.ev.join(F.broadcast(self.crowded), ["match_id", "idx"], "left")
        return rows.select("match_id", "idx", "is_radiant", "ts", "event_id", "t", F.col("event_type").alias("key"), cut.cast("bigint").alias("chunk"))

    @cached_property
    def kills(self) -> DataFrame:
        victim = F.col("k") % 10
        return (self.ev.filter((F.col("event_type") == "purchase") & (victim != F.col("idx")))
                .select("match_id", "idx", "is_radiant", "t", "event_id",
                        F.concat(F.lit("npc_"), victim.cast("string")).alias("victim_npc")))

    @cached_property
    def fight_players(self) -> DataFrame:
        kind = F.col("event_type")

        def cents(of: str) -> Column:
            return F.sum(F.when(kind == of, F.col("cents")).otherwise(0))

        return self.ev.groupBy("match_id", F.col("m").alias("fight_no"), "idx", "is_radiant").agg(
            F.count_if(kind == "error").alias("deaths"),
            cents("purchase").alias("damage"), cents("signup").alias("healing"),
            F.sum("cents").alias("gold_delta"), F.sum("k").alias("xp_delta"))

    @cached_property
    def fights(self) -> DataFrame:
        return self.ev.groupBy("match_id", F.col("m").alias("fight_no")).agg(
            F.min("t").alias("start"), F.max("t").alias("end"),
            F.count_if(F.col("event_type") == "error").alias("deaths"))

    @cached_property
    def picks(self) -> DataFrame:
        w = Window.partitionBy("match_id").orderBy("_at")             # at most ten rows
        return (self.ev.groupBy("match_id", "idx")
                .agg(F.min(F.struct("ts", "event_id", "event_type")).alias("_at"))
                .select("match_id", "idx", radiant().alias("is_radiant"),
                        F.concat(F.lit("hero_"), ((F.col("match_id") * 10 + F.col("idx")) % 25)
                                 .cast("string")).alias("hero_name"),
                        (F.col("_at.event_type") != "error").alias("is_pick"),
                        F.row_number().over(w).alias("ord")))

    @cached_property
    def objectives(self) -> DataFrame:
        kind, k = F.col("event_type"), F.col("k")
        owner = F.when(k % 3 == 0, "goodguys_").when(k % 3 == 1, "badguys_").otherwise("")
        part = (F.when(k % 4 == 0, "fort").when(k % 4 == 1, "melee_rax_top")
                .when(k % 4 == 2, "tower1_mid").otherwise("tower2_bot"))
        unit = (F.when(k % 5 == 0, F.concat(F.lit("npc_dota_hero_"), (k % 25).cast("string")))
                .when(k % 5 == 1, "npc_dota_creep"))
        return self.ev.select(
            "match_id", "event_id", "t",
            F.when(kind == "purchase", "building_kill")
            .when(kind == "signup", "CHAT_MESSAGE_ROSHAN_KILL")
            .when(kind == "error", "CHAT_MESSAGE_AEGIS")
            .when(kind == "click", "CHAT_MESSAGE_COURIER_LOST")
            .otherwise("CHAT_MESSAGE_OTHER").alias("type"),
            F.when(kind == "purchase", F.concat(F.lit("npc_dota_"), owner, part)).alias("key"),
            F.when(kind == "purchase", unit).alias("unit"),
            F.when(F.col("is_radiant"), 2).otherwise(3).alias("team"))

    @cached_property
    def metrics(self) -> DataFrame:
        """Long form of the eight benchmarked quantities per player."""
        source = {
            "gold_per_min": "total_gold", "xp_per_min": "xp", "kills_per_min": "kills",
            "last_hits_per_min": "last_hits", "hero_damage_per_min": "hero_damage",
            "hero_healing_per_min": "hero_healing", "tower_damage": "tower_damage",
            "stuns_per_min": "seconds_dead"}
        rows = F.inline(F.array(*[F.struct(F.lit(name).alias("metric"),
                                           F.col(col).cast("bigint").alias("value"))
                                  for name, col in source.items()]))
        return self.totals.select("match_id", "idx", rows)

    @cached_property
    def benchmarks(self) -> DataFrame:
        from matchlens.operators import bench
        return bench.metric_percentiles(self.metrics, ["metric"]).select(
            "match_id", "idx", "metric", F.col("value").cast("double").alias("raw"), "pct")

    # --- look-ups and requests ------------------------------------------------------

    @cached_property
    def items(self) -> DataFrame:
        return values(self.spark, ITEM_ROWS, ["key", "dname", "cost", "qual", "components"])

    @cached_property
    def requests(self) -> DataFrame:
        """One analysis request per player, its settings spread over the domains."""
        from matchlens.params import DEPTHS, FOCUSES, MODELS, ROLES
        user = F.col("match_id") * 10 + F.col("idx")

        def pick(options, step: int) -> Column:
            spread = F.floor(user / step) % len(options) + 1
            return F.element_at(F.array(*[F.lit(o) for o in options]), spread.cast("int"))

        return self.totals.select(
            "match_id", "idx", pick(DEPTHS, 1).alias("depth"), pick(FOCUSES, 1).alias("focus"),
            F.when(user % 3 == 0, pick(ROLES, 3)).alias("role"),
            pick(MODELS, 2).alias("model"),
            (user % 4 == 1).alias("has_window"), (user % 5 == 2).alias("has_note"),
            F.when(user % 6 == 0, F.concat((user % 9000).cast("string"), F.lit("  mmr "))).alias("mmr"))
