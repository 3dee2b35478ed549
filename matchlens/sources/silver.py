"""Match documents unfolded into columnar tables.

Each table is a lazy projection of the raw documents: writing them once as Parquet gives later
jobs column pruning and pushdown, using them directly reads only the nested fields they name.
All arrays live inside one document, so nothing here groups rows across documents except by
match.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlens.functions import lookup as L
from matchlens.functions import text as X
from matchlens.operators import draft, players as P
from matchlens.operators import series as S

KEY = ["match_id", "idx"]
TABLES = ("matches", "players", "minutes", "supplied_adv", "purchases", "kills", "abilities", "buffs", "damage",
          "benchmarks", "picks", "objectives", "fights", "fight_players")


def number(column: str, kind: str = "bigint") -> Column:
    return F.coalesce(F.col(column).cast(kind), F.lit(0).cast(kind))


class Silver:
    order = ["pos"]
    chunk = None

    def __init__(self, raw: DataFrame, dims: dict[str, DataFrame]):
        self.raw, self.dims = raw, dims

    @cached_property
    def matches(self) -> DataFrame:
        df = self.raw.select(
            "match_id", number("duration").alias("duration"), "game_mode", "lobby_type",
            F.col("patch").alias("patch_id"), F.coalesce("radiant_win", F.lit(False)).alias("radiant_win"),
            F.col("version").isNotNull().alias("parsed"), "region")
        df = L.mode_names(df, self.dims["game_mode"], "game_mode", "game_mode_", "mode")
        df = L.mode_names(df, self.dims["lobby_type"], "lobby_type", "lobby_type_", "lobby")
        return L.with_name(df, "patch_id", self.dims["patch"], "id", "name", "patch", L.numbered("", "patch_id"))

    @cached_property
    def _unfolded(self) -> DataFrame:
        return (self.raw.select("match_id", "radiant_win", F.posexplode("players").alias("idx", "p"))
                .select("match_id", "radiant_win", "idx", "p.*",
                        (F.coalesce("p.player_slot", F.lit(0)) < 128).alias("is_radiant")))

    @cached_property
    def players(self) -> DataFrame:
        counters = ["level", "kills", "deaths", "assists", "last_hits", "denies", "hero_damage",
                    "tower_damage", "hero_healing", "camps_stacked", "creeps_stacked", "rune_pickups",
                    "obs_placed", "sen_placed", "buyback_count", "pings", "actions_per_min", "neutral_kills",
                    "ancient_kills", "tower_kills", "roshan_kills", "courier_kills", "observer_kills",
                    "sentry_kills"]
        taken = F.aggregate(F.coalesce(F.map_values("damage_taken"), F.array().cast("array<bigint>")),
                            F.lit(0).cast("bigint"), lambda a, v: a + F.coalesce(v, F.lit(0)))
        df = self._unfolded.select(
            *KEY, "account_id", "is_radiant", number("hero_id", "int").alias("hero_id"), "personaname",
            (F.col("is_radiant") == F.coalesce("radiant_win", F.lit(False))).alias("win"),
            "lane", "lane_role", F.coalesce("is_roaming", F.lit(False)).alias("is_roaming"),
            F.col("lane_efficiency_pct").cast("bigint").alias("lane_eff"),
            *[number(c).alias(c) for c in counters],
            number("gold_per_min").alias("gpm"), number("xp_per_min").alias("xpm"),
            P.effective_net_worth(F.col("net_worth"), F.col("total_gold"), F.col("gold_t")).alias("net_worth"),
            taken.alias("damage_taken"), F.coalesce("stuns", F.lit(0.0)).alias("stuns"),
            F.coalesce(F.try_element_at("life_state", F.lit("2")), F.lit(0)).cast("bigint").alias("seconds_dead"),
            "kill_streaks", "multi_kills", "max_hero_hit")
        df = L.hero_names(df, self.dims["heroes"])
        npc = self.dims["heroes"].select(F.col("id").alias("_hid"), F.col("name").alias("hero_npc"))
        return P.assign_positions(df.join(npc, F.col("hero_id") == F.col("_hid"), "left").drop("_hid"))

    @cached_property
    def minutes(self) -> DataFrame:
        names = ["gold_t", "xp_t", "lh_t", "dn_t"]
        zipped = self._unfolded.select(*KEY, "is_radiant", F.posexplode(F.arrays_zip(*[
            F.coalesce(F.col(n).cast("array<bigint>"), F.array().cast("array<bigint>")).alias(n)
            for n in names])).alias("m", "z"))
        return zipped.select(*KEY, "is_radiant", "m", *[
            F.col(f"z.{n}").alias(n.split("_")[0]) for n in names])

    @cached_property
    def supplied_adv(self) -> DataFrame:
        """The lead series the documents bring."""
        empty = F.array().cast("array<bigint>")
        zipped = self.raw.select("match_id", F.posexplode(F.arrays_zip(
            F.coalesce("radiant_gold_adv", empty).alias("gold"),
            F.coalesce("radiant_xp_adv", empty).alias("xp"))).alias("m", "z"))
        return zipped.select("match_id", "m", F.col("z.gold").alias("gold"), F.col("z.xp").alias("xp"))

    @cached_property
    def adv(self) -> DataFrame:
        return S.advantage(self.supplied_adv, self.minutes)

    def _log(self, column: str) -> DataFrame:
        return self._unfolded.select(*KEY, "is_radiant", F.posexplode(column).alias("pos", "e"))

    @cached_property
    def purchases(self) -> DataFrame:
        return self._log("purchase_log").select(
            *KEY, "is_radiant", "pos", F.col("e.time").cast("bigint").alias("t"), F.col("e.key").alias("key"))

    @cached_property
    def kills(self) -> DataFrame:
        return self._log("kills_log").select(
            *KEY, "is_radiant", "pos", F.col("e.time").cast("bigint").alias("t"),
            F.col("e.key").alias("victim_npc"))

    @cached_property
    def abilities(self) -> DataFrame:
        df = self._log("ability_upgrades_arr").select(
            *KEY, (F.col("pos") + 1).alias("n"), F.col("e").alias("ability_id"))
        return L.ability_names(df, self.dims["ability_ids"], self.dims["abilities"], "ability_id")

    @cached_property
    def buffs(self) -> DataFrame:
        """Stacking buffs; a zero stack only says that an upgrade is owned."""
        df = P.positive_stacks(self._log("permanent_buffs").select(*KEY, "pos", "e.*")).select(
            *KEY, "pos", "permanent_buff", F.col("stack_count").alias("stacks"), "since")
        return L.buff_names(df, self.dims["permanent_buffs"], self.dims["items"], self.dims["abilities"],
                            "permanent_buff")

    @cached_property
    def damage(self) -> DataFrame:
        """Damage on heroes only, in document order."""
        df = self._unfolded.select(*KEY, F.posexplode(P.on_heroes(F.col("damage"))).alias("pos", "npc", "damage"))
        return L.with_name(df, "npc", self.dims["heroes"], "name", "localized_name", "target",
                           X.without(F.col("npc"), X.HERO_PREFIX)).select(*KEY, "pos", "target", "damage")

    @cached_property
    def benchmarks(self) -> DataFrame:
        """With each metric's place in the document, which decides between equal percentiles."""
        return (self._unfolded.select(*KEY, F.posexplode("benchmarks").alias("pos", "metric", "b"))
                .select(*KEY, "metric", F.col("b.raw").alias("raw"), F.col("b.pct").alias("pct"), "pos"))

    @cached_property
    def picks(self) -> DataFrame:
        df = self.raw.select("match_id", F.inline("picks_bans")).select(
            "match_id", F.coalesce("order", F.lit(0)).alias("ord"),
            F.coalesce("is_pick", F.lit(False)).alias("is_pick"), "hero_id",
            draft.pick_side(F.col("team")).alias("is_radiant"))
        return L.hero_names(df, self.dims["heroes"])

    @cached_property
    def objectives(self) -> DataFrame:
        return self.raw.select("match_id", F.posexplode("objectives").alias("pos", "o")).select(
            "match_id", "pos", F.coalesce("o.time", F.lit(0)).cast("bigint").alias("t"),
            F.coalesce("o.type", F.lit("")).alias("type"), "o.key", "o.unit", "o.team")

    @cached_property
    def _fights(self) -> DataFrame:
        """Fights with the sides of the document's players, in list order."""
        sides = F.transform("players", lambda p: F.coalesce(p["player_slot"], F.lit(0)) < 128)
        return self.raw.select("match_id", sides.alias("sides"), F.posexplode("teamfights").alias("fight_no", "f"))

    @cached_property
    def fights(self) -> DataFrame:
        return self._fights.select("match_id", "fight_no", F.col("f.start").alias("start"),
                                   F.col("f.end").alias("end"), F.col("f.deaths").alias("deaths"))

    @cached_property
    def fight_players(self) -> DataFrame:
        """Rows of a fight belong to players by their place in the list."""
        rows = self._fights.select("match_id", "fight_no", "sides", F.posexplode("f.players").alias("idx", "fp"))
        killed = F.map_keys(F.map_filter("fp.killed", lambda k, v: k.startswith(X.HERO_PREFIX) & (v != 0)))
        return rows.select("match_id", "fight_no", "idx", "fp.deaths", "fp.damage", "fp.healing",
                           "fp.gold_delta", "fp.xp_delta", killed.alias("killed"),
                           F.get("sides", F.col("idx")).alias("is_radiant")).filter("is_radiant is not null")

    # --- stored once, read many times -----------------------------------------------

    def write(self, path: str) -> None:
        """All tables as Parquet, each match's rows together.

        The documents are parsed once, into ``<path>/documents``; every table then reads its own fields of these.
        """
        self.raw.write.mode("overwrite").parquet(f"{path}/documents")
        stored = Silver(self.raw.sparkSession.read.parquet(f"{path}/documents"), self.dims)
        for name in TABLES:
            (getattr(stored, name).repartition("match_id").sortWithinPartitions("match_id")
             .write.mode("overwrite").parquet(f"{path}/{name}"))

    @classmethod
    def read(cls, spark: SparkSession, path: str, dims: dict[str, DataFrame]) -> Silver:
        """The tables ``write`` left: columns are pruned and filters pushed, no document is parsed again."""
        return cls._of({n: spark.read.parquet(f"{path}/{n}") for n in TABLES}, dims)

    def save_bucketed(self, prefix: str, path: str, buckets: int) -> None:
        """All tables bucketed by match: windows and joins inside a match then need no exchange."""
        for name in TABLES:
            (getattr(self, name).repartition(buckets, "match_id").write.mode("overwrite")
             .bucketBy(buckets, "match_id").sortBy("match_id").option("path", f"{path}/{name}")
             .saveAsTable(f"{prefix}_{name}"))

    @classmethod
    def bucketed(cls, spark: SparkSession, prefix: str, dims: dict[str, DataFrame]) -> Silver:
        return cls._of({n: spark.table(f"{prefix}_{n}") for n in TABLES}, dims)

    def narrowed(self, matches: DataFrame) -> Silver:
        """The same tables for the given match_ids only."""
        ids = matches.select("match_id").distinct()
        return self._of({n: getattr(self, n).join(ids, "match_id", "left_semi") for n in TABLES}, self.dims)

    @classmethod
    def _of(cls, tables: dict[str, DataFrame], dims: dict[str, DataFrame]) -> Silver:
        out = cls(tables["matches"], dims)
        for name, df in tables.items():
            setattr(out, name, df)
        return out
