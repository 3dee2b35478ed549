"""Inputs of the role metrics gathered per player."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlens.functions import text as X
from matchlens.operators import events as E
from matchlens.operators import fights as G
from matchlens.operators import players as P
from matchlens.operators.career import minute_value
from matchlens.params import DEFAULTS, Thresholds

KEY = ["match_id", "idx"]


def role_inputs(tables, requests: DataFrame | None = None, p: Thresholds = DEFAULTS) -> DataFrame:
    """Players with their role and one column per role metric."""
    players = P.with_roles(P.kill_participation(tables.players), requests)
    early = (E.early_late_times(tables.kills, E.death_times(tables.kills, tables.players), p)
             .filter("kind = 'early_kill'").groupBy(*KEY).agg(F.count("*").alias("early_kills")))
    df = (players
          .join(minute_value(tables.minutes, "lh", 10, "cs10"), KEY, "left")
          .join(early, KEY, "left")
          .join(G.fight_involvement(tables.fight_players), KEY, "left"))
    have = set(df.columns)

    def either(name: str):
        return F.col(name) if name in have else F.lit(None).cast("bigint")

    return df.select(
        *KEY, "role", "role_source", "cs10", "gpm", F.col("net_worth").alias("networth"), "hero_damage",
        F.col("kp").alias("kill_participation"), "xpm", either("rune_pickups").alias("runes"),
        F.coalesce("early_kills", F.lit(0)).alias("early_kills"), "damage_taken",
        X.half_even(F.col("stuns"), 1).alias("stuns"),
        F.coalesce("involved", F.lit(0)).alias("fight_involvement"),
        F.coalesce("fight_deaths", F.lit(0)).alias("fight_deaths"), "assists",
        either("camps_stacked").alias("camps_stacked"), either("creeps_stacked").alias("creeps_stacked"),
        F.concat(either("obs_placed").cast("string"), F.lit("/"), either("sen_placed").cast("string")).alias("wards"),
        (either("observer_kills") + either("sentry_kills")).alias("dewards"),
        F.col("hero_healing").alias("healing"))
