"""Team fights: outcome for each side, own contribution, involvement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlens.params import DEFAULTS, Thresholds

KEY = ["match_id", "idx"]


def fight_sides(fight_players: DataFrame) -> DataFrame:
    """Losses per side and the list of the fallen; a fight has at most ten player rows."""
    lost = F.coalesce("deaths", F.lit(0))
    dead = F.sort_array(F.collect_list(F.when(lost > 0, F.col("idx"))))
    return fight_players.groupBy("match_id", "fight_no").agg(
        F.sum(F.when(F.col("is_radiant"), lost).otherwise(0)).cast("bigint").alias("radiant_losses"),
        F.sum(F.when(~F.col("is_radiant"), lost).otherwise(0)).cast("bigint").alias("dire_losses"),
        dead.alias("fallen"))


def fight_outcome(fights: DataFrame, fight_players: DataFrame, players: DataFrame,
                  p: Thresholds = DEFAULTS) -> DataFrame:
    """One row per (fight, focal player): both sides' losses, verdict and own numbers."""
    spans = fights.select("match_id", "fight_no", "start", "end", F.col("deaths").alias("total_deaths"))
    sides = spans.join(fight_sides(fight_players), ["match_id", "fight_no"], "left")
    cols = ["deaths", "damage", "gold_delta", "xp_delta"]
    extra = ["killed"] if "killed" in fight_players.columns else []
    mine = fight_players.select(*KEY, "fight_no", *cols, *extra)
    rows = (sides.join(players.select(*KEY, "is_radiant"), "match_id")
            .join(mine, KEY + ["fight_no"], "left"))
    mine_lost = F.when(F.col("is_radiant"), F.col("radiant_losses")).otherwise(F.col("dire_losses"))
    their_lost = F.when(F.col("is_radiant"), F.col("dire_losses")).otherwise(F.col("radiant_losses"))
    zero = F.lit(0).cast("bigint")
    return rows.select(
        *KEY, "fight_no", "start", "end", F.col("total_deaths").alias("deaths"),
        F.coalesce(mine_lost, zero).alias("my_losses"), F.coalesce(their_lost, zero).alias("enemy_losses"),
        F.when(mine_lost < their_lost, "win").when(mine_lost > their_lost, "lose").otherwise("even")
        .alias("verdict"), "fallen",
        *[F.coalesce(F.col(c).cast("bigint"), zero).alias(f"my_{c}") for c in cols], *extra,
        (F.coalesce("start", F.lit(0)) <= p.lane_phase).alias("in_lane"))


def participants(fight_players: DataFrame) -> DataFrame:
    """Players who died or dealt damage; income alone is not taking part."""
    return fight_players.filter((F.coalesce("deaths", F.lit(0)) != 0) | (F.coalesce("damage", F.lit(0)) != 0))


def fight_involvement(fight_players: DataFrame) -> DataFrame:
    """Fights with own deaths, damage or healing, and deaths in fights."""
    died, hit, healed = (F.coalesce(c, F.lit(0)) for c in ("deaths", "damage", "healing"))
    return fight_players.groupBy(*KEY).agg(
        F.count_if((died != 0) | (hit != 0) | (healed != 0)).alias("involved"),
        F.sum(died).cast("bigint").alias("fight_deaths"))
