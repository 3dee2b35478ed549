"""Draft order: is it the real one, and what could a player see when picking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlens.functions import text as X

KEY = ["match_id", "idx"]


def draft_chronological(picks: DataFrame) -> DataFrame:
    """False when all picks come before all bans (both present); matches without rows are absent."""
    order = F.col("ord")
    last_pick = F.max(F.when(F.col("is_pick"), order))
    first_ban = F.min(F.when(~F.col("is_pick"), order))
    return picks.groupBy("match_id").agg(
        F.coalesce(last_pick > first_ban, F.lit(True)).alias("chronological"))


def draft_flag(matches: DataFrame, picks: DataFrame) -> DataFrame:
    """The same for every match: an empty draft is not chronological."""
    return (matches.select("match_id").join(draft_chronological(picks), "match_id", "left")
            .withColumn("chronological", F.coalesce("chronological", F.lit(False))))


def draft_my_pick(picks: DataFrame, players: DataFrame) -> DataFrame:
    """Place of each player's hero among the picks and the heroes shown before and after.

    A draft has a fixed, small number of picks, so its windows stay inside one match.
    """
    w = Window.partitionBy("match_id").orderBy("ord")
    seen = w.rowsBetween(Window.unboundedPreceding, -1)
    unseen = w.rowsBetween(1, Window.unboundedFollowing)
    hero = F.struct("is_radiant", "hero_name")
    ranked = (picks.filter("is_pick").select("match_id", "ord", "is_radiant", "hero_name")
              .withColumn("rank", F.row_number().over(w))
              .withColumn("total", F.count("*").over(Window.partitionBy("match_id")))
              .withColumn("_before", F.collect_list(hero).over(seen))
              .withColumn("_after", F.collect_list(hero).over(unseen)))
    mine = (players.select(*KEY, "is_radiant", "hero_name")
            .join(ranked, ["match_id", "is_radiant", "hero_name"])
            .withColumn("_first", F.row_number().over(Window.partitionBy(*KEY).orderBy("rank")))
            .filter("_first = 1"))

    def heroes(rows: str, own: bool):
        side = (lambda h: h["is_radiant"] == F.col("is_radiant")) if own else (
            lambda h: h["is_radiant"] != F.col("is_radiant"))
        return F.transform(F.filter(rows, side), lambda h: h["hero_name"])

    return mine.select(
        *KEY, F.col("rank").cast("bigint").alias("order"), "total",
        F.when(F.col("rank") == 1, "first").when(F.col("rank") == F.col("total"), "last")
        .otherwise("mid").alias("tag"),
        heroes("_before", False).alias("enemies_before"), heroes("_before", True).alias("allies_before"),
        heroes("_after", False).alias("enemies_after"), heroes("_after", True).alias("allies_after"))


def draft_rows(picks: DataFrame) -> DataFrame:
    return picks.select("match_id", "ord", "is_pick", X.side(F.col("is_radiant")).alias("side"), "hero_name")


def pick_side(team: Column) -> Column:
    """Team 0 is Radiant; another code, or none, is Dire."""
    return F.coalesce(team == 0, F.lit(False))
