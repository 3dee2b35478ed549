"""Look-up joins with technical names as fallback.

Dimension tables are joined without a broadcast hint: Spark broadcasts a side when its
measured size is under the session's threshold and shuffles it otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlens.functions import text as X


def with_name(df: DataFrame, key: str, dim: DataFrame, dim_key: str, dim_name: str, out: str,
              fallback: Column) -> DataFrame:
    """``out`` is the looked-up name, or ``fallback`` where the key or its name is missing."""
    names = dim.select(F.col(dim_key).alias("_k"), F.nullif(F.col(dim_name), F.lit("")).alias("_name"))
    return (df.join(names, F.col(key) == F.col("_k"), "left")
            .withColumn(out, F.coalesce("_name", fallback)).drop("_k", "_name"))


def numbered(prefix: str, key: str) -> Column:
    """Fallback such as ``hero_5``; a missing id prints as None."""
    return F.concat(F.lit(prefix), F.coalesce(F.col(key).cast("string"), F.lit("None")))


def hero_names(df: DataFrame, heroes: DataFrame, key: str = "hero_id", out: str = "hero_name") -> DataFrame:
    return with_name(df, key, heroes, "id", "localized_name", out, numbered("hero_", key))


def mode_names(df: DataFrame, dim: DataFrame, key: str, prefix: str, out: str) -> DataFrame:
    """Game modes and lobby types: prefix and underscores removed from the stored name."""
    clean = dim.select("id", X.squeeze(F.replace(X.without(F.col("name"), prefix), F.lit("_"), F.lit(" ")))
                       .alias("name"))
    return with_name(df, key, clean, "id", "name", out, numbered(prefix.split("_")[0].replace("game", "mode") + "_", key))


def ability_names(df: DataFrame, ability_ids: DataFrame, abilities: DataFrame, key: str,
                  out: str = "ability") -> DataFrame:
    """id -> internal name -> display name without tokens; also the talent flag."""
    ids = ability_ids.select(F.col("id").alias("_id"), F.nullif("internal", F.lit("")).alias("_internal"))
    names = abilities.select(F.col("internal").alias("_a"),
                             F.nullif(X.strip_tokens(F.col("dname")), F.lit("")).alias("_dname"))
    return (df.join(ids, F.col(key) == F.col("_id"), "left")
            .join(names, F.col("_internal") == F.col("_a"), "left")
            .withColumn(out, F.coalesce("_dname", "_internal", numbered("ability_", key)))
            .withColumn("talent", F.coalesce(F.col("_internal").startswith("special_bonus"), F.lit(False)))
            .drop("_id", "_internal", "_a", "_dname"))


def buff_names(df: DataFrame, buffs: DataFrame, items: DataFrame, abilities: DataFrame, key: str,
               out: str = "buff") -> DataFrame:
    """id -> internal name -> item name, else ability name, else the prettified internal name."""
    ids = buffs.select(F.col("id").alias("_id"), F.nullif("internal", F.lit("")).alias("_internal"))
    item = items.select(F.col("key").alias("_item"), F.nullif("dname", F.lit("")).alias("_iname"))
    ability = abilities.select(F.col("internal").alias("_a"),
                               X.strip_tokens(F.nullif("dname", F.lit(""))).alias("_aname"))
    return (df.join(ids, F.col(key) == F.col("_id"), "left")
            .join(item, X.without(F.col("_internal"), X.ITEM_PREFIX) == F.col("_item"), "left")
            .join(ability, F.col("_internal") == F.col("_a"), "left")
            .withColumn(out, F.coalesce("_iname", "_aname", X.prettify(F.col("_internal")),
                                        numbered("buff#", key)))
            .drop("_id", "_internal", "_item", "_iname", "_a", "_aname"))
