"""Purchase logs: absorbed components, assembled builds and their pace."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlens.functions import text as X
from matchlens.operators import carry
from matchlens.params import ALWAYS_KEY_ITEMS, DEFAULTS, UTILITY_ITEMS, Thresholds

KEY = ["match_id", "idx"]


def with_items(purchases: DataFrame, items: DataFrame) -> DataFrame:
    """Purchases with the item's name, cost, quality and components (technical key as fallback)."""
    dim = items.select(
        F.col("key").alias("_key"), "dname", "cost", "qual",
        F.filter("components", lambda c: (c.isNotNull()) & (c != "")).alias("components"))
    clean = purchases.withColumn("key", X.without(F.coalesce("key", F.lit("")), X.ITEM_PREFIX))
    return clean.join(dim, F.col("key") == F.col("_key"), "left").select(
        *purchases.columns, "components",
        F.coalesce(F.nullif("dname", F.lit("")), "key").alias("item"),
        F.coalesce("cost", F.lit(0)).cast("bigint").alias("cost"),
        F.coalesce("qual", F.lit("")).alias("qual"))


def absorb_components(purchases: DataFrame, order: list[str], chunk: str | None = None) -> DataFrame:
    """Marks purchases that a later assembled item used up.

    An assembled item takes, per needed component, the nearest earlier purchase not yet
    taken: a stack per (player, component). With +1 for a purchase and -1 for a need, a
    purchase is taken exactly when the running sum later falls below its value right after
    the purchase, so a running sum and a look-ahead minimum answer it. ``purchases`` comes
    from ``with_items``; ``chunk`` splits one log that outgrows a task.
    """
    part = F.inline(F.concat(
        F.array(F.struct(F.col("key").alias("_part"), F.lit(1).alias("_d"), F.lit(2 ** 30).alias("_at"))),
        F.coalesce(F.transform("components", lambda c, i: F.struct(
            c.alias("_part"), F.lit(-1).alias("_d"), i.cast("int").alias("_at"))),
            F.array().cast("array<struct<_part:string,_d:int,_at:int>>"))))
    columns = [c for c in purchases.columns if c != "components"]
    moves = purchases.select(*columns, part)
    if chunk is None:
        moves = moves.repartition(*KEY)      # serves every later window of the same log
    keys = KEY + ["_part"]
    cell = keys + ([chunk] if chunk else [])
    # The look-ahead runs backwards: a frame open to the end would be added up anew for every row.
    along = [*order, "_at"]
    ahead = Window.partitionBy(*cell).orderBy(*along).rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*cell).orderBy(*[F.col(c).desc() for c in along]).rowsBetween(
        Window.unboundedPreceding, -1)
    level = (moves.withColumn("_level", F.sum("_d").over(ahead))
             .withColumn("_low", F.min("_level").over(back)))
    if chunk:
        ends = level.groupBy(*cell).agg(F.sum("_d").alias("_total"), F.min("_level").alias("_min"))
        before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
        after = Window.partitionBy(*keys).orderBy(F.col(chunk).desc()).rowsBetween(Window.unboundedPreceding, -1)
        ends = (ends
                .withColumn("_base", F.coalesce(F.sum("_total").over(before), F.lit(0)))
                .withColumn("_later", F.min(F.col("_base") + F.col("_min")).over(after) - F.col("_base"))
                .select(*cell, "_later"))
        level = (level.join(ends, cell)
                 .withColumn("_low", F.least("_low", "_later")).drop("_later"))
    return level.filter("_d = 1").select(
        *columns, F.coalesce(F.col("_low") < F.col("_level"), F.lit(False)).alias("absorbed"))


def assembled(absorbed: DataFrame, min_cost: int) -> DataFrame:
    """Items that stayed: no components, recipes or consumables, nothing below ``min_cost``."""
    return absorbed.filter(
        ~F.col("absorbed") & ~F.col("key").startswith("recipe_") & ~F.col("qual").contains("consumable")
        & (F.col("key").isin(*ALWAYS_KEY_ITEMS) | (F.col("cost") >= min_cost))).drop("absorbed")


def pace_lag(build: DataFrame, gpm: DataFrame, order: list[str], p: Thresholds = DEFAULTS,
             chunk: str | None = None) -> DataFrame:
    """Items that came late against the pace of the player's own build.

    Expected minute = cost so far / gold per minute; the median difference over the build is
    the player's baseline. At most ``max_lags`` items per player, the latest first.
    """
    priced = build.filter((F.col("cost") > 0) & F.col("t").isNotNull())
    paced = carry.prefix_sum(priced, KEY, order, F.col("cost"), "_sum", chunk)
    actual, expected = F.col("t") / 60.0, F.col("_sum") / F.col("gpm")
    rows = paced.join(gpm.filter("gpm > 0").select(*KEY, "gpm"), KEY).select(
        *KEY, *order, "t", "item", "cost", "gpm", actual.alias("_actual"), expected.alias("_expected"),
        (actual - expected).alias("_lag"))
    excess = F.col("_lag") - F.col("_base")
    late = (carry.with_median(rows, KEY, "_lag", "_base", "_items", chunk is not None)
            .filter((F.col("_items") >= 3) & (F.col("cost") >= p.lag_min_cost) & (excess >= p.lag_minutes)
                    & (F.col("_actual") >= F.col("_expected") * p.lag_factor))
            .withColumns({"excess": excess, "severity": X.clamp01(excess / p.lag_scale)}))
    w = Window.partitionBy(*KEY).orderBy(F.col("severity").desc(), *order)
    return (late.withColumn("ord", F.row_number().over(w)).filter(F.col("ord") <= p.max_lags)
            .select(*KEY, F.col("ord").cast("bigint").alias("ord"), "item", X.mmss(F.col("t")).alias("at"),
                    F.bround("excess").cast("bigint").alias("excess"), "gpm",
                    F.floor((F.col("_expected") + F.col("_base")) * 60).cast("bigint").alias("expected"),
                    "severity"))


def first_per_key(purchases: DataFrame, order: list[str], keys: tuple[str, ...] = UTILITY_ITEMS) -> DataFrame:
    """First purchase of each listed key, in log order."""
    wanted = purchases.withColumn("key", X.without(F.col("key"), X.ITEM_PREFIX)).filter(
        F.col("key").isin(*keys))
    at = F.struct(*order)
    return (wanted.groupBy(*KEY, "key")
            .agg(F.min_by("t", at).alias("t"), F.min(at).alias("_at"))
            .select(*KEY, "key", "t", *[F.col(f"_at.{c}").alias(f"at_{c}") for c in order]))


def full_log(purchases: DataFrame, order: list[str], chunk: str | None = None) -> DataFrame:
    """Every purchase with its place in the player's log."""
    return carry.row_numbers(purchases, KEY, order, "pos", chunk)


def role_items(players: DataFrame, key_items: DataFrame, utility: DataFrame) -> DataFrame:
    """Assembled items for roles 1 and 2, first utility purchases for roles 3 to 5."""
    role = players.select(*KEY, *[c for c in ("request_id",) if c in players.columns], "role")
    core = key_items.select(*KEY, "key", "t").join(role.filter(F.col("role").isin("1", "2")), KEY)
    support = utility.select(*KEY, "key", "t").join(role.filter(F.col("role").isin("3", "4", "5")), KEY)
    return (core.withColumn("kind", F.lit("key_items"))
            .unionByName(support.withColumn("kind", F.lit("utility_items"))))
