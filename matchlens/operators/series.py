"""Operators over the per-minute series of a match or player.

Series are long form (one row per minute). Those of a match are short, and windows run by match or by (match, player); for series that outgrow
a task the functions that look along them take ``chunk``, so many minutes at a time, whose results are carried over (see carry).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlens.operators import carry
from matchlens.params import DEFAULTS, Thresholds

KEY = ["match_id", "idx"]


def by_minute() -> Window:
    return Window.partitionBy("match_id").orderBy("m")


def team_advantage(minutes: DataFrame) -> DataFrame:
    """Radiant-relative gold lead rebuilt from the players' gold; missing points count 0."""
    sign = F.when(F.col("is_radiant"), 1).otherwise(-1)
    return minutes.filter("gold is not null").groupBy("match_id", "m").agg(
        F.sum(sign * F.col("gold")).cast("bigint").alias("gold"))


def advantage(supplied: DataFrame, minutes: DataFrame) -> DataFrame:
    """The supplied lead where a match has one, else the rebuilt one; supplied experience stays beside it."""
    own = supplied.groupBy("match_id", "m").agg(F.max("gold").alias("_own"), F.max("xp").alias("xp"))
    have = own.groupBy("match_id").agg((F.count("_own") > 0).alias("_have"))
    both = own.join(team_advantage(minutes), ["match_id", "m"], "full").join(have, "match_id", "left")
    rebuilt = ~F.coalesce("_have", F.lit(False))
    return (both.filter(rebuilt | F.col("_own").isNotNull() | F.col("xp").isNotNull())
            .select("match_id", "m", F.when(rebuilt, F.col("gold")).otherwise(F.col("_own")).alias("gold"), "xp"))


def per_side(df: DataFrame, *values: str) -> DataFrame:
    """Both teams' view of a Radiant-relative row: the sign flips for Dire."""
    both = df.withColumn("is_radiant", F.explode(F.array(F.lit(True), F.lit(False))))
    sign = F.when(F.col("is_radiant"), 1).otherwise(-1)
    return both.withColumns({v: (sign * F.col(v)).cast("bigint") for v in values})


def in_chunks(df: DataFrame, chunk: int | None) -> tuple[DataFrame, str | None]:
    return (df, None) if chunk is None else (df.withColumn("_chunk", F.floor(F.col("m") / chunk)), "_chunk")


def sign_swings(adv: DataFrame, chunk: int | None = None) -> DataFrame:
    """Minutes whose sign differs from the last non-zero one, for both sides."""
    sign = F.signum("gold").cast("int")
    points, cut = in_chunks(adv.select("match_id", "m", "gold", sign.alias("_sign")), chunk)
    known = carry.last_before(points, ["match_id"], ["m"], F.nullif(F.col("_sign"), F.lit(0)), "_before", cut)
    turned = known.filter("_sign <> 0 and _sign <> _before").select("match_id", "m", "gold")
    return per_side(turned, "gold").select(
        "match_id", "is_radiant", "m", "gold",
        F.when(F.col("gold") > 0, "ahead").otherwise("behind").alias("swing"))


def top_swings(swings: DataFrame, k: int = DEFAULTS.max_swings) -> DataFrame:
    w = Window.partitionBy("match_id", "is_radiant").orderBy(F.abs("gold").desc(), "m")
    return swings.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")


def peak_trough(adv: DataFrame) -> DataFrame:
    """First minute of the largest and of the smallest lead."""
    def first(lead: Column, name: str) -> Column:
        return F.max_by(F.struct("m", lead.alias("gold")), F.struct(lead, -F.col("m"))).alias(name)

    ends = adv.groupBy("match_id").agg(first(F.col("gold"), "hi"), first(-F.col("gold"), "lo"))
    rows = ends.select("match_id", F.inline(F.array(
        F.struct(F.lit(True).alias("is_radiant"), F.col("hi").alias("best"), F.col("lo").alias("worst")),
        F.struct(F.lit(False).alias("is_radiant"), F.col("lo").alias("best"), F.col("hi").alias("worst")))))
    return rows.select("match_id", "is_radiant", F.col("best.m").alias("best_m"),
                       F.col("best.gold").alias("best_gold"), F.col("worst.m").alias("worst_m"),
                       (-F.col("worst.gold")).alias("worst_gold"))


def thin_series(df: DataFrame, keys: list[str], step: int = DEFAULTS.thin_step) -> DataFrame:
    """Every ``step``-th minute and the match's last one; minutes that a series lacks are null.

    All series of a match share one grid, which ends with the longest of them.
    """
    match = Window.partitionBy("match_id")
    grid = (df.groupBy(*keys).agg(F.min("m").alias("_from"), F.max("m").alias("_to"))
            .withColumns({"_from": F.least(F.min("_from").over(match), F.lit(0)), "_to": F.max("_to").over(match)})
            .select(*keys, F.explode(F.filter(
                F.sequence("_from", F.greatest("_from", "_to")),
                lambda m: (m % step == 0) | (m == F.col("_to")))).alias("m"), "_to").drop("_to"))
    return grid.join(df, [*keys, "m"], "left")


def longest_stall(minutes: DataFrame, p: Thresholds = DEFAULTS, chunk: int | None = None) -> DataFrame:
    """Longest run of minutes with an income below a share of the player's own mean."""
    own = Window.partitionBy(*KEY)
    points, cut = in_chunks(minutes.select(*KEY, "m", "gold").filter("gold is not null"), chunk)
    steps = carry.rows_away(points, KEY, ["m"], "gold", "_earlier", -1, cut).withColumn("_delta", F.col("gold") - F.col("_earlier"))
    mean, count = F.avg("_delta"), F.count("*")
    if cut is None:
        steps = steps.withColumn("_mean", mean.over(own)).withColumn("_points", count.over(own))
    else:
        steps = steps.join(steps.groupBy(*KEY).agg(mean.alias("_mean"), count.alias("_points")), KEY)
    steps = steps.filter((F.col("_points") >= p.stall_from + p.stall_length + 1) & (F.col("_mean") > 0)
                         & (F.col("m") >= p.stall_from) & (F.col("_delta") < F.col("_mean") * p.stall_ratio))
    # A run is what keeps its distance to the numbering; a run over several chunks is one group.
    runs = (carry.row_numbers(steps, KEY, ["m"], "_nth", cut).withColumn("_run", F.col("m") - F.col("_nth"))
            .groupBy(*KEY, "_run")
            .agg(F.min("m").alias("start"), F.max("m").alias("end"),
                 F.sum("_delta").alias("span"), F.first("_mean").alias("mean")))
    length = F.col("end") - F.col("start") + 1
    best = F.max_by(F.struct("start", "end", "span", "mean"), F.struct(length, -F.col("start")))
    return (runs.groupBy(*KEY).agg(best.alias("_b")).select(*KEY, "_b.*")
            .filter(length >= p.stall_length)
            .select(*KEY, "start", "end",
                    F.bround(F.col("span") / length).cast("bigint").alias("rate"),
                    F.bround("mean").cast("bigint").alias("average")))


def worst_drop(adv: DataFrame, p: Thresholds = DEFAULTS, chunk: int | None = None) -> DataFrame:
    """The fixed-length stretch in which a side's lead fell most, when the loss is large."""
    points, cut = in_chunks(adv.select("match_id", "m", "gold"), chunk)
    later = carry.rows_away(points, ["match_id"], ["m"], "gold", "_later", p.collapse_window, cut)
    moves = later.select("match_id", "m", (F.col("_later") - F.col("gold")).alias("change")).filter("change is not null")
    worst = F.min_by(F.struct("m", "change"), F.struct("change", "m"))
    return (per_side(moves, "change").groupBy("match_id", "is_radiant").agg(worst.alias("_w"))
            .select("match_id", "is_radiant", F.col("_w.m").alias("start"),
                    (F.col("_w.m") + p.collapse_window).alias("end"),
                    (-F.col("_w.change")).alias("loss"))
            .filter(F.col("loss") >= p.collapse_loss))


def early_grid(players: DataFrame, minutes: DataFrame, upto: int = 10) -> DataFrame:
    """Minutes 1..upto of every player; points the series lacks are null."""
    grid = players.select(*KEY, F.explode(F.sequence(F.lit(1), F.lit(upto))).alias("m"))
    early = minutes.filter(F.col("m").between(1, upto)).select(*KEY, "m", "lh", "dn", "gold", "xp")
    return grid.join(early, KEY + ["m"], "left")


def stage_changes(adv: DataFrame, p: Thresholds = DEFAULTS) -> DataFrame:
    """Change of the lead over consecutive stages of a match; a lone point has none."""
    adv = adv.filter("gold is not null")
    last = F.max("m").over(Window.partitionBy("match_id"))
    w = by_minute()
    ahead = F.coalesce(F.lead("gold", p.stage_step).over(w),
                       F.last_value("gold").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return (adv.select("match_id", "m", "gold", last.alias("_last"), ahead.alias("_end"))
            .filter((F.col("m") % p.stage_step == 0) & (F.col("m") < F.least("_last", F.lit(p.stage_last))))
            .select("match_id", F.col("m").alias("start"), (F.col("_end") - F.col("gold")).alias("change")))
