"""Analysis of one account over its recent matches.

The sample is at most twenty matches per account, chosen first with a ranking limit that
Spark applies before the shuffle; all later groups are bounded by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlens.functions import text as X
from matchlens.params import DEFAULTS, ROLES, ROLE_LANE, TREND_METRICS, Thresholds

KEY = ["match_id", "idx"]
SAMPLE = ["account_id", "match_id", "idx", "rec_no"]


def who(df: DataFrame) -> list[str]:
    """Key of a profile: the account, and the request where an account may have several."""
    return [c for c in ("account_id", "request_id") if c in df.columns]


def recent(rows: DataFrame, account: str | list[str], recency: list[Column], limit: int | Column, out: str = "rec_no",
           at_most: int | None = None, ties: bool = False) -> DataFrame:
    """The newest ``limit`` rows per account, numbered from the newest.

    With ``ties`` equal recencies share a number. A constant limit lets Spark drop older rows before the
    shuffle; where the limit is a column, ``at_most`` can state its largest value.
    """
    keys = [account] if isinstance(account, str) else account
    w = Window.partitionBy(*keys).orderBy(*recency)
    number = F.dense_rank() if ties else F.row_number()
    known = rows.filter(F.col(keys[0]).isNotNull()).withColumn(out, number.over(w))
    bound = F.col(out) <= limit
    return known.filter(bound if at_most is None else (F.col(out) <= at_most) & bound)


def capped_sample(players: DataFrame, wanted: DataFrame, available: DataFrame | None = None,
                  p: Thresholds = DEFAULTS) -> DataFrame:
    """Matches that enter each account's profile.

    ``wanted(account_id, n, role[, hero_id])`` gives size (clamped to 2..20), optional position and
    optional hero. With a position the history is twice as long, narrowed to the position's lane,
    and rows of other positions are passed over. Matches missing from ``available`` are skipped, not
    replaced unless a position made the history longer.
    """
    hero = F.col("hero_id") if "hero_id" in wanted.columns else F.lit(None).cast("int")
    ask = wanted.select(*who(wanted), F.greatest(F.lit(p.min_matches), F.least(F.lit(p.max_matches), "n"))
                        .alias("_n"), F.col("role").alias("_role"), hero.alias("_hero"))
    lanes = F.create_map(*[F.lit(x) for kv in ROLE_LANE.items() for x in kv])
    lane = F.try_element_at(lanes, F.col("_role"))
    history = (players.join(ask, "account_id")
               .filter((F.col("_role").isNull() | (F.col("lane_role") == lane))
                       & (F.col("_hero").isNull() | (F.col("hero_id") == F.col("_hero")))))
    budget = F.when(F.col("_role").isNull(), F.col("_n")).otherwise(2 * F.col("_n"))
    by = who(wanted)
    tried = recent(history, by, [F.col("match_id").desc()], budget, "_tried", 2 * p.max_matches, ties=True)
    once = Window.partitionBy(*by, "match_id").orderBy("idx")    # the first player of that account counts
    tried = tried.withColumn("_nth", F.row_number().over(once)).filter("_nth = 1").drop("_nth")
    if available is not None:
        tried = tried.join(available.select("match_id").distinct(), "match_id", "left_semi")
    passed = tried.filter(F.col("_role").isNull() | (F.col("position") == F.col("_role")))
    w = Window.partitionBy(*by).orderBy("_tried")
    return (passed.withColumn("rec_no", F.row_number().over(w))
            .filter((F.col("rec_no") <= p.max_matches) & (F.col("rec_no") <= F.col("_n")))
            .select(*by, *[c for c in SAMPLE if c not in by]))


def match_digest(players_kp: DataFrame, sample: DataFrame, cs10: DataFrame, deviations: DataFrame) -> DataFrame:
    """One row per sampled match with the axes it deviated on."""
    axes = deviations.groupBy(*KEY).agg(F.sort_array(F.collect_set("axis")).alias("axes"))
    return (sample.join(players_kp.drop("account_id"), KEY).join(cs10, KEY, "left").join(axes, KEY, "left")
            .select(*sample.columns, F.col("hero_name").alias("hero"), F.col("position").alias("role"), "win",
                    "duration", "kills", "deaths", "assists", "gpm", "xpm", "cs10", "net_worth", "kp",
                    "lane_eff", "patch", "parsed",
                    F.coalesce("axes", F.array().cast("array<string>")).alias("axes")))


def minute_value(minutes: DataFrame, column: str, minute: int, out: str) -> DataFrame:
    return minutes.filter(F.col("m") == minute).select(*KEY, F.col(column).alias(out))


def profile_averages(digests: DataFrame) -> DataFrame:
    def mean(col: str, digits: int = 0) -> Column:
        return X.half_even(F.avg(col), digits)

    wins = F.count_if("win")
    return digests.groupBy(*who(digests)).agg(
        F.count("*").alias("matches"), wins.alias("wins"), (F.count("*") - wins).alias("losses"),
        F.bround(100 * wins / F.count("*")).cast("bigint").alias("winrate"),
        mean("gpm").alias("gpm"), mean("xpm").alias("xpm"), mean("cs10").alias("cs10"),
        mean("kills", 1).alias("kills"), mean("deaths", 1).alias("deaths"), mean("assists", 1).alias("assists"),
        F.max("deaths").cast("bigint").alias("deaths_max"), mean("kp").alias("kp"),
        mean("lane_eff").alias("lane_eff"), mean("duration").alias("duration"), mean("net_worth").alias("net_worth"))


def profile_trends(benchmarks: DataFrame, sample: DataFrame, p: Thresholds = DEFAULTS) -> DataFrame:
    """Mean percentile per metric and the change between the newer and the older half."""
    pct = X.half_even(F.col("pct") * 100)
    known = (benchmarks.filter(F.col("metric").isin(*TREND_METRICS) & F.col("pct").isNotNull())
             .join(sample, KEY).select(*who(sample), "metric", "rec_no", pct.alias("pct")))
    by = Window.partitionBy(*who(sample), "metric")
    series = known.withColumn("_n", F.count("*").over(by)).withColumn(
        "_i", F.row_number().over(by.orderBy("rec_no")))
    newer = F.col("_i") <= F.greatest(F.lit(1), F.floor(F.col("_n") / 2))
    sums = series.groupBy(*who(sample), "metric").agg(
        F.avg("pct").alias("_avg"), F.min("pct").alias("low"), F.max("pct").alias("high"),
        F.count("*").alias("samples"),
        (F.avg(F.when(newer, F.col("pct"))) - F.avg(F.when(~newer, F.col("pct")))).alias("_delta"))
    flat = (F.col("samples") < p.trend_min_series) | (F.abs("_delta") < p.trend_min_delta)
    return sums.filter(F.col("samples") >= p.min_matches).select(
        *who(sample), "metric", X.half_even(F.col("_avg")).alias("avg"), "low", "high",
        F.when(flat, "flat").when(F.col("_delta") > 0, "up").otherwise("down").alias("direction"),
        X.half_even(F.abs("_delta")).alias("delta"), "samples")


def profile_patterns(deviations: DataFrame, sample: DataFrame, p: Thresholds = DEFAULTS) -> DataFrame:
    """Deviations that recur: counted once per match, with the first two examples."""
    size = sample.groupBy(*who(sample)).agg(F.count("*").alias("total")).filter(
        F.col("total") >= p.min_matches)
    seq = F.struct("rec_no", "ord")
    found = (deviations.join(sample, KEY).groupBy(*who(sample), "key").agg(
        F.countDistinct("match_id").alias("count"), F.max_by("axis", seq).alias("axis"),
        F.slice(F.sort_array(F.collect_list(F.struct(
            "rec_no", "ord", F.map_entries("params").alias("params")))), 1, 2).alias("_first")))
    floor = F.greatest(F.lit(p.pattern_min), F.bround(F.lit(p.pattern_share) * F.col("total")).cast("int"))
    return (found.join(size, who(sample)).filter(F.col("count") >= floor)
            .select(*who(sample), "key", "axis", "count", "total",
                    F.bround(100 * F.col("count") / F.col("total")).cast("bigint").alias("share"),
                    F.transform("_first", lambda e: F.map_from_entries(e["params"])).alias("examples")))


def stage_profile(changes: DataFrame, sample: DataFrame, players: DataFrame,
                  p: Thresholds = DEFAULTS) -> DataFrame:
    """Mean change of the own lead per stage over the sampled matches."""
    side = sample.join(players.select(*KEY, "is_radiant"), KEY)
    own = F.when(F.col("is_radiant"), F.col("change")).otherwise(-F.col("change"))
    end = F.least(F.col("start") + p.stage_step, F.lit(p.stage_last))
    return (side.join(changes, "match_id").groupBy(*who(sample), "start")
            .agg(X.half_even(F.avg(own)).alias("change"), F.count("*").alias("samples"))
            .select(*who(sample), "start", end.alias("end"), "change", "samples"))


def stage_verdict(stages: DataFrame, p: Thresholds = DEFAULTS) -> DataFrame:
    """Coverage, up to two weak stages and the strong one; a thin sample gets no verdict.

    An account has at most ten stages.
    """
    by = Window.partitionBy(*who(stages))
    rows = stages.withColumn("coverage", F.max("samples").over(by))
    floor = F.greatest(F.lit(p.stage_min_samples), F.bround(F.col("coverage") / 2).cast("int"))
    thin = F.col("coverage") < p.stage_min_samples
    rows = rows.withColumn("_fair", ~thin & (F.col("samples") >= floor))
    weak = F.when(F.col("_fair") & (F.col("change") < 0), F.struct("change", "start", "end"))
    strong = F.when(F.col("_fair") & (F.col("change") > 0), F.struct("start", "end", "change"))
    return rows.groupBy(*who(stages), "coverage").agg(
        F.transform(F.slice(F.sort_array(F.collect_list(weak)), 1, p.max_weak_stages),
                    lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"),
                                       s["change"].alias("change"))).alias("weak"),
        F.max_by(strong, F.when(strong.isNotNull(), F.struct("change", -F.col("start")))).alias("strong")
    ).withColumn("thin", thin)


def hero_mix(digests: DataFrame) -> DataFrame:
    mix = digests.groupBy(*who(digests), "hero").agg(
        F.count("*").alias("games"), F.count_if("win").alias("wins"), F.min("rec_no").alias("_seen"))
    w = Window.partitionBy(*who(digests)).orderBy(F.col("games").desc(), "_seen")   # twenty at most
    return mix.withColumn("ord", F.row_number().over(w)).drop("_seen")


def sample_caveats(digests: DataFrame, wanted: DataFrame, p: Thresholds = DEFAULTS) -> DataFrame:
    """What limits the sample, and the single warning shown for it.

    Every request has its row: one without a usable match counts none and warns ``empty``. The size that was asked for is
    clamped as in ``capped_sample`` before it is compared.
    """
    by = who(wanted)
    seen = digests.groupBy(*by).agg(
        F.count("*").alias("analyzed"), F.count_if(~F.col("parsed")).alias("unparsed"),
        F.countDistinct(F.when(F.col("role").isin(*ROLES), F.col("role"))).alias("_roles"),
        F.sort_array(F.collect_set(F.nullif("patch", F.lit("")))).alias("_patches"))
    asked = F.greatest(F.lit(p.min_matches), F.least(F.lit(p.max_matches), "n"))
    ask = wanted.select(*by, asked.alias("requested"), F.col("role").alias("_role"))
    counted = ask.join(seen, by, "left").fillna(0, ["analyzed", "unparsed"])
    return counted.select(
        *by, "requested", "analyzed", "unparsed",
        F.when(F.col("_role").isNull() & (F.col("_roles") > 1), F.col("_roles")).alias("mixed_roles"),
        F.when(F.size("_patches") > 1, F.array_join("_patches", ", ")).alias("patches"),
        F.when(F.col("analyzed") == 0, "empty").when(F.col("unparsed") > 0, "unparsed")
        .when(F.col("analyzed") < F.col("requested"), "short").alias("warning"))
