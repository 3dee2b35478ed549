"""Every operator run over the general tables (see sources.bind for the roles they play)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlens.functions import lookup as L
from matchlens.functions import text as X
from matchlens.operators import anchored as A, bench, build as B, career as C, detectors as D, documents as T
from matchlens.operators import draft, events as E, fights as G, players as P, requests as Q
from matchlens.operators import resolve as R, series as S
from matchlens.params import FOCUSES, LANGUAGES, MODELS, WRAPPERS
from matchlens.plans import deviations as V
from matchlens.plans.role_impact import role_inputs
from matchlens.plans.share import keep
from matchlens.sources.bind import LIMITS, Bound
from matchlens.sources import sinks
from matchlens.session import new_folder
from matchlens.sources.landing import latest_version
from matchlens.sources.versioned import VersionedTable
from matchlens.streaming import feedback as FB
from matchlens.streaming.fanout import FanOut

KEY = ["match_id", "idx"]
LOG = ["ts", "event_id"]
Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Callable[[Bound], DataFrame]) -> Callable[[Bound], DataFrame]:
    """Registers a query over the lazy tables."""
    REGISTRY[fn.__name__] = lambda spark, sf_dir: plain(fn(Bound(spark, sf_dir)))
    return fn


def wide_query(fn: Callable[[Bound], DataFrame]) -> Callable[[Bound], DataFrame]:
    """The same for plans whose branches read the player reductions many times."""
    REGISTRY[fn.__name__] = lambda spark, sf_dir: plain(fn(Bound(spark, sf_dir, shared=True)))
    return fn


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint and arrays of names as one string, so engines compare equal."""
    out = []
    for name, kind in df.dtypes:
        col = F.col(f"`{name}`")
        if kind in ("int", "smallint", "tinyint"):
            col = col.cast("bigint")
        elif kind.startswith("array<"):
            col = F.array_join(col.cast("array<string>"), ",")
        elif kind == "map<string,string>":
            col = params_text(col)
        out.append(col.alias(name))
    return df.select(*out)


def params_text(params: Column) -> Column:
    pairs = F.array_sort(F.map_entries(params))
    return F.array_join(F.transform(pairs, lambda e: F.concat_ws("=", e["key"], e["value"])), ";")


def one_of(options, at: Column) -> Column:
    """The option at a zero-based place."""
    return F.get(F.array(*[F.lit(o) for o in options]), at.cast("int"))


# --- scans ----------------------------------------------------------------------------

@query
def scan_events(b: Bound) -> DataFrame:
    props = F.from_json("props", "k bigint")
    return b.table("events").select(
        "event_id", "user_id", "event_type", F.round(F.col("value") * 100).cast("bigint").alias("cents"),
        F.coalesce(props.getField("k"), F.lit(0)).alias("k"))


@query
def latest_version_per_key(b: Bound) -> DataFrame:
    orders = b.table("orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return latest_version(orders, "o_custkey", F.col("o_orderstatus") == "F",
                          [F.col("o_orderdate"), F.col("o_orderkey")]).drop("o_orderdate")


@query
def upserted_versions(b: Bound) -> DataFrame:
    """The same by upserts of three batches into a versioned table."""
    orders = b.table("orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    table = VersionedTable(b.spark, new_folder(b.spark, "orders"), "o_custkey", lambda: F.col("o_orderstatus") == "F", ["o_orderdate", "o_orderkey"], buckets=16)
    for epoch in range(3):
        table.upsert(orders.where(F.pmod(F.xxhash64("o_orderkey"), F.lit(3)) == epoch), epoch)
    return table.read().drop("o_orderdate")


@query
def recent_n_per_account(b: Bound) -> DataFrame:
    orders = b.table("orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return C.recent(orders, "o_custkey", [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()],
                    5).drop("o_orderdate")


@query
def explode_props(b: Bound) -> DataFrame:
    return b.table("events").select(
        "event_id", F.explode(F.from_json("props", "map<string,bigint>")).alias("key", "val"))


@query
def explode_series(b: Bound) -> DataFrame:
    return b.table("embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "val")).select(
        "vec_id", "pos", F.col("val").cast("double").alias("val"))


# --- projections, filters, classification ---------------------------------------------

@query
def player_projection(b: Bound) -> DataFrame:
    return b.players.select(*KEY, "hero_name", "is_radiant", "kills", "deaths", "assists", "last_hits", "denies",
                            "gpm", "xpm", "net_worth", "damage_taken", "seconds_dead", "lane_eff")


@query
def net_worth_fallback(b: Bound) -> DataFrame:
    final = F.when(F.col("idx") % 3 == 0, 0).otherwise(F.col("total_gold"))
    players = b.totals.withColumn("net_worth_final", final)
    return P.net_worth_fallback(players, b.minutes).select(*KEY, "net_worth_final", "net_worth")


@query
def assign_positions(b: Bound) -> DataFrame:
    return b.players.select(*KEY, "lane_key", "is_core", "position")


@query
def classify_events(b: Bound) -> DataFrame:
    return E.classify_objectives(b.objectives)


@query
def major_events(b: Bound) -> DataFrame:
    return E.major_only(E.classify_objectives(b.objectives)).select("match_id", "event_id", "t", "kind")


@query
def early_events(b: Bound) -> DataFrame:
    return E.early_events(b.ev, "t", LIMITS).select("event_id", *KEY, "t")


@query
def early_late_times(b: Bound) -> DataFrame:
    return E.early_late_times(b.kills, E.death_times(b.kills, b.players), LIMITS)


@query
def first_per_key(b: Bound) -> DataFrame:
    return B.first_per_key(b.purchases, LOG, ("purchase", "signup", "view")).select(*KEY, "key", "t")


@query
def kill_participation(b: Bound) -> DataFrame:
    return P.kill_participation(b.players).select(*KEY, "kills", "assists", "team_kills", "kp")


@query
def scoreboard(b: Bound) -> DataFrame:
    return P.scoreboard(b.players)


@query
def match_meta(b: Bound) -> DataFrame:
    return P.match_meta(b.matches, b.players)


@query
def combat_counters(b: Bound) -> DataFrame:
    kills, level = F.col("kills"), F.col("level")
    hit = F.struct(F.col("hero_damage").alias("value"),
                   F.concat(F.lit(X.HERO_PREFIX), F.col("idx").cast("string")).alias("key"))
    one = F.lit(1)
    counters = {
        "kill_streaks": F.create_map(kills.cast("string"), one, (kills + level + 1).cast("string"), one),
        "multi_kills": F.create_map((level + 2).cast("string"), one), "max_hero_hit": hit,
        "camps_stacked": level, "rune_pickups": F.col("denies"), "obs_placed": kills, "sen_placed": F.col("deaths"),
        "buyback_count": F.col("assists") % 3, "neutral_kills": F.col("last_hits"), "ancient_kills": level % 4,
        "tower_kills": kills % 3, "roshan_kills": kills % 2, "courier_kills": level % 2,
        "observer_kills": F.col("deaths") % 3, "sentry_kills": F.col("deaths") % 2,
        "actions_per_min": F.col("xpm"), "pings": F.col("denies")}
    return P.combat_counters(b.players.withColumns(counters))


@wide_query
def role_metrics(b: Bound) -> DataFrame:
    return P.role_metrics(role_inputs(b, b.requests, LIMITS))


@wide_query
def benchmark_rows(b: Bound) -> DataFrame:
    return bench.benchmark_rows(b.benchmarks, P.with_roles(b.players))


@query
def full_log(b: Bound) -> DataFrame:
    log = B.full_log(B.with_items(b.purchases, b.items), LOG, b.chunk)
    return log.select(*KEY, "pos", "event_id", X.mmss(F.col("t")).alias("at"), "item")


@query
def role_items(b: Bound) -> DataFrame:
    taken = B.absorb_components(B.with_items(b.purchases, b.items), LOG, b.chunk)
    core = B.assembled(taken, LIMITS.own_item_cost)
    support = B.first_per_key(b.purchases, LOG, ("purchase", "view"))
    return B.role_items(P.with_roles(b.players), core, support)


@query
def fight_involvement(b: Bound) -> DataFrame:
    return G.fight_involvement(b.fight_players)


@query
def clock_text(b: Bound) -> DataFrame:
    return b.ev.select("event_id", X.mmss(F.col("t") - 86400).alias("clock"),
                       X.signed(F.col("k") - 50).alias("signed"),
                       X.tag(F.col("event_type"), F.col("is_radiant"), F.col("k") > 50).alias("tag"))


@query
def strip_tokens(b: Bound) -> DataFrame:
    labelled = F.concat(F.lit("+{s:bonus_"), F.col("source"), F.lit("}% "), F.col("text"),
                        F.lit(" -{d:value}s slow, {s:other}s"))
    return b.table("documents").select("doc_id", X.strip_tokens(labelled).alias("name"))


@query
def squeeze_text(b: Bound) -> DataFrame:
    return b.table("conversations").select("conv_id", "turn", X.blank_to_null(F.col("text")).alias("text"))


@query
def prettify_names(b: Bound) -> DataFrame:
    internal = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    return b.table("part").select("p_partkey", X.prettify(internal).alias("name"))


@query
def parse_ranges(b: Bound) -> DataFrame:
    k = F.col("k").cast("string")
    raw = (F.when(F.col("k") % 4 == 0, F.concat(k, F.lit("-"), F.col("m").cast("string")))
           .when(F.col("k") % 4 == 1, F.concat(F.lit(" "), k, F.lit(" – "), F.col("t").cast("string")))
           .when(F.col("k") % 4 == 2, F.concat(k, F.lit("-"), k, F.lit("-1"))).otherwise(F.col("event_type")))
    lo, hi = X.range_bounds(raw)
    return b.ev.select("event_id", lo.alias("lo"), hi.alias("hi"))


@query
def text_bytes(b: Bound) -> DataFrame:
    return b.table("documents").select("doc_id", X.text_bytes(F.col("text")).alias("bytes"))


# --- joins and look-ups ----------------------------------------------------------------

@query
def lookup_fallback(b: Bound) -> DataFrame:
    nation = b.table("nation")
    return L.with_name(b.ev.select("event_id", "k"), "k", nation, "n_nationkey", "n_name", "name",
                       L.numbered("hero_", "k"))


@query
def lookup_cascade(b: Bound) -> DataFrame:
    nation, region = b.table("nation"), b.table("region")
    internal = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("special_bonus_"), F.col("n_name"))
                      ).otherwise(F.col("n_name"))
    named = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("id"), internal.alias("internal"),
        F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("+{s:bonus}% "), F.col("r_name"))).alias("dname"))
    out = L.ability_names(b.ev.select("event_id", "k"), named.select("id", "internal"),
                          named.select("internal", "dname"), "k")
    return out


@query
def resolve_focal(b: Bound) -> DataFrame:
    k = F.col("k")
    asked = b.ev.select(
        F.col("event_id").alias("request_id"), "match_id",
        F.when(k % 3 > 0, k % 13).alias("account_id"),
        F.when(k % 5 > 0, F.concat(F.lit("RO_"), (k % 25).cast("string"))).alias("hero"))
    return R.resolve_focal(asked, b.players)


@query
def resolve_name(b: Bound) -> DataFrame:
    part, nation = b.table("part"), b.table("nation")
    names = (part.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("id"))
             .groupBy("name").agg(F.min("id").alias("id"))
             .unionByName(nation.select(F.col("n_name").alias("name"),
                                        (F.col("n_nationkey") + 10 ** 9).cast("bigint").alias("id"))))
    words = F.split("p_name", " ")
    needle = (F.when(F.col("p_partkey") % 3 == 0, F.upper(F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))))
              .when(F.col("p_partkey") % 3 == 1, F.get(words, 0))
              .otherwise(F.concat(F.lit(" nation_"), (F.col("p_partkey") % 30).cast("string"))))
    return R.resolve_name(part.select(F.col("p_partkey").alias("request_id"), needle.alias("needle")), names)


@query
def opponents(b: Bound) -> DataFrame:
    return P.opponents(b.players).select(
        *KEY, F.transform("opponents", lambda o: o["idx"]).alias("opponents"))


@query
def lane_opponents(b: Bound) -> DataFrame:
    return P.lane_opponents(b.players).select(
        *KEY, F.transform("opponents", lambda o: o["idx"]).alias("opponents"))


@query
def death_times(b: Bound) -> DataFrame:
    return E.death_times(b.kills, b.players)


@query
def early_deaths(b: Bound) -> DataFrame:
    return E.early_deaths(b.kills, b.players, LIMITS)


@query
def fight_outcome(b: Bound) -> DataFrame:
    return G.fight_outcome(b.fights, b.fight_players, b.players, LIMITS)


@query
def fight_participants(b: Bound) -> DataFrame:
    return G.participants(b.fight_players).select("match_id", "fight_no", "idx", "deaths", "damage", "healing")


def windows(b: Bound) -> DataFrame:
    """Six clock steps of every match."""
    lo = F.col("match_id") % 20
    return b.matches.select("match_id", lo.alias("lo_m"), (lo + 5).alias("hi_m"), (lo * 86400).alias("lo"),
                            ((lo + 5) * 86400).alias("hi"))


@query
def interval_overlap(b: Bound) -> DataFrame:
    return E.overlapping(b.fights, windows(b)).select("match_id", "fight_no", "start", "end")


@query
def skip_missing(b: Bound) -> DataFrame:
    accounts = b.table("customer").select(F.col("c_custkey").alias("account_id"))
    return R.skip_missing(accounts, b.table("orders").select(F.col("o_custkey").alias("account_id")))


@query
def draft_my_pick(b: Bound) -> DataFrame:
    return draft.draft_my_pick(b.picks, b.players)


@query
def draft_chronological(b: Bound) -> DataFrame:
    return draft.draft_flag(b.matches, b.picks)


@query
def roster(b: Bound) -> DataFrame:
    return P.roster(P.with_roles(b.players, b.requests))


# --- series ----------------------------------------------------------------------------

@query
def team_advantage(b: Bound) -> DataFrame:
    return S.team_advantage(b.minutes)


@query
def sign_swings(b: Bound) -> DataFrame:
    return S.sign_swings(b.adv)


@query
def top_swings(b: Bound) -> DataFrame:
    return S.top_swings(S.sign_swings(b.adv))


@query
def peak_trough(b: Bound) -> DataFrame:
    return S.peak_trough(b.adv)


@query
def thin_series(b: Bound) -> DataFrame:
    return S.thin_series(b.minutes, KEY).select(*KEY, "m", "gold")


@query
def longest_stall(b: Bound) -> DataFrame:
    return S.longest_stall(b.minutes, LIMITS)


@query
def densest_cluster(b: Bound) -> DataFrame:
    errors = b.ev.filter("event_type = 'error'").select(*KEY, "t")
    return E.death_cluster(errors, LIMITS)


@query
def worst_drop(b: Bound) -> DataFrame:
    return S.worst_drop(b.adv, LIMITS)


@query
def early_grid(b: Bound) -> DataFrame:
    return S.early_grid(b.totals, b.minutes)


@query
def absorb_components(b: Bound) -> DataFrame:
    taken = B.absorb_components(B.with_items(b.purchases, b.items), LOG, b.chunk)
    return taken.select("event_id", *KEY, "key", "absorbed")


@query
def pace_lag(b: Bound) -> DataFrame:
    late = V.late_items(b, b.items, LOG, b.chunk, LIMITS)
    return late.withColumn("severity", millionths())


@query
def window_dump(b: Bound) -> DataFrame:
    return window_rows(b)


def window_rows(b: Bound) -> DataFrame:
    return E.window_events(windows(b), b.kills, b.purchases, b.fights, E.classify_objectives(b.objectives))


@query
def window_series(b: Bound) -> DataFrame:
    return E.window_series(windows(b), b.minutes)


@query
def window_summary(b: Bound) -> DataFrame:
    return E.window_summary(windows(b), window_rows(b))


@query
def top_targets(b: Bound) -> DataFrame:
    hits = (b.ev.filter("event_type = 'purchase'")
            .groupBy(*KEY, (F.col("k") % 10).alias("pos")).agg(F.sum("cents").alias("damage"))
            .withColumn("target", F.concat(F.lit("npc_"), F.col("pos").cast("string"))))
    return P.top_targets(hits)


@query
def hero_damage(b: Bound) -> DataFrame:
    """Damage maps of every player, heroes' entries only."""
    npc = F.concat(F.when(F.col("k") % 3 == 0, X.HERO_PREFIX).otherwise("npc_creep_"), (F.col("k") % 10).cast("string"))
    sums = b.ev.groupBy(*KEY, npc.alias("npc")).agg(F.sum("cents").alias("damage"))
    maps = sums.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("npc", "damage"))).alias("all"))   # thirteen keys at most
    return maps.select(*KEY, F.explode(P.on_heroes(F.col("all"))).alias("npc", "damage"))


@query
def positive_stacks(b: Bound) -> DataFrame:
    buffs = b.ev.select("event_id", *KEY, (F.col("k") % 4).alias("stack_count"), (F.col("t") % 7).alias("grant_time"))
    return P.positive_stacks(buffs).drop("grant_time")


@query
def pick_side(b: Bound) -> DataFrame:
    team = F.when(F.col("k") % 4 < 3, F.col("k") % 4)
    return b.ev.select("event_id", draft.pick_side(team).alias("is_radiant"))


@query
def file_names(b: Bound) -> DataFrame:
    """Names of the text files of match and profile documents."""
    return b.totals.select(*KEY, sinks.match_filename(F.col("match_id"), F.col("idx"), F.col("deaths")).alias("of_match"),
                           sinks.profile_filename(F.col("idx"), F.col("kills"), F.col("match_id")).alias("of_profile"))


@query
def json_lines(b: Bound) -> DataFrame:
    """The lines of the JSON sink."""
    return b.ev.select("event_id", sinks.json_line("match_id", "idx", "event_type").alias("line"))


# --- benchmarks and detectors -------------------------------------------------------------

@query
def metric_percentiles(b: Bound) -> DataFrame:
    return bench.metric_percentiles(b.metrics, ["metric"])


@query
def median_of_others(b: Bound) -> DataFrame:
    return D.median_of_others(b.players, "seconds_dead", "typical").select(*KEY, "seconds_dead", "typical")


@query
def det_bench_edges(b: Bound) -> DataFrame:
    return D.bench_edges(b.benchmarks, LIMITS)


@query
def det_bench_spread(b: Bound) -> DataFrame:
    return D.bench_spread(b.benchmarks, LIMITS)


@query
def det_dead_share(b: Bound) -> DataFrame:
    return D.dead_share(b.players, b.matches, LIMITS)


@query
def det_lane_gap(b: Bound) -> DataFrame:
    return D.lane_gap(b.players, LIMITS)


@query
def det_kp(b: Bound) -> DataFrame:
    return D.kill_share(P.kill_participation(b.players), LIMITS)


def millionths() -> Column:
    """Severity in whole millionths: engines round decimals of doubles differently."""
    return F.floor(F.col("severity") * 1000000.0 + 0.5).cast("bigint")


def deviations(b: Bound) -> DataFrame:
    return V.anomaly_topk(b, b.items, b.adv, LOG, b.chunk, LIMITS)


@wide_query
def anomaly_topk(b: Bound) -> DataFrame:
    return deviations(b).withColumn("severity", millionths()).select(
        *KEY, "ord", "det_no", "key", "axis", "severity", "params")


# --- profiles ----------------------------------------------------------------------------

def wanted(b: Bound) -> DataFrame:
    """One profile request per account, of 10 to 19 matches."""
    return b.totals.select(F.col("idx").alias("account_id")).distinct().select(
        "account_id", (10 + F.col("account_id")).cast("int").alias("n"), F.lit(None).cast("string").alias("role"))


def sample(b: Bound) -> DataFrame:
    return C.capped_sample(b.players, wanted(b))


def digests(b: Bound, chosen: DataFrame, found: DataFrame) -> DataFrame:
    return C.match_digest(P.kill_participation(b.results), chosen,
                          C.minute_value(b.minutes, "lh", 10, "cs10"), found)


def plain_digests(b: Bound) -> DataFrame:
    """Digests for reports that do not show the deviation axes, reduced from the sampled matches only."""
    none = b.spark.sql("SELECT 0L AS match_id, 0L AS idx, '' AS axis WHERE false")
    chosen = keep(sample(b))
    return digests(b.narrowed(chosen), chosen, none)


@query
def capped_sample(b: Bound) -> DataFrame:
    asks = wanted(b).withColumn("n", F.when(F.col("account_id") == 9, 50).otherwise(4)).withColumn(
        "role", one_of(["1", None, "2", "3", None, "4", "5", None, "1", None], F.col("account_id")))
    return C.capped_sample(b.players, asks, b.matches.filter("parsed"))


@query
def hero_sample(b: Bound) -> DataFrame:
    asks = wanted(b).withColumns({"n": F.lit(4), "hero_id": F.col("account_id") % 5})
    return C.capped_sample(b.players, asks)


@wide_query
def match_digest(b: Bound) -> DataFrame:
    chosen = keep(sample(b))
    return digests(b, chosen, deviations(b.narrowed(chosen))).select(
        "account_id", "rec_no", "match_id", "hero", "role", "win", X.mmss(F.col("duration")).alias("duration"),
        T.joined(F.col("kills"), F.col("deaths"), F.col("assists"), sep="/").alias("kda"), "gpm", "xpm", "cs10",
        "net_worth", "kp", "lane_eff", "parsed", "axes")


@query
def profile_averages(b: Bound) -> DataFrame:
    return C.profile_averages(plain_digests(b)).withColumn("duration", X.mmss(F.col("duration")))


@query
def profile_trends(b: Bound) -> DataFrame:
    return C.profile_trends(b.benchmarks, sample(b), LIMITS)


@wide_query
def profile_patterns(b: Bound) -> DataFrame:
    chosen = keep(sample(b))
    rows = C.profile_patterns(deviations(b.narrowed(chosen)), chosen, LIMITS)
    return rows.withColumn("examples", F.array_join(F.transform("examples", params_text), " / "))


def stages(b: Bound) -> DataFrame:
    chosen = keep(sample(b))
    part = b.narrowed(chosen)
    return C.stage_profile(S.stage_changes(part.adv, LIMITS), chosen, part.players, LIMITS)


@query
def stage_profile(b: Bound) -> DataFrame:
    return stages(b)


@query
def stage_verdict(b: Bound) -> DataFrame:
    weak = F.transform("weak", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")))
    return C.stage_verdict(stages(b), LIMITS).select(
        "account_id", "coverage", "thin", weak.alias("weak"), F.col("strong.start").alias("strong_start"),
        F.col("strong.change").alias("strong_change"))


@query
def hero_mix(b: Bound) -> DataFrame:
    chosen = keep(sample(b))
    part = b.narrowed(chosen)
    return C.hero_mix(chosen.join(part.results.drop("account_id"), KEY).withColumn("hero", F.col("hero_name")))


@query
def sample_caveats(b: Bound) -> DataFrame:
    """Two requests per account, sizes outside 2..20 among them, and one for an account without matches."""
    more = F.when(F.col("account_id") % 2 == 0, 50).otherwise(1)
    asked = F.inline(F.array(*[F.struct(F.lit(k).cast("bigint").alias("request_id"), n.alias("n"), a.cast("bigint").alias("account_id"))
                               for k, n, a in ((1, F.col("n"), F.col("account_id")), (2, more, F.col("account_id")),
                                               (3, F.lit(50), F.when(F.col("account_id") == 9, 99)))]))
    asks = wanted(b).select(asked, "role").filter("account_id is not null")
    narrow = b.narrowed(C.capped_sample(b.players, asks))
    chosen = C.capped_sample(narrow.players, asks)
    axes = b.spark.sql("SELECT 0L AS match_id, 0L AS idx, '' AS axis WHERE false")
    none = narrow.totals.select(*KEY, F.lit(None).cast("bigint").alias("cs10"))
    return C.sample_caveats(C.match_digest(P.kill_participation(narrow.results), chosen, none, axes), asks)


# --- requests and documents ------------------------------------------------------------------

@query
def validate_requests(b: Bound) -> DataFrame:
    k = F.col("k")
    asked = b.ev.select(
        F.col("event_id").alias("request_id"), one_of(["quick", "deep", "huge"], k % 3).alias("depth"),
        one_of([*FOCUSES, "other"], k % 10).alias("focus"),
        one_of([None, "1", "2", "3", "4", "5", "9"], k % 7).alias("role"),
        one_of([*MODELS, "other"], F.floor(k / 10) % 4).alias("model"),
        one_of([None, "5-10", " 7 – 9 ", "10-5", "abc", ""], F.floor(k / 3) % 6).alias("window"),
        one_of(["ru", "en", "uk", "de"], k % 4).alias("lang"),
        F.when(k % 5 == 0, "  \n ").otherwise(F.concat(F.lit("  "), F.col("event_type"), F.lit(" \n"))).alias("note"),
        F.concat(F.lit(" "), k.cast("string"), F.lit("   mmr ")).alias("mmr"))
    return Q.validate_requests(asked)


@query
def effective_role(b: Bound) -> DataFrame:
    return P.with_roles(b.players, b.requests).select(*KEY, "position", "role", "role_source")


@query
def section_levels(b: Bound) -> DataFrame:
    return Q.section_levels(b.requests).select(*KEY, "depth", "focus", "has_window", "section", "level")


@query
def rule_list(b: Bound) -> DataFrame:
    return Q.rule_list(b.requests)


@query
def missing_templates(b: Bound) -> DataFrame:
    docs = b.table("documents")
    entries = docs.select("lang", F.concat_ws(":", "source", F.floor(F.col("n_chars") / 200).cast("string")).alias("key"))
    return T.missing_templates(entries, ["de", "en", "es", "fr"], "en")


@wide_query
def render_templates(b: Bound) -> DataFrame:
    langs = deviations(b).withColumn("lang", one_of(LANGUAGES, F.col("idx") % 3))
    return T.render_templates(langs, T.templates(b.spark)).select(*KEY, "ord", "lang", "key", "text")


def fact_lines(b: Bound) -> DataFrame:
    players = P.with_roles(b.players)
    return T.union([
        T.meta_lines(P.match_meta(b.matches, b.players)),
        T.scoreboard_lines(P.scoreboard(b.players)),
        T.deviation_lines(D.top_deviations([D.among_players(b.players, b.matches, LIMITS)], LIMITS), T.templates(b.spark)),
        T.swing_lines(S.top_swings(S.sign_swings(b.adv)), b.players),
        T.bench_lines(bench.benchmark_rows(b.benchmarks, players)),
        T.limit_lines(b.players, b.matches)])


@wide_query
def format_lines(b: Bound) -> DataFrame:
    return fact_lines(b)


def shown_lines(b: Bound) -> DataFrame:
    lines = fact_lines(b)
    levels = Q.section_levels(b.requests)
    always = levels.filter("section = 'meta'").withColumn("section", F.lit("limits")).withColumn("level", F.lit(1))
    return Q.gated(lines, levels.unionByName(always), KEY)


@wide_query
def gated_sections(b: Bound) -> DataFrame:
    return shown_lines(b).groupBy(*KEY, "section", "level").agg(F.count("*").alias("n_lines"))


@wide_query
def assemble_documents(b: Bound) -> DataFrame:
    wrapper = F.try_element_at(F.create_map(*[F.lit(x) for kv in WRAPPERS.items() for x in kv]), F.col("model"))
    lines = (T.with_headings(shown_lines(b).drop("level"))
             .join(b.requests.select(*KEY, wrapper.alias("wrapper")), KEY))
    return T.assemble(lines, KEY)


# --- feedback ----------------------------------------------------------------------------------

def feedback(b: Bound) -> DataFrame:
    k = F.col("k")
    return b.ev.select(
        "event_id", F.col("ts"), F.when(k % 10 == 9, 0).when(k % 2 == 0, 1).otherwise(-1).alias("rating"),
        F.when(k % 17 == 0, "other").when(F.col("is_radiant"), "match").otherwise("profile").alias("mode"),
        one_of(MODELS, k % 3).alias("model"),
        F.when(k % 4 == 0, "   ").otherwise(F.concat(F.lit("  "), F.col("event_type"), F.lit(" "))).alias("comment"),
        "match_id", F.lit(None).cast("string").alias("role"), one_of(["quick", "deep", "odd"], k % 3).alias("depth"),
        F.lit(None).cast("string").alias("focus"), F.lit("5-10").alias("window"),
        F.col("cents").alias("prompt_bytes"), (F.col("event_type") == "click").alias("followup"),
        F.when(k % 23 == 0, "yesterday").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("created_at"))


@query
def validate_feedback(b: Bound) -> DataFrame:
    return FB.validate_feedback(feedback(b)).select("event_id", "rating", "mode", "comment", "followup", "problem")


@query
def cap_per_window(b: Bound) -> DataFrame:
    return FB.cap_per_window(feedback(b), ["mode"], order=("event_id",), limit=FB.MAX_PER_MINUTE,
                             seconds=86400).select("event_id", "mode")


@query
def anchored_cap(b: Bound) -> DataFrame:
    return A.anchored_cap(feedback(b), "mode", "ts", ("event_id",), limit=FB.MAX_PER_MINUTE, seconds=86400).select("event_id", "mode")


@query
def fan_out_sinks(b: Bound) -> DataFrame:
    """What two sinks and the quarantine got of four batches; one sink was down at first and caught up."""
    checked = FB.validate_feedback(feedback(b)).select("event_id", "mode", "problem", "ts")
    where, tries = new_folder(b.spark, "fanout"), []

    def sink(name: str, good: bool, down: int = 0):
        def write(batch: DataFrame, epoch: int) -> None:
            if down:
                tries.append(epoch)
                if len(tries) <= down:
                    raise OSError(f"{name} is down")
            rows = batch.where(F.col("problem").isNull() if good else F.col("problem").isNotNull()).select(F.lit(name).alias("sink"), "event_id", "mode")
            FB.folder_sink(f"{where}/out/{name}", "parquet")(rows, epoch)
        return write
    names = ["late", "quarantine", "steady"]
    fan = FanOut(b.spark, {"late": sink("late", True, 2), "quarantine": sink("quarantine", False), "steady": sink("steady", True)}, where)
    for epoch in range(4):
        fan(checked.where(F.pmod(F.unix_date(F.to_date("ts")), F.lit(4)) == epoch).drop("ts"), epoch)
    if not fan.wait(600) or any(fan.replay(name) for name in names):
        raise RuntimeError("a sink did not catch up")
    return T.union([b.spark.read.parquet(f"{where}/out/{name}").drop("batch") for name in names])


@query
def vote_tally(b: Bound) -> DataFrame:
    day = F.date_diff(F.to_date("start"), F.lit("2024-01-01").cast("date"))
    return FB.vote_tally(feedback(b)).select(day.alias("m"), "mode", "model", "votes", "balance")
