"""Digests of players' matches, kept as matches land: a profile reads the rows of its accounts and no match document.

A digest has all that profiles show of a match: the facts of the player, percentiles, deviations and the changes of the lead by stage. Digests
lie in buckets by account; a parsed match's digest supersedes that of an unparsed copy.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlens.operators import career as C, players as P, series as S
from matchlens.params import DEFAULTS, TREND_METRICS, Thresholds
from matchlens.plans.account_profile import AccountProfile
from matchlens.plans.deviations import anomaly_topk
from matchlens.plans.share import keep
from matchlens.sources.silver import Silver
from matchlens.sources.versioned import VersionedTable

KEY = ["match_id", "idx"]
FACTS = ["account_id", *KEY, "hero_id", "hero_name", "lane_role", "position", "is_radiant", "win", "duration", "kills", "deaths", "assists", "gpm", "xpm",
         "net_worth", "kp", "lane_eff", "patch", "parsed"]


class DigestStore:
    def __init__(self, spark: SparkSession, path: str, dims: dict[str, DataFrame], limits: Thresholds = DEFAULTS, buckets: int = 64, **options):
        self.dims, self.p = dims, limits
        self.table = VersionedTable(spark, path, "digest", lambda: F.col("parsed"), ["epoch"], buckets, by="account_id", **options)

    def add(self, matches: DataFrame, epoch: int) -> None:
        """A foreachBatch writer for raw match documents, one per match in a batch. Players without an account have no digest."""
        t = Silver(matches, self.dims)
        results = P.kill_participation(t.players).join(t.matches.select("match_id", "duration", "patch", "parsed"), "match_id")
        found = anomaly_topk(t, self.dims["items"], t.supplied_adv, t.order, t.chunk, self.p)
        facts = found.groupBy(*KEY).agg(F.collect_list(F.struct(*(c for c in found.columns if c not in KEY))).alias("deviations"))      # seven at most
        known = t.benchmarks.filter(F.col("metric").isin(*TREND_METRICS))
        percentiles = known.groupBy(*KEY).agg(F.collect_list(F.struct("metric", "pct")).alias("percentiles"))
        stages = S.stage_changes(t.supplied_adv, self.p).groupBy("match_id").agg(F.collect_list(F.struct("start", "change")).alias("stages"))
        rows = results.filter("account_id is not null").select(*FACTS).join(C.minute_value(t.minutes, "lh", 10, "cs10"), KEY, "left")
        rows = rows.join(facts, KEY, "left").join(percentiles, KEY, "left").join(stages, "match_id", "left")
        named = F.concat_ws("-", F.col("account_id").cast("string"), F.col("match_id").cast("string"), F.col("idx").cast("string"))
        self.table.upsert(rows.withColumns({"digest": named, "epoch": F.lit(epoch).cast("long")}), epoch)

    def profile(self, wanted: DataFrame) -> StoredProfile:
        return StoredProfile(self, wanted)


class StoredProfile(AccountProfile):
    """The same document from stored digests: only the buckets of the accounts wanted are read."""

    def __init__(self, store: DigestStore, wanted: DataFrame):
        super().__init__(None, wanted, store.p)
        self.store = store

    @cached_property
    def rows(self) -> DataFrame:
        return keep(self.store.table.read(self.wanted))

    @cached_property
    def sample(self) -> DataFrame:
        return keep(C.capped_sample(self.rows, self.wanted, None, self.p))

    @cached_property
    def deviations(self) -> DataFrame:
        return self.rows.join(self.sample.select(*KEY).distinct(), KEY, "left_semi").select(*KEY, F.inline("deviations"))

    @cached_property
    def digests(self) -> DataFrame:
        facts = self.rows.select(*FACTS)
        return C.match_digest(facts, self.sample, self.rows.select(*KEY, "cs10"), self.deviations)

    def trends(self) -> DataFrame:
        return C.profile_trends(self.rows.select(*KEY, F.inline("percentiles")), self.sample, self.p)

    def stages(self) -> DataFrame:
        changes = self.rows.select("match_id", F.inline("stages")).distinct()
        return C.stage_profile(changes, self.sample, self.rows.select(*KEY, "is_radiant"), self.p)
