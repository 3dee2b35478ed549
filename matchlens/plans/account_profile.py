"""Documents about accounts over their sampled matches.

``wanted`` is a table (account_id, n, role, model[, request_id, note, mmr]); several requests may name one account, each gets its own
document. The sample is taken first; detectors and
series then run on the sampled matches only.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlens.functions import text as X
from matchlens.operators import career as C, documents as T, players as P, series as S
from matchlens.params import DEFAULTS, PROFILE_RULES, WRAPPERS, Thresholds
from matchlens.plans.deviations import anomaly_topk
from matchlens.plans.match_facts import note_lines, rule_lines
from matchlens.plans.share import keep
from matchlens.sources.sinks import profile_filename

KEY = ["match_id", "idx"]
SECTIONS = {"averages": "AVERAGES", "trends": "TRENDS", "patterns": "RECURRING DEVIATIONS", "stages": "STAGES",
            "heroes": "HEROES", "matches": "MATCHES", "limits": "LIMITS"}


class AccountProfile:
    def __init__(self, tables, wanted: DataFrame, limits: Thresholds = DEFAULTS):
        self.all, self.wanted, self.p = tables, wanted, limits

    @cached_property
    def sample(self) -> DataFrame:
        return keep(C.capped_sample(self.all.players, self.wanted, self.all.matches, self.p))

    @cached_property
    def t(self):
        """The tables of the sampled matches."""
        return self.all.narrowed(self.sample)

    @cached_property
    def deviations(self) -> DataFrame:
        """Deviations of the sampled players; read by the patterns, their examples and the digests."""
        found = anomaly_topk(self.t, self.t.dims["items"], self.t.supplied_adv, self.t.order, self.t.chunk, self.p)
        return keep(found.join(self.sample.select(*KEY), KEY, "left_semi"))

    @cached_property
    def digests(self) -> DataFrame:
        results = P.kill_participation(self.t.players).join(
            self.t.matches.select("match_id", "duration", "patch", "parsed"), "match_id")
        return C.match_digest(results, self.sample, C.minute_value(self.t.minutes, "lh", 10, "cs10"), self.deviations)

    def averages(self) -> DataFrame:
        return C.profile_averages(self.digests)

    def trends(self) -> DataFrame:
        return C.profile_trends(self.t.benchmarks, self.sample, self.p)

    def patterns(self) -> DataFrame:
        return C.profile_patterns(self.deviations, self.sample, self.p)

    def stages(self) -> DataFrame:
        return C.stage_profile(S.stage_changes(self.t.supplied_adv, self.p), self.sample, self.t.players, self.p)

    def verdicts(self) -> DataFrame:
        return C.stage_verdict(self.stages(), self.p)

    def heroes(self) -> DataFrame:
        return C.hero_mix(self.digests)

    def caveats(self) -> DataFrame:
        return C.sample_caveats(self.digests, self.wanted, self.p)

    # --- documents -------------------------------------------------------------------

    def lines(self) -> DataFrame:
        c = F.col

        def line(df: DataFrame, section: str, order: Column, *parts: Column) -> DataFrame:
            return df.select(*C.who(df), F.lit(section).alias("section"), order.cast("bigint").alias("ord"),
                             T.joined(*parts).alias("line"))

        def named(df: DataFrame, cols: list[str]) -> list[Column]:
            return [F.concat(F.lit(f"{n} "), F.coalesce(c(n).cast("string"), F.lit("-"))) for n in cols]

        avg = self.averages().withColumn("duration", X.mmss(c("duration")))
        templates = T.templates(self.wanted.sparkSession)
        place = F.row_number().over(Window.partitionBy(*C.who(self.wanted)).orderBy("key"))
        patterns = self.patterns().withColumn("_place", place)
        examples = patterns.select("*", F.posexplode("examples").alias("_pos", "params")).withColumn(
            "lang", F.lit("en"))
        order = -c("count") * 1000
        by_key = order + F.col("_place") * 10
        digest = self.digests
        verdict = self.verdicts()
        weak = F.array_join(F.transform("weak", lambda s: F.concat_ws("-", s["start"].cast("string"),
                                                                      s["end"].cast("string"))), ", ")
        caveats = self.caveats()
        return T.union([
            line(avg, "averages", F.lit(1), *named(avg, [x for x in avg.columns if x not in C.who(avg)])),
            line(self.trends(), "trends", F.array_position(F.array(*map(F.lit, C.TREND_METRICS)), c("metric")),
                 c("metric"), *named(avg, ["avg", "low", "high", "samples"]), T.joined(c("direction"), c("delta"), sep=" ")),
            line(patterns, "patterns", by_key, F.concat(F.lit("["), c("axis"), F.lit("] "), c("key")),
                 F.concat(c("count").cast("string"), F.lit(" of "), c("total").cast("string")),
                 F.concat(c("share").cast("string"), F.lit("%"))),
            line(T.render_templates(examples, templates), "patterns", by_key + 1 + c("_pos"),
                 F.concat(F.lit("  "), c("text"))),
            line(self.stages(), "stages", c("start"), F.format_string("%d-%d", c("start"), c("end")),
                 X.signed(c("change")), c("samples")),
            line(verdict, "stages", F.lit(1000), F.when(c("thin"), "too few series for a verdict").otherwise(
                F.concat(F.lit("weak: "), F.coalesce(F.nullif(weak, F.lit("")), F.lit("none")))),
                F.when(c("strong").isNotNull(), F.concat(F.lit("strong: "), c("strong.start").cast("string"), F.lit("-"),
                                                         c("strong.end").cast("string")))),
            line(self.heroes(), "heroes", c("ord"), c("hero"), c("games"), c("wins")),
            line(digest, "matches", c("rec_no"), c("match_id"), c("hero"), F.when(c("win"), "won").otherwise("lost"),
                 X.mmss(c("duration")), T.joined(c("kills"), c("deaths"), c("assists"), sep="/"), c("gpm"),
                 F.coalesce(c("cs10").cast("string"), F.lit("-")), c("kp"),
                 F.coalesce(F.nullif(F.array_join("axes", ", "), F.lit("")), F.lit("-"))),
            line(caveats, "limits", F.lit(1), F.concat(F.lit("aggregate of "), c("analyzed").cast("string"), F.lit(" matches"))),
            line(caveats.filter("analyzed < requested"), "limits", F.lit(2), F.concat(
                c("requested").cast("string"), F.lit(" matches were asked for"))),
            line(caveats.filter("unparsed > 0"), "limits", F.lit(3), F.concat(
                c("unparsed").cast("string"), F.lit(" matches are not parsed"))),
            line(caveats.filter("mixed_roles is not null"), "limits", F.lit(4), F.lit("several roles are mixed")),
            line(caveats.filter("patches is not null"), "limits", F.lit(5), F.concat(F.lit("patches "), c("patches")))])

    def documents(self) -> DataFrame:
        """(account_id[, request_id], wrapper, document, filename): the facts, their limits, the reader's question if there is one, and the rules.

        wanted may have note and mmr; a column it lacks asks for nothing.
        """
        by = C.who(self.wanted)
        names = list(SECTIONS)
        heading = F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv])
        limits = F.col("section") == "limits"
        wrapper = F.try_element_at(F.create_map(*[F.lit(x) for kv in WRAPPERS.items() for x in kv]), F.col("model"))
        parts = (self.lines()
                 .withColumn("heading", F.try_element_at(heading, F.col("section")))
                 .withColumn("section_ord", F.array_position(F.array(*map(F.lit, names)), F.col("section")))
                 .withColumn("group_ord", F.when(limits, 2).otherwise(1))
                 .withColumn("group_tag", F.when(limits, "data_limitations").otherwise("profile_data"))
                 )
        asked = self.wanted.select(*by, "role", *(F.col(c) if c in self.wanted.columns else F.lit(None).cast("string").alias(c) for c in ("note", "mmr")))
        extra = T.union([note_lines(asked), rule_lines(asked, PROFILE_RULES)])
        parts = parts.unionByName(extra.select(parts.columns)).join(self.wanted.select(*by, wrapper.alias("wrapper")), by)
        size = self.sample.groupBy(*by).agg(F.count("*").alias("_n"))
        name = profile_filename(F.col("account_id"), F.coalesce("_n", F.lit(0)), *[F.col(c) for c in by if c != "account_id"])
        return T.assemble(parts, by).join(size, by, "left").withColumn("filename", name).drop("_n")
