"""Documents about single matches: every section of every requested focal player.

``requests`` is a table (request_id, match_id, idx, depth, focus, role, model, has_window, lo_m, hi_m,
note, mmr); several requests may name one player, each gets its own document. Each section is a lazy DataFrame of lines keyed by the focal player; a section nobody's
request shows contributes no rows, and no section is computed before the final write.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlens.functions import text as X
from matchlens.operators import bench, build as B, documents as T, draft, events as E, fights as G
from matchlens.operators import players as P, requests as Q, series as S
from matchlens.params import DEFAULTS, MATCH_RULES, UTILITY_ITEMS, WRAPPERS, Thresholds
from matchlens.plans.deviations import anomaly_topk
from matchlens.plans.role_impact import role_inputs
from matchlens.sources.sinks import match_filename

KEY = ["match_id", "idx"]
DOC = [*KEY, "request_id"]


def listed(df: DataFrame, keys: list[str], order: list[str], item: Column, out: str = "text") -> DataFrame:
    """Items of one line joined in order; callers group by (document, player), so lists are short."""
    entry = F.struct(*order, item.alias("_item"))
    return df.groupBy(*keys).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(entry)), lambda e: e["_item"]), ", ").alias(out))


class MatchFacts:
    def __init__(self, tables, requests: DataFrame, limits: Thresholds = DEFAULTS):
        self.t, self.p = tables, limits
        self.requests = requests if "request_id" in requests.columns else requests.withColumn("request_id", F.lit(0))

    # --- levels and audiences -------------------------------------------------------

    @cached_property
    def players(self) -> DataFrame:
        """Every player once, with the role inferred; what a request asks for belongs to ``focal``."""
        return P.with_roles(self.t.players)

    @cached_property
    def focal(self) -> DataFrame:
        """One row per request: the player's side and lane, and the role of this request."""
        role, source = P.effective_role(F.col("position"), F.col("_asked"))
        asked = self.requests.withColumnRenamed("role", "_asked")
        joined = asked.join(self.players.select(*KEY, "is_radiant", "lane", "position"), KEY)
        return joined.withColumns({"role": role, "role_source": source}).drop("_asked", "position")

    def shown(self, section: str) -> DataFrame:
        """Focal players whose request shows the section, with its level."""
        level = Q.section_level(F.lit(section), F.col("depth"), F.col("focus"), F.col("has_window"))
        return self.focal.withColumn("level", level).filter("level > 0")

    def about(self, rows: DataFrame, section: str, rule: Column | None = None) -> DataFrame:
        """Per-player rows (match_id, idx, ..) spread to the focal players they are shown to.

        ``who`` is the player the row is about, ``idx`` the focal one. A match has ten players and
        only requested ones are focal, so this is no pairing of the table with itself.
        """
        mine = F.col("who") == F.col("idx")
        rule = mine | (F.col("level") >= 2) if rule is None else rule
        focal = self.shown(section).select(*DOC, "level", F.col("is_radiant").alias("my_side"),
                                           F.col("lane").alias("my_lane"))
        return (rows.withColumnRenamed("idx", "who").join(focal, "match_id").filter(rule)
                .withColumn("focal", mine))

    def who(self) -> Column:
        return X.tag(F.col("hero_name"), F.col("is_radiant"), F.col("focal"))

    def named(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.players.select(*KEY, "hero_name", "is_radiant"), KEY)

    # --- sections -------------------------------------------------------------------

    def meta(self) -> DataFrame:
        focal = self.shown("meta").select(*DOC, "role", "role_source")
        rows = P.match_meta(self.t.matches, self.players).join(focal, KEY)
        return T.meta_lines(rows.withColumn("position", F.coalesce("role", "position")))

    def scoreboard(self) -> DataFrame:
        cols = ["lvl", "kda", "lh_dn", "gpm_xpm", "nw", "hd", "td", "heal", "dt"]
        rows = self.about(P.scoreboard(self.players), "scoreboard", F.lit(True))
        return T._lines(rows, "scoreboard", F.col("who"), T.joined(self.who(), *[F.col(c) for c in cols]))

    def deviations(self) -> DataFrame:
        return anomaly_topk(self.t, self.t.dims["items"], self.t.supplied_adv, self.t.order, self.t.chunk, self.p)

    def anomalies(self, spark) -> DataFrame:
        rows = self.deviations().join(self.shown("anomalies").select(*DOC), KEY)
        some = T.deviation_lines(rows, T.templates(spark))
        quiet = self.shown("anomalies").select(*DOC).join(rows.select(*DOC).distinct(), DOC, "left_anti")
        return T.union([some, T._lines(quiet, "anomalies", F.lit(0), F.lit("nothing unusual"))])

    def role_impact(self) -> DataFrame:
        focal = self.shown("role_impact").select(*DOC, "role", "role_source")
        inputs = role_inputs(self.t, None, self.p).drop("role", "role_source").join(focal, KEY)
        metrics = listed(P.role_metrics(inputs), DOC, ["ord"], T.joined(
            F.col("metric"), F.coalesce("value", F.lit("?")), sep=" "))
        times = E.early_late_times(self.t.kills, self._deaths, self.p).join(focal.drop("role_source"), KEY).filter(
            ((F.col("kind") == "early_kill") & (F.col("role") == "2"))
            | ((F.col("kind") == "late_death") & (F.col("role") == "1")))
        when = listed(times, DOC + ["kind"], ["t"], X.mmss(F.col("t")))
        items = B.role_items(focal, B.assembled(self._absorbed, self.p.own_item_cost),
                             B.first_per_key(self.t.purchases, self.t.order, UTILITY_ITEMS))
        bought = listed(items, DOC + ["kind"], ["t", "key"], T.joined(X.mmss(F.col("t")), F.col("key"), sep=" "))
        titled = T.joined(F.col("kind"), F.col("text"), sep=": ")
        return T.union([T._lines(metrics, "role_impact", F.lit(1), F.col("text")),
                        T._lines(when, "role_impact", F.lit(2), titled),
                        T._lines(bought, "role_impact", F.lit(3), titled)])

    def draft(self) -> DataFrame:
        focal = self.shown("draft").select(*DOC, "role")
        rows = draft.draft_rows(self.t.picks).join(draft.draft_flag(self.t.matches, self.t.picks), "match_id")
        kind = F.when(F.col("is_pick"), "pick").otherwise("ban")
        order = F.when(F.col("chronological"), F.col("ord")).otherwise(
            F.col("ord") + F.when(F.col("is_pick"), 1000).otherwise(0))
        stages = T._lines(rows.join(focal, "match_id"), "draft", order,
                          F.format_string("#%2d %s %s %s", F.col("ord").cast("int"), F.col("side"), kind, F.col("hero_name")))
        mine = draft.draft_my_pick(self.t.picks, self.players).join(focal, KEY)
        shown = [T.joined(F.lit(c), F.coalesce(F.nullif(F.array_join(c, ", "), F.lit("")), F.lit("-")), sep=": ")
                 for c in ("enemies_before", "allies_before", "enemies_after")]
        own = T._lines(mine, "draft", F.lit(3000), T.joined(
            F.concat(F.lit("pick "), F.col("order").cast("string"), F.lit(" of "), F.col("total").cast("string")),
            F.col("tag"), *shown, sep="; "))
        team = P.roster(self.players).withColumnRenamed("idx", "who").join(focal, "match_id")
        seen_as = F.when(F.col("who") == F.col("idx"), F.coalesce("role", "position")).otherwise(F.col("position"))
        names = T._lines(team, "draft", F.col("who") + 4000, T.joined(
            F.col("side"), F.col("hero_name"), seen_as, F.col("lane_key")))
        return T.union([stages, own, names])

    def benchmarks(self) -> DataFrame:
        mine = bench.benchmark_rows(self.t.benchmarks, self.focal)
        general = bench.benchmark_rows(self.t.benchmarks, self.t.players.select(
            *KEY, F.lit(None).cast("string").alias("role")))
        own = mine.join(self.shown("benchmarks").select(*DOC), DOC).withColumn("who", F.col("idx"))
        rest = self.about(general, "benchmarks", (F.col("who") != F.col("idx")) & (F.col("level") >= 2))
        rows = own.unionByName(rest.select(*own.columns))
        text = T.joined(F.col("metric"), F.col("raw"), F.concat(
            F.lit("("), F.coalesce(F.col("pct").cast("string"), F.lit("?")), F.lit(")")), sep=" ")
        return self._player_lines(listed(rows, DOC + ["who"], ["ord"], text), "benchmarks")

    def _player_lines(self, rows: DataFrame, section: str, offset: int = 0) -> DataFrame:
        """Lines '<tag>: <text>' of (match_id, idx, who, text)."""
        names = self.players.select("match_id", F.col("idx").alias("who"), "hero_name", "is_radiant")
        named = rows.join(names, ["match_id", "who"]).withColumn("focal", F.col("who") == F.col("idx"))
        return T._lines(named, section, F.col("who") + offset,
                        F.concat(self.who(), F.lit(": "), F.coalesce(F.nullif("text", F.lit("")), F.lit("-"))))

    def networth(self) -> DataFrame:
        side = self.shown("networth").select(*DOC, "level", "is_radiant")
        thin = S.thin_series(S.per_side(self.t.adv, "gold", "xp"), ["match_id", "is_radiant"], self.p.thin_step)
        both = ["match_id", "is_radiant"]
        team = T._lines(thin.join(side, both), "networth", F.col("m"), F.format_string(
            "m%2d: gold %s, xp %s", F.col("m"), F.coalesce(X.signed(F.col("gold")), F.lit("-")),
            F.coalesce(X.signed(F.col("xp")), F.lit("-"))))
        swings = T._lines(S.top_swings(S.sign_swings(self.t.adv), self.p.max_swings).join(side, both), "networth",
                          F.col("m") + 1000, F.format_string("swing m%d: %s %s", F.col("m"), F.col("swing"),
                                                             X.signed(F.col("gold"))))
        peak = T._lines(S.peak_trough(self.t.adv).join(side, both), "networth", F.lit(2000), F.format_string(
            "best %s at m%d, worst %s at m%d", X.signed(F.col("best_gold")), F.col("best_m"),
            X.signed(F.col("worst_gold")), F.col("worst_m")))
        series = S.thin_series(self.t.minutes.filter("gold is not null"), KEY, self.p.thin_step)
        cores = self.players.select(*KEY, "is_core")
        curves = self.about(series.join(cores, KEY), "networth", (F.col("who") == F.col("idx")) | (F.col("level") >= 2)
                            | ((F.col("is_radiant") != F.col("my_side")) & F.col("is_core")))
        curve = listed(curves, DOC + ["who"], ["m"], F.format_string("m%d=%s", F.col("m"), F.coalesce(F.col("gold").cast("string"), F.lit("-"))))
        return T.union([team, swings, peak, self._player_lines(curve, "networth", 3000)])

    @cached_property
    def _absorbed(self) -> DataFrame:
        return B.absorb_components(B.with_items(self.t.purchases, self.t.dims["items"]), self.t.order, self.t.chunk)

    def items(self) -> DataFrame:
        """All players: own key items (or the whole log at the full level), large items of others."""
        full = F.col("level") >= 3
        kept = T.union([
            self.about(self._absorbed.drop("absorbed"), "items", F.lit(True)).filter(F.col("focal") & full),
            self.about(B.assembled(self._absorbed, self.p.own_item_cost), "items", F.lit(True)).filter(
                F.col("focal") & ~full),
            self.about(B.assembled(self._absorbed, self.p.other_item_cost), "items", F.lit(True)).filter(~F.col("focal"))])
        text = listed(kept, DOC + ["who"], self.t.order, T.joined(X.mmss(F.col("t")), F.col("item"), sep=" "))
        everyone = self.about(self.players.select(*KEY), "items", F.lit(True)).select(*DOC, "who")
        return self._player_lines(everyone.join(text, DOC + ["who"], "left"), "items")

    def abilities(self) -> DataFrame:
        lane = self.players.select(*KEY, "is_radiant", "lane")
        rule = ((F.col("who") == F.col("idx")) | (F.col("level") >= 2)
                | ((F.col("is_radiant") != F.col("my_side")) & (F.col("lane") == F.col("my_lane"))))
        rows = self.about(self.t.abilities.join(lane, KEY), "abilities", rule)
        name = F.concat(F.lit("#"), F.col("n").cast("string"), F.lit(" "), F.col("ability"),
                        F.when(F.col("talent"), " (talent)").otherwise(""))
        return self._player_lines(listed(rows, DOC + ["who"], ["n"], name), "abilities")

    @cached_property
    def _deaths(self) -> DataFrame:
        return E.death_times(self.t.kills, self.t.players)

    def laning(self) -> DataFrame:
        focal = self.shown("laning").select(*DOC, "level")
        lane = self.players.select(*KEY, "is_radiant", "lane", "lane_eff")
        grid = S.early_grid(self.players, self.t.minutes).join(lane, KEY)
        opponent = (F.col("is_radiant") != F.col("my_side")) & (F.col("lane") == F.col("my_lane"))
        cs = self.about(grid, "laning", (F.col("who") == F.col("idx")) | (opponent & (F.col("level") >= 2)))
        number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
        cell = F.concat(F.lit("m"), F.col("m").cast("string"), F.lit(":"), number("lh"), F.lit("/"), number("dn"),
                        F.when(F.col("focal") & (F.col("level") >= 2), F.concat(
                            F.lit(" "), number("gold"), F.lit("g/"), number("xp"), F.lit("xp"))).otherwise(""))
        lines = self._player_lines(listed(cs, DOC + ["who"], ["m"], cell), "laning")
        facing = self.about(lane, "laning", opponent)
        eff = self._player_lines(facing.select(*DOC, "who", F.concat(
            F.lit("lane efficiency "), number("lane_eff"), F.lit("%")).alias("text")), "laning", 100)
        kills = E.early_events(self.t.kills, "t", self.p).join(focal, KEY)
        killed = T._lines(kills, "laning", 200000 + F.col("t"), T.joined(
            X.mmss(F.col("t")), F.lit("killed"), X.without(F.col("victim_npc"), X.HERO_PREFIX), sep=" "))
        dead = E.early_deaths(self.t.kills, self.t.players, self.p).join(focal, KEY)
        killer = self.players.select("match_id", F.col("idx").alias("killer"), "hero_name")
        died = T._lines(dead.join(killer, ["match_id", "killer"]), "laning", 400000 + F.col("t"), T.joined(
            X.mmss(F.col("t")), F.lit("killed by"), F.col("hero_name"), sep=" "))
        return T.union([lines, eff, killed, died])

    def combat(self) -> DataFrame:
        rows = self.about(P.combat_counters(self.t.players, self.t.dims["heroes"]), "combat")
        own = ["best_streak", "best_multikill", "stuns_sec", "camps_stacked", "runes", "obs", "sen", "buybacks", "time_dead"]
        types = [c for c in rows.columns if c.endswith("_kills")]
        extra = F.when(F.col("level") >= 2, F.concat_ws(" | ", *[
            F.concat(F.lit(f"{c} "), F.col(c).cast("string")) for c in ("apm", "pings", "max_hit")]))
        text = F.concat_ws(" | ", *[F.concat(F.lit(f"{c} "), F.col(c).cast("string")) for c in own], *[
            F.when(F.col(c) != 0, F.concat(F.lit(f"{c} "), F.col(c).cast("string"))) for c in types], extra)
        return self._player_lines(rows.select(*DOC, "who", text.alias("text")), "combat")

    def buffs(self) -> DataFrame:
        rows = self.about(self.t.buffs, "buffs", F.lit(True))
        text = F.concat(F.col("buff"), F.lit(" x"), F.col("stacks").cast("string"), F.when(
            F.col("since").isNotNull(), F.concat(F.lit(" since "), X.mmss(F.col("since")))).otherwise(""))
        return self._player_lines(listed(rows, DOC + ["who"], ["pos"], text), "buffs")

    @cached_property
    def _hero_names(self) -> DataFrame:
        """Heroes of a match by player, ten at most."""
        return self.players.groupBy("match_id").agg(F.map_from_entries(F.collect_list(F.struct("idx", "hero_name"))).alias("names"))

    def teamfights(self) -> DataFrame:
        focal = self.shown("teamfights").select(*DOC, "level", F.col("focus").alias("_focus"))
        rows = (G.fight_outcome(self.t.fights, self.t.fight_players, self.players, self.p).join(focal, KEY)
                .join(self._hero_names, "match_id").filter((F.col("_focus") != "laning") | F.col("in_lane")))
        return T.union([T.fight_lines(rows).withColumn("ord", F.col("ord") * 100),
                        self._participants(rows.filter("level >= 2"), "teamfights")])

    def _participants(self, shown: DataFrame, section: str) -> DataFrame:
        took = G.participants(self.t.fight_players).withColumnRenamed("idx", "who").drop("is_radiant", "killed")
        rows = took.join(shown.select(*DOC, "fight_no"), ["match_id", "fight_no"]).join(
            self.players.select("match_id", F.col("idx").alias("who"), "hero_name", "is_radiant"), ["match_id", "who"])
        rows = rows.withColumn("focal", F.col("who") == F.col("idx"))
        return T._lines(rows, section, F.col("fight_no") * 100 + 1 + F.col("who"), F.concat(F.lit("  "), T.joined(
            self.who(), X.signed(F.col("gold_delta")), X.signed(F.col("xp_delta")), F.col("deaths"), F.col("damage"),
            F.col("healing"))))

    @cached_property
    def _objectives(self) -> DataFrame:
        return E.classify_objectives(self.t.objectives, self.t.dims["heroes"])

    def objectives(self) -> DataFrame:
        focal = self.shown("objectives").select(*DOC, "level")
        rows = self._objectives.join(focal, "match_id").filter(~F.col("minor") | (F.col("level") >= 2))
        return self._objective_lines(rows, "objectives", F.col("pos"))

    @staticmethod
    def _objective_lines(rows: DataFrame, section: str, order: Column) -> DataFrame:
        c = F.col
        return T._lines(rows, section, order, T.joined(
            X.mmss(c("t")), c("kind"), c("attacker"), c("building"), c("short"),
            F.coalesce("hero", F.when(c("by_creeps"), "creeps")), c("side"), sep=" "))

    def damage(self) -> DataFrame:
        rows = self.about(P.top_targets(self.t.damage, self.p.top_targets), "damage")
        text = T.joined(F.col("target"), F.col("damage"), sep=":")
        return self._player_lines(listed(rows, DOC + ["who"], ["ord"], text), "damage")

    def window(self) -> DataFrame:
        """The chosen minutes in full: lead, every player's series, kills, purchases, fights, objectives."""
        focal = self.focal.filter("has_window").select(*DOC, "is_radiant", "lo_m", "hi_m")
        spans = focal.select(*DOC, (F.col("lo_m") * 60).alias("lo"), (F.col("hi_m") * 60).alias("hi"))
        both = ["match_id", "is_radiant"]
        lead = S.per_side(self.t.adv, "gold", "xp").join(focal, both).filter("m between lo_m and hi_m")
        team = T._lines(lead, "window", F.col("m"), F.format_string(
            "m%2d: gold %s, xp %s", F.col("m"), F.coalesce(X.signed(F.col("gold")), F.lit("-")),
            F.coalesce(X.signed(F.col("xp")), F.lit("-"))))
        points = self.t.minutes.drop("is_radiant").withColumnRenamed("idx", "who").join(
            focal.drop("is_radiant"), "match_id").filter("m between lo_m and hi_m")
        number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
        text = F.concat(F.lit("m"), F.col("m").cast("string"), F.lit("="), number("gold"), F.lit("g/"), number("xp"),
                        F.lit("xp/"), number("lh"), F.lit("-"), number("dn"))
        series = self._player_lines(listed(points, DOC + ["who"], ["m"], text), "window", 1000)
        short = X.short_tag(F.col("hero_name"), F.col("is_radiant"), F.col("who") == F.col("idx"))
        names = self.players.select("match_id", F.col("idx").alias("who"), "hero_name", F.col("is_radiant"))

        def log(rows: DataFrame, offset: int, what: Column) -> DataFrame:
            hit = E.inside_many(rows.withColumnRenamed("idx", "who").drop("is_radiant"), spans).join(names, ["match_id", "who"])
            return T._lines(hit, "window", F.col("t") + offset, F.concat(X.mmss(F.col("t")), F.lit(" "), short, what))

        kills = log(self.t.kills, 10 ** 6, F.concat(F.lit(" killed "), X.without(F.col("victim_npc"), X.HERO_PREFIX)))
        bought = B.with_items(self.t.purchases, self.t.dims["items"]).drop("components").filter(~F.col("key").startswith("recipe_"))
        purchases = log(bought, 2 * 10 ** 6, F.concat(F.lit(": "), F.col("item")))
        spanned = E.overlapping(self.t.fights, spans).select(*DOC, "fight_no")
        outcome = G.fight_outcome(self.t.fights, self.t.fight_players, self.players, self.p).join(spanned, KEY + ["fight_no"])
        fights = T.union([T.fight_lines(outcome).withColumn("section", F.lit("window")).withColumn("ord", F.col("ord") * 100),
                          self._participants(outcome, "window")]).withColumn("ord", F.col("ord") + 3 * 10 ** 6)
        objectives = self._objective_lines(E.inside_many(self._objectives, spans), "window", F.col("t") + 4 * 10 ** 6)
        happened = T.union([kills, purchases, fights, objectives])
        quiet = focal.select(*DOC).join(happened.select(*DOC).distinct(), DOC, "left_anti")
        return T.union([team, series, happened, T._lines(quiet, "window", F.lit(9 * 10 ** 6), F.lit("quiet: no events"))])

    def limits(self) -> DataFrame:
        """Fixed limits and the caveats the shown sections bring with them."""
        lines = T.limit_lines(self.focal, self.t.matches)

        def caveat(rows: DataFrame, order: int, text: str) -> DataFrame:
            return T._lines(rows, "limits", F.lit(order), F.lit(text))

        grouped = draft.draft_flag(self.t.matches, self.t.picks).filter("not chronological").join(
            self.t.picks.select("match_id").distinct(), "match_id", "left_semi")
        return T.union([
            lines,
            caveat(self.shown("role_impact").filter(F.col("role").isin("4", "5")), 10, "saves are not recorded"),
            caveat(self.shown("draft").join(grouped, "match_id"), 11, "picks and bans come grouped, not in draft order"),
            caveat(self.shown("items").filter("level < 3"), 12,
                   f"items: own from {self.p.own_item_cost}, others from {self.p.other_item_cost} gold"),
            caveat(self.shown("abilities"), 13, "abilities are listed in upgrade order"),
            caveat(self.focal.filter("has_window"), 14, "sections outside the window are summaries")])

    # --- documents -----------------------------------------------------------------

    def lines(self) -> DataFrame:
        spark = self.requests.sparkSession
        return T.union([
            self.meta(), self.window(), self.role_impact(), self.anomalies(spark), self.draft(), self.scoreboard(),
            self.benchmarks(), self.networth(), self.items(), self.abilities(), self.laning(), self.combat(),
            self.buffs(), self.teamfights(), self.damage(), self.objectives(), self.limits()])

    def documents(self) -> DataFrame:
        """(match_id, idx, request_id, wrapper, document, filename)."""
        wrapper = F.try_element_at(F.create_map(*[F.lit(x) for kv in WRAPPERS.items() for x in kv]), F.col("model"))
        facts = T.with_headings(self.lines())
        extra = T.union([note_lines(self.requests), rule_lines(self.requests)])
        parts = facts.unionByName(extra).join(self.requests.select(*DOC, wrapper.alias("wrapper")), DOC)
        return T.assemble(parts, DOC).withColumn("filename", match_filename(*map(F.col, DOC)))


def _grouped(df: DataFrame, group: int, tag: str, heading: str, order: Column, line: Column) -> DataFrame:
    rows = df.select(*[c for c in (*DOC, "account_id") if c in df.columns], F.lit(tag).alias("section"),
                     order.cast("bigint").alias("ord"), line.alias("line"))
    return (rows.withColumn("heading", F.lit(heading)).withColumn("section_ord", F.lit(1).cast("bigint"))
            .withColumn("group_ord", F.lit(group)).withColumn("group_tag", F.lit(tag)))


def note_lines(requests: DataFrame) -> DataFrame:
    """The player's own question, each line trimmed."""
    lines = F.posexplode(F.split(F.regexp_replace("note", r"^\s+|\s+$", ""), "\n"))
    rows = requests.filter(X.blank_to_null(F.col("note")).isNotNull()).select("*", lines.alias("_pos", "_line"))
    return _grouped(rows, 3, "player_question", "QUESTION", F.col("_pos"), F.trim(F.col("_line")))


def rule_lines(requests: DataFrame, rules: tuple = MATCH_RULES) -> DataFrame:
    """The numbered rules that apply to each request."""
    asked = requests.withColumn("has_note", X.blank_to_null(F.col("note")).isNotNull())
    rows = Q.rule_list(asked, rules)
    return _grouped(rows, 4, "method", "METHOD", F.col("n"), T.joined(F.col("n"), F.col("rule"), sep=". "))
