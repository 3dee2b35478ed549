"""Facts as text: templates, lines per section and assembled documents.

A document's size is bounded by its operators (at most seven deviations, eight swings, ten
players, one match of minutes), so its lines may be collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlens.functions import text as X
from matchlens.sources.landing import values

KEY = ["match_id", "idx"]

# Our own wording. Key, then text with {name} placeholders.
TEMPLATES = {
    "item_lag": "{item} at {at}: {excess} min behind own pace (expected {expected} at {gpm} per min)",
    "bench_low": "{metric} in the bottom of the distribution: percentile {pct}",
    "bench_high": "{metric} in the top of the distribution: percentile {pct}",
    "bench_spread": "{high_metric} at percentile {high}, {low_metric} at {low}",
    "farm_stall": "income {rate} per min in minutes {start} to {end}, usual {average}",
    "death_cluster": "{count} of {total} deaths between {start} and {end}",
    "dead_share": "dead for {dead}, {pct}% of the match; others typically {typical}",
    "lane_gap_ahead": "lane efficiency {mine}% against {theirs}%: {gap} ahead",
    "lane_gap_behind": "lane efficiency {mine}% against {theirs}%: {gap} behind",
    "kp_low": "took part in {pct}% of {team_kills} team kills ({kills} kills, {assists} assists)",
    "kp_high": "took part in {pct}% of {team_kills} team kills ({kills} kills, {assists} assists)",
    "gold_collapse": "team lost {gold} of its lead in minutes {start} to {end}",
}

HEADINGS = {
    "meta": "MATCH", "window": "WINDOW", "role_impact": "ROLE", "anomalies": "UNUSUAL IN THE DATA",
    "draft": "DRAFT", "scoreboard": "SCOREBOARD", "benchmarks": "BENCHMARKS", "networth": "ADVANTAGE",
    "items": "ITEMS", "abilities": "ABILITIES", "laning": "LANE", "combat": "COMBAT", "buffs": "BUFFS",
    "teamfights": "FIGHTS", "damage": "DAMAGE", "objectives": "OBJECTIVES", "limits": "LIMITS",
}
GROUP_OF = {"limits": "data_limitations"}      # every other section belongs to match_data


def templates(spark: SparkSession, lang: str = "en") -> DataFrame:
    return values(spark, [(lang, k, v) for k, v in TEMPLATES.items()], ["lang", "key", "template"])


def missing_templates(entries: DataFrame, languages: list[str], base: str) -> DataFrame:
    """(key, lang) pairs the base language has and another one lacks."""
    held = entries.groupBy("key").agg(F.collect_set("lang").alias("_held"))   # a few languages
    wanted = F.array(*[F.lit(x) for x in languages])
    return (held.filter(F.array_contains("_held", base))
            .select("key", F.explode(F.array_except(wanted, F.col("_held"))).alias("lang")))


def fill(template: Column, params: Column) -> Column:
    """Every {name} replaced by its parameter."""
    return F.aggregate(F.map_entries(params), template, lambda text, e: F.replace(
        text, F.concat(F.lit("{"), e["key"], F.lit("}")), F.coalesce(e["value"], F.lit("?"))))


def render_templates(rows: DataFrame, table: DataFrame, out: str = "text") -> DataFrame:
    """Text of each (lang, key, params) row; a key the language lacks shows as [key?]."""
    return (rows.join(table, ["lang", "key"], "left")
            .withColumn(out, F.coalesce(fill(F.col("template"), F.col("params")),
                                        F.concat(F.lit("["), F.col("key"), F.lit("?]"))))
            .drop("template"))


# --- lines: (match_id, idx, section, ord, line) --------------------------------------

def _document(df: DataFrame) -> list[str]:
    """Key of the document a row belongs to: the focal player, and the request where there is one."""
    return [*KEY, *[c for c in ("request_id",) if c in df.columns]]


def _lines(df: DataFrame, section: str, order: Column, line: Column) -> DataFrame:
    return df.select(*_document(df), F.lit(section).alias("section"), order.cast("bigint").alias("ord"), line.alias("line"))


def joined(*parts: Column, sep: str = " | ") -> Column:
    return F.concat_ws(sep, *[p.cast("string") for p in parts])


def meta_lines(meta: DataFrame) -> DataFrame:
    c = F.col
    text = joined(c("match_id"), c("patch"), c("mode"), c("lobby"), c("duration"),
                  F.when(c("win"), "won").otherwise("lost"), c("my_side"), c("hero_name"),
                  F.concat(c("position"), F.lit("/"), c("lane_key")), *([c("role_source")] if "role_source" in meta.columns else []))
    return _lines(meta, "meta", F.lit(1), text)


def scoreboard_lines(board: DataFrame) -> DataFrame:
    cols = ["lvl", "kda", "lh_dn", "gpm_xpm", "nw", "hd", "td", "heal", "dt"]
    who = X.tag(F.col("hero_name"), F.col("is_radiant"), F.lit(True))
    return _lines(board, "scoreboard", F.col("idx"), joined(who, *[F.col(c) for c in cols]))


def deviation_lines(deviations: DataFrame, table: DataFrame, lang: str = "en") -> DataFrame:
    rendered = render_templates(deviations.withColumn("lang", F.lit(lang)), table)
    return _lines(rendered, "anomalies", F.col("ord"),
                  F.concat(F.lit("- ["), F.col("axis"), F.lit("] "), F.col("text")))


def swing_lines(swings: DataFrame, players: DataFrame) -> DataFrame:
    rows = players.select(*KEY, "is_radiant").join(swings, ["match_id", "is_radiant"])
    return _lines(rows, "networth", F.col("m"),
                  F.format_string("m%2d: %s, %s", F.col("m"), F.col("swing"), X.signed(F.col("gold"))))


def bench_lines(rows: DataFrame) -> DataFrame:
    return _lines(rows, "benchmarks", F.col("ord"),
                  joined(F.col("metric"), F.coalesce(F.col("pct").cast("string"), F.lit("?")), sep=" "))


def fight_lines(outcome: DataFrame) -> DataFrame:
    """Time, losses of both sides, verdict and own gold; then who fell (``names``, if given) and what the focal player did."""
    c = F.col
    own = [F.concat(F.lit("died "), F.nullif(c("my_deaths"), F.lit(0)).cast("string")),
           F.concat(F.lit("damage "), F.nullif(c("my_damage"), F.lit(0)).cast("string"))]
    if "killed" in outcome.columns:
        victims = F.array_join(F.transform("killed", lambda k: X.without(k, X.HERO_PREFIX)), ", ")
        own.append(F.concat(F.lit("killed "), F.nullif(victims, F.lit(""))))
    if "names" in outcome.columns:
        dead = F.array_join(F.transform("fallen", lambda i: F.try_element_at("names", i)), ", ")
        own.insert(0, F.concat(F.lit("fallen "), F.nullif(dead, F.lit(""))))
    score = F.concat(c("my_losses").cast("string"), F.lit(":"), c("enemy_losses").cast("string"))
    span = F.concat(X.mmss(c("start")), F.lit("-"), X.mmss(c("end")))
    return _lines(outcome, "teamfights", c("fight_no"), joined(span, score, c("verdict"), X.signed(c("my_gold_delta")), *own))


def limit_lines(players: DataFrame, matches: DataFrame) -> DataFrame:
    """Fixed limits and one more for a match without a parsed replay."""
    rows = players.select(*_document(players)).join(matches.select("match_id", "parsed"), "match_id")
    texts = F.array_compact(F.array(F.lit("series have one point per minute"),
                                    F.lit("positions are inferred from lane and net worth"),
                                    F.when(~F.col("parsed"), "the replay is not parsed")))
    listed = rows.select(*_document(rows), F.posexplode(texts).alias("_pos", "_text"))
    return _lines(listed, "limits", F.col("_pos") + 1, F.col("_text"))


def with_headings(lines: DataFrame) -> DataFrame:
    """Adds group, section order and heading."""
    names = list(HEADINGS)
    heading = F.create_map(*[F.lit(x) for kv in HEADINGS.items() for x in kv])
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("section"))
    limits = F.col("section").isin(*GROUP_OF)
    return (lines.withColumn("heading", F.try_element_at(heading, F.col("section")))
            .withColumn("section_ord", place)
            .withColumn("group_ord", F.when(limits, 2).otherwise(1))
            .withColumn("group_tag", F.when(limits, "data_limitations").otherwise("match_data")))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# --- documents ------------------------------------------------------------------------

def assemble(lines: DataFrame, doc: list[str]) -> DataFrame:
    """One text per document from (doc.., wrapper, group_ord, group_tag, section_ord, heading, ord, line).

    Markdown prints '## heading' per section. XML puts each group into a tag and leaves out the
    heading of a group's only section. All levels aggregate inside one partitioning by document.
    """
    keys = [*doc, "wrapper"]
    section = (lines.repartition(*keys)
               .groupBy(*keys, "group_ord", "group_tag", "section_ord", "heading")
               .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "line"))),
                                             lambda x: x["line"]), "\n").alias("body")))
    group = section.groupBy(*keys, "group_ord", "group_tag").agg(
        F.sort_array(F.collect_list(F.struct("section_ord", "heading", "body"))).alias("parts"))
    title = lambda s: F.concat(F.lit("## "), s["heading"])
    markdown = F.transform("parts", lambda s: F.concat_ws("\n", title(s), s["body"], F.lit("")))
    alone = F.size("parts") == 1
    tagged = F.transform("parts", lambda s, i: F.concat_ws(
        "\n", F.when(~alone & (i > 0) & s["heading"].isNotNull(), ""), F.when(~alone, title(s)), s["body"]))
    text = F.when(F.col("wrapper") == "xml", F.concat_ws(
        "\n", F.concat(F.lit("<"), F.col("group_tag"), F.lit(">")), F.array_join(tagged, "\n"),
        F.concat(F.lit("</"), F.col("group_tag"), F.lit(">")), F.lit(""))).otherwise(F.array_join(markdown, "\n"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("group_ord", text.alias("text")))),
                                     lambda g: g["text"]), "\n")
    return group.groupBy(*keys).agg(
        F.concat(F.regexp_replace(whole, r"\n+$", ""), F.lit("\n")).alias("document"))
