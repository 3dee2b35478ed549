"""Who or what a request means: focal player, entity name, account presence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlens.functions import text as X


def resolve_focal(requests: DataFrame, players: DataFrame) -> DataFrame:
    """Player of each (request_id, match_id, account_id, hero): by account, else by hero name part.

    The first match in list order wins; ``idx`` is null where nobody fits.
    """
    member = F.struct("idx", "account_id", F.lower("hero_name").alias("hero"))
    roster = players.groupBy("match_id").agg(F.sort_array(F.collect_list(member)).alias("_roster"))  # ten
    by_account = F.get(F.filter("_roster", lambda p: p["account_id"] == F.col("account_id")), 0)
    needle = F.nullif(F.lower("hero"), F.lit(""))
    by_hero = F.get(F.filter("_roster", lambda p: p["hero"].contains(needle)), 0)
    found = requests.join(roster, "match_id", "left")
    return found.select(
        "request_id", "match_id", F.coalesce(by_account["idx"], by_hero["idx"]).alias("idx"),
        F.when(by_account.isNotNull(), "account").when(by_hero.isNotNull(), "hero")
        .otherwise("unresolved").alias("how"))


def unresolved(resolved: DataFrame) -> DataFrame:
    return resolved.filter(F.col("idx").isNull())


def _grams(text: Column, size: int) -> Column:
    """The distinct pieces of ``size`` characters."""
    last = F.length(text) - size + 1
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda s: F.substring(text, s, F.lit(size)))
    return F.when(last >= 1, F.array_distinct(pieces)).otherwise(F.array().cast("array<string>"))


def resolve_name(requests: DataFrame, names: DataFrame) -> DataFrame:
    """Id of each (request_id, needle): exact name first, else the only name containing it.

    Names are indexed by their pieces of one to three characters, each with a number for its name: linear in a name's length. A longer needle looks only
    at the names that have its rarest piece, and these are then fetched and searched. A needle is unique when the smallest and the largest
    id found agree.
    """
    label = X.normal_name(F.col("name"))
    known = names.select(label.alias("_label"), F.col("id").cast("bigint").alias("id")).filter("_label <> ''")
    known = known.groupBy("_label").agg(F.max("id").alias("id"))        # a repeated name: the last wins
    known = known.withColumn("_key", F.xxhash64("_label"))              # stands for the label, which is looked up and compared last
    pieces = known.select("id", "_key", F.explode(F.concat(*[_grams(F.col("_label"), n) for n in (1, 2, 3)])).alias("_piece"))
    index = pieces.groupBy("_piece").agg(F.count("*").alias("_n"), F.min("id").alias("_lo"), F.max("id").alias("_hi"))
    asked = requests.withColumn("_needle", X.normal_name(F.col("needle")))
    needles = asked.select("_needle").distinct().filter("_needle <> ''")
    short = needles.join(index, F.col("_needle") == F.col("_piece")).select("_needle", "_lo", "_hi")
    parts = needles.filter(F.length("_needle") > 3).select(
        "_needle", F.size(_grams(F.col("_needle"), 3)).alias("_all"), F.explode(_grams(F.col("_needle"), 3)).alias("_piece"))
    rarest = (parts.join(index, "_piece").groupBy("_needle", "_all")
              .agg(F.count("*").alias("_found"), F.min_by("_piece", F.struct("_n", "_piece")).alias("_piece"))
              .filter("_found = _all"))                                 # a piece no name has: no name contains the needle
    longer = (rarest.join(pieces.select("_piece", "_key"), "_piece").join(known, "_key").filter(F.contains("_label", "_needle"))
              .groupBy("_needle").agg(F.min("id").alias("_lo"), F.max("id").alias("_hi")))
    found = short.unionByName(longer)
    exact = known.select(F.col("_label").alias("_needle"), F.col("id").alias("_exact"))
    return (asked.join(found, "_needle", "left").join(exact, "_needle", "left")
            .select("request_id", "needle", F.coalesce(
                "_exact", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo"))).alias("id")))


def skip_missing(accounts: DataFrame, history: DataFrame) -> DataFrame:
    """Accounts with their status: ``kept`` when the history knows them, else ``skipped``."""
    known = history.select("account_id").distinct()
    kept = accounts.join(known, "account_id", "left_semi").withColumn("status", F.lit("kept"))
    gone = accounts.join(known, "account_id", "left_anti").withColumn("status", F.lit("skipped"))
    return kept.unionByName(gone)
