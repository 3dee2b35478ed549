"""Column expressions over text and game clock values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: unresolved localisation token and the edge characters left around it
LOC_TOKEN = r"[+-]?\{[sfvd]:[^}]*\}(?:%|s(?=\s|$))?"
LOC_EDGES = " +-/,"
HERO_PREFIX = "npc_dota_hero_"
ITEM_PREFIX = "item_"
# ---


def mmss(seconds: Column) -> Column:
    """Game clock text; keeps the sign of pre-game seconds, '?' for null."""
    s = F.abs(seconds.cast("bigint"))
    text = F.format_string("%s%d:%02d", F.when(seconds < 0, "-").otherwise(""),
                           F.floor(s / 60).cast("bigint"), s % 60)
    return F.when(seconds.isNull(), "?").otherwise(text)


def clock(seconds: Column) -> Column:
    """Clock text of a possibly fractional, never negative number of seconds."""
    s = seconds.cast("bigint")
    text = F.format_string("%d:%02d", F.floor(s / 60).cast("bigint"), F.pmod(s, F.lit(60)))
    return F.when(seconds.isNull(), "?").otherwise(text)


def signed(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "?").when(value > 0, F.concat(F.lit("+"), text)).otherwise(text)


def squeeze(text: Column) -> Column:
    """Runs of white space become one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def blank_to_null(text: Column) -> Column:
    return F.nullif(squeeze(text), F.lit(""))


def strip_tokens(text: Column) -> Column:
    """Drop localisation tokens and their unit, leaving the readable name."""
    cut = F.regexp_replace(text, LOC_TOKEN, " ")
    cut = F.regexp_replace(cut, r"\s{2,}", " ")
    cut = F.regexp_replace(cut, r"^\s+|\s+$", "")
    return F.when(text.contains("{"), F.btrim(cut, F.lit(LOC_EDGES))).otherwise(text)


def prettify(internal: Column) -> Column:
    return F.initcap(F.replace(internal, F.lit("_"), F.lit(" ")))


def without(text: Column, part: str) -> Column:
    return F.replace(text, F.lit(part), F.lit(""))


def clamp01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def normal_name(text: Column) -> Column:
    """The form names are compared in: underscores as blanks, squeezed, lower case."""
    return F.lower(squeeze(F.replace(text, F.lit("_"), F.lit(" "))))


def range_bounds(text: Column) -> tuple[Column, Column]:
    """Both ends of 'a-b' (hyphen or en dash); nulls when the text is anything else."""
    pattern = r"^\s*([0-9]+)\s*[-–]\s*([0-9]+)\s*$"
    return tuple(F.regexp_extract(text, pattern, i).try_cast("bigint") for i in (1, 2))


def side(is_radiant: Column) -> Column:
    return F.when(is_radiant, "Radiant").otherwise("Dire")


def tag(hero: Column, is_radiant: Column, focal: Column) -> Column:
    return F.concat(F.when(focal, "★ ").otherwise(""), F.lit("["),
                    F.when(is_radiant, "R").otherwise("D"), F.lit("] "), hero)


def short_tag(hero: Column, is_radiant: Column, focal: Column) -> Column:
    return F.concat(hero, F.lit("["), F.when(is_radiant, "R").otherwise("D"), F.lit("]"),
                    F.when(focal, "★").otherwise(""))


def text_bytes(text: Column) -> Column:
    return F.octet_length(text).cast("bigint")


def half_even(value: Column, digits: int = 0) -> Column:
    out = F.bround(value.cast("double"), digits)
    return out if digits else out.cast("bigint")
