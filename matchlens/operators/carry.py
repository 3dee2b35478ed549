"""Exact sequence operators whose groups may be far larger than one task.

A window needs all rows of its partition in one task. Where a group can hold a
large part of the table, rows also carry a ``chunk``: a function of the ordering
value that never decreases along the order. The window then runs per
(group, chunk), every chunk is reduced to one row, a second window runs over those
few rows and its result is joined back to the chunk. ``chunk=None`` is the plain
window for groups bounded by the data model (one log inside one document).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNBOUNDED_BEFORE = Window.unboundedPreceding
UNBOUNDED_AFTER = Window.unboundedFollowing


def value_range(value: Column) -> Column:
    """A cell number that never decreases with ``value``: 128 cells per doubling, both signs.

    Any 64-bit quantity falls into some 16,000 cells, so per-cell totals stay small while
    values of one magnitude still spread over many cells.
    """
    cells = F.floor(F.log2(F.abs(value.cast("double")) + 1) * 128)
    return F.when(value < 0, -cells - 1).otherwise(cells)


def prefix_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str,
               chunk: str | None = None, upto: int = 0) -> DataFrame:
    """Running sum of ``value`` along ``order``; ``upto=-1`` leaves the row itself out."""
    parts = keys + ([chunk] if chunk else [])
    w = Window.partitionBy(*parts).orderBy(*order)
    local = df.withColumn(out, F.coalesce(F.sum(value).over(w.rowsBetween(UNBOUNDED_BEFORE, upto)),
                                          F.lit(0)))
    if chunk is None:
        return local
    totals = df.groupBy(*parts).agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(UNBOUNDED_BEFORE, -1)
    base = totals.select(*parts, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    return (local.join(base, parts)
            .withColumn(out, F.col(out) + F.col("_base")).drop("_base"))


def row_numbers(df: DataFrame, keys: list[str], order: list[str], out: str,
                chunk: str | None = None) -> DataFrame:
    return prefix_sum(df, keys, order, F.lit(1).cast("bigint"), out, chunk)


def last_before(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, chunk: str | None = None) -> DataFrame:
    """Adds the last value that isn't null of the rows before each row.

    A chunk's summary is its own last value; of two neighbours' summaries the later one counts if it is there, so they combine like sums.
    """
    parts = keys + ([chunk] if chunk else [])
    earlier = Window.partitionBy(*parts).orderBy(*order).rowsBetween(UNBOUNDED_BEFORE, -1)
    local = df.withColumn(out, F.last(value, ignorenulls=True).over(earlier))
    if chunk is None:
        return local
    last = df.groupBy(*parts).agg(F.max_by(value, F.when(value.isNotNull(), F.struct(*order))).alias("_last"))
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(UNBOUNDED_BEFORE, -1)
    carried = last.select(*parts, F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    return local.join(carried, parts).withColumn(out, F.coalesce(out, "_carried")).drop("_carried")


def rows_away(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, k: int, chunk: str | None = None) -> DataFrame:
    """Adds the value k rows later (earlier, if k is negative), null where there is no such row.

    Across chunks rows meet by their number in the group: each is sent to its own and to the one that looks for it.
    """
    if chunk is None:
        return df.withColumn(out, F.lead(value, k).over(Window.partitionBy(*keys).orderBy(*order)))
    columns = df.columns
    numbered = row_numbers(df, keys, order, "_nth", chunk)
    own = F.struct(F.col("_nth").alias("_for"), F.struct(*columns).alias("_own"), F.lit(None).cast(df.schema[value].dataType).alias("_value"))
    other = F.struct((F.col("_nth") - k).alias("_for"), F.lit(None).cast(df.select(F.struct(*columns).alias("x")).schema["x"].dataType).alias("_own"),
                     F.col(value).alias("_value"))
    sent = numbered.select(*(F.col(c).alias(f"_{c}_key") for c in keys), F.inline(F.array(own, other)))
    met = sent.groupBy(*(f"_{c}_key" for c in keys), "_for").agg(F.max_by("_own", F.col("_own").isNotNull()).alias("_own"), F.max("_value").alias("_value"))
    return met.where("_own is not null").select("_own.*", F.col("_value").alias(out))


def value_counts(df: DataFrame, keys: list[str], value: str, cells: Column | None = None) -> DataFrame:
    """Counts per value with their place in the group's order: ``_start``, ``_end``, ``_all``.

    Equal values are counted before anything is ordered and the counts are ordered cell by cell, so
    a group as large as the table still spreads. ``cells`` keeps only the cells of interest, judged
    by ``_base`` (rows before the cell), ``_rows`` (rows in it) and ``_all``.
    """
    counts = (df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
              .withColumn("_range", value_range(F.col(value))))
    w = Window.partitionBy(*keys)
    places = counts.groupBy(*keys, "_range").agg(F.sum("_n").alias("_rows")).select(
        *keys, "_range", "_rows", F.sum("_rows").over(w).alias("_all"),
        F.coalesce(F.sum("_rows").over(w.orderBy("_range").rowsBetween(UNBOUNDED_BEFORE, -1)),
                   F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(UNBOUNDED_BEFORE, 0)
    end = F.sum("_n").over(inside) + F.col("_base")
    return counts.join(places if cells is None else places.filter(cells), keys + ["_range"]).select(
        *keys, value, "_all", end.alias("_end"), (end - F.col("_n")).alias("_start"))


def percent_rank(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Share of smaller values: (rank - 1) / (rows - 1) inside ``keys``, 0 for a single row."""
    share = F.when(F.col("_all") > 1, F.col("_start") / (F.col("_all") - 1)).otherwise(0.0)
    return df.join(value_counts(df, keys, value).select(*keys, value, share.alias(out)), keys + [value])


def with_median(df: DataFrame, keys: list[str], value: str, out: str, n: str,
                chunked: bool = False) -> DataFrame:
    """Adds each group's exact median (mean of the two middle values when even) and its size.

    ``chunked`` is for groups of any size: only the one or two cells that hold the middle are ordered.
    """
    if not chunked:
        w = Window.partitionBy(*keys)
        return df.withColumns({out: F.median(value).over(w), n: F.count(value).over(w)})
    lo, hi = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    middle = (F.col("_base") <= hi) & (F.col("_base") + F.col("_rows") > lo)

    def at(rank: Column) -> Column:
        hit = (F.col("_start") <= rank) & (F.col("_end") > rank)
        return F.max(F.when(hit, F.col(value).cast("double")))

    found = value_counts(df, keys, value, middle).groupBy(*keys).agg(
        ((at(lo) + at(hi)) / 2).alias(out), F.max("_all").alias(n))
    return df.join(found, keys)


def densest_span(df: DataFrame, keys: list[str], t: str, span: int) -> DataFrame:
    """Largest number of rows inside any closed interval of ``span``, first reached on ties.

    Rows are counted per time value and put into span-wide cells. The interval ending at t covers
    its own cell up to t and the previous cell from t - span on; both parts come from running sums,
    the second one read by a probe placed at t - span. A sliding frame would add up each interval
    anew; this stays linear, and a cell never holds more than two spans of distinct times.
    """
    cell = F.floor(F.col(t) / span)
    counted = df.groupBy(*keys, t).agg(F.count("*").alias("_n"))
    placed = counted.select(*keys, t, F.inline(F.array(
        F.struct(cell.alias("_cell"), F.col(t).alias("_at"), F.lit(1).alias("_kind"), F.col("_n").alias("_add")),
        F.struct((cell - 1).alias("_cell"), (F.col(t) - span).alias("_at"), F.lit(0).alias("_kind"),
                 F.lit(0).cast("bigint").alias("_add")))))
    w = Window.partitionBy(*keys, "_cell")
    upto = F.sum("_add").over(w.orderBy("_at", "_kind").rowsBetween(UNBOUNDED_BEFORE, 0))
    rest = F.sum("_add").over(w) - upto
    spans = (placed.select(*keys, t, F.when(F.col("_kind") == 1, upto).otherwise(rest).alias("_part"))
             .groupBy(*keys, t).agg(F.sum("_part").alias("_rows")))
    best = spans.groupBy(*keys).agg(F.max(F.struct(F.col("_rows").alias("n"), (-F.col(t)).alias("end"))).alias("_best"))
    end = -F.col("_best.end")
    return counted.join(best, keys).groupBy(*keys).agg(
        F.first("_best.n").alias("n"), F.min(F.when(F.col(t) >= end - span, F.col(t))).alias("start"),
        F.first(end).alias("end"), F.sum("_n").alias("total"))
