"""Raw match documents in, newest version kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlens.schemas import DIMENSIONS, RAW_MATCH


def values(spark: SparkSession, rows: list[tuple], columns: list[str]) -> DataFrame:
    """A small literal table with known size, so that Spark can decide to broadcast it."""
    def literal(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, list):
            return f"CAST(array({', '.join(map(literal, v))}) AS array<string>)"
        return str(v) if isinstance(v, (int, float)) else "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"

    body = ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(columns)})")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """All documents as typed rows, with the text of those that can't be read in ``_bad``."""
    return (spark.read.schema(RAW_MATCH).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_bad").json(path))


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """Match documents as typed rows; unknown fields are ignored, missing ones are null.

    Documents that can't be read or name no match are left out; ``rejected`` has them.
    """
    return read_documents(spark, path).filter("_bad is null and match_id is not null")


def rejected(spark: SparkSession, path: str) -> DataFrame:
    """The documents that ``read_matches`` leaves out: their text, or the document without a match."""
    bad = read_documents(spark, path).filter("_bad is not null or match_id is null")
    return bad.select(F.coalesce("_bad", F.to_json(F.struct(*[c for c in bad.columns if c != "_bad"]))).alias("document"))


def read_dimension(spark: SparkSession, name: str, path: str | None = None) -> DataFrame:
    """A look-up table, or an empty one where it is not available: names then fall back."""
    schema = DIMENSIONS[name]
    if path is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def read_dimensions(spark: SparkSession, paths: dict[str, str] | None = None) -> dict[str, DataFrame]:
    paths = paths or {}
    return {name: read_dimension(spark, name, paths.get(name)) for name in DIMENSIONS}


def latest_version(rows: DataFrame, key: str, final: Column, recency: list[Column]) -> DataFrame:
    """One row per key: a final (parsed) version beats any other, then the newest.

    An aggregate, not a ranking: versions of a hot key are reduced before the shuffle. Callers give a recency
    without ties where equal ones can differ.
    """
    rank = F.struct(final.cast("int").alias("final"), *[c.alias(f"r{i}") for i, c in enumerate(recency)])
    rest = [c for c in rows.columns if c != key]
    return (rows.groupBy(key).agg(F.max_by(F.struct(*rest), rank).alias("_row"))
            .select(key, *[F.col(f"_row.{c}").alias(c) for c in rest]))
