"""Incremental landing of match documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlens.schemas import RAW_MATCH
from matchlens.sources.versioned import VersionedTable


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    return (spark.readStream.schema(RAW_MATCH).option("columnNameOfCorruptRecord", "_bad").json(path)
            .withColumns({"ingest_ts": F.current_timestamp(), "file_ts": F.col("_metadata.file_modification_time"),
                          "file_name": F.col("_metadata.file_path")}))


def match_table(spark: SparkSession, path: str, buckets: int = 64, **options) -> VersionedTable:
    """One row per match: a parsed copy supersedes unparsed ones, then the newest counts."""
    return VersionedTable(spark, path, "match_id", lambda: F.col("version").isNotNull(), ["ingest_ts", "file_ts", "file_name"], buckets, **options)


def land(stream: DataFrame, path: str, checkpoint: str, buckets: int = 64, **options):
    """Upserts every batch by match. A batch that is replayed changes nothing; only the buckets of its matches are written.

    Documents that can't be read, or name no match, go to ``<path>_quarantine`` with their text.
    """
    table = match_table(stream.sparkSession, path, buckets, **options)

    def write(batch: DataFrame, epoch: int) -> None:
        broken = F.col("_bad").isNotNull() | F.col("match_id").isNull()
        (batch.filter(broken).select("_bad", "match_id", "ingest_ts", "file_ts", "file_name")
         .write.mode("overwrite").parquet(f"{path}_quarantine/batch={epoch}"))
        table.upsert(batch.filter(~broken).drop("_bad"), epoch)

    return (stream.writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def current(spark: SparkSession, path: str) -> DataFrame:
    """The landed table with one row per match: a scan, without the places of superseded documents."""
    return match_table(spark, path).read().drop("file_ts", "file_name")
