"""Feedback records as a stream: validation, rate cap, tally, and ingestion to isolated sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchlens.params import DEPTHS, FOCUSES, MAX_COMMENT, MAX_PER_MINUTE, MODELS, ROLES
from matchlens.schemas import FEEDBACK
from matchlens.streaming.fanout import FanOut, Sink

MODES = ("match", "profile")


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(FEEDBACK).json(path)


def problem() -> Column:
    """The first violated rule of a record, null for a valid one."""
    c = F.col

    def outside(name: str, domain: tuple[str, ...]) -> Column:
        return c(name).isNotNull() & ~c(name).isin(*domain)

    return (F.when(c("rating").isNull() | ~c("rating").isin(1, -1), "rating")
            .when(c("mode").isNull() | ~c("mode").isin(*MODES), "mode")
            .when(outside("model", MODELS), "model")
            .when(F.length("comment") > MAX_COMMENT, "comment")
            .when(c("match_id") <= 0, "match_id")
            .when(outside("role", ROLES), "role").when(outside("depth", DEPTHS), "depth")
            .when(outside("focus", FOCUSES), "focus")
            .when(F.length("window") > 16, "window")
            .when(c("prompt_bytes") < 0, "prompt_bytes")
            .when(F.try_to_timestamp("created_at").isNull(), "created_at"))


def validate_feedback(records: DataFrame) -> DataFrame:
    """Records with ``problem`` and a trimmed comment; an account id is never carried."""
    trimmed = F.nullif(F.regexp_replace("comment", r"^\s+|\s+$", ""), F.lit(""))
    return (records.drop("account_id").withColumn("problem", problem())
            .withColumn("comment", trimmed)
            .withColumn("followup", F.coalesce("followup", F.lit(False))))


def cap_per_window(records: DataFrame, by: list[str], ts: str = "ts", order: tuple[str, ...] = (),
                   limit: int = MAX_PER_MINUTE, seconds: int = 60) -> DataFrame:
    """At most ``limit`` records per aligned minute; the ranking limit runs before the shuffle."""
    w = Window.partitionBy(*by, "_minute").orderBy(ts, *order)
    return (records.withColumn("_minute", F.window(F.col(ts), f"{seconds} seconds").getField("start"))
            .withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit)
            .drop("_minute", "_n"))


def vote_tally(records: DataFrame, every: str = "1 day", ts: str = "ts") -> DataFrame:
    """Votes and their balance per period; follow-up comments are not votes."""
    return (records.filter(~F.col("followup"))
            .groupBy(F.window(F.col(ts), every).alias("_w"), "mode", "model")
            .agg(F.count("*").alias("votes"), F.sum("rating").alias("balance"))
            .select(F.col("_w.start").alias("start"), "mode", "model", "votes", "balance"))


def tally_stream(records: DataFrame, late: str = "10 minutes", every: str = "1 day") -> DataFrame:
    """The tally with a watermark, for append or update mode; records with a problem are not counted."""
    sound = records.filter("problem is null") if "problem" in records.columns else records
    stamped = sound.withColumn("ts", F.try_to_timestamp("created_at")).filter("ts is not null").withWatermark("ts", late)
    return vote_tally(stamped, every)


def folder_sink(path: str, fmt: str) -> Sink:
    """One folder per batch, overwritten when the batch is replayed: no duplicates on retry."""
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").format(fmt).save(f"{path}/batch={epoch}")
    return write


def ingest(spark: SparkSession, records: DataFrame, accepted: dict[str, Sink], quarantine: Sink, path: str, **limits):
    """Validated records to every accepted sink, the others to quarantine: the query and its fan-out.

    Checkpoint, spool and ledgers are below path. The query ends when the input is read, whatever state the sinks are in.
    """
    def only(sink: Sink, good: bool) -> Sink:
        def write(batch: DataFrame, epoch: int) -> None:
            sink(batch.filter("problem is null").drop("problem") if good else batch.filter("problem is not null"), epoch)
        return write
    sinks = {**{name: only(sink, True) for name, sink in accepted.items()}, "quarantine": only(quarantine, False)}
    fan = FanOut(spark, sinks, f"{path}/fanout", **limits)
    query = (records.writeStream.foreachBatch(lambda batch, epoch: fan(validate_feedback(batch), epoch))
             .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())
    return query, fan
