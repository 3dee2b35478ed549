"""Helpers shared by the operators: the shared folder, tables written there, words, Arrow slices."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators of words, as a class of a regular expression.
SEPARATORS = r"\x20\x09-\x0D"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, one of this machine in local mode; a cluster's executors couldn't see that."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="matchlens-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table, written to the shared folder and read again: its lineage ends there, and lost executors cost nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """The path below the shared folder goes, with what was written there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SEPARATORS}]+")), F.lit(0)).cast("long")


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces whose texts hold about `most` bytes: the memory of a task doesn't follow a batch."""
    for batch in until_end(batches):
        start, held = 0, 0
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        for at, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(start, at - start)
                start, held = at, 0
            held += size
        if batch.num_rows > start:
            yield batch.slice(start)


BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on rows of this session go to Python in batches of about 4 MB instead of Spark's 64 MB, of which both sides of the pipe hold a whole one.

    A bound that the session already has stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_BYTES)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)          # where the C library has it


def give_back() -> None:
    """Memory that Arrow and the allocator hold for later goes back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def until_end(batches: Iterator[pa.RecordBatch], *endings: Callable[[], None]) -> Iterator[pa.RecordBatch]:
    """The batches, and the endings after the last one: what a task kept for its rows doesn't stay in a worker that later tasks use."""
    try:
        yield from batches
    finally:
        for ending in endings:
            ending()
        give_back()


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as no column of df has (Spark's names don't tell capitals apart)."""
    taken = {c.lower() for c in df.columns}
    longest = max((len(c) for c in taken), default=0)
    return [n if n.lower() not in taken else n + "_" * (longest + 1 - len(n)) for n in names]


SALTS = 16
BROADCAST_IDS = 1_000_000    # 8 MB of ids


def small_ids(ids: DataFrame, name: str) -> DataFrame:
    """The ids (one column), written, and broadcast if they are few; more of them meet the rows by a shuffle."""
    return small_rows(written(ids.distinct(), name))


def small_rows(rows: DataFrame) -> DataFrame:
    """Rows of a few fields, broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


def salted_join(rows: DataFrame, small: DataFrame, keys: list[str], by: list[str], how: str = "inner") -> DataFrame:
    """rows joined with one row per key, where one key may be that of a third of all rows: these go to SALTS partitions.

    What is still too large for a task then, adaptive execution cuts further: the rows stand on the left. The copies of `small` are never
    broadcast: Spark's estimate doesn't count them, and SALTS times a table that just fits would pass through the driver.
    """
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))
    spread = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    return dealt.join(spread, [*keys, "_salt"], how).drop("_salt")
