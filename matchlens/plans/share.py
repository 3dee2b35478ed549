"""Intermediate tables several branches of one plan read.

Spark reuses an exchange only between identical branches, and column pruning makes them
differ; a reduced table read by many branches is therefore persisted. Lost blocks are
recomputed from their lineage. ``release`` drops everything kept so far.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame

_kept: list[DataFrame] = []


def keep(df: DataFrame) -> DataFrame:
    df.persist(StorageLevel.MEMORY_AND_DISK)
    _kept.append(df)
    return df


def release() -> None:
    while _kept:
        _kept.pop().unpersist()
