"""Reading the tables of a folder: one Parquet file or directory per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The table, or just the named columns of it (which then are all that is read)."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def latest(df: DataFrame, key: str, by: str) -> DataFrame:
    """The current row of each key: the one with the greatest ``by``; of equal rows one is kept.

    A row whose ``by`` is null counts as the oldest, a row without key is dropped.  Ties are
    settled by the order of the remaining columns, so the result does not hinge on partitioning.
    The maximum is combined before the shuffle, so a key with many states costs no more than one.
    """
    rest = [c for c in df.columns if c not in (key, by)]
    packed = F.struct(F.col(by).isNotNull().alias("_has"), F.col(by), *[F.col(f"`{c}`") for c in rest])
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(packed).alias("_best"))
    return best.select(*[F.col(c) if c == key else F.col(f"_best.`{c}`").alias(c) for c in df.columns])
