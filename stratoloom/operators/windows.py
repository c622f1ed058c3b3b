"""Ranking, first-per-key and running totals that do not gather a whole table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group; the planner limits every partition before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def first_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in the order."""
    return top_per_group(df, key, order, 1)


def value_ranks(df: DataFrame, value: str, partitions: int | None = None) -> DataFrame:
    """For every distinct value: ``value, n, before, total`` (rows with it, rows below it, all rows).

    A global window would sort the table in one task.  Here equal values are counted first (combined
    before the shuffle), range-partitioned and summed in two levels: within a partition and over the
    partitions, whose totals are one row each.  Null sorts first.
    """
    counts = df.groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    spread = (counts.repartitionByRange(partitions, F.col("value").asc_nulls_first()) if partitions else counts.repartitionByRange(F.col("value").asc_nulls_first())).withColumn("part", F.spark_partition_id())
    sums = spread.groupBy("part").agg(F.sum("n").alias("part_n"))
    # as many rows as there are partitions
    before_part = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("part", F.coalesce(F.sum("part_n").over(before_part), F.lit(0)).alias("offset"), F.sum("part_n").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("part").orderBy(F.col("value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = spread.withColumn("inner", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return ranked.join(F.broadcast(offsets), "part").select("value", "n", (F.col("offset") + F.col("inner")).alias("before"), "total")


def percent_rank(df: DataFrame, value: str, name: str = "percent_rank") -> DataFrame:
    """The rows with their percent rank by ``value`` (rows below over all rows but one; 0 for one row)."""
    ranks = value_ranks(df, value).select(F.col("value").alias("_v"), F.when(F.col("total") > 1, F.col("before") / (F.col("total") - 1)).otherwise(F.lit(0.0)).alias(name))
    return df.join(ranks, df[value].eqNullSafe(F.col("_v"))).drop("_v")


def running_total(df: DataFrame, group: list[str], order: list[str], value: str, name: str = "running_total") -> DataFrame:
    """The sum of ``value`` over the group's rows up to each row, in an order without ties."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(value).over(w))


def gaps_and_islands(df: DataFrame, group: list[str], seq: str) -> DataFrame:
    """Runs of consecutive integers per group: the group, ``first, last, length``; repeats count once."""
    d = df.select(*group, seq).where(F.col(seq).isNotNull()).distinct()
    w = Window.partitionBy(*group).orderBy(seq)
    return (
        d.withColumn("_island", F.col(seq) - F.row_number().over(w))
        .groupBy(*group, "_island")
        .agg(F.min(seq).alias("first"), F.max(seq).alias("last"), F.count(F.lit(1)).alias("length"))
        .drop("_island")
    )


def dominant(df: DataFrame, group: list[str], category: str) -> DataFrame:
    """The most frequent category of each group with its count and share; ties go to the smaller category."""
    counts = df.groupBy(*group, category).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*group).agg(F.max(F.struct("n")).alias("_m"), F.sum("n").alias("total"))
    best = counts.join(totals, group).where(F.col("n") == F.col("_m.n"))
    return best.groupBy(*group).agg(F.min(category).alias(category), F.first("n").alias("n"), F.first("total").alias("total")).withColumn("share", F.col("n") / F.col("total"))
