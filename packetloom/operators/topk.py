"""Top-k lists, newest-N feeds and orders. Every order ends in a key, so ties never depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(df: DataFrame, by: str, k: int, ties: list[str]) -> DataFrame:
    return df.orderBy(F.desc(by), *ties).limit(k)


def top_per(df: DataFrame, group: list[str], by: str, k: int, ties: list[str]) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc(by), *ties)
    return df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def newest(df: DataFrame, ts: str, k: int, ties: list[str]) -> DataFrame:
    return df.orderBy(F.desc(ts), *(F.desc(t) for t in ties)).limit(k)


def top_groups(df: DataFrame, key: str, k: int, by: str, **sums: Column) -> DataFrame:
    """Group by a key, without null ones, and keep the k largest by one of the sums."""
    return top(df.where(F.col(key).isNotNull()).groupBy(key).agg(*(v.alias(n) for n, v in sums.items())), by, k, [key])


def live_order(df: DataFrame) -> DataFrame:
    """Active sessions first, then the most recently seen."""
    return df.orderBy(F.desc("is_active"), F.desc("last_seen"), "id")
