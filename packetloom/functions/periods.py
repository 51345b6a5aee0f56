"""Period windows, time buckets and calendar profiles. The present is always an argument: the last time in the data unless given."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERIODS = {"1h": "1 hour", "24h": "24 hours", "7d": "7 days", "30d": "30 days", "90d": "90 days", "1y": "365 days"}
DEFAULT = "24h"


def moment(value: datetime | str | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp_ntz")


def present(df: DataFrame, ts: str, as_of=None) -> Column:
    """``as_of``, or the latest ``ts`` of the table as a scalar subquery."""
    return moment(as_of) if as_of is not None else df.select(F.max(ts)).scalar()


def ago(until: Column, span: str) -> Column:
    return until - F.expr(f"INTERVAL {span}")


def in_period(df: DataFrame, ts: str, period: str = DEFAULT, as_of=None, start=None, end=None) -> DataFrame:
    """Rows of a named period before ``as_of`` or between ``start`` and ``end``; both ends count. Unknown names mean 24 hours."""
    if start is not None and end is not None:
        return df.where(F.col(ts).between(moment(start), moment(end)))
    until = present(df, ts, as_of)
    return df.where(F.col(ts).between(ago(until, PERIODS.get(period, PERIODS[DEFAULT])), until))


def since(df: DataFrame, ts: str, period: str = DEFAULT, as_of=None, end=None) -> DataFrame:
    """Rows from the start of a period on: a name, an ISO date or time (``Z`` allowed), else 24 hours; up to ``end``, if given."""
    if end is not None:
        return since(df.where(F.col(ts) <= F.lit(end).try_cast("timestamp").cast("timestamp_ntz")), ts, period, as_of)
    until = present(df, ts, as_of)
    if period in PERIODS:
        return df.where(F.col(ts) >= ago(until, PERIODS[period]))
    parsed = F.lit(period).try_cast("timestamp").cast("timestamp_ntz")
    return df.where(F.col(ts) >= F.coalesce(parsed, ago(until, PERIODS[DEFAULT])))


def trailing_hours(df: DataFrame, ts: str, hours: int = 24, as_of=None) -> DataFrame:
    return df.where(F.col(ts) >= ago(present(df, ts, as_of), f"{int(hours)} hours"))


def bucket(ts: Column, unit: str) -> Column:
    """The text key of an hour, day, week (Sunday first, as ``%Y-W%U``) or, for any other unit, month."""
    if unit == "hour":
        return F.date_format(ts, "yyyy-MM-dd HH:00")
    if unit == "day":
        return F.date_format(ts, "yyyy-MM-dd")
    if unit == "week":
        week = F.floor((F.dayofyear(ts) - 1 + 7 - (F.dayofweek(ts) - 1)) / 7)
        return F.concat(F.date_format(ts, "yyyy"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))
    return F.date_format(ts, "yyyy-MM")


def slots(spark, n: int, name: str) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias(name))


def filled(df: DataFrame, spine: DataFrame, key: str) -> DataFrame:
    """Every key of the spine, with zeros where ``df`` has no row."""
    return spine.join(df, key, "left").na.fill(0)


def hour_profile(df: DataFrame, ts: str, **sums) -> DataFrame:
    """24 rows, one for each hour of the day."""
    found = df.groupBy(F.hour(ts).alias("hour")).agg(*(v.alias(k) for k, v in sums.items()))
    return filled(found, slots(df.sparkSession, 24, "hour"), "hour")


def weekday_profile(df: DataFrame, ts: str, **sums) -> DataFrame:
    """7 rows, Monday is 0."""
    found = df.groupBy(F.weekday(ts).alias("weekday")).agg(*(v.alias(k) for k, v in sums.items()))
    return filled(found, slots(df.sparkSession, 7, "weekday"), "weekday")


def day_spine(df: DataFrame, ts: str, days: int, as_of=None) -> DataFrame:
    """One row for each of the last ``days`` days, the present one included."""
    last = F.to_date(present(df, ts, as_of))
    one = df.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))
    return one


def bandwidth_trend(df: DataFrame, ts: str, size: Column, period: str, unit: str | None = None) -> DataFrame:
    """Bytes by hour if the period names 24h, else by day, unless a unit is given."""
    unit = unit or ("hour" if "24h" in period else "day")
    return df.groupBy(bucket(F.col(ts), unit).alias("bucket")).agg(F.sum(size).alias("bytes"))


def peak_hour(df: DataFrame, ts: str, size: Column) -> DataFrame:
    """The hour of the day with the most bytes (the earliest on a tie), its bytes and its label; no row without rows."""
    hours = df.groupBy(F.hour(ts).alias("hour")).agg(F.sum(size).alias("bytes"))
    top = hours.orderBy(F.desc("bytes"), "hour").limit(1)
    return top.withColumn("label", F.format_string("%02d:00 - %02d:00", "hour", (F.col("hour") + 1) % 24))
