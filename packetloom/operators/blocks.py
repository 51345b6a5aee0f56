"""Running values over long histories of one key, cut into blocks of time.

A window by key alone puts a busy key's whole history in one task. Here a window runs inside each (key, block), and what
earlier blocks of the key left behind comes from a small table with a row for each block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.periods import moment

BLOCK_SECONDS = 3600
#: The block of rows without a time: they come first, as in an ascending sort.
NO_TIME = -(1 << 62)


def block_of(ts: str | Column, seconds: int = BLOCK_SECONDS) -> Column:
    at = F.col(ts) if isinstance(ts, str) else moment(ts)
    return F.coalesce(F.floor(F.unix_seconds(at.cast("timestamp")) / seconds).cast("long"), F.lit(NO_TIME))


#: The key's columns as one value that is never null, so that windows and joins by it share one exchange.
KEY = "running_key"


def keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with its key as one column; null keys are a key of their own."""
    return df.withColumn(KEY, F.struct(*keys) if keys else F.struct(F.lit(0).alias("all")))


def running(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str | Column], column: str, how: str, through: bool = True) -> DataFrame:
    """Adds ``running``: the ``max``, ``sum`` or ``last`` non-null value of ``column`` in the key's rows up to this one.

    ``order`` sorts a block's rows, ``through`` says whether a row's own value counts. Null keys are a key of their own.
    Rows are shuffled once, by key and block; one that has its key from ``keyed`` keeps it, and a second call over it
    doesn't shuffle again.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    given = KEY in df.columns
    df = df if given else keyed(df, keys)
    inside = Window.partitionBy(KEY, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if through else -1)
    earlier = Window.partitionBy(KEY).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    last = F.max_by(column, F.when(F.col(column).isNotNull(), F.struct(*order)))
    whole, merged = {"max": (F.max(column), F.max), "sum": (F.sum(column), F.sum), "last": (last, lambda c: F.last(c, ignorenulls=True))}[how]
    blocks = df.groupBy(KEY, block).agg(whole.alias("whole")).select(KEY, block, merged("whole").over(earlier).alias("carried"))
    own = {"max": F.max, "sum": F.sum, "last": lambda c: F.last(c, ignorenulls=True)}[how](column).over(inside)
    out = df.withColumn("own", own).join(blocks, [KEY, block], "left")
    both = {"max": F.greatest("own", "carried"), "last": F.coalesce("own", "carried")}.get(how, F.coalesce("own", F.lit(0)) + F.coalesce("carried", F.lit(0)))
    return out.select(*(c for c in df.columns if given or c != KEY), both.alias("running"))


def running_sums(df: DataFrame, at: str, columns: Sequence[str], seconds: int = BLOCK_SECONDS) -> DataFrame:
    """``df`` (one row for each time ``at``) with ``total_`` of each column up to the row; only blocks meet in one task."""
    df = df.withColumn("time_block", block_of(at, seconds))
    inside, earlier = Window.partitionBy("time_block").orderBy(at), Window.orderBy("time_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = df.groupBy("time_block").agg(*(F.sum(c).alias(c) for c in columns))
    blocks = blocks.select("time_block", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"before_{c}") for c in columns))
    own = df.select("*", *(F.sum(c).over(inside).alias(f"total_{c}") for c in columns)).join(blocks, "time_block")
    return own.select(*(c for c in df.columns if c != "time_block"), *((F.col(f"total_{c}") + F.col(f"before_{c}")).alias(f"total_{c}") for c in columns))


def previous(times: DataFrame, at: str, seconds: int = BLOCK_SECONDS) -> DataFrame:
    """Each distinct time with the one before it (``before``); only blocks, not times, meet in one task."""
    times = times.select(at).where(F.col(at).isNotNull()).distinct().withColumn("time_block", block_of(at, seconds))
    blocks = times.groupBy("time_block").agg(F.max(at).alias("latest"))
    blocks = blocks.select("time_block", F.lag("latest").over(Window.orderBy("time_block")).alias("carried"))
    inside = F.lag(at).over(Window.partitionBy("time_block").orderBy(at))
    return times.withColumn("inside", inside).join(blocks, "time_block").select(at, F.coalesce("inside", "carried").alias("before"))
