"""Time rollups: packets summed into buckets of time, device and application, kept as a table and read in their place.

A rollup table is a folder with a base and one delta for each batch since, all partitioned by date. A batch that runs
again replaces its own delta, late packets are just part of a later delta, and compaction sums what is there into a new
base beside the old one. Readers take the newest finished base and the finished deltas after it, so neither a lost
executor nor a stopped compaction leaves anything half done. Buckets are sums, so all of this is exact; distinct counts
are kept as sketches, which merge like sums.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 300
KEYS = ("src_mac", "application")
#: Registers of a sketch as a power of 2: its error is about 1.6 %.
SKETCH_BITS = 12
EPOCH = datetime(1970, 1, 1)


def _merges(columns: Sequence[str]) -> list[Column]:
    """How the measures among ``columns`` are merged."""
    of = {"bytes": F.sum, "packets": F.sum, "first_ts": F.min, "last_ts": F.max}
    return [F.hll_union_agg(c).alias(c) if c.endswith("_sketch") else of[c](c).alias(c) for c in columns if c in of or c.endswith("_sketch")]


def rollup(packets: DataFrame, width: int = WIDTH, keys: Sequence[str] = KEYS, distinct: Sequence[str] = ()) -> DataFrame:
    """``bucket`` (start of ``width`` seconds), the keys, bytes, packets, first and last time, and a sketch of each ``distinct``.

    Packets without a time have no bucket; null keys are a key of their own.
    """
    sketches = [F.hll_sketch_agg(c, SKETCH_BITS).alias(f"{c}_sketch") for c in distinct]
    grouped = packets.where("ts is not null").groupBy(F.window("ts", f"{width} seconds").alias("w"), *keys)
    sums = [F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("packets"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")]
    out = grouped.agg(*sums, *sketches)
    return out.select(F.col("w.start").alias("bucket"), *(c for c in out.columns if c != "w"))


def merged(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row for each bucket and key."""
    return rows.groupBy("bucket", *keys).agg(*_merges(rows.columns))


def coarser(rows: DataFrame, unit: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Buckets of an hour, day, week or month, perhaps with fewer keys, from finer ones."""
    kind = rows.schema["bucket"].dataType
    return merged(rows.withColumn("bucket", F.date_trunc(unit, "bucket").cast(kind)), keys)


def estimates(rows: DataFrame) -> DataFrame:
    """The sketches as distinct counts."""
    return rows.select(*(F.hll_sketch_estimate(c).alias(c.removesuffix("_sketch")) if c.endswith("_sketch") else F.col(c) for c in rows.columns))


# ---- the table


def write_delta(packets: DataFrame, path: str, batch: int, width: int = WIDTH, keys: Sequence[str] = KEYS, distinct: Sequence[str] = ()) -> None:
    """The rollup of one batch of packets as the table's delta of that number; one that is there is replaced."""
    rows = rollup(packets, width, keys, distinct).withColumn("date", F.to_date("bucket"))
    rows.write.partitionBy("date").mode("overwrite").parquet(f"{path}/delta/batch={batch}")


def finished(spark: SparkSession, path: str, kind: str, name: str) -> dict[int, str]:
    """The folders ``kind``/``name``=N of a table that were written to their end, by N."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, f"{kind}/{name}=*/_SUCCESS")) or []
    folders = [f.getPath().getParent().toString() for f in found]
    return {int(re.search(r"=(\d+)$", x)[1]): x for x in folders}


def read_rollup(spark: SparkSession, path: str, keys: Sequence[str] = KEYS, first_day=None, last_day=None) -> DataFrame:
    """The table's rows, one for each bucket and key; only the partitions of the given days are read."""
    bases, deltas = finished(spark, path, "base", "version"), finished(spark, path, "delta", "batch")
    upto = max(bases, default=-1)
    found = []
    if bases:
        found.append(spark.read.option("basePath", f"{path}/base").parquet(bases[upto]).drop("version"))
    if later := [deltas[n] for n in sorted(deltas) if n > upto]:
        found.append(spark.read.option("basePath", f"{path}/delta").parquet(*later).drop("batch"))
    if not found:
        raise ValueError(f"no rollup table at {path}")
    rows = reduce(DataFrame.unionByName, found)
    if first_day is not None:
        rows = rows.where(F.col("date") >= F.lit(first_day).cast("date"))
    if last_day is not None:
        rows = rows.where(F.col("date") <= F.lit(last_day).cast("date"))
    return merged(rows.drop("date"), keys)


def compact(spark: SparkSession, path: str, keys: Sequence[str] = KEYS) -> int:
    """Sum base and deltas into a new base; returns the number of the last delta in it. Older folders may be removed after.

    A delta that is written again after it was compacted doesn't count twice, nor at all: compact batches that are done.
    """
    bases = finished(spark, path, "base", "version")
    upto = max((*bases, *finished(spark, path, "delta", "batch")), default=-1)
    if upto not in bases:
        rows = read_rollup(spark, path, keys).withColumn("date", F.to_date("bucket"))
        rows.write.partitionBy("date").mode("overwrite").parquet(f"{path}/base/version={upto}")
    return upto


# ---- answers


def floor_time(value: datetime, width: int) -> datetime:
    plain = value.astimezone(timezone.utc).replace(tzinfo=None) if value.tzinfo else value
    return value - timedelta(seconds=(plain - EPOCH).total_seconds() % width)


def range_totals(packets: DataFrame, rows: DataFrame, start: datetime, end: datetime, keys: Sequence[str] = KEYS, width: int = WIDTH) -> DataFrame:
    """Bytes and packets by key from ``start`` to ``end``, both included: whole buckets from the rollup, the rest from packets.

    At most two buckets' worth of packets are read, whatever the length of the range, if packets are stored by time.
    """
    last = floor_time(end, width)
    first = floor_time(start, width)
    first = first if first == start else first + timedelta(seconds=width)
    at = F.col("ts")
    edges = packets.where(at.between(F.lit(start), F.lit(end)))
    if first < last:
        edges = edges.where((at < F.lit(first)) | (at >= F.lit(last)))
        inside = rows.where((F.col("bucket") >= F.lit(first)) & (F.col("bucket") < F.lit(last)))
    else:
        inside = rows.limit(0)
    parts = inside.select(*keys, "bytes", "packets").unionByName(edges.select(*keys, F.col("size").alias("bytes"), F.lit(1).cast("long").alias("packets")))
    return parts.groupBy(*keys).agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.sum("packets").alias("packets"))
