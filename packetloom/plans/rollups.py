"""Queries answered from rollup tables; the oracle SQL reads the packets themselves."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.operators import rollups, topk
from packetloom.plans.streams import shared
from packetloom.plans.views import Views, registry
from packetloom.streaming import streams

query, QUERIES, ORACLE = registry()

BUCKET = "time_bucket(interval '5' minute, ts)"
MEASURES = "cast(coalesce(sum(size), 0) as bigint) as bytes, count(*) as packets"


def stored(v: Views) -> str:
    """A rollup table made of three batches that mix all times, the second of them run twice, with a compaction between."""
    path, packets = shared(v, "rollup"), v("packets")
    for batch in (0, 1, 1):
        rollups.write_delta(packets.where(F.col("id") % 3 == batch), path, batch, distinct=("user_id",))
    rollups.compact(v.spark, path)
    rollups.write_delta(packets.where(F.coalesce(F.col("id") % 3, F.lit(2)) == 2), path, 2, distinct=("user_id",))
    return path


def table(v: Views) -> DataFrame:
    return rollups.read_rollup(v.spark, stored(v))


@query(f"select {BUCKET} as bucket, src_mac, application, {MEASURES}, min(ts) as first_ts, max(ts) as last_ts from packets where ts is not null group by all")
def rollup_buckets(v: Views):
    """ST2: the five-minute rollup in one batch."""
    return rollups.rollup(v("packets"))


@query(f"select {BUCKET} as bucket, src_mac, application, {MEASURES}, min(ts) as first_ts, max(ts) as last_ts from packets where ts is not null group by all")
def rollup_refreshed(v: Views):
    """ST2: the same table kept up to date by batches, with one rerun and a compaction."""
    return table(v).drop("user_id_sketch")


@query(f"select date_trunc('hour', ts) as bucket, application, {MEASURES}, min(ts) as first_ts, max(ts) as last_ts from packets where ts is not null group by all")
def rollup_hours(v: Views):
    """WN1 from the rollup: hours by application."""
    return rollups.coarser(rollups.rollup(v("packets")), "hour", ("application",))


@query(f"select src_mac, application, {MEASURES} from packets where ts between (select min(ts) from packets) + interval '100006' second and (select min(ts) from packets) + interval '1700009' second group by all")
def rollup_range(v: Views):
    """FLT1 at scale: a period with ends inside buckets, from whole buckets and the packets of its two edges."""
    packets = v("packets")
    at = lambda seconds: packets.agg(F.min("ts") + F.expr(f"interval '{seconds}' second")).first()[0]
    start: datetime = at(100006)
    return rollups.range_totals(packets, rollups.rollup(packets), start, at(1700009))


@query(f"""
with d as (select cast(ts as date) as day, src_mac, {MEASURES} from packets where ts is not null group by all)
select day, src_mac, bytes, packets from (select *, row_number() over (partition by day order by bytes desc, src_mac) as turn from d) where turn <= 3""")
def rollup_talkers(v: Views):
    """TK5 for each day, from the stored table."""
    days = rollups.coarser(table(v), "day", ("src_mac",)).withColumn("day", F.to_date("bucket"))
    return topk.top_per(days, ["day"], "bytes", 3, ["src_mac"]).select("day", "src_mac", "bytes", "packets")


@query("select cast(ts as date) as day, count(distinct user_id) as users, true as near from packets where ts is not null group by all")
def rollup_distinct(v: Views):
    """AG20 at scale: distinct users of a day from merged sketches, held against the exact count."""
    days = rollups.estimates(rollups.coarser(table(v), "day", ())).select(F.to_date("bucket").alias("day"), F.col("user_id").alias("estimate"))
    exact = v("packets").where("ts is not null").groupBy(F.to_date("ts").alias("day")).agg(F.count_distinct("user_id").alias("users"))
    return exact.join(days, "day").select("day", "users", (F.abs(F.col("estimate") - F.col("users")) <= 1 + 0.08 * F.col("users")).alias("near"))


@query(f"select {BUCKET} as bucket, src_mac, application, {MEASURES}, min(ts) as first_ts, max(ts) as last_ts from packets where ts is not null group by all")
def stream_rollup_table(v: Views):
    """ST2 as a stream: micro-batches of files in no order of time keep the table."""
    files, path = shared(v, "packet-files"), shared(v, "rollup")
    v("packets").repartition(4, "id").write.parquet(files)
    stream = v.spark.readStream.schema(v("packets").schema).option("maxFilesPerTrigger", 2).parquet(files)
    streams.each_batch(stream, streams.rollup_upkeep(path), f"{path}-checkpoint", None).awaitTermination()
    return rollups.read_rollup(v.spark, path)
