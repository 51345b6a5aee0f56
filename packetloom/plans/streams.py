"""Streaming operators over the driver's tables: the table is read as a stream of files and run until all of it is read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.plans.views import Views, registry
from packetloom.streaming import streams

query, QUERIES, ORACLE = registry()


def shared(v: Views, name: str) -> str:
    """A new folder in that of ``spark.checkpoint.dir``; in local mode without one, a temporary folder."""
    folder = v.spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not v.spark.sparkContext.master.startswith("local[") and v.spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


END = "end of stream"


def packet_stream(v: Views, files: int | None = 64) -> tuple[DataFrame, str]:
    """The packets of ``events`` as a stream of files, with a last row far ahead that closes all windows, and a watermark.

    Files are read in no order of time, so the watermark is longer than the table's span: no row is late. A batch has at
    most ``files`` files, if given, else all.
    """
    path = shared(v, "packet-files")
    packets = v("packets").withColumn("ts", F.col("ts").cast("timestamp"))
    low, high = packets.agg(F.min("ts"), F.max("ts")).first()
    days = (high - low).days + 2 if low is not None else 2
    ahead = packets.orderBy(F.desc("ts"), F.desc("id")).limit(1).withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {2 * days + 30} days")).withColumn("src_mac", F.lit(END))
    packets.write.parquet(f"{path}/1")
    ahead.write.parquet(f"{path}/2")
    reader = v.spark.readStream.schema(packets.schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{path}/*"), f"{days} days"


def finished(v: Views, stream: DataFrame) -> DataFrame:
    """Run a stream to its end into a table of the shared folder and read that."""
    path = shared(v, "stream-result")
    run = stream.writeStream.outputMode("append").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).format("parquet").start(f"{path}/rows")
    run.awaitTermination()
    return v.spark.read.schema(stream.schema).parquet(f"{path}/rows").where(F.col("src_mac") != END if "src_mac" in stream.columns else F.lit(True))


@query("""
with gaps as (select *, case when ts - lag(ts) over (partition by src_mac, dst_ip, dst_port, protocol order by ts, id) <= interval '6' hour then 0 else 1 end as fresh from packets),
numbered as (select *, sum(fresh) over (partition by src_mac, dst_ip, dst_port, protocol order by ts, id rows unbounded preceding) as session from gaps)
select src_mac, dst_ip, dst_port, protocol, min(ts) as start_time, max(ts) as end_time, cast(sum(size) as bigint) as bytes_sent, count(*) as packet_count, min_by(src_ip, id) as src_ip from numbered group by src_mac, dst_ip, dst_port, protocol, session""")
def stream_sessions(v: Views):
    packets, late = packet_stream(v)
    out = finished(v, streams.session_stream(packets, "6 hours", late))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start_time", "end_time")})


@query("select time_bucket(interval '5 minutes', ts) as window_start, src_mac, application, cast(sum(size) as bigint) as bytes, count(*) as packets from packets group by all")
def stream_rollup(v: Views):
    packets, late = packet_stream(v)
    out = finished(v, streams.rollup_stream(packets, watermark=late))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "src_mac", "application", "bytes", "packets")


@query("""
select time_bucket(interval '1 minute', ts) - k * interval '1 minute' as window_start, src_mac, application, cast(sum(size) as bigint) as bytes, count(*) as packets from packets, range(0, 5) as s(k) group by all""")
def stream_live(v: Views):
    """ST3: the trailing five minutes, renewed every minute."""
    packets, late = packet_stream(v)
    out = finished(v, streams.live_stream(packets, late))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "src_mac", "application", "bytes", "packets")


def hooked(v: Views, stream: DataFrame, hook, mode: str = "append") -> None:
    writer = stream.writeStream.outputMode(mode).foreachBatch(hook).option("checkpointLocation", shared(v, "hook-checkpoint"))
    writer.trigger(availableNow=True).start().awaitTermination()


def versions(v: Views, path: str, name: str) -> DataFrame:
    """The last version of a table that a hook keeps."""
    rows = v.spark.read.parquet(path)
    return rows.where(F.col(name) == rows.select(F.max(name)).scalar()).drop(name)


@query("select protocol, count(*) as packets, cast(sum(size) as bigint) as bytes from packets group by protocol")
def stream_counters(v: Views):
    """ST7: running counters, each batch's state as a version."""
    path = shared(v, "counters")
    packets, _ = packet_stream(v)
    hooked(v, streams.counter_stream(packets.where(F.col("src_mac") != END)), lambda df, n: df.write.mode("overwrite").parquet(f"{path}/version={n}"), "complete")
    return versions(v, path, "version")


@query("select src_mac as mac_address, min(ts) as first_seen, max(ts) as last_seen, max_by(src_ip, struct_pack(t := ts, i := id)) as ip_address from packets group by src_mac")
def stream_devices(v: Views):
    """ST8: the device table, merged batch by batch."""
    path = shared(v, "devices")
    packets, _ = packet_stream(v)
    hooked(v, packets.where(F.col("src_mac") != END), streams.device_upsert(path))
    found = versions(v, path, "version")
    return found.select("mac_address", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("first_seen", "last_seen")), "ip_address")


@query("""
with b as (select ts, dst_ip, max(domain) as name from packets where domain is not null group by ts, dst_ip)
select p.id, b.name from packets p asof left join b on p.dst_ip = b.dst_ip and p.ts >= b.ts""")
def stream_names(v: Views):
    """ST4: names kept as state, used on later packets. The files stand in no order of time, so all of them are one batch."""
    path = shared(v, "names")
    packets, _ = packet_stream(v, None)
    hooked(v, packets.where(F.col("src_mac") != END), streams.named_batches(path))
    return v.spark.read.parquet(f"{path}/named").select("id", "name")


@query("""
with s as (select distinct date_trunc('day', ts) as taken, src_ip, dst_ip, dst_port from packets), t as (select taken, lag(taken) over (order by taken) as before from (select distinct taken from s))
select s.taken, s.src_ip, s.dst_ip, s.dst_port from s join t on t.taken = s.taken where not exists (select 1 from s p where p.taken = t.before and p.src_ip = s.src_ip and p.dst_ip = s.dst_ip and p.dst_port = s.dst_port)""")
def stream_snapshots(v: Views):
    """ST5: connections that the snapshot before lacked."""
    path = shared(v, "snapshots")
    packets, _ = packet_stream(v)
    rows = packets.where(F.col("src_mac") != END).withColumn("taken", F.date_trunc("day", "ts"))
    hooked(v, rows, streams.snapshot_changes(path, "taken", ["src_ip", "dst_ip", "dst_port"]))
    return v.spark.read.parquet(f"{path}/new").select(F.col("taken").cast("timestamp_ntz").alias("taken"), "src_ip", "dst_ip", "dst_port")
