"""Structured Streaming forms of the sessionizer, the rollups, the live view, the name cache and the device table.

Packets carry event time in ``ts``. Late rows behind the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from packetloom.operators.joins import as_of_join
from packetloom.operators.pipeline import new_connections
from packetloom.operators.rollups import WIDTH, write_delta
from packetloom.operators.sessions import SESSION_KEY, discover_devices, merge_devices, sessionize
from packetloom.operators.topk import newest


def timed(packets: DataFrame, watermark: str) -> DataFrame:
    return packets.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def session_stream(packets: DataFrame, idle: str = "90 seconds", watermark: str = "10 minutes") -> DataFrame:
    """Sessions, each appended once the watermark has passed its end."""
    grouped = timed(packets, watermark).groupBy(*SESSION_KEY, F.session_window("ts", idle))
    out = grouped.agg(F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.sum("size").alias("bytes_sent"), F.count("*").alias("packet_count"), F.min_by("src_ip", F.struct("ts", "id")).alias("src_ip"))
    return out.drop("session_window")


def rollup_stream(packets: DataFrame, width: str = "5 minutes", slide: str | None = None, watermark: str = "10 minutes") -> DataFrame:
    """Bytes and packets by device and application in tumbling windows, or sliding ones with ``slide``."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = timed(packets, watermark).groupBy(window.alias("w"), "src_mac", "application").agg(F.sum("size").alias("bytes"), F.count("*").alias("packets"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "src_mac", "application", "bytes", "packets")


def live_stream(packets: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """The trailing five minutes, renewed every minute."""
    return rollup_stream(packets, "5 minutes", "1 minute", watermark)


def counter_stream(packets: DataFrame) -> DataFrame:
    """Running packets and bytes by protocol; for update mode."""
    return packets.groupBy("protocol").agg(F.count("*").alias("packets"), F.sum("size").alias("bytes"))


NAMED = "id long, ts timestamp, dst_ip string, name string"
NAME_STATE = "ts timestamp, name string"


def named_stream(packets: DataFrame, bindings: DataFrame, keep_ms: int | None = 24 * 3600 * 1000) -> DataFrame:
    """Packets with the name last bound to their destination; a name is forgotten when its address is idle for ``keep_ms``, if given.

    ``bindings``: ts, ip, name. Rows of a batch are taken in order of time, a binding before a packet of the same time.
    An address's rows of one batch are sorted in one Python frame; ``named_batches`` has no such bound.
    """
    mine = packets.select("id", F.col("ts").cast("timestamp").alias("ts"), F.col("dst_ip").alias("ip"), F.lit(None).cast("string").alias("name"))
    theirs = bindings.select(F.lit(None).cast("long").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "ip", "name")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        at, name = state.get if state.exists else (None, None)
        rows = pd.concat(list(frames)).assign(turn=lambda d: d["id"].notna()).sort_values(["ts", "turn", "name"])
        bound = rows["name"].where(~rows["turn"])
        first = pd.Series([name] + [None] * (len(rows) - 1), index=rows.index, dtype=object) if at is not None and (rows["ts"].iloc[0] >= at) and pd.isna(bound.iloc[0]) else pd.Series([None] * len(rows), index=rows.index, dtype=object)
        carried = bound.astype(object).where(bound.notna(), first).ffill()
        kept = rows.assign(name=carried)
        if bound.notna().any():
            last = rows[~rows["turn"]].iloc[-1]
            if at is None or last["ts"] >= at:
                state.update((last["ts"].to_pydatetime(), last["name"]))
        if state.exists and keep_ms is not None:
            state.setTimeoutDuration(keep_ms)
        out = kept[kept["turn"]]
        yield pd.DataFrame({"id": out["id"].astype("int64"), "ts": out["ts"], "dst_ip": key[0], "name": out["name"]})

    grouped = mine.unionByName(theirs).groupBy("ip")
    timeout = GroupStateTimeout.NoTimeout if keep_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return grouped.applyInPandasWithState(step, NAMED, NAME_STATE, "append", timeout)


def each_batch(stream: DataFrame, hook: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = "3 seconds"):
    """Run a hook on every micro-batch; without a period, on all that is there and then stop."""
    writer = stream.writeStream.foreachBatch(hook).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def session_log(folder: str, k: int = 50) -> Callable[[DataFrame, int], None]:
    """A hook that writes the newest ``k`` sessions of each batch of packets; a batch that runs again replaces its own."""

    def log(batch: DataFrame, number: int) -> None:
        newest(sessionize(batch), "start_time", k, list(SESSION_KEY)).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return log


def device_upsert(folder: str) -> Callable[[DataFrame, int], None]:
    """A hook that keeps the device table: each batch writes the merged table as a new version named by the batch.

    A batch that runs again after a failure overwrites its own version and reads the same one before it.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        new = discover_devices(batch)
        old = batch.sparkSession.read.parquet(f"{folder}/version={number - 1}") if number else new.limit(0)
        merge_devices(old, new).write.mode("overwrite").parquet(f"{folder}/version={number}")

    return upsert


def named_batches(folder: str) -> Callable[[DataFrame, int], None]:
    """A hook that writes each batch's packets (``named``) with the name last bound to their destination, by an earlier batch
    or this one, and the last name of every address (``last``). Names are ``domain`` of the packets and are never forgotten.

    The join is cut into blocks of time, so a busy address is no single task. A batch that runs again replaces its own.
    """

    def name(batch: DataFrame, number: int) -> None:
        bindings = batch.where("domain is not null and dst_ip is not null").select("dst_ip", "ts", F.col("domain").alias("name"))
        if number:
            bindings = bindings.unionByName(batch.sparkSession.read.parquet(f"{folder}/last/batch={number - 1}"))
        as_of_join(batch.select("id", "ts", "dst_ip"), "dst_ip", "ts", bindings, "name").write.mode("overwrite").parquet(f"{folder}/named/batch={number}")
        last = bindings.groupBy("dst_ip").agg(F.max("ts").alias("ts"), F.max_by("name", F.struct("ts", "name")).alias("name"))
        last.write.mode("overwrite").parquet(f"{folder}/last/batch={number}")

    return name


def rollup_upkeep(folder: str, width: int = WIDTH) -> Callable[[DataFrame, int], None]:
    """A hook that adds each batch of packets to the rollup table; late packets are no special case, and a rerun changes nothing."""

    def add(batch: DataFrame, number: int) -> None:
        write_delta(batch, folder, number, width)

    return add


def snapshot_changes(folder: str, at: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A hook that appends the connections each snapshot has and the one before it, of this or the last batch, had not."""

    def compare(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.select(at, *keys).distinct()
        if number:
            last = spark.read.parquet(f"{folder}/last/batch={number - 1}").select(*batch.columns)
            both = last.unionByName(batch)
        else:
            both = batch
        fresh = new_connections(both, at, keys)
        if number:
            fresh = fresh.join(last.select(F.col(at).alias("old")).distinct(), F.col(at) == F.col("old"), "left_anti")
        fresh.write.mode("overwrite").parquet(f"{folder}/new/batch={number}")
        newest = both.join(F.broadcast(both.agg(F.max(at).alias("newest"))), F.col(at) == F.col("newest"))
        newest.drop("newest").write.mode("overwrite").parquet(f"{folder}/last/batch={number}")

    return compare
