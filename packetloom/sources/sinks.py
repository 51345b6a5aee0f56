"""Exports, appends and retention."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions.periods import since
from packetloom.operators.filters import total_bytes
from packetloom.operators.pipeline import retained
from packetloom.operators.sessions import merge_devices

TRAFFIC_FIELDS = ("timestamp", "src_ip", "dst_ip", "protocol", "bytes", "application")
#: What an export of devices or users holds; columns that a table lacks are left out.
ENTITY_FIELDS = {
    "devices": ("id", "mac_address", "ip_address", "hostname", "vendor", "device_type", "first_seen", "last_seen", "is_active"),
    "users": ("id", "username", "email", "full_name", "role", "department", "is_active"),
}


def export_rows(sessions: DataFrame, period: str = "24h", as_of=None) -> DataFrame:
    rows = since(sessions, "start_time", period, as_of)
    return rows.select(F.col("start_time").alias("timestamp"), "src_ip", "dst_ip", "protocol", total_bytes().alias("bytes"), "application")


def entity_rows(table: DataFrame, kind: str) -> DataFrame:
    """The devices or users of an export."""
    return table.select(*(c for c in ENTITY_FIELDS[kind] if c in table.columns))


def export(df: DataFrame, path: str, kind: str = "csv") -> None:
    """One export in JSON lines, or in CSV with a header; an empty one has no content."""
    if kind == "json":
        df.write.mode("overwrite").json(path)
    else:
        df.write.mode("overwrite").csv(path, header=True)


def export_report(sections: dict[str, DataFrame], path: str) -> None:
    """Each section of a report under its own folder."""
    for name, df in sections.items():
        export(df, f"{path}/{name}", "json")


def append_fact(df: DataFrame, path: str, ts: str, batch: int | None = None) -> None:
    """Append to a fact partitioned by date, so that periods read only their own days.

    A streaming hook gives its batch number: the batch has its own folder, which a batch that runs again replaces.
    """
    dated = df.withColumn("date", F.to_date(ts)).write.partitionBy("date")
    if batch is None:
        dated.mode("append").parquet(path)
    else:
        dated.mode("overwrite").parquet(f"{path}/batch={batch}")


def rebuild_devices(old: DataFrame, new: DataFrame, path: str) -> None:
    """Write the merged device table beside the old one; the caller switches to it."""
    merge_devices(old, new).write.mode("errorifexists").parquet(path)


def drop_expired(spark: SparkSession, path: str, days: int = 90, as_of: date | None = None) -> list[str]:
    """Remove the date folders of a fact or a rollup table that are older than ``days`` before ``as_of`` (today); no kept row is rewritten."""
    until = ((as_of or date.today()) - timedelta(days=days)).isoformat()
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for pattern in ("date=*", "batch=*/date=*", "base/version=*/date=*", "delta/batch=*/date=*"):
        for found in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, pattern)) or []:
            if found.getPath().getName().removeprefix("date=") < until:
                files.delete(found.getPath(), True)
                gone.append(found.getPath().toString())
    return gone


def expire(fact: DataFrame, ts: str, path: str, days: int = 90, as_of=None) -> None:
    append_fact(retained(fact, ts, days, as_of), path, ts)
