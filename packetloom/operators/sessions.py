"""Packets to sessions, visits, devices and user sessions; interval unions and latest-row picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.scalars import application_category, device_type_of_address, visit_url
from packetloom.operators.blocks import BLOCK_SECONDS, KEY, block_of, keyed, running

SESSION_KEY = ("src_mac", "dst_ip", "dst_port", "protocol")
WEB_PORTS = (80, 443, 8080, 8443)


def first_of(column: str, ts: str = "ts", id_: str = "id") -> Column:
    """The first value that is neither null nor empty, by time and id."""
    value = F.nullif(F.col(column), F.lit("")) if column != "src_port" else F.col(column)
    return F.min_by(value, F.when(value.isNotNull(), F.struct(ts, id_)))


def sessionize(packets: DataFrame, idle: str = "90 seconds") -> DataFrame:
    """Sessions of the key (src_mac, dst_ip, dst_port, protocol): a packet joins while the gap is at most ``idle``.

    Packets of a key within one slot of ``idle`` are always of one session, so slots are summed first, before the
    shuffle; session windows then merge slots, and a busy key is as many rows as it has slots. The first packet gives
    the source address; the first known domain and application name the session; bytes received stay 0.
    """
    has = set(packets.columns)
    micros = lambda at: F.unix_micros(at.cast("timestamp"))
    width = F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"INTERVAL {idle}"))
    extra = {c: F.when(F.nullif(F.col(c), F.lit("")).isNotNull(), F.struct("ts", "id", c)) for c in ("application", "domain") if c in has}
    firsts = {c: F.struct("ts", "id", c) for c in ("src_ip", "src_port", "dst_mac") if c in has} | extra
    slots = packets.where("ts is not null").groupBy(*SESSION_KEY, F.floor(micros(F.col("ts")) / width).alias("slot")).agg(
        F.min("ts").alias("low"), F.max("ts").alias("high"), F.sum("size").alias("bytes"), F.count("*").alias("packets"), *(F.min(v).alias(f"first_{c}") for c, v in firsts.items())
    )
    slots = slots.withColumn("at", F.col("low").cast("timestamp"))
    seconds = (micros(F.col("high")) - micros(F.col("low")) + width) / F.lit(1_000_000)
    gap = F.make_interval(secs=seconds.cast("decimal(18, 6)"))
    grouped = slots.groupBy(*SESSION_KEY, F.session_window("at", gap)).agg(
        F.min("low").alias("start_time"), F.max("high").alias("end_time"), F.sum("bytes").alias("bytes_sent"), F.lit(0).cast("long").alias("bytes_received"), F.sum("packets").alias("packet_count"),
        *(F.min(f"first_{c}")[c].alias(c) for c in firsts),
    )
    out = grouped.drop("session_window")
    if "application" in has:
        out = out.withColumn("application_category", application_category(F.col("application")))
    return out.withColumn("is_encrypted", (F.col("protocol") == "HTTPS") | (F.col("dst_port") == 443))


def sessionize_by_gaps(packets: DataFrame, idle_seconds: int = 90) -> DataFrame:
    """The same sessions by gaps and islands: each packet with its session's number within the key."""
    order = Window.partitionBy(*SESSION_KEY).orderBy("ts", "id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(order)
    fresh = F.when(gap <= idle_seconds * 1_000_000, 0).otherwise(1)
    return packets.withColumn("fresh", fresh).withColumn("session", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("fresh")


def flows_by_tuple(packets: DataFrame) -> DataFrame:
    """Flows of the 5-tuple without an idle time; the end of a one-packet flow is null; incomplete packets are dropped.

    Packets with a ``confidence`` of their application give the flow that of the application it takes.
    """
    whole = packets.where("src_ip is not null and dst_ip is not null and protocol is not null")
    return whole.groupBy("src_ip", "dst_ip", "src_port", "dst_port", "protocol").agg(
        F.min("ts").alias("start_time"), F.when(F.count("*") > 1, F.max("ts")).alias("end_time"), F.sum("size").alias("bytes"), F.count("*").alias("packet_count"),
        F.bool_or(F.col("dst_port") == 443).alias("is_encrypted"), first_of("application").alias("application"),
        *([F.min_by("confidence", F.when(F.nullif("application", F.lit("")).isNotNull(), F.struct("ts", "id"))).alias("confidence")] if "confidence" in packets.columns else []),
    )


def website_visits(packets: DataFrame) -> DataFrame:
    """One visit for each packet with a domain to a web port."""
    web = packets.where(F.col("domain").isNotNull() & F.col("protocol").isin("HTTP", "HTTPS", "TCP") & F.col("dst_port").isin(*WEB_PORTS))
    return web.select(
        F.col("id").alias("packet_id"), F.col("src_mac").alias("device_mac"), "domain", visit_url(F.col("domain"), F.col("dst_port")).alias("url"), F.col("ts").alias("timestamp"),
        F.col("size").alias("bytes_transferred"), F.col("application").alias("category"), application_category(F.col("application")).alias("subcategory"),
    )


def discover_devices(packets: DataFrame) -> DataFrame:
    """A row for each source: first and last time seen, latest address, guessed name and type."""
    found = packets.groupBy(F.col("src_mac").alias("mac_address")).agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max_by("src_ip", F.struct("ts", "id")).alias("ip_address"))
    return found.withColumn("hostname", F.concat(F.lit("Device-"), F.col("ip_address"))).withColumn("device_type", device_type_of_address(F.col("ip_address"))).withColumn("is_active", F.lit(True))


def merge_devices(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old devices with the new sightings: earliest first, latest last, newest address; other old values stay."""
    a, b = old.alias("a"), new.alias("b")
    pick = lambda c: F.coalesce(f"a.{c}", f"b.{c}").alias(c)
    newer = F.coalesce(F.col("b.last_seen") >= F.col("a.last_seen"), F.col("a.mac_address").isNull())
    return a.join(b, F.col("a.mac_address") == F.col("b.mac_address"), "full").select(
        pick("mac_address"), F.least("a.first_seen", "b.first_seen").alias("first_seen"), F.greatest("a.last_seen", "b.last_seen").alias("last_seen"),
        F.when(newer, F.col("b.ip_address")).otherwise(F.col("a.ip_address")).alias("ip_address"), pick("hostname"), pick("device_type"), pick("is_active"),
    )


def user_sessions(packets: DataFrame) -> DataFrame:
    """For each (user, device): bytes, packets with a domain and distinct applications in order of first use."""
    firsts = packets.where("application is not null").groupBy("user_id", "src_mac", "application").agg(F.min(F.struct("ts", "id")).alias("first"))
    used = firsts.groupBy("user_id", "src_mac").agg(F.array_sort(F.collect_list(F.struct("first", "application"))).alias("used"))
    used = used.select(F.col("user_id").alias("u"), F.col("src_mac").alias("m"), F.transform("used", lambda x: x["application"]).alias("applications_used"))
    totals = packets.groupBy("user_id", "src_mac").agg(F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.sum("size").alias("total_bytes"), F.count("domain").alias("websites_visited"))
    same = totals["user_id"].eqNullSafe(used["u"]) & (totals["src_mac"] == used["m"])
    return totals.join(used, same, "left").drop("u", "m").withColumn("applications_used", F.coalesce("applications_used", F.array().cast("array<string>")))


def interval_union(sessions: DataFrame, keys: list[str], start: str = "start_time", end: str = "end_time", gap: str = "5 minutes", block_seconds: int = BLOCK_SECONDS, sums: Sequence[str] = ()) -> DataFrame:
    """Intervals of a key merged while they stand at most ``gap`` apart; duration in seconds, counted once where they overlap.

    A key's history is cut into blocks of time, so a busy key is no single task. Rows without a start come first.
    The columns ``sums`` are summed.
    """
    closed = keyed(sessions, keys).select(KEY, start, F.coalesce(end, start).alias(end), *sums).withColumn("time_block", block_of(start, block_seconds))
    reached = running(closed, keys, "time_block", [start, end], end, "max", through=False)
    fresh = F.when(F.col(start) <= F.col("running") + F.expr(f"INTERVAL {gap}"), 0).otherwise(1)
    marked = running(reached.withColumn("fresh", fresh).drop("running"), keys, "time_block", [start, end, F.desc("fresh")], "fresh", "sum")
    merged = marked.groupBy(KEY, "running").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("sessions"), *(F.sum(c).alias(c) for c in sums))
    seconds = F.unix_seconds(F.col(end).cast("timestamp")) - F.unix_seconds(F.col(start).cast("timestamp"))
    return merged.select(f"{KEY}.*", start, end, "sessions", *sums).withColumn("duration", seconds)


def latest(df: DataFrame, keys: list[str], ts: str, tie: str = "id") -> DataFrame:
    """The newest whole row of each key, by one aggregation."""
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(ts, tie)).alias("row"))
    return best.select("row.*")
