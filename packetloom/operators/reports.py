"""Reports as named sections, trends over days, and packets named by what earlier packets told."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.functions.periods import ago, present, since
from packetloom.functions.scalars import without_final_dot
from packetloom.operators import analytics
from packetloom.operators.analytics import bytes_sum, owned, zero
from packetloom.operators.blocks import running_sums
from packetloom.operators.filters import matching, of_device, of_users
from packetloom.operators.joins import as_of_join
from packetloom.operators.topk import newest, top

# ---- reports


def chosen(fact: DataFrame, mac: str, devices: DataFrame, user_id=None, device_id=None) -> DataFrame:
    """The rows of a user's devices and of a device, each if given. A user without devices has no rows."""
    fact = of_users(fact, mac, devices, None if user_id is None else [user_id])
    return fact if device_id is None else of_device(fact, mac, devices, device_id)


def website_report(visits: DataFrame, devices: DataFrame, period: str = "24h", as_of=None, user_id=None, device_id=None, category=None, k: int = 20) -> dict[str, DataFrame]:
    """Summary, the ``k`` domains of most visits with their first category, categories (null: Uncategorized) and hours of a
    period's visits, perhaps of one user, device or category. Hours without visits have no row."""
    rows = matching(chosen(since(visits, "timestamp", period, as_of), "device_mac", devices, user_id, device_id), category=category)
    measures = [F.count("*").alias("visits"), zero(F.sum("bytes_transferred")).alias("bytes")]
    summary = rows.agg(*measures, zero(F.sum("duration")).alias("duration"))
    return {
        "summary": summary.withColumn("average_duration", F.when(F.col("visits") > 0, F.col("duration") / F.col("visits")).otherwise(0.0)),
        "domains": top(analytics.domain_stats(rows, last_category=False), "visits", k, ["domain"]),
        "categories": analytics.category_stats(rows, "Uncategorized"),
        "hours": rows.groupBy(F.hour("timestamp").alias("hour")).agg(*measures),
    }


def traffic_report(sessions: DataFrame, devices: DataFrame, period: str = "24h", as_of=None, user_id=None, device_id=None, k: int = 10) -> dict[str, DataFrame]:
    """Summary, protocols, applications (null: Unknown) and the ``k`` destinations of most bytes of a period's sessions."""
    rows = chosen(since(sessions, "start_time", period, as_of), "src_mac", devices, user_id, device_id)
    measures = [F.count("*").alias("sessions"), bytes_sum().alias("bytes")]
    return {
        "summary": rows.agg(*measures),
        "protocols": rows.groupBy("protocol").agg(*measures),
        "applications": rows.groupBy(F.coalesce("application", F.lit(analytics.UNKNOWN)).alias("application")).agg(*measures),
        "destinations": top(rows.groupBy("dst_ip").agg(*measures), "bytes", k, ["dst_ip"]),
    }


def monitoring(sessions: DataFrame, visits: DataFrame, devices: DataFrame, as_of=None, span: str = "5 minutes", k: int = 50) -> dict[str, DataFrame]:
    """The newest ``k`` sessions and visits of the last ``span``, and the devices seen in it, by either fact."""
    start = ago(present(sessions, "start_time", as_of), span)
    recent, web = sessions.where(F.col("start_time") >= start), visits.where(F.col("timestamp") >= start)
    seen = recent.select(F.col("src_mac").alias("seen_mac")).unionByName(web.select(F.col("device_mac").alias("seen_mac"))).distinct()
    return {
        "devices": devices.join(seen, F.col("mac_address") == F.col("seen_mac"), "left_semi"),
        "sessions": newest(recent, "start_time", k, ["id"]),
        "visits": newest(web, "timestamp", k, ["id"]),
    }


def devices_in_period(devices: DataFrame, sessions: DataFrame, visits: DataFrame, period: str = "24h", as_of=None, user_id=None, device_type=None, is_active=None) -> DataFrame:
    """The devices that fit the given values, with bytes, sessions and visits of the period; zeros where there are none."""
    own = matching(devices, user_id=user_id, device_type=device_type, is_active=is_active)
    return analytics.device_breakdown(own, since(sessions, "start_time", period, as_of), since(visits, "timestamp", period, as_of)).drop("last_active")


# ---- trends


def stats_rows(packets: DataFrame, every: int = 3600) -> DataFrame:
    """What the counters stood at after each ``every`` seconds with a packet: total bytes, packets and devices so far.

    Packets are first summed by time, and devices by the time they are first seen; only these sums are carried on.
    """
    bucket = lambda c: F.window(c, f"{every} seconds")
    timed = packets.where("ts is not null")
    sums = timed.groupBy(bucket("ts").alias("w")).agg(zero(F.sum("size")).alias("bytes"), F.count("*").alias("packets"))
    first = timed.where("src_mac is not null").groupBy("src_mac").agg(F.min("ts").alias("ts"))
    seen = first.groupBy(bucket("ts").alias("w")).agg(F.count("*").alias("devices"))
    none = F.lit(0).cast("long")
    rows = sums.select(F.col("w.end").alias("timestamp"), "bytes", "packets", none.alias("devices")).unionByName(seen.select(F.col("w.end").alias("timestamp"), none.alias("bytes"), none.alias("packets"), "devices"))
    rows = rows.groupBy("timestamp").agg(*(F.sum(c).alias(c) for c in ("bytes", "packets", "devices")))
    return running_sums(rows, "timestamp", ("bytes", "packets", "devices"), every * 1000).drop("bytes", "packets", "devices")


def system_trend(stats: DataFrame, days: int = 30, as_of=None) -> DataFrame:
    """Each of the last ``days`` days: the sum of the cumulative byte counter's readings, as the reference adds it, what the
    counter grew by within the day (``grown``), and the most devices; zeros on days without a reading."""
    last = F.to_date(present(stats, "timestamp", as_of))
    spine = stats.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))
    daily = stats.groupBy(F.to_date("timestamp").alias("day")).agg(F.sum("total_bytes").alias("bytes"), (F.max("total_bytes") - F.min("total_bytes")).alias("grown"), F.max("total_devices").alias("devices"))
    return spine.join(daily, "day", "left").na.fill(0)


def user_trend(sessions: DataFrame, devices: DataFrame, days: int = 30, as_of=None) -> DataFrame:
    """For every user with devices and each of the last ``days`` days: bytes and devices in use, zeros kept."""
    last = F.to_date(present(sessions, "start_time", as_of))
    users = devices.where("user_id is not null").select("user_id").distinct()
    spine = users.select("user_id", F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))
    rows = owned(sessions.where(F.to_date("start_time").between(F.date_sub(last, days - 1), last)), devices)
    daily = rows.groupBy("user_id", F.to_date("start_time").alias("day")).agg(bytes_sum().alias("bytes"), F.count_distinct("src_mac").alias("devices"))
    return spine.join(daily, ["user_id", "day"], "left").na.fill(0)


# ---- names of packets


def packet_bindings(packets: DataFrame, bind_queries: bool = True) -> DataFrame:
    """(ts, dst_ip, domain): the name that each address last got at a time, from queries, answers and HTTP hosts.

    ``packets``: id, ts, dst_ip, dns_query, http_host, dns_answers (array of name and ip). A query's name goes to the
    address asked, that is the resolver, unless ``bind_queries`` is false. Within a packet an answer outdoes the query
    and the host both; answers of addresses without three dots don't count.
    """
    row = lambda ip, name, turn: F.struct(ip.alias("dst_ip"), name.alias("domain"), F.lit(turn).alias("turn"))
    query = without_final_dot(F.col("dns_query"))
    told = F.transform(F.coalesce("dns_answers", F.array().cast(packets.schema["dns_answers"].dataType)), lambda x: row(x["ip"], without_final_dot(x["name"]), 1))
    own = [row(F.col("dst_ip"), F.col("http_host"), 2), *([row(F.col("dst_ip"), query, 0)] if bind_queries else [])]
    rows = packets.select("id", "ts", F.inline(F.concat(told, F.array(*own)))).where("domain <> '' and dst_ip is not null")
    rows = rows.where((F.col("turn") != 1) | F.col("dst_ip").rlike(r"^[^.]*(\.[^.]*){3}$"))
    return rows.groupBy("ts", "dst_ip").agg(F.max_by("domain", F.struct("id", "turn", "domain")).alias("domain"))


def named_packets(packets: DataFrame, bind_queries: bool = True) -> DataFrame:
    """Adds ``domain``: the packet's HTTP host, else its query's name, else what its destination was last bound to by then."""
    bound = packet_bindings(packets, bind_queries).withColumnRenamed("domain", "bound")
    known = as_of_join(packets.select("id", "ts", "dst_ip"), "dst_ip", "ts", bound, "bound").select(F.col("id").alias("known_id"), "bound")
    own = F.coalesce(F.nullif("http_host", F.lit("")), F.nullif(without_final_dot(F.col("dns_query")), F.lit("")))
    return packets.join(known, F.col("id") == F.col("known_id"), "left").withColumn("domain", F.coalesce(own, "bound")).drop("known_id", "bound")
