"""Aggregations and drill-downs over sessions, visits, devices and users.

Facts: sessions (id, src_mac, dst_mac, dst_ip, dst_port, protocol, application, start_time, end_time, bytes_sent,
bytes_received) and visits (id, device_mac, domain, category, timestamp, bytes_transferred, duration). Facts are always
aggregated before they meet a dimension.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.periods import PERIODS, ago, bucket, day_spine, present
from packetloom.functions.scalars import percent_change, ratio, subnet24
from packetloom.operators.filters import total_bytes

UNKNOWN = "Unknown"


def zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0))


def bytes_sum() -> Column:
    return zero(F.sum(total_bytes())).cast("long")


def seconds_between(start: str, end: str) -> Column:
    second = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    return zero(second(end) - second(start))


def one_row(*frames: DataFrame) -> DataFrame:
    """One-row frames side by side."""
    return reduce(lambda a, b: a.crossJoin(b), frames)


# ---- summaries


def overview(sessions: DataFrame, visits: DataFrame, users: DataFrame, devices: DataFrame, user_sessions: DataFrame) -> DataFrame:
    """One row: active users and devices, traffic, visits, user sessions and the share of devices with traffic."""
    out = one_row(
        users.agg(F.count_if("is_active").alias("active_users")),
        devices.agg(F.count_if("is_active").alias("active_devices")),
        sessions.agg(F.count_distinct("src_mac").alias("devices_with_traffic"), bytes_sum().alias("total_bytes"), F.count("*").alias("total_sessions")),
        visits.agg(F.count("*").alias("total_visits"), F.count_distinct("domain").alias("unique_domains"), zero(F.sum("bytes_transferred")).alias("web_bytes")),
        user_sessions.agg(F.count("*").alias("user_sessions")),
    )
    return out.withColumn("device_utilization", ratio(F.col("devices_with_traffic"), F.col("active_devices"), 100))


def period_change(sessions: DataFrame, period: str, as_of=None) -> DataFrame:
    """Bytes, sessions and devices of the period and of the one before, with changes in percent; one scan, both ends count twice."""
    now = present(sessions, "start_time", as_of)
    start = ago(now, PERIODS[period])
    before = ago(start, PERIODS[period])
    current, previous = F.col("start_time").between(start, now), F.col("start_time").between(before, start)
    spans = {"current": current, "previous": previous}
    per = [x for name, inside in spans.items() for x in (F.sum(F.when(inside, total_bytes())).alias(f"{name}_b"), F.count_if(inside).alias(f"{name}_s"))]
    by_device = sessions.where(F.col("start_time") >= before).groupBy("src_mac").agg(*per)
    total = lambda n: [zero(F.sum(f"{n}_b")).cast("long").alias(f"{n}_bytes"), zero(F.sum(f"{n}_s")).alias(f"{n}_sessions"), F.count_if((F.col(f"{n}_s") > 0) & F.col("src_mac").isNotNull()).alias(f"{n}_devices")]
    out = by_device.agg(*(x for n in spans for x in total(n)))
    return out.withColumns({f"{m}_change": percent_change(F.col(f"current_{m}"), F.col(f"previous_{m}")) for m in ("bytes", "sessions", "devices")})


def distribution(sessions: DataFrame, key: str, null_as: str | None = None) -> DataFrame:
    """Sessions and bytes by a column; null keys are dropped or named."""
    rows = sessions.where(F.col(key).isNotNull()) if null_as is None else sessions.withColumn(key, F.coalesce(key, F.lit(null_as)))
    return rows.groupBy(key).agg(F.count("*").alias("sessions"), bytes_sum().alias("bytes"))


def destinations(sessions: DataFrame, enriched: DataFrame) -> DataFrame:
    """Sessions and bytes by destination, with its host name if known."""
    names = enriched.select(F.col("ip_address").alias("dst_ip"), "hostname")
    return distribution(sessions, "dst_ip").join(names, "dst_ip", "left")


def traffic_summary(sessions: DataFrame) -> DataFrame:
    out = sessions.agg(F.count("*").alias("sessions"), bytes_sum().alias("bytes"))
    return out.withColumn("average_size", ratio(F.col("bytes"), F.col("sessions")))


def website_summary(visits: DataFrame) -> DataFrame:
    out = visits.agg(F.count("*").alias("visits"), zero(F.sum("bytes_transferred")).alias("bytes"), zero(F.sum("duration")).alias("duration"), F.count_distinct("domain").alias("unique_domains"))
    return out.withColumn("average_duration", ratio(F.col("duration"), F.col("visits")))


def domain_stats(visits: DataFrame, last_category: bool = True) -> DataFrame:
    """By domain: visits, bytes, duration, devices, and the last (or first) category seen, be it null."""
    pick = F.max_by if last_category else F.min_by
    return visits.groupBy("domain").agg(
        F.count("*").alias("visits"), zero(F.sum("bytes_transferred")).alias("bytes"), zero(F.sum("duration")).alias("duration"), F.count_distinct("device_mac").alias("devices"),
        pick("category", F.struct("timestamp", "id")).alias("category"),
    )


def category_stats(visits: DataFrame, null_as: str | None = None) -> DataFrame:
    rows = visits.where("category is not null") if null_as is None else visits.withColumn("category", F.coalesce("category", F.lit(null_as)))
    out = rows.groupBy("category").agg(F.count("*").alias("visits"), zero(F.sum("bytes_transferred")).alias("bytes"), zero(F.sum("duration")).alias("duration"))
    return out.withColumn("average_duration", ratio(F.col("duration"), F.col("visits")))


def content_stats(content: DataFrame) -> DataFrame:
    """One row: pages, mean sentiment (null is 0) and sums of images, links, forms and scripts."""
    sums = [zero(F.sum(c)).alias(c) for c in ("images_count", "links_count", "forms_count", "scripts_count")]
    return content.agg(F.count("*").alias("pages"), F.round(F.avg(F.coalesce("sentiment", F.lit(0.0))), 6).alias("average_sentiment"), *sums)


def content_languages(content: DataFrame) -> DataFrame:
    return content.groupBy(F.coalesce("language", F.lit(UNKNOWN)).alias("language")).agg(F.count("*").alias("pages"))


def talkers(sessions: DataFrame) -> DataFrame:
    """Bytes of each device: sent ones to the source, received ones to the destination."""
    sent = sessions.select(F.col("src_mac").alias("mac"), F.col("bytes_sent").alias("bytes"))
    received = sessions.select(F.col("dst_mac").alias("mac"), F.col("bytes_received").alias("bytes"))
    return sent.unionAll(received).where("mac is not null").groupBy("mac").agg(zero(F.sum("bytes")).alias("bytes"))


def four_ranges(sessions: DataFrame, as_of=None) -> DataFrame:
    """A row for each of 1h, 24h, 7d and 30d before the present that holds a session.

    All four end now, so a device or destination is in a range just if its latest session is; nothing is expanded.
    """
    now, names = present(sessions, "start_time", as_of), ("1h", "24h", "7d", "30d")
    start = {p: ago(now, PERIODS[p]) for p in names}
    rows = sessions.where(F.col("start_time") >= start["30d"])
    inside = lambda p: F.col("start_time") >= start[p]
    sums = rows.agg(*(x for p in names for x in (zero(F.sum(F.when(inside(p), total_bytes()))).cast("long").alias(f"bytes_{p}"), F.count_if(inside(p)).alias(f"sessions_{p}"))))

    def distinct(column: str, name: str) -> DataFrame:
        last = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.max("start_time").alias("start_time"))
        return last.agg(*(F.count_if(inside(p)).alias(f"{name}_{p}") for p in names))

    wide = one_row(sums, distinct("src_mac", "devices"), distinct("dst_ip", "destinations"))
    made = F.array(*(F.struct(F.lit(p).alias("range"), *(F.col(f"{c}_{p}").alias(c) for c in ("bytes", "sessions", "devices", "destinations"))) for p in names))
    return wide.select(F.explode(made).alias("x")).select("x.*").where("sessions > 0")


def historical(sessions: DataFrame, visits: DataFrame, metric: str, as_of=None) -> DataFrame:
    """One metric (traffic, visits or devices) over the named periods, as rows."""
    fact, ts, value = {
        "traffic": (sessions, "start_time", lambda inside: zero(F.sum(F.when(inside, total_bytes())))),
        "visits": (visits, "timestamp", F.count_if),
        "devices": (sessions, "start_time", lambda inside: F.count_distinct(F.when(inside, F.col("src_mac")))),
    }[metric]
    now = present(fact, ts, as_of)
    names = ("1h", "24h", "7d", "30d")
    wide = fact.agg(*(value(F.col(ts).between(ago(now, PERIODS[p]), now)).cast("long").alias(p) for p in names))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(p).alias("period"), F.col(p).alias("value")) for p in names))).alias("x")).select("x.*")


def capture_counters(packets: DataFrame) -> DataFrame:
    """One row: packets, bytes, devices and packets a second over at least one second."""
    second = lambda f: F.unix_seconds(f(F.col("ts")).cast("timestamp"))
    out = packets.agg(F.count("*").alias("packets"), zero(F.sum("size")).alias("bytes"), F.count_distinct("src_mac").alias("devices"), (second(F.max) - second(F.min)).alias("elapsed"))
    return out.select("packets", "bytes", "devices", F.round(F.col("packets") / F.greatest(F.col("elapsed"), F.lit(1)), 6).alias("packets_per_second"))


def network_stats(sessions: DataFrame, devices: DataFrame, as_of=None) -> DataFrame:
    """One snapshot row: devices, those active in the last five minutes, bytes so far and counts by protocol as a map."""
    now = present(sessions, "start_time", as_of)
    active = sessions.where(F.coalesce("end_time", "start_time") >= ago(now, "5 minutes")).agg(F.count_distinct("src_mac").alias("active_devices"))
    protocols = sessions.groupBy("protocol").count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("protocol", "count")))).alias("top_protocols"))
    return one_row(devices.agg(F.count("*").alias("total_devices")), active, sessions.agg(bytes_sum().alias("total_traffic_bytes")), protocols)


# ---- devices, users, groups, applications


def device_breakdown(devices: DataFrame, sessions: DataFrame, visits: DataFrame) -> DataFrame:
    """Every device with its bytes, sessions, visits and last activity (null if none); zeros without traffic."""
    mine = sessions.groupBy(F.col("src_mac").alias("m1")).agg(bytes_sum().alias("bytes"), F.count("*").alias("sessions"), F.max("start_time").alias("last_session"))
    web = visits.groupBy(F.col("device_mac").alias("m2")).agg(F.count("*").alias("visits"), F.max("timestamp").alias("last_visit"))
    out = devices.join(mine, F.col("mac_address") == F.col("m1"), "left").join(web, F.col("mac_address") == F.col("m2"), "left")
    return out.select("id", "mac_address", "hostname", "user_id", *(zero(F.col(c)).cast("long").alias(c) for c in ("bytes", "sessions", "visits")), F.greatest("last_session", "last_visit").alias("last_active"))


def owned(sessions: DataFrame, devices: DataFrame, mac: str = "src_mac") -> DataFrame:
    """Facts of assigned devices, with their user."""
    own = devices.where("user_id is not null").select(F.col("mac_address").alias("own_mac"), "user_id")
    facts = sessions.drop("user_id")
    return facts.join(own, facts[mac] == own["own_mac"]).drop("own_mac")


def user_totals(sessions: DataFrame, visits: DataFrame, devices: DataFrame) -> DataFrame:
    """For every user with devices: devices, active ones, bytes, sessions, visits and time in seconds."""
    per = device_breakdown(devices.where("user_id is not null"), sessions, visits)
    time = owned(sessions, devices).groupBy("user_id").agg(F.sum(seconds_between("start_time", "end_time")).alias("seconds"))
    out = per.groupBy("user_id").agg(F.count("*").alias("devices"), F.count_if(F.col("bytes") > 0).alias("active_devices"), *(F.sum(c).alias(c) for c in ("bytes", "sessions", "visits")))
    return out.join(time, "user_id", "left").na.fill(0, ["seconds"])


def user_applications(sessions: DataFrame, devices: DataFrame) -> DataFrame:
    rows = owned(sessions, devices).withColumn("application", F.coalesce("application", F.lit(UNKNOWN)))
    return rows.groupBy("user_id", "application").agg(bytes_sum().alias("bytes"), F.count("*").alias("sessions"), F.sum(seconds_between("start_time", "end_time")).alias("seconds"))


def user_domains(visits: DataFrame, devices: DataFrame) -> DataFrame:
    return owned(visits, devices, "device_mac").groupBy("user_id", "domain").agg(F.count("*").alias("visits"), zero(F.sum("bytes_transferred")).alias("bytes"))


def usage_rollup(sessions: DataFrame, devices: DataFrame) -> DataFrame:
    """Bytes and sessions by (user, device, application) with all subtotals."""
    rows = owned(sessions, devices).withColumn("application", F.coalesce("application", F.lit(UNKNOWN)))
    return rows.rollup("user_id", "src_mac", "application").agg(bytes_sum().alias("bytes"), F.count("*").alias("sessions"), F.grouping_id().alias("level"))


def device_totals(sessions: DataFrame, visits: DataFrame) -> DataFrame:
    """For every source: bytes sent and received, sessions, destinations, visits and domains."""
    mine = sessions.groupBy(F.col("src_mac").alias("mac")).agg(zero(F.sum("bytes_sent")).alias("bytes_sent"), zero(F.sum("bytes_received")).alias("bytes_received"), F.count("*").alias("sessions"), F.count_distinct("dst_ip").alias("destinations"))
    web = visits.groupBy(F.col("device_mac").alias("mac")).agg(F.count("*").alias("visits"), F.count_distinct("domain").alias("domains"))
    return mine.join(web, "mac", "left").na.fill(0)


def group_devices(members: DataFrame, devices: DataFrame, sessions: DataFrame, visits: DataFrame) -> DataFrame:
    """Each group's devices with bytes, sessions, visits and their share of the group's bytes in percent."""
    per = device_breakdown(devices, sessions, visits).withColumnRenamed("id", "device_id")
    out = members.select("group_id", "device_id").distinct().join(per, "device_id")
    return out.withColumn("share", ratio(F.col("bytes"), F.sum("bytes").over(Window.partitionBy("group_id")), 100))


def group_totals(members: DataFrame, devices: DataFrame, sessions: DataFrame, visits: DataFrame) -> DataFrame:
    out = group_devices(members, devices, sessions, visits).groupBy("group_id").agg(F.count("*").alias("devices"), F.count_distinct("user_id").alias("users"), *(F.sum(c).alias(c) for c in ("bytes", "sessions", "visits")))
    return out.withColumns({"bytes_per_device": ratio(F.col("bytes"), F.col("devices")), "sessions_per_device": ratio(F.col("sessions"), F.col("devices"))})


def group_applications(members: DataFrame, devices: DataFrame, sessions: DataFrame) -> DataFrame:
    """Each application's bytes and distinct devices within each group."""
    by_device = sessions.groupBy("src_mac", F.coalesce("application", F.lit(UNKNOWN)).alias("application")).agg(bytes_sum().alias("bytes"))
    own = members.select("group_id", "device_id").distinct().join(devices.select(F.col("id").alias("device_id"), F.col("mac_address").alias("src_mac")), "device_id")
    return own.join(by_device, "src_mac").groupBy("group_id", "application").agg(F.count_distinct("src_mac").alias("devices"), F.sum("bytes").alias("bytes"))


def applications(sessions: DataFrame) -> DataFrame:
    """Known applications with bytes, sessions, mean size and distinct devices."""
    out = sessions.where("application is not null").groupBy("application").agg(bytes_sum().alias("bytes"), F.count("*").alias("sessions"), F.count_distinct("src_mac").alias("devices"))
    return out.withColumn("average_size", ratio(F.col("bytes"), F.col("sessions")))


def application_users(sessions: DataFrame, devices: DataFrame, users: DataFrame) -> DataFrame:
    """Each application's bytes and sessions by owner; devices without one are Unassigned."""
    by_device = sessions.where("application is not null").groupBy("application", "src_mac").agg(bytes_sum().alias("bytes"), F.count("*").alias("sessions"))
    owners = devices.join(users.select(F.col("id").alias("uid"), "username"), F.col("user_id") == F.col("uid"), "left").select(F.col("mac_address").alias("src_mac"), "username")
    out = by_device.join(owners, "src_mac", "left").withColumn("owner", F.coalesce("username", F.lit("Unassigned")))
    return out.groupBy("application", "owner").agg(F.sum("bytes").alias("bytes"), F.sum("sessions").alias("sessions"), F.count_distinct("src_mac").alias("devices"))


def comparison(sessions: DataFrame, entity: str, entities: list) -> DataFrame:
    """Bytes by application and entity, a column each, 0 where missing."""
    rows = sessions.where(F.col(entity).isin(entities)).withColumn("application", F.coalesce("application", F.lit(UNKNOWN)))
    return rows.groupBy("application").pivot(entity, entities).agg(bytes_sum()).na.fill(0)


def group_suggestions(devices: DataFrame) -> DataFrame:
    """Active devices that share a type, a vendor or an IPv4 /24: kind, value and count, where more than one does."""
    live = devices.where("is_active")
    kinds = F.array(
        F.struct(F.lit("type").alias("kind"), F.coalesce("device_type", F.lit("unknown")).alias("value")),
        F.struct(F.lit("vendor").alias("kind"), F.when(F.lower("vendor") != "unknown", F.col("vendor")).alias("value")),
        F.struct(F.lit("subnet").alias("kind"), F.when(F.col("ip_address").rlike(r"^\d+\.\d+\.\d+\.\d+$"), subnet24(F.col("ip_address"))).alias("value")),
    )
    found = live.select(F.explode(kinds).alias("x")).select("x.*").where("value is not null")
    return found.groupBy("kind", "value").agg(F.count("*").alias("devices")).where("devices > 1")


def membership_counts(groups: DataFrame, members: DataFrame) -> DataFrame:
    """Active groups by name with their number of devices."""
    sizes = members.groupBy(F.col("group_id").alias("gid")).agg(F.count_distinct("device_id").alias("devices"))
    return groups.where("is_active").join(sizes, F.col("id") == F.col("gid"), "left").select("id", "name", zero(F.col("devices")).alias("devices"))


def department_groups(users: DataFrame, devices: DataFrame) -> DataFrame:
    """Groups derived from users' departments: users and devices of each; no department is General."""
    rows = users.withColumn("department", F.coalesce("department", F.lit("General")))
    mine = devices.groupBy(F.col("user_id").alias("uid")).agg(F.count("*").alias("n"))
    return rows.join(mine, F.col("id") == F.col("uid"), "left").groupBy("department").agg(F.count("*").alias("users"), zero(F.sum("n")).alias("devices"))


def assignment_summary(users: DataFrame, devices: DataFrame, user_sessions: DataFrame) -> DataFrame:
    out = one_row(users.agg(F.count("*").alias("users")), devices.agg(F.count("*").alias("devices"), F.count("user_id").alias("assigned")), user_sessions.agg(F.count("*").alias("sessions")))
    return out.withColumn("unassigned", F.col("devices") - F.col("assigned")).withColumn("assignment_rate", ratio(F.col("assigned"), F.col("devices"), 100))


def sessions_per_user(users: DataFrame, user_sessions: DataFrame) -> DataFrame:
    counted = user_sessions.groupBy(F.col("user_id").alias("uid")).agg(F.count("*").alias("sessions"), zero(F.sum("total_bytes")).alias("bytes"))
    return users.join(counted, F.col("id") == F.col("uid")).select("id", "username", "sessions", "bytes")


def dashboard(devices: DataFrame, sessions: DataFrame, profiles: DataFrame, as_of=None) -> DataFrame:
    """One row: devices, active profiles, open sessions and bytes of the last hour."""
    now = present(sessions, "start_time", as_of)
    last = F.col("start_time") >= ago(now, "1 hour")
    return one_row(devices.agg(F.count("*").alias("devices")), profiles.agg(F.count_if("is_active").alias("active_profiles")), sessions.agg(F.count_if(F.col("end_time").isNull()).alias("open_sessions"), zero(F.sum(F.when(last, total_bytes()))).alias("bytes_last_hour")))


def report_summary(sessions: DataFrame, visits: DataFrame, devices: DataFrame) -> DataFrame:
    """For every user: devices, visits, sessions and the bytes of both."""
    mine = owned(sessions, devices).groupBy("user_id").agg(F.count("*").alias("sessions"), bytes_sum().alias("b1"))
    web = owned(visits, devices, "device_mac").groupBy("user_id").agg(F.count("*").alias("visits"), zero(F.sum("bytes_transferred")).alias("b2"))
    own = devices.where("user_id is not null").groupBy("user_id").agg(F.count("*").alias("devices"))
    out = own.join(mine, "user_id", "left").join(web, "user_id", "left").na.fill(0)
    return out.select("user_id", "devices", "sessions", "visits", (F.col("b1") + F.col("b2")).cast("long").alias("bytes"))


def time_online(merged: DataFrame) -> DataFrame:
    """Seconds online by profile from merged intervals (profile, application, duration)."""
    return merged.groupBy("profile").agg(F.sum("duration").alias("seconds"))


# ---- series and timelines


def series(sessions: DataFrame, visits: DataFrame, unit: str) -> DataFrame:
    """Bytes, sessions and visits by time bucket, whichever of the facts has rows there."""
    mine = sessions.groupBy(bucket(F.col("start_time"), unit).alias("bucket")).agg(bytes_sum().alias("bytes"), F.count("*").alias("sessions"), F.lit(0).cast("long").alias("visits"))
    web = visits.groupBy(bucket(F.col("timestamp"), unit).alias("bucket")).agg(F.lit(0).cast("long").alias("bytes"), F.lit(0).cast("long").alias("sessions"), F.count("*").alias("visits"))
    return mine.unionByName(web).groupBy("bucket").agg(*(F.sum(c).alias(c) for c in ("bytes", "sessions", "visits")))


def daily_trend(sessions: DataFrame, days: int, as_of=None) -> DataFrame:
    spine = day_spine(sessions, "start_time", days, as_of)
    daily = sessions.groupBy(F.to_date("start_time").alias("day")).agg(bytes_sum().alias("bytes"), F.count("*").alias("sessions"), F.count_distinct("src_mac").alias("devices"))
    return spine.join(daily, "day", "left").na.fill(0)


def application_timeline(sessions: DataFrame, k: int = 50) -> DataFrame:
    """Each application's newest ``k`` sessions in order of time: start, bytes and seconds."""
    order = Window.partitionBy("application").orderBy(F.desc("start_time"), F.desc("id"))
    few = sessions.where("application is not null").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return few.select("application", "place", "start_time", total_bytes().alias("bytes"), seconds_between("start_time", "end_time").alias("seconds"))


def activity_timeline(sessions: DataFrame, visits: DataFrame, per_source: int | None = 50, k: int = 100) -> DataFrame:
    """The newest visits and significant sessions together, newest first."""
    web = visits.select(F.lit("visit").alias("kind"), F.col("timestamp").alias("time"), F.col("domain").alias("what"), F.col("bytes_transferred").alias("bytes"), F.col("id").cast("string").alias("key"))
    mine = sessions.where((total_bytes() > 1024) & F.col("application").isNotNull())
    mine = mine.select(F.lit("session").alias("kind"), F.col("start_time").alias("time"), F.col("application").alias("what"), total_bytes().alias("bytes"), F.col("id").cast("string").alias("key"))
    newest = lambda df, n: df.orderBy(F.desc("time"), "kind", "key").limit(n)
    if per_source is not None:
        web, mine = newest(web, per_source), newest(mine, per_source)
    return newest(web.unionByName(mine), k)
