"""Detail views of one kind of entity: users, devices, applications, groups, profiles and categories.

Each returns frames for all entities at once; a caller filters the one it shows. Facts are aggregated before they meet
a dimension.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.periods import ago, bucket, present
from packetloom.operators.analytics import (
    UNKNOWN,
    activity_timeline,
    applications,
    bytes_sum,
    device_breakdown,
    distribution,
    one_row,
    overview,
    owned,
    report_summary,
    seconds_between,
    sessions_per_user,
    traffic_summary,
    user_applications,
    user_domains,
    user_totals,
    website_summary,
    zero,
)
from packetloom.operators.filters import total_bytes
from packetloom.operators.topk import newest, top, top_per

# ---- users


def user_summary(users: DataFrame, sessions: DataFrame, visits: DataFrame, devices: DataFrame) -> DataFrame:
    """Every user's totals; a user without devices has zeros everywhere."""
    totals = user_totals(sessions, visits, devices).withColumnRenamed("user_id", "uid")
    names = [c for c in totals.columns if c != "uid"]
    return users.join(totals, users["id"] == totals["uid"], "left").select(F.col("id").alias("user_id"), *(zero(F.col(c)).cast("long").alias(c) for c in names))


def user_series(sessions: DataFrame, visits: DataFrame, devices: DataFrame, unit: str) -> DataFrame:
    """Bytes, sessions and visits of each user by time bucket."""
    mine = sessions.groupBy("src_mac", bucket(F.col("start_time"), unit).alias("bucket")).agg(bytes_sum().alias("bytes"), F.count("*").alias("sessions"), F.lit(0).cast("long").alias("visits"))
    web = visits.groupBy(F.col("device_mac").alias("src_mac"), bucket(F.col("timestamp"), unit).alias("bucket")).agg(F.lit(0).cast("long").alias("bytes"), F.lit(0).cast("long").alias("sessions"), F.count("*").alias("visits"))
    return owned(mine.unionByName(web), devices).groupBy("user_id", "bucket").agg(*(F.sum(c).alias(c) for c in ("bytes", "sessions", "visits")))


def user_categories(visits: DataFrame, devices: DataFrame, null_as: str = "Uncategorized") -> DataFrame:
    by_device = visits.groupBy("device_mac", F.coalesce("category", F.lit(null_as)).alias("category"))
    by_device = by_device.agg(F.count("*").alias("visits"), zero(F.sum("bytes_transferred")).alias("bytes"), zero(F.sum("duration")).alias("duration"))
    return owned(by_device, devices, "device_mac").groupBy("user_id", "category").agg(*(F.sum(c).alias(c) for c in ("visits", "bytes", "duration")))


def user_hours(sessions: DataFrame, devices: DataFrame, part: str = "hour") -> DataFrame:
    """Bytes of each user by hour of the day, or by weekday (Monday is 0)."""
    key = {"hour": F.hour, "weekday": F.weekday}[part]("start_time").alias(part)
    return owned(sessions.groupBy("src_mac", key).agg(bytes_sum().alias("bytes")), devices).groupBy("user_id", part).agg(F.sum("bytes").alias("bytes"))


def user_timeline(sessions: DataFrame, visits: DataFrame, devices: DataFrame, k: int = 100) -> DataFrame:
    """The newest ``k`` visits and significant sessions of each user, newest first."""
    web = owned(visits, devices, "device_mac").select("user_id", F.lit("visit").alias("kind"), F.col("timestamp").alias("time"), F.col("domain").alias("what"), F.col("bytes_transferred").alias("bytes"), F.col("id").cast("string").alias("key"))
    mine = owned(sessions.where((total_bytes() > 1024) & F.col("application").isNotNull()), devices)
    mine = mine.select("user_id", F.lit("session").alias("kind"), F.col("start_time").alias("time"), F.col("application").alias("what"), total_bytes().alias("bytes"), F.col("id").cast("string").alias("key"))
    return top_per(web.unionByName(mine), ["user_id"], "time", k, ["kind", "key"])


def user_detail(users: DataFrame, sessions: DataFrame, visits: DataFrame, devices: DataFrame, unit: str = "day") -> dict[str, DataFrame]:
    """All that a user's page shows: summary, timeline, devices, categories, applications, domains, hours, weekdays and a series."""
    return {
        "summary": user_summary(users, sessions, visits, devices),
        "timeline": user_timeline(sessions, visits, devices),
        "devices": device_breakdown(devices.where("user_id is not null"), sessions, visits),
        "categories": user_categories(visits, devices),
        "applications": user_applications(sessions, devices),
        "domains": user_domains(visits, devices),
        "hours": user_hours(sessions, devices),
        "weekdays": user_hours(sessions, devices, "weekday"),
        "series": user_series(sessions, visits, devices, unit),
    }


def user_report(users: DataFrame, user_sessions: DataFrame, sessions: DataFrame, visits: DataFrame, devices: DataFrame, days: int = 7, as_of=None, k: int = 10) -> dict[str, DataFrame]:
    """The user report of the last ``days`` days: totals, top domains and top applications of each user by number."""
    start = ago(present(sessions, "start_time", as_of), f"{int(days)} days")
    late = lambda df, ts: df.where(F.col(ts) >= start)
    mine, web = late(sessions, "start_time"), late(visits, "timestamp")
    logged = late(user_sessions, "start_time").groupBy(F.col("user_id").alias("logged_user")).agg(F.count("*").alias("user_sessions"))
    totals = user_summary(users, mine, web, devices).select("user_id", "devices", "bytes", "visits")
    totals = totals.join(logged, totals["user_id"] == logged["logged_user"], "left").select("user_id", "devices", zero(F.col("user_sessions")).alias("user_sessions"), "bytes", "visits")
    domains = user_domains(web, devices).select("user_id", "domain", "visits")
    apps = user_applications(mine.where("application is not null"), devices).select("user_id", "application", "sessions")
    return {"totals": totals, "domains": top_per(domains, ["user_id"], "visits", k, ["domain"]), "applications": top_per(apps, ["user_id"], "sessions", k, ["application"])}


def full_report(users: DataFrame, user_sessions: DataFrame, sessions: DataFrame, visits: DataFrame, devices: DataFrame, user: bool = False) -> dict[str, DataFrame]:
    """The report as sections: a user's detail with its totals, or overview, traffic, websites and top users."""
    if user:
        return user_detail(users, sessions, visits, devices) | {"totals": report_summary(sessions, visits, devices)}
    return {
        "overview": overview(sessions, visits, users, devices, user_sessions),
        "traffic": traffic_summary(sessions),
        "protocols": distribution(sessions, "protocol"),
        "websites": website_summary(visits),
        "top_users": top(sessions_per_user(users, user_sessions), "sessions", 10, ["id"]),
    }


def timeline_totals(sessions: DataFrame, visits: DataFrame) -> DataFrame:
    """One row: events of the whole timeline, visits, distinct applications and the bytes of all."""
    shown = (total_bytes() > 1024) & F.col("application").isNotNull()
    out = one_row(
        visits.agg(F.count("*").alias("websites_visited"), zero(F.sum("bytes_transferred")).alias("web_bytes")),
        sessions.agg(F.count_if(shown).alias("shown"), F.count_distinct("application").alias("applications_used"), bytes_sum().alias("session_bytes")),
    )
    return out.select((F.col("websites_visited") + F.col("shown")).alias("total_events"), "websites_visited", "applications_used", (F.col("web_bytes") + F.col("session_bytes")).alias("data_transferred"))


def whole_timeline(sessions: DataFrame, visits: DataFrame, k: int = 100) -> dict[str, DataFrame]:
    """The timeline without a limit for each source, and its totals."""
    return {"timeline": activity_timeline(sessions, visits, None, k), "totals": timeline_totals(sessions, visits)}


# ---- devices and applications


def device_tables(sessions: DataFrame, enriched: DataFrame, ports: int = 20, destinations: int = 50) -> DataFrame:
    """Each device's bytes and sessions by protocol, by port (the top 20) and by destination (the top 50, with its name).

    Returns mac, kind, value, sessions, bytes, name. One pass over the facts; the three tables come from its sums.
    """
    fine = sessions.groupBy("src_mac", "protocol", "dst_port", "dst_ip").agg(F.count("*").alias("sessions"), bytes_sum().alias("bytes"))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("value")) for k, c in (("protocol", "protocol"), ("port", "dst_port"), ("destination", "dst_ip"))))
    sums = fine.select("src_mac", "sessions", "bytes", F.explode(kinds).alias("x")).groupBy(F.col("src_mac").alias("mac"), "x.kind", "x.value").agg(F.sum("sessions").alias("sessions"), F.sum("bytes").alias("bytes"))
    most = F.when(F.col("kind") == "port", ports).when(F.col("kind") == "destination", destinations)
    kept = top_per(sums, ["mac", "kind"], "bytes", 1 << 30, ["value"]).where(most.isNull() | (F.col("place") <= most)).drop("place")
    names = enriched.select(F.col("ip_address").alias("known_ip"), F.col("hostname").alias("name"))
    return kept.join(names, (F.col("kind") == "destination") & (F.col("value") == F.col("known_ip")), "left").drop("known_ip")


def application_tables(sessions: DataFrame, visits: DataFrame, devices: DataFrame, users: DataFrame, people: int = 20, sites: int = 50) -> DataFrame:
    """Each application's top users, devices and domains by bytes: application, kind, value, uses, bytes, place.

    Sessions of unknown devices don't count; a domain belongs to the application that its visits' category names.
    """
    by_device = sessions.where("application is not null").groupBy("application", "src_mac").agg(F.count("*").alias("uses"), bytes_sum().alias("bytes"))
    names = users.select(F.col("id").alias("uid"), "username")
    owners = devices.select(F.col("mac_address").alias("src_mac"), "user_id").join(names, F.col("user_id") == F.col("uid"), "left").select("src_mac", "username")
    known = by_device.join(owners, "src_mac")
    user_rows = known.where("username is not null").groupBy("application", F.col("username").alias("value")).agg(F.sum("uses").alias("uses"), F.sum("bytes").alias("bytes"))
    device_rows = known.groupBy("application", F.col("src_mac").alias("value")).agg(F.sum("uses").alias("uses"), F.sum("bytes").alias("bytes"))
    site_rows = visits.where("category is not null").groupBy(F.col("category").alias("application"), F.col("domain").alias("value")).agg(F.count("*").alias("uses"), zero(F.sum("bytes_transferred")).alias("bytes"))
    kind = lambda df, name: df.select("application", F.lit(name).alias("kind"), "value", "uses", "bytes")
    rows = kind(user_rows, "user").unionByName(kind(device_rows, "device")).unionByName(kind(site_rows, "domain"))
    most = F.when(F.col("kind") == "domain", sites).otherwise(people)
    return top_per(rows, ["application", "kind"], "bytes", 1 << 30, ["value"]).where(F.col("place") <= most)


def application_peaks(sessions: DataFrame) -> DataFrame:
    """Each application's hour and weekday (Monday is 0) with the most bytes, the lowest one on a tie."""

    def peak(part: Column, name: str) -> DataFrame:
        sums = sessions.where("application is not null").groupBy("application", part.alias("at")).agg(bytes_sum().alias("bytes"))
        return sums.groupBy("application").agg(F.max_by("at", F.struct("bytes", -F.col("at"))).alias(name))

    return peak(F.hour("start_time"), "peak_hour").join(peak(F.weekday("start_time"), "peak_day"), "application")


def categorized_applications(sessions: DataFrame, rules: DataFrame) -> DataFrame:
    """Applications with bytes, sessions, devices and the category that ``rules`` (application, category) give them."""
    known = rules.groupBy(F.col("application").alias("ruled")).agg(F.min("category").alias("category"))
    out = applications(sessions)
    return out.join(known, out["application"] == known["ruled"], "left").withColumn("category", F.coalesce("category", F.lit("Other"))).drop("ruled")


def category_usage(profile_sessions: DataFrame, categories: DataFrame) -> DataFrame:
    """By profile and category: seconds, the device last used, when, and the newest 50 sessions in order of time.

    ``profile_sessions``: profile, device, application, start_time, end_time. ``categories``: application, category.
    """
    known = categories.groupBy("application").agg(F.min("category").alias("category"))
    rows = profile_sessions.join(known, "application", "left").withColumn("category", F.coalesce("category", F.lit("Uncategorized")))
    rows = rows.withColumn("seconds", seconds_between("start_time", "end_time"))
    totals = rows.groupBy("profile", "category").agg(F.sum("seconds").alias("seconds"), F.count("*").alias("sessions"), F.max("start_time").alias("last_accessed"), F.max_by("device", F.struct("start_time", "device", "application")).alias("device"))
    few = top_per(rows, ["profile", "category"], "start_time", 50, ["application", "device", "seconds"])
    line = F.struct("start_time", "application", "device", "seconds")
    lines = few.groupBy(F.col("profile").alias("p"), F.col("category").alias("c")).agg(F.array_sort(F.collect_list(line)).alias("timeline"))  # at most 50
    return totals.join(lines, F.col("profile").eqNullSafe(F.col("p")) & (F.col("category") == F.col("c"))).drop("p", "c")


def count_badges(sessions: DataFrame, categories: DataFrame, alerts: DataFrame, rules: DataFrame) -> DataFrame:
    """(badge, value, n): sessions of each category, unseen alerts, and rules under Unknown or Uncategorized."""
    known = categories.groupBy(F.col("application").alias("ruled")).agg(F.min("category").alias("category"))
    by_app = sessions.groupBy("application").agg(F.count("*").alias("n"))
    by_category = by_app.join(known, F.col("application") == F.col("ruled"), "left").groupBy(F.coalesce("category", F.lit("Uncategorized")).alias("value")).agg(F.sum("n").alias("n"))
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("badge"), F.lit(None).cast("string").alias("value"), "n")
    out = by_category.select(F.lit("sessions").alias("badge"), "value", "n")
    return out.unionByName(one(alerts.where("not seen"), "alerts")).unionByName(one(rules.where("category in ('Unknown', 'Uncategorized')"), "rules"))


# ---- groups and profiles


def member_lists(owners: DataFrame, members: DataFrame, owner: str = "group_id", member: str = "device_id") -> DataFrame:
    """Each group or profile with the number and the sorted ids of its members; none is an empty list.

    A list holds the members of one owner (devices of a household or team), not facts.
    """
    lists = members.groupBy(F.col(owner).alias("owner")).agg(F.array_sort(F.collect_set(member)).alias("ids"))
    out = owners.join(lists, owners["id"] == lists["owner"], "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<long>")))
    return out.select("id", "name", F.size("ids").cast("long").alias("members"), "ids")


def derived_groups(users: DataFrame, devices: DataFrame) -> DataFrame:
    """Groups that users and departments (none: General) make of their devices: id, kind, members and sorted ids."""
    own = devices.where("user_id is not null").select("user_id", F.col("id").alias("device_id"))
    rows = own.join(users.select(F.col("id").alias("uid"), F.coalesce("department", F.lit("General")).alias("department")), F.col("user_id") == F.col("uid"))
    of = lambda key, kind: rows.groupBy(F.concat(F.lit(f"{kind}-"), key).alias("id")).agg(F.array_sort(F.collect_list("device_id")).alias("ids")).select("id", F.lit(kind).alias("kind"), F.size("ids").cast("long").alias("members"), "ids")
    return of(F.col("user_id").cast("string"), "user").unionByName(of(F.lower("department"), "dept"))


def profile_devices(profiles: DataFrame, devices: DataFrame) -> DataFrame:
    """Devices of each profile (device_id, profile_id), in order of host name."""
    named = devices.select(F.col("id").alias("device_id"), "hostname", "mac_address")
    return profiles.select("profile_id", "device_id").distinct().join(named, "device_id").orderBy("profile_id", "hostname", "device_id")


def profile_analytics(profiles: DataFrame, devices: DataFrame, sessions: DataFrame, visits: DataFrame, as_of=None, k: int = 10) -> dict[str, DataFrame]:
    """Each profile's devices, those active in five minutes, bytes, top domains and recent activity.

    ``profiles``: device_id, profile_id. A profile whose devices have no traffic has zeros.
    """
    now = present(sessions, "start_time", as_of)
    own = profile_devices(profiles, devices).select("profile_id", F.col("mac_address").alias("mac"))
    mine = sessions.groupBy(F.col("src_mac").alias("mac")).agg(bytes_sum().alias("bytes"), F.max(F.coalesce("end_time", "start_time")).alias("last"))
    totals = own.join(mine, "mac", "left").groupBy("profile_id").agg(F.count("*").alias("total_devices"), F.count_if(F.col("last") >= ago(now, "5 minutes")).alias("active_devices"), zero(F.sum("bytes")).cast("long").alias("total_traffic"))
    sites = visits.groupBy(F.col("device_mac").alias("mac"), "domain").agg(F.count("*").alias("visits"), zero(F.sum("bytes_transferred")).alias("bytes"))
    sites = own.join(sites, "mac").groupBy("profile_id", "domain").agg(F.sum("visits").alias("visits"), F.sum("bytes").alias("bytes"))
    web = visits.select(F.col("device_mac").alias("mac"), F.col("timestamp").alias("time"), F.col("domain").alias("what"), F.col("id").cast("string").alias("key"))
    recent = own.join(top_per(web, ["mac"], "time", k, ["key"]).drop("place"), "mac")
    return {"totals": totals, "domains": top_per(sites, ["profile_id"], "visits", k, ["domain"]), "activity": top_per(recent, ["profile_id"], "time", k, ["mac", "key"])}


def sessions_of_group(members: DataFrame, devices: DataFrame, sessions: DataFrame, group_id) -> DataFrame:
    """Sessions of a group's devices, by semi joins from group to devices to sessions."""
    own = members.where(F.col("group_id") == group_id).select("device_id")
    macs = devices.join(own, devices["id"] == own["device_id"], "left_semi").select(F.col("mac_address").alias("own_mac"))
    return sessions.join(macs, sessions["src_mac"] == macs["own_mac"], "left_semi")


def newest_of_group(members: DataFrame, devices: DataFrame, sessions: DataFrame, group_id, span: str = "5 minutes", k: int = 100, as_of=None) -> DataFrame:
    """The newest ``k`` sessions of a group that began within the span."""
    late = sessions.where(F.col("start_time") >= ago(present(sessions, "start_time", as_of), span))
    return newest(sessions_of_group(members, devices, late, group_id), "start_time", k, ["id"])


def online_first(devices: DataFrame, sessions: DataFrame, idle: str = "90 seconds", as_of=None) -> DataFrame:
    """Devices with their latest activity, those online first, then the most recent; never active ones last."""
    now = present(sessions, "start_time", as_of)
    last = sessions.groupBy("src_mac").agg(F.max(F.coalesce("end_time", "start_time")).alias("last_active"))
    out = devices.join(last, devices["mac_address"] == last["src_mac"], "left").drop("src_mac")
    return out.withColumn("online", F.coalesce(F.col("last_active") >= ago(now, idle), F.lit(False))).orderBy(F.desc("online"), F.desc_nulls_last("last_active"), "id")


def last_device(owners: DataFrame, sessions: DataFrame) -> DataFrame:
    """The device (mac_address) of each owner (user_id) that was active last, and when."""
    last = sessions.groupBy("src_mac").agg(F.max(F.coalesce("end_time", "start_time")).alias("at"))
    rows = owners.where("user_id is not null").join(last, F.col("mac_address") == F.col("src_mac"))
    return rows.groupBy("user_id").agg(F.max_by("mac_address", F.struct("at", "mac_address")).alias("mac_address"), F.max("at").alias("last_active"))


def busy_counters(packets: DataFrame) -> DataFrame:
    """(kind, value, packets) of a capture: counts by protocol, application and domain; null ones are Unknown."""
    fine = packets.groupBy("protocol", "application", "domain").agg(F.count("*").alias("n"))
    kinds = F.array(*(F.struct(F.lit(c).alias("kind"), F.coalesce(c, F.lit(UNKNOWN)).alias("value")) for c in ("protocol", "application", "domain")))
    return fine.select("n", F.explode(kinds).alias("x")).groupBy("x.kind", "x.value").agg(F.sum("n").alias("packets"))


def snapshot_maps(packets: DataFrame, visits: DataFrame, k: int = 10) -> DataFrame:
    """One row: packets a second and maps of the top ``k`` applications, domains and categories by number."""
    second = lambda f: F.unix_seconds(f(F.col("ts")).cast("timestamp"))
    rate = packets.agg(F.round(F.count("*") / F.greatest(second(F.max) - second(F.min), F.lit(1)), 6).alias("packets_per_second"))

    def top_map(df: DataFrame, column: str, name: str) -> DataFrame:
        few = top(df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")), "n", k, [column])
        return few.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias(name))

    return one_row(rate, top_map(packets, "application", "top_applications"), top_map(visits, "domain", "top_domains"), top_map(visits, "category", "top_categories"))
