"""Queries over sessions and packets: sources, filters, sessions, distributions, top lists, series and timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.functions import periods
from packetloom.operators import analytics, filters, sessions, topk
from packetloom.plans.views import Views, registry, rounded

query, QUERIES, ORACLE = registry()

TOTAL = "(coalesce(bytes_sent, 0) + coalesce(bytes_received, 0))"
BYTES = f"cast(coalesce(sum{TOTAL}, 0) as bigint)"
AS_OF = "(select max(start_time) from flows)"
SESSIONS = """
gaps as (select *, case when ts - lag(ts) over (partition by src_mac, dst_ip, dst_port, protocol order by ts, id) <= interval '6' hour then 0 else 1 end as fresh from packets),
numbered as (select *, sum(fresh) over (partition by src_mac, dst_ip, dst_port, protocol order by ts, id rows unbounded preceding) as session from gaps),
sessions as (select src_mac, dst_ip, dst_port, protocol, min(ts) as start_time, max(ts) as end_time, cast(sum(size) as bigint) as bytes_sent, count(*) as packet_count,
  min_by(src_ip, id) as src_ip, min(application) as application, bool_or(dst_port = 443) as is_encrypted from numbered group by src_mac, dst_ip, dst_port, protocol, session)
"""
IDLE = "6 hours"


def plain_sessions(v: Views):
    return sessions.sessionize(v("packets"), IDLE)


@query(f"with {SESSIONS} select application, cast(sum(bytes_sent) as bigint) as bytes, count(*) as sessions from sessions group by application order by bytes desc, application limit 10")
def top_applications(v: Views):
    """PL1 -> AG5 -> TK2, the flagship."""
    return topk.top_groups(plain_sessions(v), "application", 10, "bytes", bytes=F.sum("bytes_sent"), sessions=F.count("*"))


@query(f"with {SESSIONS} select src_mac, dst_ip, dst_port, protocol, start_time, end_time, bytes_sent, packet_count, application, is_encrypted from sessions")
def packet_sessions(v: Views):
    return plain_sessions(v).select("src_mac", "dst_ip", "dst_port", "protocol", "start_time", "end_time", "bytes_sent", "packet_count", "application", "is_encrypted")


@query(f"with {SESSIONS} select src_mac, cast(count(distinct session) as bigint) as keys_sessions, count(*) as packets from numbered group by src_mac")
def sessions_by_gaps(v: Views):
    marked = sessions.sessionize_by_gaps(v("packets"), 6 * 3600)
    return marked.groupBy("src_mac").agg(F.count_distinct("session").alias("keys_sessions"), F.count("*").alias("packets"))


@query("""
select src_ip, dst_ip, src_port, dst_port, protocol, min(ts) as start_time, case when count(*) > 1 then max(ts) end as end_time, cast(sum(size) as bigint) as bytes, count(*) as packet_count,
  bool_or(dst_port = 443) as is_encrypted, min_by(application, id) as application from packets group by src_ip, dst_ip, src_port, dst_port, protocol""")
def flows_by_tuple(v: Views):
    return sessions.flows_by_tuple(v("packets"))


@query("""
select id as packet_id, src_mac as device_mac, domain, concat(case when dst_port = 443 then 'https://' else 'http://' end, domain) as url, ts as timestamp, size as bytes_transferred,
  app as category, case app when 'Netflix' then 'Entertainment' when 'GitHub' then 'Development' else 'Other' end as subcategory
from (select *, case id % 4 when 0 then 'Netflix' when 1 then 'GitHub' when 2 then application end as app from packets) where domain is not null and protocol in ('HTTP', 'HTTPS', 'TCP') and dst_port in (80, 443, 8080, 8443)""")
def website_visits(v: Views):
    turn = F.col("id") % 4
    app = F.when(turn == 0, "Netflix").when(turn == 1, "GitHub").when(turn == 2, F.col("application"))
    return sessions.website_visits(v("packets").withColumn("application", app))


@query("""
select src_mac as mac_address, min(ts) as first_seen, max(ts) as last_seen, max_by(src_ip, ts) as ip_address, concat('Device-', max_by(src_ip, ts)) as hostname,
  case when max_by(src_ip, ts) like '%.1' then 'router' else 'computer' end as device_type, true as is_active from packets group by src_mac""")
def device_discovery(v: Views):
    return sessions.discover_devices(v("packets"))


@query("""
with firsts as (select user_id, src_mac, application, min(struct_pack(ts := ts, id := id)) as first from packets group by all),
used as (select user_id, src_mac, array_to_string(list(application order by first), ',') as applications_used from firsts group by all)
select p.user_id, p.src_mac, min(ts) as start_time, max(ts) as end_time, cast(sum(size) as bigint) as total_bytes, count(domain) as websites_visited, any_value(applications_used) as applications_used
from packets p join used u on u.user_id = p.user_id and u.src_mac = p.src_mac group by p.user_id, p.src_mac""")
def user_session_totals(v: Views):
    return sessions.user_sessions(v("packets")).withColumn("applications_used", F.array_join("applications_used", ","))


@query("""
with closed as (select src_mac, application, start_time, coalesce(end_time, start_time) as end_time from flows where application is not null),
reach as (select *, max(end_time) over (partition by src_mac, application order by start_time, end_time rows between unbounded preceding and 1 preceding) as reach from closed),
marked as (select *, sum(case when start_time <= reach + interval '5' minute then 0 else 1 end) over (partition by src_mac, application order by start_time, end_time rows unbounded preceding) as island from reach)
select src_mac, application, min(start_time) as start_time, max(end_time) as end_time, count(*) as sessions, cast(epoch(max(end_time) - min(start_time)) as bigint) as duration from marked group by src_mac, application, island""")
def merged_intervals(v: Views):
    return sessions.interval_union(v("flows").where("application is not null"), ["src_mac", "application"])


@query("select src_mac, max_by(id, struct_pack(t := start_time, i := id)) as id, max(start_time) as start_time from flows group by src_mac")
def latest_session_per_device(v: Views):
    return sessions.latest(v("flows").select("id", "src_mac", "start_time"), ["src_mac"], "start_time").select("src_mac", "id", "start_time")


# ---- filters and derived columns


@query(f"select id, start_time from flows where start_time between {AS_OF} - interval '30' day and {AS_OF}")
def period_window(v: Views):
    return periods.in_period(v("flows"), "start_time", "30d").select("id", "start_time")


@query("select id, start_time from flows where start_time >= timestamp '1998-06-01 00:00:00'")
def period_from_date(v: Views):
    return periods.since(v("flows"), "start_time", "1998-06-01T00:00:00Z").select("id", "start_time")


@query(f"select id, start_time from flows where start_time >= {AS_OF} - interval '24' hour")
def trailing_day(v: Views):
    return periods.trailing_hours(v("flows"), "start_time", 24).select("id", "start_time")


@query("select f.id, src_mac from flows f where src_mac in (select mac_address from devices where user_id in (1, 2, 3))")
def sessions_of_users(v: Views):
    return filters.of_users(v("flows"), "src_mac", v("devices"), [1, 2, 3]).select("id", "src_mac")


@query("select f.id, src_mac from flows f where src_mac in (select mac_address from devices where id = 5)")
def sessions_of_device(v: Views):
    return filters.of_device(v("flows"), "src_mac", v("devices"), 5).select("id", "src_mac")


@query("select id, src_mac, dst_mac from flows where src_mac = 'dev-3' or dst_mac = 'dev-3'")
def sessions_of_endpoint(v: Views):
    return filters.either_endpoint(v("flows"), "dev-3").select("id", "src_mac", "dst_mac")


@query(f"select id, application from flows where {TOTAL} > 5000000 and application is not null")
def significant_sessions(v: Views):
    return filters.significant(v("flows"), 5_000_000).select("id", "application")


@query("select id, username, email from users where contains(lower(username), 'tion_1') or contains(lower(email), 'tion_1')")
def user_search(v: Views):
    return filters.search(v("users"), "TION_1", ["username", "email"]).select("id", "username", "email")


@query("select id, device_type, is_active from devices where device_type = 'laptop' and is_active")
def device_filter(v: Views):
    return filters.matching(v("devices"), device_type="laptop", is_active=True, user_id=None).select("id", "device_type", "is_active")


@query("select id, start_time, end_time from flows where start_time >= timestamp '1998-08-01 00:00:00' or end_time >= timestamp '1998-08-01 00:00:00'")
def touched_sessions(v: Views):
    return filters.touched_since(v("flows"), "1998-08-01 00:00:00").select("id", "start_time", "end_time")


@query("select id from flows where end_time is null")
def open_sessions(v: Views):
    return filters.open_sessions(v("flows")).select("id")


@query(f"select id, application, protocol from flows where start_time >= {AS_OF} - interval '24' hour and application in ('Brand#11', 'Brand#12', 'Brand#23') and protocol in ('A', 'N')")
def live_filter(v: Views):
    return filters.live_filter(v("flows"), "24h", application=["Brand#11", "Brand#12", "Brand#23"], protocol=["A", "N"], src_mac=[]).select("id", "application", "protocol")


@query(f"""
select id, {TOTAL} as total_bytes, coalesce(end_time, start_time) as last_seen, cast(floor(epoch(coalesce(end_time, start_time) - start_time) / 60) as bigint) as duration_minutes,
  coalesce(end_time, start_time) >= {AS_OF} - interval '90' second as is_active, dst_port = 443 as is_encrypted from flows""")
def session_columns(v: Views):
    return filters.session_columns(v("flows")).select("id", "total_bytes", "last_seen", "duration_minutes", "is_active", "is_encrypted")


@query(f"""
select id, coalesce(end_time, start_time) >= {AS_OF} - interval '200' day as is_active, coalesce(end_time, start_time) as last_seen from flows order by is_active desc, last_seen desc, id limit 60""")
def live_order(v: Views):
    """TK14: the first rows of the live order."""
    return topk.live_order(filters.session_columns(v("flows"), idle="200 days")).select("id", "is_active", "last_seen").limit(60)


# ---- aggregates


@query("select protocol, count(*) as sessions, " + BYTES + " as bytes from flows group by protocol")
def protocol_distribution(v: Views):
    return analytics.distribution(v("flows"), "protocol")


@query("select coalesce(application, 'Unknown') as application, count(*) as sessions, " + BYTES + " as bytes from flows group by 1")
def application_distribution(v: Views):
    return analytics.distribution(v("flows"), "application", "Unknown")


@query("select f.dst_ip, sessions, bytes, hostname from (select dst_ip, count(*) as sessions, " + BYTES + " as bytes from flows group by dst_ip) f left join enriched on ip_address = dst_ip")
def destination_distribution(v: Views):
    return analytics.destinations(v("flows"), v("enriched"))


@query("select dst_port, count(*) as sessions, " + BYTES + " as bytes from flows group by dst_port order by bytes desc, dst_port limit 20")
def top_ports(v: Views):
    return topk.top(analytics.distribution(v("flows"), "dst_port"), "bytes", 20, ["dst_port"])


@query("select dst_ip, count(*) as sessions, " + BYTES + " as bytes from flows group by dst_ip order by bytes desc, dst_ip limit 50")
def top_destinations(v: Views):
    return topk.top(analytics.distribution(v("flows"), "dst_ip"), "bytes", 50, ["dst_ip"])


@query("select protocol, count(*) as sessions from flows group by protocol order by sessions desc, protocol limit 10")
def top_protocols(v: Views):
    return topk.top_groups(v("flows"), "protocol", 10, "sessions", sessions=F.count("*"))


@query(f"select count(*) as sessions, {BYTES} as bytes, {rounded(f'sum{TOTAL} / cast(count(*) as double)')} as average_size from flows")
def traffic_summary(v: Views):
    return analytics.traffic_summary(v("flows"))


@query("""
select mac, cast(sum(bytes) as bigint) as bytes from (select src_mac as mac, bytes_sent as bytes from flows union all select dst_mac, bytes_received from flows) group by mac order by bytes desc, mac limit 10""")
def top_talkers(v: Views):
    return topk.top(analytics.talkers(v("flows")), "bytes", 10, ["mac"])


@query(f"""
with r(range, start) as (select '1h', {AS_OF} - interval '1' hour union all select '24h', {AS_OF} - interval '24' hour union all select '7d', {AS_OF} - interval '7' day union all select '30d', {AS_OF} - interval '30' day)
select range, {BYTES} as bytes, count(*) as sessions, count(distinct src_mac) as devices, count(distinct dst_ip) as destinations from flows join r on start_time >= start group by range""")
def four_range_summary(v: Views):
    return analytics.four_ranges(v("flows"))


def _change(measure: str) -> str:
    return f"case when previous_{measure} > 0 then {rounded(f'(current_{measure} - previous_{measure}) / cast(previous_{measure} as double) * 100')} else 0.0 end as {measure}_change"


@query(f"""
with marked as (select *, start_time between {AS_OF} - interval '365' day and {AS_OF} as now, start_time between {AS_OF} - interval '730' day and {AS_OF} - interval '365' day as past from flows),
summed as (select cast(coalesce(sum({TOTAL}) filter (now), 0) as bigint) as current_bytes, count(*) filter (now) as current_sessions, count(distinct src_mac) filter (now) as current_devices,
  cast(coalesce(sum({TOTAL}) filter (past), 0) as bigint) as previous_bytes, count(*) filter (past) as previous_sessions, count(distinct src_mac) filter (past) as previous_devices from marked)
select *, {_change('bytes')}, {_change('sessions')}, {_change('devices')} from summed""")
def period_change(v: Views):
    return analytics.period_change(v("flows"), "1y")


@query(f"""
with p(period, start) as (select '1h', {AS_OF} - interval '1' hour union all select '24h', {AS_OF} - interval '24' hour union all select '7d', {AS_OF} - interval '7' day union all select '30d', {AS_OF} - interval '30' day)
select period, {BYTES} as value from p left join flows on start_time between start and {AS_OF} group by period""")
def historical_traffic(v: Views):
    return analytics.historical(v("flows"), v("visits"), "traffic")


@query(f"""
with p(period, start) as (select '1h', {AS_OF} - interval '1' hour union all select '24h', {AS_OF} - interval '24' hour union all select '7d', {AS_OF} - interval '7' day union all select '30d', {AS_OF} - interval '30' day)
select period, count(distinct src_mac) as value from p left join flows on start_time between start and {AS_OF} group by period""")
def historical_devices(v: Views):
    return analytics.historical(v("flows"), v("visits"), "devices")


@query("""
with n as (select max(timestamp) as now from visits), p(period, start) as (select '1h', now - interval '1' hour from n union all select '24h', now - interval '24' hour from n union all select '7d', now - interval '7' day from n union all select '30d', now - interval '30' day from n)
select period, count(id) as value from p left join visits on timestamp >= start group by period""")
def historical_visits(v: Views):
    return analytics.historical(v("flows"), v("visits"), "visits")


@query("select count(*) as packets, cast(sum(size) as bigint) as bytes, count(distinct src_mac) as devices, round(count(*) / cast(greatest(epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts))), 1) as double), 6) as packets_per_second from packets")
def capture_counters(v: Views):
    return analytics.capture_counters(v("packets"))


@query(f"""
with protocols as (select string_agg(concat(protocol, '=', n), ',' order by protocol) as top_protocols from (select protocol, cast(count(*) as varchar) as n from flows group by protocol))
select (select count(*) from devices) as total_devices, (select count(distinct src_mac) from flows where coalesce(end_time, start_time) >= {AS_OF} - interval '5' minute) as active_devices,
  (select {BYTES} from flows) as total_traffic_bytes, top_protocols from protocols""")
def network_stats(v: Views):
    stats = analytics.network_stats(v("flows"), v("devices"))
    text = F.array_join(F.transform(F.map_entries("top_protocols"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return stats.withColumn("top_protocols", text)


@query(f"""
select (select count(*) from devices) as devices, (select count(*) from device_groups where is_active) as active_profiles, count(*) filter (end_time is null) as open_sessions, cast(coalesce(sum({TOTAL}) filter (start_time >= {AS_OF} - interval '1' hour), 0) as bigint) as bytes_last_hour from flows""")
def dashboard(v: Views):
    return analytics.dashboard(v("devices"), v("flows"), v("device_groups"))


# ---- time


def _series(unit: str, pattern: str) -> str:
    return f"""
with merged as (select strftime(start_time, '{pattern}') as bucket, {TOTAL} as bytes, 1 as sessions, 0 as visits from flows union all select strftime(timestamp, '{pattern}'), 0, 0, 1 from visits)
select bucket, cast(sum(bytes) as bigint) as bytes, cast(sum(sessions) as bigint) as sessions, cast(sum(visits) as bigint) as visits from merged group by bucket"""


@query(_series("hour", "%Y-%m-%d %H:00"))
def series_by_hour(v: Views):
    return analytics.series(v("flows"), v("visits"), "hour")


@query(_series("day", "%Y-%m-%d"))
def series_by_day(v: Views):
    return analytics.series(v("flows"), v("visits"), "day")


@query(_series("week", "%Y-W%U"))
def series_by_week(v: Views):
    return analytics.series(v("flows"), v("visits"), "week")


@query(_series("month", "%Y-%m"))
def series_by_month(v: Views):
    return analytics.series(v("flows"), v("visits"), "month")


@query("""
select cast(h as int) as hour, cast(coalesce(sum(size), 0) as bigint) as bytes, count(id) as packets from range(24) as s(h) left join packets on hour(ts) = h group by h""")
def hour_profile(v: Views):
    return periods.hour_profile(v("packets"), "ts", bytes=F.sum("size"), packets=F.count("*"))


@query("""
select cast(d as int) as weekday, cast(coalesce(sum(size), 0) as bigint) as bytes, count(id) as packets from range(7) as s(d) left join packets on isodow(ts) - 1 = d group by d""")
def weekday_profile(v: Views):
    return periods.weekday_profile(v("packets"), "ts", bytes=F.sum("size"), packets=F.count("*"))


@query("select strftime(ts, '%Y-%m-%d %H:00') as bucket, cast(sum(size) as bigint) as bytes from packets group by 1")
def bandwidth_trend(v: Views):
    return periods.bandwidth_trend(v("packets"), "ts", F.col("size"), "24h")


@query("""
with h as (select cast(hour(ts) as int) as hour, cast(sum(size) as bigint) as bytes from packets group by 1 order by bytes desc, hour limit 1)
select hour, bytes, printf('%02d:00 - %02d:00', hour, (hour + 1) % 24) as label from h""")
def peak_hour(v: Views):
    return periods.peak_hour(v("packets"), "ts", F.col("size"))


@query(f"""
with days as (select cast(unnest(generate_series(date_trunc('day', {AS_OF}) - interval '59' day, date_trunc('day', {AS_OF}), interval '1' day)) as date) as day)
select day, {BYTES} as bytes, count(id) as sessions, count(distinct src_mac) as devices from days left join flows on cast(start_time as date) = day group by day""")
def daily_trend(v: Views):
    return analytics.daily_trend(v("flows"), 60)


@query(f"""
select application, cast(place as int) as place, start_time, bytes, seconds from (select application, row_number() over (partition by application order by start_time desc, id desc) as place, start_time, {TOTAL} as bytes,
  cast(coalesce(epoch(end_time - start_time), 0) as bigint) as seconds from flows where application is not null) where place <= 20""")
def application_timeline(v: Views):
    return analytics.application_timeline(v("flows"), 20)


@query(f"""
with web as (select 'visit' as kind, timestamp as time, domain as what, bytes_transferred as bytes, cast(id as varchar) as key from visits order by time desc, key limit 50),
mine as (select 'session' as kind, start_time as time, application as what, {TOTAL} as bytes, cast(id as varchar) as key from flows where {TOTAL} > 1024 and application is not null order by time desc, key limit 50)
select * from (select * from web union all select * from mine) order by time desc, kind, key limit 100""")
def activity_timeline(v: Views):
    return analytics.activity_timeline(v("flows"), v("visits"))


@query(f"select id, start_time, {TOTAL} as bytes from flows order by start_time desc, id desc limit 200")
def newest_sessions(v: Views):
    return topk.newest(v("flows").select("id", "start_time", filters.total_bytes().alias("bytes")), "start_time", 200, ["id"])
