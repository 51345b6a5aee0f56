"""Queries of reports, trends and named packets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.operators import reports
from packetloom.plans.views import Views, registry

query, QUERIES, ORACLE = registry()

BYTES = "cast(coalesce(sum(coalesce(bytes_sent, 0) + coalesce(bytes_received, 0)), 0) as bigint)"
WEB = "count(*) as visits, cast(coalesce(sum(bytes_transferred), 0) as bigint) as bytes, cast(coalesce(sum(duration), 0) as bigint) as duration"


def stacked(sections: dict[str, DataFrame], names: dict[str, str | None], *columns: str) -> DataFrame:
    """The sections under each other: section, name (the given column of each, as text) and the columns, null where missing."""
    rows = [df.select(F.lit(s).alias("section"), (F.col(names[s]).cast("string") if names[s] else F.lit(None).cast("string")).alias("name"), *(F.col(c) if c in df.columns else F.lit(None).alias(c) for c in columns)) for s, df in sections.items()]
    return reduce(lambda a, b: a.unionByName(b), rows)


@query(f"""
with r as (select * from visits where timestamp >= (select max(timestamp) from visits) - interval '7' day and device_mac in (select mac_address from devices where user_id = 18) and category = 'News')
select 'summary' as section, null as name, {WEB}, null as category from r
union all select 'domains', * from (select domain, {WEB}, min_by(category, struct_pack(t := timestamp, i := id)) as category from r group by domain order by visits desc, domain limit 20)
union all select 'categories', coalesce(category, 'Uncategorized') as c, {WEB}, c from r group by c
union all select 'hours', cast(hour(timestamp) as varchar) as h, count(*), cast(sum(bytes_transferred) as bigint), null, null from r group by h""")
def website_report(v: Views):
    """A user's visits of one category in a week: summary, domains, categories and hours."""
    found = reports.website_report(v("visits"), v("devices"), "7d", user_id=18, category="News")
    return stacked(found, {"summary": None, "domains": "domain", "categories": "category", "hours": "hour"}, "visits", "bytes", "duration", "category")


@query(f"""
with r as (select * from flows where start_time >= (select max(start_time) from flows) - interval '365' day and src_mac = 'dev-4')
select 'summary' as section, null as name, count(*) as sessions, {BYTES} as bytes from r
union all select 'protocols', protocol, count(*), {BYTES} from r group by protocol
union all select 'applications', coalesce(application, 'Unknown') as a, count(*), {BYTES} from r group by a
union all select 'destinations', * from (select dst_ip, count(*), {BYTES} as b from r group by dst_ip order by b desc, dst_ip limit 10)""")
def traffic_report(v: Views):
    """A device's year: summary, protocols, applications and destinations."""
    found = reports.traffic_report(v("flows"), v("devices"), "1y", device_id=4)
    return stacked(found, {"summary": None, "protocols": "protocol", "applications": "application", "destinations": "dst_ip"}, "sessions", "bytes")


@query(f"""
with s as (select id, src_mac, start_time + interval '8122' day as start_time from flows), u as (select max(start_time) - interval '20' day as start from s),
recent as (select * from s, u where start_time >= u.start), web as (select * from visits, u where timestamp >= u.start)
select 'devices' as section, cast(id as varchar) as name, null as time from devices where mac_address in (select src_mac from recent union all select device_mac from web)
union all select 'sessions', * from (select cast(id as varchar), start_time from recent order by start_time desc, id desc limit 50)
union all select 'visits', * from (select cast(id as varchar), timestamp from web order by timestamp desc, id desc limit 50)""")
def monitoring_live(v: Views):
    """The monitoring view; sessions are moved so that both facts have rows in its span."""
    moved = v("flows").withColumn("start_time", F.col("start_time") + F.expr("interval 8122 days"))
    found = reports.monitoring(moved, v("visits"), v("devices"), span="20 days")
    found = {k: df.withColumn("time", F.col({"sessions": "start_time", "visits": "timestamp"}[k]) if k != "devices" else F.lit(None).cast("timestamp_ntz")) for k, df in found.items()}
    return stacked(found, dict.fromkeys(found, "id"), "time")


@query(f"""
with s as (select src_mac, {BYTES} as bytes, count(*) as sessions from flows where start_time >= (select max(start_time) from flows) - interval '90' day group by src_mac),
w as (select device_mac, count(*) as visits from visits where timestamp >= (select max(timestamp) from visits) - interval '90' day group by device_mac)
select id, mac_address, hostname, user_id, coalesce(bytes, 0) as bytes, coalesce(sessions, 0) as sessions, coalesce(visits, 0) as visits from devices left join s on src_mac = mac_address left join w on device_mac = mac_address where device_type = 'laptop' and is_active""")
def devices_in_period(v: Views):
    return reports.devices_in_period(v("devices"), v("flows"), v("visits"), "90d", device_type="laptop", is_active=True)


STATS = """b as (select time_bucket(interval '1' hour, ts) + interval '1' hour as timestamp, cast(coalesce(sum(size), 0) as bigint) as bytes, count(*) as packets from packets where ts is not null group by 1),
d as (select time_bucket(interval '1' hour, m) + interval '1' hour as timestamp, count(*) as devices from (select min(ts) as m from packets where src_mac is not null group by src_mac) group by 1),
stats as (select b.timestamp, cast(sum(bytes) over w as bigint) as total_bytes, cast(sum(packets) over w as bigint) as total_packets, cast(sum(coalesce(devices, 0)) over w as bigint) as total_devices from b left join d on d.timestamp = b.timestamp window w as (order by b.timestamp))"""


@query(f"with {STATS} select * from stats")
def stats_rows(v: Views):
    """ST7 in batch: hourly readings of the cumulative counters."""
    return reports.stats_rows(v("packets"))


@query(f"""
with {STATS}, days as (select cast(unnest(generate_series(date_trunc('day', m) - interval '44' day, date_trunc('day', m), interval '1' day)) as date) as day from (select max(timestamp) as m from stats))
select day, cast(coalesce(sum(total_bytes), 0) as bigint) as bytes, coalesce(max(total_bytes) - min(total_bytes), 0) as grown, coalesce(max(total_devices), 0) as devices from days left join stats on cast(timestamp as date) = day group by day""")
def system_trend(v: Views):
    """JN18 over counter readings: their sum, their growth and the most devices."""
    return reports.system_trend(reports.stats_rows(v("packets")), 45)


@query(f"""
with m as (select max(start_time) as t from flows), days as (select distinct user_id, cast(unnest(generate_series(date_trunc('day', t) - interval '29' day, date_trunc('day', t), interval '1' day)) as date) as day from devices, m where user_id is not null),
f as (select user_id, cast(start_time as date) as day, {BYTES} as bytes, count(distinct src_mac) as devices from flows join devices on mac_address = src_mac where user_id is not null group by all)
select d.user_id, d.day, coalesce(bytes, 0) as bytes, coalesce(f.devices, 0) as devices from days d left join f on f.user_id = d.user_id and f.day = d.day""")
def user_trend(v: Views):
    """JN18 for every user at once."""
    return reports.user_trend(v("flows"), v("devices"), 30)


DECODED = """dec as (select id, ts, dst_ip, case when application = 'DNS' then concat('q', id % 7, '.example.org.') end as dns_query, case when dst_port = 80 and id % 3 = 0 then domain end as http_host,
  case when application = 'DNS' and id % 2 = 0 then concat('203.0.113.', id * 3 % 7) when id % 10 = 0 then 'fe80::1' end as answer_ip, concat('a', id % 5, '.example.net.') as answer_name from packets),
bound as (select ts, ip, max_by(name, struct_pack(i := id, t := turn, n := name)) as name from (
  select id, ts, dst_ip as ip, rtrim(dns_query, '.') as name, 0 as turn from dec where dns_query is not null union all select id, ts, answer_ip, rtrim(answer_name, '.'), 1 from dec where answer_ip like '%.%.%.%'
  union all select id, ts, dst_ip, http_host, 2 from dec where http_host <> '') where {which} group by ts, ip)"""


def decoded(v: Views) -> DataFrame:
    dns = F.col("application") == "DNS"
    answer = F.when(dns & (F.col("id") % 2 == 0), F.concat(F.lit("203.0.113."), (F.col("id") * 3 % 7).cast("string"))).when(F.col("id") % 10 == 0, "fe80::1")
    return v("packets").select(
        "id", "ts", "dst_ip", F.when(dns, F.concat(F.lit("q"), (F.col("id") % 7).cast("string"), F.lit(".example.org."))).alias("dns_query"), F.when((F.col("dst_port") == 80) & (F.col("id") % 3 == 0), F.col("domain")).alias("http_host"),
        F.when(answer.isNotNull(), F.array(F.struct(F.concat(F.lit("a"), (F.col("id") % 5).cast("string"), F.lit(".example.net.")).alias("name"), answer.alias("ip")))).alias("dns_answers"),
    )


NAMED = "select d.id, coalesce(http_host, rtrim(dns_query, '.'), b.name) as domain from dec d asof left join bound b on d.dst_ip = b.ip and d.ts >= b.ts"


@query(f"with {DECODED.replace('{which}', 'true')} {NAMED}")
def named_packets(v: Views):
    """PL9 and JN9 together: queries, answers and hosts name the packets that follow."""
    return reports.named_packets(decoded(v)).select("id", "domain")


@query(f"with {DECODED.replace('{which}', 'turn > 0')} {NAMED}")
def named_packets_without_queries(v: Views):
    """The same without binding the resolver's address to the name asked for."""
    return reports.named_packets(decoded(v), bind_queries=False).select("id", "domain")
