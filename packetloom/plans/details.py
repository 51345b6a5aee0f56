"""Queries over the detail views: users, devices, applications, groups, profiles and categories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.operators import details, pipeline, topk
from packetloom.functions import periods
from packetloom.plans.entities import PER_DEVICE, SECONDS, VISIT_BYTES
from packetloom.plans.streams import shared
from packetloom.plans.views import Views, registry, rounded
from packetloom.sources import sinks

query, QUERIES, ORACLE = registry()

TOTAL = "(coalesce(bytes_sent, 0) + coalesce(bytes_received, 0))"
BYTES = f"cast(coalesce(sum{TOTAL}, 0) as bigint)"
AS_OF = "(select max(start_time) from flows)"
ONE_PROFILE = "select device_id, max_by(profile_id, struct_pack(a := added_at, p := profile_id)) as profile_id from members group by device_id"
OWN_BYTES = f"select d.user_id, src_mac, start_time, end_time, application, id, {TOTAL} as bytes from flows f join devices d on d.mac_address = f.src_mac where d.user_id is not null"
OWN_BYTES = OWN_BYTES.replace(" id, ", " f.id, ")
OWN_VISITS = "select d.user_id, v.id, v.domain, v.category, v.timestamp, v.bytes_transferred, v.duration from visits v join devices d on d.mac_address = v.device_mac where d.user_id is not null"


def sections(frames: dict[str, DataFrame], *columns: str) -> DataFrame:
    """Rows of each section, by the given columns."""
    counted = [df.groupBy(*columns).agg(F.count("*").alias("n")).select(F.lit(name).alias("section"), *columns, "n") for name, df in frames.items()]
    return reduce(DataFrame.unionByName, counted)


# ---- users


@query(f"""
with {PER_DEVICE}, t as (select d.user_id, {SECONDS} as seconds from flows join devices d on mac_address = src_mac where d.user_id is not null group by d.user_id),
u as (select user_id, count(*) as devices, count(*) filter (bytes > 0) as active_devices, cast(sum(bytes) as bigint) as bytes, cast(sum(sessions) as bigint) as sessions, cast(sum(visits) as bigint) as visits from per_device where user_id is not null group by user_id)
select users.id as user_id, coalesce(devices, 0) as devices, coalesce(active_devices, 0) as active_devices, coalesce(bytes, 0) as bytes, coalesce(sessions, 0) as sessions, coalesce(visits, 0) as visits, coalesce(seconds, 0) as seconds
from users left join u on u.user_id = users.id left join t on t.user_id = users.id""")
def user_summary(v: Views):
    return details.user_summary(v("users"), v("flows"), v("visits"), v("devices"))


@query(f"""
with x as (select user_id, strftime(start_time, '%Y-%m') as bucket, bytes, 1 as s, 0 as w from ({OWN_BYTES}) union all select user_id, strftime(timestamp, '%Y-%m'), 0, 0, 1 from ({OWN_VISITS}))
select user_id, bucket, cast(sum(bytes) as bigint) as bytes, cast(sum(s) as bigint) as sessions, cast(sum(w) as bigint) as visits from x group by all""")
def user_series(v: Views):
    return details.user_series(v("flows"), v("visits"), v("devices"), "month")


@query(f"select user_id, coalesce(category, 'Uncategorized') as category, count(*) as visits, {VISIT_BYTES} as bytes, cast(sum(duration) as bigint) as duration from ({OWN_VISITS}) group by 1, 2")
def user_categories(v: Views):
    return details.user_categories(v("visits"), v("devices"))


@query(f"select user_id, cast(isodow(start_time) - 1 as int) as weekday, cast(sum(bytes) as bigint) as bytes from ({OWN_BYTES}) group by 1, 2")
def user_weekdays(v: Views):
    return details.user_hours(v("flows"), v("devices"), "weekday")


USER_EVENTS = f"""
events_of as (select user_id, 'visit' as kind, timestamp as time, domain as what, bytes_transferred as bytes, cast(id as varchar) as key from ({OWN_VISITS})
  union all select user_id, 'session', start_time, application, bytes, cast(id as varchar) from ({OWN_BYTES}) where bytes > 1024 and application is not null)
"""


@query(f"with {USER_EVENTS} select * from (select *, cast(row_number() over (partition by user_id order by time desc, kind, key) as int) as place from events_of) where place <= 40")
def user_timeline(v: Views):
    return details.user_timeline(v("flows"), v("visits"), v("devices"), 40)


@query(f"""
with {USER_EVENTS}, own as (select * from devices where user_id is not null), b as ({OWN_BYTES}), w as ({OWN_VISITS})
select 'summary' as section, id as user_id, 1 as n from users union all select 'timeline', user_id, least(count(*), 100) from events_of group by user_id union all select 'devices', user_id, count(*) from own group by user_id
union all select 'categories', user_id, count(distinct coalesce(category, '?')) from w group by user_id union all select 'applications', user_id, count(distinct coalesce(application, '?')) from b group by user_id
union all select 'domains', user_id, count(distinct domain) from w group by user_id union all select 'hours', user_id, count(distinct hour(start_time)) from b group by user_id union all select 'weekdays', user_id, count(distinct isodow(start_time)) from b group by user_id
union all select 'series', user_id, count(distinct day) from (select user_id, cast(start_time as date) as day from b union all select user_id, cast(timestamp as date) from w) group by user_id""")
def user_detail(v: Views):
    """PL13: how many rows each section of each user's page has."""
    return sections(details.user_detail(v("users"), v("flows"), v("visits"), v("devices")), "user_id")


REPORT = f"late as (select * from ({OWN_BYTES}) where start_time >= {AS_OF} - interval '400' day), web as (select * from ({OWN_VISITS}) where timestamp >= {AS_OF} - interval '400' day)"


def report(v: Views):
    return details.user_report(v("users"), v("user_sessions"), v("flows"), v("visits"), v("devices"), 400)


@query(f"""
with {REPORT}, s as (select user_id, count(*) as n from user_sessions where start_time >= {AS_OF} - interval '400' day group by user_id)
select u.id as user_id, (select count(*) from devices d where d.user_id = u.id) as devices, coalesce(s.n, 0) as user_sessions, cast(coalesce((select sum(bytes) from late where late.user_id = u.id), 0) as bigint) as bytes,
  (select count(*) from web where web.user_id = u.id) as visits from users u left join s on s.user_id = u.id""")
def user_report_totals(v: Views):
    return report(v)["totals"]


@query(f"with {REPORT} select * from (select *, cast(row_number() over (partition by user_id order by visits desc, domain) as int) as place from (select user_id, domain, count(*) as visits from web group by 1, 2)) where place <= 10")
def user_report_domains(v: Views):
    return report(v)["domains"]


@query(f"with {REPORT} select * from (select *, cast(row_number() over (partition by user_id order by sessions desc, application) as int) as place from (select user_id, application, count(*) as sessions from late where application is not null group by 1, 2)) where place <= 10")
def user_report_applications(v: Views):
    return report(v)["applications"]


@query("""
select 'overview' as section, 1 as n union all select 'traffic', 1 union all select 'protocols', count(distinct protocol) from flows union all select 'websites', 1
union all select 'top_users', least(10, count(*)) from users where id in (select user_id from user_sessions)""")
def full_report(v: Views):
    return sections(details.full_report(v("users"), v("user_sessions"), v("flows"), v("visits"), v("devices")))


FULL = ORACLE["full_report"]


@query()
def exported_report(v: Views):
    """SNK2 and PL12: the sections of the report written as JSON and read back."""
    frames, path = details.full_report(v("users"), v("user_sessions"), v("flows"), v("visits"), v("devices")), shared(v, "report")
    sinks.export_report(frames, path)
    return sections({name: v.spark.read.json(f"{path}/{name}") for name in frames})


ORACLE["exported_report"] = FULL


@query(f"""
select (select count(*) from visits) + count(*) filter ({TOTAL} > 1024 and application is not null) as total_events, (select count(*) from visits) as websites_visited, count(distinct application) as applications_used,
  cast((select sum(bytes_transferred) from visits) + sum{TOTAL} as bigint) as data_transferred from flows""")
def timeline_totals(v: Views):
    return details.whole_timeline(v("flows"), v("visits"))["totals"]


# ---- devices and applications


@query(f"""
with x as (select src_mac as mac, 'protocol' as kind, protocol as value, {TOTAL} as b from flows union all select src_mac, 'port', cast(dst_port as varchar), {TOTAL} from flows union all select src_mac, 'destination', dst_ip, {TOTAL} from flows),
g as (select mac, kind, value, count(*) as sessions, cast(sum(b) as bigint) as bytes from x group by all), r as (select *, row_number() over (partition by mac, kind order by bytes desc, value) as place from g)
select mac, kind, value, sessions, bytes, hostname as name from r left join enriched on kind = 'destination' and ip_address = value where kind = 'protocol' or kind = 'port' and place <= 20 or kind = 'destination' and place <= 50""")
def device_tables(v: Views):
    return details.device_tables(v("flows"), v("enriched"))


@query(f"""
with s as (select application, src_mac, username, {TOTAL} as b from flows join devices d on d.mac_address = src_mac left join users u on u.id = d.user_id where application is not null),
x as (select application, 'user' as kind, username as value, b from s where username is not null union all select application, 'device', src_mac, b from s union all select category, 'domain', domain, bytes_transferred from visits where category is not null),
g as (select application, kind, value, count(*) as uses, cast(sum(b) as bigint) as bytes from x group by all)
select * from (select *, cast(row_number() over (partition by application, kind order by bytes desc, value) as int) as place from g) where place <= case kind when 'domain' then 50 else 20 end""")
def application_tables(v: Views):
    return details.application_tables(v("flows"), v("visits"), v("devices"), v("users"))


@query(f"""
with h as (select application, cast(hour(start_time) as int) as turn, sum{TOTAL} as b from flows where application is not null group by 1, 2), d as (select application, cast(isodow(start_time) - 1 as int) as turn, sum{TOTAL} as b from flows where application is not null group by 1, 2)
select h.application, max_by(h.turn, struct_pack(b := h.b, a := -h.turn)) as peak_hour, any_value(x.turn) as peak_day from h join (select application, max_by(turn, struct_pack(b := b, a := -turn)) as turn from d group by application) x on x.application = h.application group by h.application""")
def application_peaks(v: Views):
    return details.application_peaks(v("flows"))


KINDS = "kinds as (select distinct p_brand as application, 'Kind' || substr(p_brand, 7, 1) as category from part where substr(p_brand, 8, 1) <> '3')"


def kinds(v: Views):
    brand = F.col("p_brand")
    return v("part").where(F.substring(brand, 8, 1) != "3").select(brand.alias("application"), F.concat(F.lit("Kind"), F.substring(brand, 7, 1)).alias("category")).distinct()


@query(f"""
with {KINDS} select f.application, {BYTES} as bytes, count(*) as sessions, count(distinct src_mac) as devices, {rounded(f'sum{TOTAL} / cast(count(*) as double)')} as average_size, coalesce(any_value(category), 'Other') as category
from flows f left join kinds on kinds.application = f.application where f.application is not null group by f.application""")
def categorized_applications(v: Views):
    return details.categorized_applications(v("flows"), kinds(v))


@query(f"""
with {KINDS}, s as (select o.profile_id as profile, src_mac as device, f.application, coalesce(category, 'Uncategorized') as category, start_time, cast(coalesce(epoch(end_time - start_time), 0) as bigint) as seconds
  from flows f join devices d on d.mac_address = src_mac join ({ONE_PROFILE}) o on o.device_id = d.id left join kinds on kinds.application = f.application where f.application is not null),
few as (select * from (select *, row_number() over (partition by profile, category order by start_time desc, application, device, seconds) as place from s) where place <= 50),
t as (select profile, category, string_agg(concat(application, '@', device, '@', seconds), ',' order by start_time, application, device, seconds) as timeline from few group by all)
select s.profile, s.category, cast(sum(seconds) as bigint) as seconds, count(*) as sessions, max(start_time) as last_accessed, max_by(device, struct_pack(t := start_time, d := device, a := application)) as device, any_value(t.timeline) as timeline
from s join t on t.profile = s.profile and t.category = s.category group by s.profile, s.category""")
def category_usage(v: Views):
    own = pipeline.one_profile(v("members")).join(v("devices").select(F.col("id").alias("device_id"), F.col("mac_address").alias("device")), "device_id").select("device", F.col("profile_id").alias("profile"))
    rows = v("flows").where("application is not null").join(own, F.col("src_mac") == F.col("device")).select("profile", "device", "application", "start_time", "end_time")
    out = details.category_usage(rows, kinds(v))
    line = F.transform("timeline", lambda x: F.concat_ws("@", x["application"], x["device"], x["seconds"].cast("string")))
    return out.withColumn("timeline", F.array_join(line, ","))


@query(f"""
with {KINDS} select 'sessions' as badge, coalesce(category, 'Uncategorized') as value, count(*) as n from flows f left join kinds on kinds.application = f.application group by 2
union all select 'alerts', null, count(*) from part where p_partkey % 3 <> 0 union all select 'rules', null, count(*) from part where p_partkey % 4 in (0, 1)""")
def count_badges(v: Views):
    part = v("part").withColumn("turn", F.col("p_partkey") % 4)
    alerts = part.select((F.col("p_partkey") % 3 == 0).alias("seen"))
    rules = part.select(F.when(F.col("turn") == 0, "Unknown").when(F.col("turn") == 1, "Uncategorized").otherwise("Web").alias("category"))
    return details.count_badges(v("flows"), kinds(v), alerts, rules)


@query("""
select kind, value, count(*) as packets from (select 'protocol' as kind, coalesce(protocol, 'Unknown') as value from packets union all select 'application', coalesce(application, 'Unknown') from packets union all select 'domain', coalesce(domain, 'Unknown') from packets) group by all""")
def busy_counters(v: Views):
    return details.busy_counters(v("packets"))


def _map(table: str, column: str, name: str) -> str:
    few = f"(select {column} as k, count(*) as n from {table} where {column} is not null group by 1 order by n desc, k limit 5)"
    return f"(select string_agg(concat(k, '=', n), ',' order by k) from {few}) as {name}"


@query(f"""
select round(count(*) / cast(greatest(epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts))), 1) as double), 6) as packets_per_second,
  {_map('packets', 'application', 'top_applications')}, {_map('visits', 'domain', 'top_domains')}, {_map('visits', 'category', 'top_categories')} from packets""")
def snapshot_maps(v: Views):
    shown = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias(c)
    out = details.snapshot_maps(v("packets"), v("visits"), 5)
    return out.select("packets_per_second", *(shown(c) for c in ("top_applications", "top_domains", "top_categories")))


@query(f"select domain, count(*) as visits, {VISIT_BYTES} as bytes from visits where domain is not null and timestamp >= (select max(timestamp) from visits) - interval '48' hour group by domain order by visits desc, domain limit 20")
def top_domains_of_hours(v: Views):
    return topk.top_groups(periods.trailing_hours(v("visits"), "timestamp", 48), "domain", 20, "visits", visits=F.count("*"), bytes=F.sum("bytes_transferred"))


# ---- groups and profiles


def _joined(column: str):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",").alias(column)


@query("""
select g.id, name, count(distinct device_id) as members, coalesce(string_agg(distinct cast(device_id as varchar), ',' order by lpad(cast(device_id as varchar), 12, '0')), '') as ids
from device_groups g left join (select group_id, device_id from members) m on m.group_id = g.id group by g.id, name""".replace("string_agg(distinct cast(device_id as varchar), ',' order by lpad(cast(device_id as varchar), 12, '0'))", "array_to_string(list_sort(list_distinct(list(device_id) filter (device_id is not null))), ',')"))
def group_members(v: Views):
    out = details.member_lists(v("device_groups"), v("members"))
    return out.select("id", "name", "members", _joined("ids"))


@query("""
with own as (select d.id, d.user_id, coalesce(department, 'General') as department from devices d join users u on u.id = d.user_id)
select concat('user-', user_id) as id, 'user' as kind, count(*) as members, array_to_string(list_sort(list(own.id)), ',') as ids from own group by user_id
union all select concat('dept-', lower(department)), 'dept', count(*), array_to_string(list_sort(list(own.id)), ',') from own group by department""")
def derived_groups(v: Views):
    out = details.derived_groups(v("users"), v("devices"))
    return out.select("id", "kind", "members", _joined("ids"))


@query(f"select profile_id, device_id, hostname from ({ONE_PROFILE}) join devices on devices.id = device_id")
def profile_devices(v: Views):
    return details.profile_devices(pipeline.one_profile(v("members")), v("devices")).select("profile_id", "device_id", "hostname")


def profiles(v: Views):
    return details.profile_analytics(pipeline.one_profile(v("members")), v("devices"), v("flows"), v("visits"))


OF_PROFILE = f"own as (select profile_id, mac_address as mac from ({ONE_PROFILE}) join devices on devices.id = device_id)"


@query(f"""
with {OF_PROFILE}, mine as (select src_mac, {BYTES} as b, max(coalesce(end_time, start_time)) as last from flows group by src_mac)
select profile_id, count(*) as total_devices, count(*) filter (last >= {AS_OF} - interval '5' minute) as active_devices, cast(coalesce(sum(b), 0) as bigint) as total_traffic from own left join mine on src_mac = mac group by profile_id""")
def profile_totals(v: Views):
    return profiles(v)["totals"]


@query(f"""
with {OF_PROFILE} select * from (select *, cast(row_number() over (partition by profile_id order by visits desc, domain) as int) as place from (
  select profile_id, domain, count(*) as visits, {VISIT_BYTES} as bytes from own join visits on device_mac = mac group by 1, 2)) where place <= 10""")
def profile_domains(v: Views):
    return profiles(v)["domains"]


@query(f"""
with {OF_PROFILE} select * from (select *, cast(row_number() over (partition by profile_id order by time desc, mac, key) as int) as place from (
  select profile_id, mac, timestamp as time, domain as what, cast(id as varchar) as key from own join visits on device_mac = mac)) where place <= 10""")
def profile_activity(v: Views):
    return profiles(v)["activity"].select("profile_id", "mac", "time", "what", "key", "place")


IN_GROUP = "src_mac in (select mac_address from devices where id in (select device_id from members where group_id = 1))"


@query(f"select id, src_mac from flows where {IN_GROUP}")
def sessions_of_group(v: Views):
    return details.sessions_of_group(v("members"), v("devices"), v("flows"), 1).select("id", "src_mac")


@query(f"select id, start_time from flows where {IN_GROUP} and start_time >= {AS_OF} - interval '1000' day order by start_time desc, id desc limit 100")
def newest_of_group(v: Views):
    return details.newest_of_group(v("members"), v("devices"), v("flows"), 1, "1000 days").select("id", "start_time")


@query(f"""
with last as (select src_mac, max(coalesce(end_time, start_time)) as last_active from flows group by src_mac)
select id, last_active, coalesce(last_active >= {AS_OF} - interval '20' day, false) as online, cast(row_number() over (order by coalesce(last_active >= {AS_OF} - interval '20' day, false) desc, last_active desc nulls last, id) as int) as place
from devices left join last on src_mac = mac_address""")
def online_first(v: Views):
    """TK15; the place is added for the comparison alone, over one row for each device."""
    out = details.online_first(v("devices"), v("flows"), "20 days")
    order = [F.desc("online"), F.desc_nulls_last("last_active"), F.col("id")]
    return out.select("id", "last_active", "online", F.row_number().over(topk.Window.orderBy(*order)).alias("place"))


@query(f"select user_id, max_by(src_mac, struct_pack(t := coalesce(end_time, start_time), m := src_mac)) as mac_address, max(coalesce(end_time, start_time)) as last_active from ({OWN_BYTES}) group by user_id")
def last_device(v: Views):
    return details.last_device(v("devices"), v("flows"))
