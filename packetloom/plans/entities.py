"""Queries over devices, users, groups, applications and websites, with the joins and labels they need."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.functions import scalars, tables
from packetloom.operators import analytics, joins, pipeline, topk
from packetloom.plans.views import Views, registry, rounded

query, QUERIES, ORACLE = registry()

TOTAL = "(coalesce(bytes_sent, 0) + coalesce(bytes_received, 0))"
BYTES = f"cast(coalesce(sum{TOTAL}, 0) as bigint)"
SECONDS = "cast(coalesce(sum(coalesce(epoch(end_time - start_time), 0)), 0) as bigint)"
VISIT_BYTES = "cast(coalesce(sum(bytes_transferred), 0) as bigint)"
PER_DEVICE = f"""
mine as (select src_mac as m1, {BYTES} as bytes, count(*) as sessions, max(start_time) as last_session from flows group by src_mac),
web as (select device_mac as m2, count(*) as visits, max(timestamp) as last_visit from visits group by device_mac),
per_device as (select id, mac_address, hostname, user_id, coalesce(bytes, 0) as bytes, coalesce(sessions, 0) as sessions, coalesce(visits, 0) as visits,
  greatest(last_session, last_visit) as last_active from devices left join mine on m1 = mac_address left join web on m2 = mac_address)
"""


# ---- overview and websites


@query(f"""
with s as (select count(distinct src_mac) as devices_with_traffic, {BYTES} as total_bytes, count(*) as total_sessions from flows)
select (select count(*) from users where is_active) as active_users, (select count(*) from devices where is_active) as active_devices, s.*,
  (select count(*) from visits) as total_visits, (select count(distinct domain) from visits) as unique_domains, (select {VISIT_BYTES} from visits) as web_bytes, (select count(*) from user_sessions) as user_sessions,
  {rounded('devices_with_traffic / cast((select count(*) from devices where is_active) as double) * 100')} as device_utilization from s""")
def overview(v: Views):
    return analytics.overview(v("flows"), v("visits"), v("users"), v("devices"), v("user_sessions"))


@query(f"select count(*) as visits, {VISIT_BYTES} as bytes, cast(sum(duration) as bigint) as duration, count(distinct domain) as unique_domains, {rounded('sum(duration) / cast(count(*) as double)')} as average_duration from visits")
def website_summary(v: Views):
    return analytics.website_summary(v("visits"))


@query(f"""
select domain, count(*) as visits, {VISIT_BYTES} as bytes, cast(sum(duration) as bigint) as duration, count(distinct device_mac) as devices,
  (max_by(struct_pack(c := category), struct_pack(t := timestamp, i := id))).c as category from visits group by domain""")
def domain_stats(v: Views):
    return analytics.domain_stats(v("visits"))


@query(f"select domain, count(*) as visits, {VISIT_BYTES} as bytes from visits group by domain order by visits desc, domain limit 20")
def top_domains(v: Views):
    return topk.top_groups(v("visits"), "domain", 20, "visits", visits=F.count("*"), bytes=F.sum("bytes_transferred"))


@query(f"""
select category, count(*) as visits, {VISIT_BYTES} as bytes, cast(sum(duration) as bigint) as duration, {rounded('sum(duration) / cast(count(*) as double)')} as average_duration from visits where category is not null group by category""")
def category_stats(v: Views):
    return analytics.category_stats(v("visits"))


@query(f"""
select coalesce(category, 'Uncategorized') as category, count(*) as visits, {VISIT_BYTES} as bytes, cast(sum(duration) as bigint) as duration, {rounded('sum(duration) / cast(count(*) as double)')} as average_duration from visits group by 1""")
def category_stats_with_null(v: Views):
    return analytics.category_stats(v("visits"), "Uncategorized")


# ---- devices and users


@query(f"with {PER_DEVICE} select * from per_device")
def device_breakdown(v: Views):
    return analytics.device_breakdown(v("devices"), v("flows"), v("visits"))


@query(f"""
with m as (select src_mac as mac, cast(sum(bytes_sent) as bigint) as bytes_sent, cast(sum(bytes_received) as bigint) as bytes_received, count(*) as sessions, count(distinct dst_ip) as destinations from flows group by src_mac),
w as (select device_mac, count(*) as visits, count(distinct domain) as domains from visits group by device_mac)
select mac, bytes_sent, bytes_received, sessions, destinations, coalesce(visits, 0) as visits, coalesce(domains, 0) as domains from m left join w on device_mac = mac""")
def device_totals(v: Views):
    return analytics.device_totals(v("flows"), v("visits"))


@query(f"""
with {PER_DEVICE}, t as (select d.user_id, {SECONDS} as seconds from flows join devices d on mac_address = src_mac where d.user_id is not null group by d.user_id),
u as (select user_id, count(*) as devices, count(*) filter (bytes > 0) as active_devices, cast(sum(bytes) as bigint) as bytes, cast(sum(sessions) as bigint) as sessions, cast(sum(visits) as bigint) as visits from per_device where user_id is not null group by user_id)
select u.*, coalesce(seconds, 0) as seconds from u left join t on t.user_id = u.user_id""")
def user_totals(v: Views):
    return analytics.user_totals(v("flows"), v("visits"), v("devices"))


@query(f"""
select user_id, application, bytes, sessions, seconds, cast(place as int) as place from (select *, row_number() over (partition by user_id order by bytes desc, application) as place from (
  select d.user_id, coalesce(application, 'Unknown') as application, {BYTES} as bytes, count(*) as sessions, {SECONDS} as seconds from flows join devices d on mac_address = src_mac where d.user_id is not null group by 1, 2)) where place <= 10""")
def top_applications_per_user(v: Views):
    return topk.top_per(analytics.user_applications(v("flows"), v("devices")), ["user_id"], "bytes", 10, ["application"])


@query(f"""
select user_id, domain, visits, bytes, cast(place as int) as place from (select *, row_number() over (partition by user_id order by bytes desc, domain) as place from (
  select d.user_id, domain, count(*) as visits, {VISIT_BYTES} as bytes from visits join devices d on mac_address = device_mac where d.user_id is not null group by 1, 2)) where place <= 20""")
def top_domains_per_user(v: Views):
    return topk.top_per(analytics.user_domains(v("visits"), v("devices")), ["user_id"], "bytes", 20, ["domain"])


@query(f"""
select user_id, src_mac, application, {BYTES} as bytes, count(*) as sessions, cast(grouping_id(user_id, src_mac, application) as bigint) as level from (
  select d.user_id, src_mac, coalesce(application, 'Unknown') as application, bytes_sent, bytes_received from flows join devices d on mac_address = src_mac where d.user_id is not null) group by rollup (user_id, src_mac, application)""")
def usage_rollup(v: Views):
    return analytics.usage_rollup(v("flows"), v("devices"))


@query(f"""
with o as (select user_id, count(*) as devices from devices where user_id is not null group by user_id),
s as (select d.user_id, count(*) as sessions, {BYTES} as b from flows join devices d on mac_address = src_mac group by d.user_id),
w as (select d.user_id, count(*) as visits, {VISIT_BYTES} as b from visits join devices d on mac_address = device_mac group by d.user_id)
select o.user_id, devices, coalesce(sessions, 0) as sessions, coalesce(visits, 0) as visits, cast(coalesce(s.b, 0) + coalesce(w.b, 0) as bigint) as bytes from o left join s on s.user_id = o.user_id left join w on w.user_id = o.user_id""")
def report_summary(v: Views):
    return analytics.report_summary(v("flows"), v("visits"), v("devices"))


@query("select u.id, username, count(*) as sessions, cast(sum(total_bytes) as bigint) as bytes from users u join user_sessions s on s.user_id = u.id group by u.id, username order by sessions desc, u.id limit 10")
def top_users(v: Views):
    return topk.top(analytics.sessions_per_user(v("users"), v("user_sessions")), "sessions", 10, ["id"])


@query(f"""
with d as (select count(*) as devices, count(user_id) as assigned from devices)
select (select count(*) from users) as users, devices, assigned, (select count(*) from user_sessions) as sessions, devices - assigned as unassigned, {rounded('assigned / cast(devices as double) * 100')} as assignment_rate from d""")
def assignment_summary(v: Views):
    return analytics.assignment_summary(v("users"), v("devices"), v("user_sessions"))


@query("select id, hostname from devices where user_id is null")
def unassigned_devices(v: Views):
    return joins.unassigned(v("devices")).select("id", "hostname")


@query("select d.id, hostname, coalesce(username, 'Unassigned') as owner from devices d left join users u on u.id = d.user_id")
def device_owners(v: Views):
    return joins.with_users(v("devices"), v("users")).select("id", "hostname", "owner")


# ---- groups and applications


@query(f"""
with {PER_DEVICE}, g as (select group_id, p.* from (select distinct group_id, device_id from members) m join per_device p on p.id = m.device_id)
select group_id, id as device_id, bytes, sessions, visits, case when sum(bytes) over (partition by group_id) > 0 then {rounded('bytes / cast(sum(bytes) over (partition by group_id) as double) * 100')} else 0.0 end as share from g""")
def group_devices(v: Views):
    return analytics.group_devices(v("members"), v("devices"), v("flows"), v("visits")).select("group_id", "device_id", "bytes", "sessions", "visits", "share")


@query(f"""
with {PER_DEVICE}, g as (select group_id, p.* from (select distinct group_id, device_id from members) m join per_device p on p.id = m.device_id)
select group_id, count(*) as devices, count(distinct user_id) as users, cast(sum(bytes) as bigint) as bytes, cast(sum(sessions) as bigint) as sessions, cast(sum(visits) as bigint) as visits,
  {rounded('sum(bytes) / cast(count(*) as double)')} as bytes_per_device, {rounded('sum(sessions) / cast(count(*) as double)')} as sessions_per_device from g group by group_id""")
def group_totals(v: Views):
    return analytics.group_totals(v("members"), v("devices"), v("flows"), v("visits"))


@query(f"""
select group_id, coalesce(application, 'Unknown') as application, count(distinct src_mac) as devices, {BYTES} as bytes from (select distinct group_id, device_id from members) m join devices d on d.id = device_id join flows on src_mac = mac_address group by 1, 2""")
def group_applications(v: Views):
    return analytics.group_applications(v("members"), v("devices"), v("flows"))


@query("select g.id, name, count(distinct device_id) as devices from device_groups g left join members on group_id = g.id where is_active group by g.id, name")
def group_counts(v: Views):
    return analytics.membership_counts(v("device_groups"), v("members"))


@query("""
with m as (select user_id, count(*) as n from devices group by user_id)
select coalesce(department, 'General') as department, count(*) as users, cast(coalesce(sum(n), 0) as bigint) as devices from users u left join m on m.user_id = u.id group by 1""")
def department_groups(v: Views):
    return analytics.department_groups(v("users"), v("devices"))


@query("""
with live as (select * from devices where is_active),
x as (select 'type' as kind, coalesce(device_type, 'unknown') as value from live union all select 'vendor', vendor from live where lower(vendor) <> 'unknown'
  union all select 'subnet', regexp_extract(ip_address, '^\\d+\\.\\d+\\.\\d+') from live)
select kind, value, count(*) as devices from x group by all having count(*) > 1""")
def group_suggestions(v: Views):
    return analytics.group_suggestions(v("devices"))


@query(f"select application, {BYTES} as bytes, count(*) as sessions, count(distinct src_mac) as devices, {rounded(f'sum{TOTAL} / cast(count(*) as double)')} as average_size from flows where application is not null group by application")
def application_list(v: Views):
    return analytics.applications(v("flows"))


@query(f"""
select application, coalesce(username, 'Unassigned') as owner, {BYTES} as bytes, count(*) as sessions, count(distinct src_mac) as devices
from flows left join devices d on mac_address = src_mac left join users u on u.id = d.user_id where application is not null group by 1, 2""")
def application_users(v: Views):
    return analytics.application_users(v("flows"), v("devices"), v("users"))


@query(f"""
select coalesce(application, 'Unknown') as application, cast(coalesce(sum({TOTAL}) filter (src_mac = 'dev-1'), 0) as bigint) as "dev-1", cast(coalesce(sum({TOTAL}) filter (src_mac = 'dev-2'), 0) as bigint) as "dev-2",
  cast(coalesce(sum({TOTAL}) filter (src_mac = 'dev-3'), 0) as bigint) as "dev-3" from flows where src_mac in ('dev-1', 'dev-2', 'dev-3') group by 1""")
def device_comparison(v: Views):
    return analytics.comparison(v("flows"), "src_mac", ["dev-1", "dev-2", "dev-3"])


# ---- joins, labels and enrichment


@query("""
with asked as (select distinct size * 977 as number from packets where size is not null)
select number, max_by(range_asn, range_start) as range_asn, max_by(range_name, range_start) as range_name from asked left join networks on number between range_start and range_end group by number""")
def network_lookup(v: Views):
    asked = v("packets").select((F.col("size") * 977).alias("number")).distinct()
    return joins.range_lookup(asked, "number", v("networks"), "range_start", "range_end").select("number", "range_asn", "range_name")


@query("""
with b as (select ts, dst_ip, max(domain) as name from packets where domain is not null group by ts, dst_ip)
select p.id, b.name from packets p asof left join b on p.dst_ip = b.dst_ip and p.ts >= b.ts""")
def name_as_of(v: Views):
    bound = v("packets").where("domain is not null").groupBy("ts", "dst_ip").agg(F.max("domain").alias("name"))
    return joins.as_of_join(v("packets").select("id", "ts", "dst_ip"), "dst_ip", "ts", bound, "name").select("id", "name")


@query("""
with q as (select src_ip, ts as asked, domain from packets where domain is not null)
select p.id, max_by(q.domain, struct_pack(a := asked, d := q.domain)) as name from packets p left join q on q.src_ip = p.src_ip and asked between p.ts - interval '180' second and p.ts group by p.id""")
def name_within_three_minutes(v: Views):
    asked = v("packets").where("domain is not null").select("src_ip", F.col("ts").alias("asked"), F.col("domain").alias("name"))
    facts = v("packets").select("id", "src_ip", "ts")
    return joins.trailing_join(facts, "src_ip", "ts", asked, "asked", "name", 180).select("id", "name")


RULES = (
    (1, "domain", "site1.example.com", "Work", "One", 1.0), (2, "domain", "site1.example.com", "Other", "Later", 0.5), (3, "domain", "example.com", "Web", "Root", 0.8),
    (4, "ip", "203.0.113.3", "Net", "Address", 0.6), (5, "domain", "site2.example.com", "Play", "Two", 0.9),
)


def rule_table(v: Views):
    return v.spark.createDataFrame(RULES, "id long, type string, value string, category string, app string, confidence double")


@query("""
select id, case when lower(domain) = 'site1.example.com' then 'One' when lower(domain) = 'site2.example.com' then 'Two' when domain is not null then 'Root' when dst_ip = '203.0.113.3' then 'Address' else 'Unknown' end as app,
  case when lower(domain) = 'site1.example.com' then 1.0::double when lower(domain) = 'site2.example.com' then 0.9 when domain is not null then 0.8 when dst_ip = '203.0.113.3' then 0.6 else 0.2 end as confidence from packets""")
def rule_cascade(v: Views):
    rooted = v("packets").withColumn("root", F.lower(scalars.naive_root_domain(F.col("domain")))).drop("application")
    return joins.rule_cascade(rooted, "domain", "root", "dst_ip", rule_table(v)).select("id", "app", "confidence")


def _case(pairs) -> str:
    return "case " + " ".join(f"when {condition} then {value}" for condition, value in pairs) + " end"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_PORTS = ", ".join(f"({p}, '{a}', '{c}')" for p, (a, c) in tables.PORT_LABELS.items())
_HOSTS = _case((f"regexp_matches(host, {_quoted(p)})", f"'{a}|{c}'") for p, a, c in tables.HOST_PATTERNS)


_PREFIXES = _case((f"starts_with(ip, '{p}')", f"'{a}'") for p, a, _ in tables.ADDRESS_PREFIXES)
_PREFIX_LABELS = _case((f"starts_with(ip, '{p}')", f"'{a}|{c}'") for p, a, c in tables.ADDRESS_PREFIXES)


@query(f"""
with hosts as (select id, case id % 7 when 0 then 9 when 3 then 443 when 5 then null else dst_port end as dst_port, case id % 11 when 0 then null when 1 then 'HTTPS' when 2 then 'HTTP' else protocol end as protocol,
  case id % 5 when 0 then domain when 1 then 'WWW.youtube.com.' || domain when 2 then 'cdn.reddit.com' when 3 then null else 'unlisted' || (id % 3) end as host, case id % 3 when 0 then '8.8.8.8' when 1 then '104.' || (id % 40) || '.1.2' else '203.0.113.9' end as ip from packets),
ports(port, app, category) as (values {_PORTS}), named as (select *, {_HOSTS.replace('host,', 'lower(host),')} as by_host, {_PREFIX_LABELS} as by_ip from hosts),
labelled as (select *, coalesce(split_part(by_host, '|', 1), app, split_part(by_ip, '|', 1), case when protocol = 'HTTPS' or dst_port = 443 then 'HTTPS' when protocol = 'HTTP' or dst_port = 80 then 'HTTP' else protocol end, 'Unknown') as found,
  coalesce(split_part(by_host, '|', 2), category, split_part(by_ip, '|', 2), case when protocol in ('HTTPS', 'HTTP') or dst_port in (443, 80) then 'Web' when protocol is not null then 'Network' end, 'Uncategorized') as found_category from named left join ports on port = dst_port)
select id, found as app, found_category as category, case when by_host is not null then 'high' when app is not null then case when host is not null then 'high' else 'medium' end else 'low' end as confidence from labelled""")
def flow_classification(v: Views):
    turn = F.col("id") % 5
    host = F.when(turn == 0, F.col("domain")).when(turn == 1, F.concat(F.lit("WWW.youtube.com."), "domain")).when(turn == 2, "cdn.reddit.com").when(turn == 4, F.concat(F.lit("unlisted"), (F.col("id") % 3).cast("string")))
    port = F.when(F.col("id") % 7 == 0, 9).when(F.col("id") % 7 == 3, 443).when(F.col("id") % 7 != 5, F.col("dst_port"))
    protocol = F.when(F.col("id") % 11 == 1, "HTTPS").when(F.col("id") % 11 == 2, "HTTP").when(F.col("id") % 11 != 0, F.col("protocol"))
    ip = F.when(F.col("id") % 3 == 0, "8.8.8.8").when(F.col("id") % 3 == 1, F.concat(F.lit("104."), (F.col("id") % 40).cast("string"), F.lit(".1.2"))).otherwise("203.0.113.9")
    rows = v("packets").select("id", host.alias("host"), port.alias("port"), ip.alias("ip"), protocol.alias("protocol"))
    return joins.classify_flows(rows, "host", "port", "ip", "protocol").select("id", "found.app", "found.category", "found.confidence")


_IP = "concat(cast(p_partkey % 256 as varchar), '.', cast(p_partkey * 7 % 130 as varchar), '.0.', cast(p_size as varchar))"


@query(f"with a as (select p_partkey as id, {_IP} as ip from part) select id, ip, {_PREFIXES} as app from a")
def address_labels(v: Views):
    ip = F.concat_ws(".", (F.col("p_partkey") % 256).cast("string"), (F.col("p_partkey") * 7 % 130).cast("string"), F.lit("0"), F.col("p_size").cast("string"))
    listed = v("part").select(F.col("p_partkey").alias("id"), ip.alias("ip"))
    rules = v.spark.createDataFrame([(n, p, a) for n, (p, a, _) in enumerate(tables.ADDRESS_PREFIXES)], "priority int, pattern string, app string")
    return joins.ordered_rules(listed, "ip", rules, "prefix").select("id", "ip", "app")


@query(f"""
with a as (select p_partkey as id, {_IP} as ip, p_partkey % 256 as a, p_partkey * 7 % 130 as b from part)
select id, ((a * 256 + b) * 256) * 256 + cast(split_part(ip, '.', 4) as bigint) as number, not (a in (10, 127) or (a = 172 and b between 16 and 31) or (a = 192 and b = 168) or (a = 169 and b = 254)) as public,
  concat(cast(a as varchar), '.', cast(b as varchar), '.0') as subnet, array_to_string([substr(md5(ip), 1, 2), substr(md5(ip), 3, 2), substr(md5(ip), 5, 2), substr(md5(ip), 7, 2), substr(md5(ip), 9, 2), substr(md5(ip), 11, 2)], ':') as mac,
  case when starts_with(ip, '192.168.') then 'computer' when ip like '%.1' then 'router' else 'device' end as kind from a""")
def address_features(v: Views):
    ip = F.concat_ws(".", (F.col("p_partkey") % 256).cast("string"), (F.col("p_partkey") * 7 % 130).cast("string"), F.lit("0"), F.col("p_size").cast("string"))
    listed = v("part").select(F.col("p_partkey").alias("id"), ip.alias("ip"))
    c = F.col("ip")
    return listed.select("id", scalars.ipv4_number(c).alias("number"), scalars.is_public(c).alias("public"), scalars.subnet24(c).alias("subnet"), scalars.pseudo_mac(c).alias("mac"), scalars.device_type_of_address(c).alias("kind"))


@query("""
select id, case when regexp_matches(lower(coalesce(organization, '')), 'tor|proxy|vpn') then 'medium' when regexp_matches(lower(hostname), 'malware|botnet|spam') then 'high' else 'low' end as threat_level
from (select *, ip_address as id from enriched)""")
def threat_levels(v: Views):
    return pipeline.with_threat_level(v("enriched")).select(F.col("ip_address").alias("id"), "threat_level")


@query("""
with last as (select dst_ip, min_by(domain, struct_pack(t := ts, i := id)) filter (domain is not null) as domain, min_by(application, struct_pack(t := ts, i := id)) filter (application is not null) as application from packets group by dst_ip)
select dst_ip as ip_address, domain, application from last where dst_ip not in (select ip_address from enriched)""")
def enrichment_candidates(v: Views):
    return pipeline.enrichment_candidates(v("packets"), v("enriched"))


@query("""
with k as (select ip_address, case when ip_address like 'dst-3%' then null else hostname end as hostname, case when ip_address like 'dst-3%' then null else organization end as organization, ip_address like 'dst-1%' as fresh from enriched where ip_address < 'dst-5')
select dst_ip as ip, case when k.ip_address is null or (hostname is null and organization is null) then 0 else 5 end as priority from (select distinct dst_ip from flows) left join k on k.ip_address = dst_ip where k.ip_address is null or not fresh""")
def enrichment_due(v: Views):
    bare = F.col("ip_address").startswith("dst-3")
    known = v("enriched").where("ip_address < 'dst-5'").withColumns({c: F.when(~bare, F.col(c)) for c in ("hostname", "organization")})
    known = known.withColumn("updated_at", F.when(F.col("ip_address").startswith("dst-1"), F.lit("1999-12-31 12:00:00")).otherwise("1998-01-01 00:00:00").cast("timestamp_ntz"))
    local = v("nation").select(F.lit("127.0.0.1").alias("ip"))
    return pipeline.enrichment_due(v("flows").select(F.col("dst_ip").alias("ip")).unionAll(local), known, "2000-01-01 00:00:00")


@query("""
with m as (select distinct group_id, device_id from members)
select device_id, max_by(profile_id, struct_pack(a := added_at, p := profile_id)) as profile_id from members group by device_id""")
def one_profile(v: Views):
    return pipeline.one_profile(v("members")).select("device_id", "profile_id")


@query("""
with s as (select distinct date_trunc('day', ts) as taken, src_ip, dst_ip, dst_port from packets), t as (select taken, lag(taken) over (order by taken) as before from (select distinct taken from s))
select s.taken, s.src_ip, s.dst_ip, s.dst_port from s join t on t.taken = s.taken where not exists (select 1 from s p where p.taken = t.before and p.src_ip = s.src_ip and p.dst_ip = s.dst_ip and p.dst_port = s.dst_port)""")
def new_connections(v: Views):
    snapshots = v("packets").select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("taken"), "src_ip", "dst_ip", "dst_port")
    return pipeline.new_connections(snapshots, "taken", ["src_ip", "dst_ip", "dst_port"])


@query("select id, start_time from flows where start_time >= (select max(start_time) from flows) - interval '90' day")
def retained_sessions(v: Views):
    return pipeline.retained(v("flows"), "start_time").select("id", "start_time")


@query("select id, hostname, case when user_id in (select id from users where not is_active) then null else user_id end as user_id from devices")
def unassign_users(v: Views):
    return pipeline.unassign(v("devices"), v("users").where("not is_active").select(F.col("id").alias("user_id"))).select("id", "hostname", "user_id")


@query("select 'department' as column, department as value, count(*) as rows from users where department is not null group by department having count(*) > 1")
def duplicate_names(v: Views):
    return pipeline.duplicates(v("users"), "username", "email", "department")


# ---- pages


_EN, _GOOD, _BAD = (" + ".join(f"contains(lower(text), '{w}')::int" for w in words) for words in (tables.ENGLISH_WORDS, tables.POSITIVE_WORDS, tables.NEGATIVE_WORDS))


@query(f"""
select doc_id, case when {_EN} > 3 then 'en' else 'unknown' end as language, case when {_GOOD} + {_BAD} > 0 then ({_GOOD} - ({_BAD})) / cast({_GOOD} + {_BAD} as double) else 0.0 end as sentiment from documents""")
def text_language(v: Views):
    return v("documents").select("doc_id", scalars.language(F.col("text")).alias("language"), scalars.sentiment(F.col("text")).alias("sentiment"))


@query(r"""
select page_id, nullif(trim(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')), '') as title, len(regexp_extract_all(html, '(?i)<img\b'))::int as images_count,
  len(regexp_extract_all(html, '(?i)<a\b'))::int as links_count, len(regexp_extract_all(html, '(?i)<form\b'))::int as forms_count, len(regexp_extract_all(html, '(?i)<script\b'))::int as scripts_count,
  case page_id % 3 when 0 then concat('Page ', cast(page_id as varchar)) when 1 then concat('Site ', cast(page_id as varchar)) end as meta_description from pages""")
def page_features(v: Views):
    """The pages hold no description, so two of three get one, in either order of its fields."""
    n = F.col("page_id").cast("string")
    meta = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<meta name="description" content="Page '), n, F.lit('">'))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("<META content='Site "), n, F.lit("' name='description'/>")))
    pages = v("pages").withColumn("html", F.concat(F.coalesce(meta, F.lit("")), "html"))
    return pages.select("page_id", *(c.alias(k) for k, c in scalars.page_features(F.col("html")).items()))


@query(r"""
with bare as (select page_id, regexp_replace(regexp_replace(regexp_replace(html, '<script\b.*?</script\s*>', ' ', 'gis'), '<style\b.*?</style\s*>', ' ', 'gis'), '<[^>]*>', ' ', 'gs') as text from pages),
words as (select page_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) as word from bare), counted as (select page_id, word, count(*) as times from words where length(word) > 3 group by all)
select page_id, word, times, cast(place as int) as place from (select *, row_number() over (partition by page_id order by times desc, word) as place from counted) where place <= 10""")
def page_keywords(v: Views):
    text = F.lower(scalars.visible_text(F.col("html")))
    words = v("pages").select("page_id", F.explode(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+)"), 1)).alias("word")).where(F.length("word") > 3)
    return topk.top_per(words.groupBy("page_id", "word").agg(F.count("*").alias("times")), ["page_id"], "times", 10, ["word"])


_BARE = r"regexp_replace(regexp_replace(regexp_replace(html, '<script\b.*?</script\s*>', ' ', 'gis'), '<style\b.*?</style\s*>', ' ', 'gis'), '<[^>]*>', ' ', 'gs')"
_CONTENT = rf"""
bare as (select page_id, html, {_BARE} as text from pages), felt as (select *, {_GOOD} as good, {_BAD} as bad from bare),
f as (select page_id, case when good + bad > 0 then (good - bad) / cast(good + bad as double) else 0.0 end as sentiment, len(regexp_extract_all(html, '(?i)<img\b')) as i, len(regexp_extract_all(html, '(?i)<a\b')) as l,
  len(regexp_extract_all(html, '(?i)<form\b')) as f, len(regexp_extract_all(html, '(?i)<script\b')) as s from felt)
"""
_CONTENT_SUMS = "count(*) as pages, round(avg(sentiment), 6) as average_sentiment, cast(sum(i) as bigint) as images_count, cast(sum(l) as bigint) as links_count, cast(sum(f) as bigint) as forms_count, cast(sum(s) as bigint) as scripts_count"


def page_content(v: Views):
    counts = {n: c for n, c in scalars.page_features(F.col("html")).items() if n.endswith("_count")}
    return v("pages").select("page_id", scalars.sentiment(scalars.visible_text(F.col("html"))).alias("sentiment"), *(c.alias(n) for n, c in counts.items()))


@query(f"with {_CONTENT} select {_CONTENT_SUMS} from f")
def content_stats(v: Views):
    return analytics.content_stats(page_content(v))


@query(f"""
with {_CONTENT}, near as (select page_id from visits where timestamp between (select max(timestamp) from visits) - interval '7' day and (select max(timestamp) from visits) and id % 3 <> 0)
select {_CONTENT_SUMS} from near join f on f.page_id = near.page_id""")
def content_of_visits(v: Views):
    """JN4: the content of analysed visits within a period."""
    content = v("visits").where("id % 3 <> 0").select(F.col("id").alias("website_visit_id"), "page_id").join(page_content(v), "page_id")
    return analytics.content_stats(joins.content_of_visits(content, v("visits"), "7d"))


@query("""
with asked as (select distinct lower(domain) as host from visits where domain <> ''), cut as (select host, string_split(host, '.') as parts from asked)
select host, case when len(parts) >= 2 then array_to_string(parts[len(parts) - 1:], '.') else host end as root_domain, case when len(parts) >= 2 then concat(upper(parts[len(parts) - 1][1]), lower(parts[len(parts) - 1][2:])) else 'Unknown' end as app from cut""")
def root_domains(v: Views):
    hosts = v("visits").where("domain <> ''").select(F.lower("domain").alias("host")).distinct()
    suffixes = v.spark.createDataFrame([(s,) for s in ("com", "org", "net")], "suffix string")
    found = joins.registered_domain(hosts, "host", suffixes)
    return found.select("host", "root_domain", scalars.fallback_app_name(F.col("host")).alias("app"))
