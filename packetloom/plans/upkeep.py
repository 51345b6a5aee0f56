"""Queries over labels from other tools, vendors, payloads, the live table, alerts, profiles and dimension upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.functions import periods, scalars
from packetloom.operators import analytics, filters, joins, pipeline, sessions, topk
from packetloom.plans.entities import _HOSTS, _PORTS
from packetloom.plans.views import Views, registry

query, QUERIES, ORACLE = registry()

TOTAL = "(coalesce(bytes_sent, 0) + coalesce(bytes_received, 0))"


@query("""
with own as (select case id % 2 when 0 then dst_ip else src_ip end as a, case id % 2 when 0 then src_ip else dst_ip end as b, dst_port, upper(protocol) as protocol, ts, concat('App', cast(id % 5 as varchar)) as app, concat('Kind', cast(id % 5 as varchar)) as kind, id % 5 / 10.0 as sure from packets where id % 30 = 1 or id % 30 = 10),
two_ways as (select * from own union all select b, a, dst_port, protocol, ts, app, kind, sure from own),
last as (select a, b, dst_port, protocol, max_by(struct_pack(a := app, k := kind, c := sure), struct_pack(t := ts, a := app)) as l from two_ways group by all)
select p.id, l.a as ndpi_app, l.k as ndpi_category, cast(l.c as double) as ndpi_confidence from packets p left join last on last.a = p.src_ip and last.b = p.dst_ip and last.dst_port = p.dst_port and last.protocol = p.protocol""")
def flow_labels(v: Views):
    some = v("packets").where("id % 30 = 1 or id % 30 = 10")
    even, kind = F.col("id") % 2 == 0, (F.col("id") % 5).cast("string")
    labels = some.select(
        F.when(even, F.col("dst_ip")).otherwise(F.col("src_ip")).alias("src_ip"), F.when(even, F.col("src_ip")).otherwise(F.col("dst_ip")).alias("dst_ip"), "dst_port", F.lower("protocol").alias("protocol"), "ts",
        F.concat(F.lit("App"), kind).alias("app"), F.concat(F.lit("Kind"), kind).alias("category"), (F.col("id") % 5 / 10).alias("confidence"),
    )
    return joins.flow_labels(v("packets"), labels).select("id", "ndpi_app", "ndpi_category", "ndpi_confidence")


@query("""
with d as (select s_suppkey as id, md5(s_name) as h from supplier),
names as (select p, min(n) as n from (select substr(h, 1, 6) as p, concat('six ', cast(id as varchar)) as n from d where id % 2 = 0 union all select substr(h, 1, 9), concat('nine ', cast(id as varchar)) from d where id % 3 = 0) group by p)
select id, coalesce(nine.n, six.n, 'Unknown') as vendor from d left join names nine on nine.p = substr(h, 1, 9) left join names six on six.p = substr(h, 1, 6)""")
def vendor_lookup(v: Views):
    hashed = v("supplier").select(F.col("s_suppkey").alias("id"), F.md5(F.col("s_name").cast("binary")).alias("h"))
    name = lambda word: F.concat(F.lit(word), F.col("id").cast("string")).alias("vendor_short")
    oui = hashed.where("id % 2 = 0").select(F.substring("h", 1, 6).alias("prefix"), name("six ")).unionByName(hashed.where("id % 3 = 0").select(F.substring("h", 1, 9).alias("prefix"), name("nine ")))
    macs = hashed.select("id", F.regexp_replace(F.substring("h", 1, 12), "(..)(?=.)", "$1:").alias("mac"))
    return joins.vendor_lookup(macs, "mac", oui.withColumn("vendor_long", F.lit(None).cast("string"))).select("id", "vendor")


@query("""
with p as (select page_id, page_id % 10 as turn, regexp_extract(url, '^https?://([^/:?#]+)', 1) as host from pages)
select page_id, case turn when 0 then 'HTTP' when 1 then 'SMTP' when 2 then 'HTTPS' when 3 then 'DNS' when 4 then 'SSH' when 5 then 'YOUTUBE' when 6 then 'MySQL' when 8 then 'FTP' when 9 then 'HTTP' else 'Unknown' end as app,
  case turn when 0 then 0.95::double when 1 then 0.9 when 2 then 0.95 when 3 then 0.8 when 4 then 0.9 when 5 then 0.9 when 6 then 0.7 when 8 then 0.9 when 9 then 0.95 else 0.0 end as confidence,
  turn in (2, 4) as encrypted, case when turn in (0, 9) then host end as host, case turn when 0 then 'GET' when 9 then 'POST' end as method, case turn when 0 then '/x' when 9 then concat('/', host) end as url, case turn when 9 then 'agent 1' end as user_agent from p""")
def payload_labels(v: Views):
    turn = F.col("page_id") % 10
    host = F.regexp_extract("url", "^https?://([^/:?#]+)", 1)
    get = F.concat(F.lit("GET /x HTTP/1.1\r\nHost: "), host, F.lit("\r\nAccept: *\r\n"))
    post = F.concat(F.lit("POST /"), host, F.lit(" HTTP/1.1\r\nUser-Agent: agent 1\r\nHost:  "), host, F.lit("\r\n"))
    payload = F.when(turn == 0, get).when(turn == 1, "220 ready").when(turn == 2, "\x16\x03\x01").when(turn == 3, "GET not for UDP").when(turn == 4, "SSH-2.0-x").when(turn == 5, "a youtube.com b").when(turn == 8, "USER bob").when(turn == 9, post)
    rows = v("pages").select("page_id", payload.alias("payload"), F.when(turn.isin(3, 7), "UDP").otherwise("TCP").alias("protocol"), F.when(turn == 3, 53).when(turn == 6, 3306).otherwise(9).alias("port"))
    rows = rows.withColumn("found", scalars.payload_label(F.col("payload"), F.col("protocol"), F.col("port")))
    fields = scalars.http_fields(F.when(turn.isin(0, 9), F.col("payload")))
    return rows.select("page_id", "found.app", "found.confidence", "found.encrypted", *(fields[n].alias(n) for n in ("host", "method", "url", "user_agent")))


_EXACT, _OWN = "e.hostname is not null and cast(substr(f.dst_ip, 5) as bigint) % 10 = 2", "e.hostname is null and cast(substr(f.dst_ip, 5) as bigint) % 10 = 1"


def _pick(exact: str, root: str, own: str, none: str) -> str:
    return f"case when {_EXACT} then '{exact}' when e.hostname is not null then '{root}' when {_OWN} then '{own}' else '{none}' end"


@query(f"""
with few as (select * from flows order by start_time desc, id desc limit 200)
select f.id, coalesce(d.hostname, f.src_ip) as device, e.hostname, {TOTAL} as total_bytes, coalesce(f.end_time, f.start_time) >= (select max(start_time) from flows) - interval '90' second as is_active,
  {_pick('Work', 'Web', 'Net', 'Uncategorized')} as category, {_pick('Exact', 'Root', 'Address', 'Unknown')} as app
from few f left join devices d on d.mac_address = f.src_mac left join enriched e on e.ip_address = f.dst_ip""")
def live_table(v: Views):
    part = v("part").withColumn("turn", F.col("p_partkey") % 10)
    rule = lambda kind, value, category, app: [F.col("p_partkey").alias("id"), F.lit(kind).alias("type"), value.alias("value"), F.lit(category).alias("category"), F.lit(app).alias("app"), F.lit(0.9).alias("confidence")]
    exact = v("enriched").where("cast(substr(ip_address, 5) as bigint) % 10 = 2").select(F.lit(1).cast("long").alias("p_partkey"), F.lower("hostname").alias("value")).select(*rule("domain", F.col("value"), "Work", "Exact"))
    own = part.where("turn = 1").select(*rule("ip", F.concat(F.lit("dst-"), F.col("p_partkey").cast("string")), "Net", "Address"))
    root = part.where("p_partkey = 5").select(*rule("domain", F.lit("example.org"), "Web", "Root"))
    return pipeline.live_table(v("flows").drop("application"), v("devices"), v("enriched"), exact.unionAll(own).unionAll(root)).select("id", "device", "hostname", "total_bytes", "is_active", "category", "app")


@query(f"""
with few as (select * from flows order by start_time desc, id desc limit 200), named as (select f.id, f.dst_port, f.protocol, f.src_ip, f.dst_ip, lower(e.hostname) as host from few f left join enriched e on e.ip_address = f.dst_ip),
ports(port, app, category) as (values {_PORTS}),
last as (select src_ip, dst_ip, dst_port, protocol, max(concat('Flow', l_quantity)) as app from (select f.*, cast(cast(id as bigint) % 5 as varchar) as l_quantity from flows f where id % 3 = 0) group by all)
select n.id, coalesce(last.app, split_part({_HOSTS}, '|', 1), ports.app, n.protocol) as label from named n left join ports on port = n.dst_port left join last on last.src_ip = n.src_ip and last.dst_ip = n.dst_ip and last.dst_port = n.dst_port and last.protocol = n.protocol""")
def live_labels(v: Views):
    """PL11: the flow's own label, else the heuristic one."""
    labels = v("flows").where("id % 3 = 0").select("src_ip", "dst_ip", "dst_port", "protocol", F.lit("2000-01-01").cast("timestamp_ntz").alias("ts"), F.concat(F.lit("Flow"), (F.col("id") % 5).cast("string")).alias("app"), F.lit("any").alias("category"), F.lit(0.5).alias("confidence"))
    none = v("part").limit(0).select(F.col("p_partkey").alias("id"), F.lit("ip").alias("type"), F.lit("").alias("value"), F.lit("").alias("category"), F.lit("").alias("app"), F.lit(0.1).alias("confidence"))
    return pipeline.live_table(v("flows").drop("application"), v("devices"), v("enriched"), none, labels=labels).select("id", "label")


PROFILE_SESSIONS = f"""
s as (select m.profile_id as profile, application, start_time, end_time, {TOTAL} as bytes from flows join devices on mac_address = src_mac join (select device_id, max_by(profile_id, struct_pack(a := added_at, p := profile_id)) as profile_id from members group by device_id) m on m.device_id = devices.id where application is not null)
"""


def profile_sessions(v: Views):
    own = pipeline.one_profile(v("members")).join(v("devices").select(F.col("id").alias("device_id"), F.col("mac_address").alias("src_mac")), "device_id").select("src_mac", F.col("profile_id").alias("profile"))
    return v("flows").where("application is not null").join(own, "src_mac").select("profile", "application", "start_time", "end_time", filters.total_bytes().alias("bytes"))


@query(f"""
with {PROFILE_SESSIONS}, used as (select profile, sum(bytes) as used, max(start_time) as time from s group by profile)
select profile, 'restricted application' as title, application as description, start_time as time from s where application in ('Brand#11', 'Brand#21') and profile < 2
union all select profile, 'restricted hours', application, start_time from s where hour(start_time) between 1 and 5 and profile < 2
union all select profile, 'threshold exceeded', cast(cast(used as bigint) as varchar), time from used where used > 1000000000 and profile < 2""")
def policy_alerts(v: Views):
    policies = v.spark.createDataFrame([(k, ["Brand#11", "Brand#21"], 1, 5, 1_000_000_000) for k in (0, 1)], "profile long, restricted array<string>, hour_from int, hour_to int, max_bytes long")
    return pipeline.alerts(profile_sessions(v), policies).drop("seen")


@query(f"""
with {PROFILE_SESSIONS}, closed as (select profile, application, start_time, coalesce(end_time, start_time) as end_time from s),
reach as (select *, max(end_time) over (partition by profile, application order by start_time, end_time rows between unbounded preceding and 1 preceding) as reach from closed),
marked as (select *, sum(case when start_time <= reach + interval '5' minute then 0 else 1 end) over (partition by profile, application order by start_time, end_time rows unbounded preceding) as island from reach),
merged as (select profile, cast(epoch(max(end_time) - min(start_time)) as bigint) as duration from marked group by profile, application, island)
select profile, cast(sum(duration) as bigint) as seconds from merged group by profile""")
def time_online(v: Views):
    return analytics.time_online(sessions.interval_union(profile_sessions(v), ["profile", "application"]))


@query("""
with wanted as (select distinct s_suppkey % 4 as group_id, s_suppkey + 3 as device_id from supplier where s_suppkey % 5 < 3)
select w.group_id, w.device_id, case when d.id is null or m.device_id is not null then 'skipped' else 'added' end as status, case when d.id is null then 'unknown device' when m.device_id is not null then 'already a member' end as reason
from wanted w left join devices d on d.id = w.device_id left join (select distinct group_id, device_id from members) m on m.group_id = w.group_id and m.device_id = w.device_id""")
def membership_report(v: Views):
    wanted = v("supplier").where("s_suppkey % 5 < 3").select((F.col("s_suppkey") % 4).alias("group_id"), (F.col("s_suppkey") + 3).alias("device_id"))
    return pipeline.add_members(v("members"), wanted, v("devices"))


@query("""
with last as (select n_nationkey % 7 as id, max_by(n_name, n_nationkey) as hostname from nation group by 1)
select d.id, coalesce(last.hostname, d.hostname) as hostname, user_id from devices d left join last on last.id = d.id""")
def partial_updates(v: Views):
    changes = v("nation").select((F.col("n_nationkey") % 7).cast("long").alias("id"), F.col("n_name").alias("hostname"), F.lit(None).cast("long").alias("user_id"), F.col("n_nationkey").alias("turn"))
    return pipeline.apply_changes(v("devices").select("id", "hostname", "user_id"), changes, "id", ["hostname", "user_id"], "turn")


@query("""
select id, hostname, is_active and id not in (select s_suppkey from supplier where s_suppkey % 6 = 0) as is_active from devices""")
def soft_deletes(v: Views):
    gone = v("supplier").where("s_suppkey % 6 = 0").select(F.col("s_suppkey").alias("id"))
    return pipeline.soft_delete(v("devices").select("id", "hostname", "is_active"), gone, "id")


@query("""
select ip_address, coalesce(n.organization, e.organization) as organization, coalesce(n.hostname, e.hostname) as hostname from enriched e
full join (select distinct dst_ip as ip, 'New Org' as organization, cast(null as varchar) as hostname from flows where dst_ip like 'dst-1%') n on n.ip = ip_address where ip_address is not null
union all select n.ip, n.organization, n.hostname from (select distinct dst_ip as ip, 'New Org' as organization, cast(null as varchar) as hostname from flows where dst_ip like 'dst-1%') n where n.ip not in (select ip_address from enriched)""")
def enrichment_merge(v: Views):
    new = v("flows").where("dst_ip like 'dst-1%'").select(F.col("dst_ip").alias("ip_address"), F.lit("New Org").alias("organization"), F.lit(None).cast("string").alias("hostname")).distinct()
    return pipeline.merge_enrichment(v("enriched"), new, ["organization", "hostname"])


@query("""
select domain, count(*) as visits, cast(sum(bytes_transferred) as bigint) as bytes, cast(sum(duration) as bigint) as duration, count(distinct device_mac) as devices, (min_by(struct_pack(c := category), struct_pack(t := timestamp, i := id))).c as category
from visits where timestamp >= (select max(timestamp) from visits) - interval '240' hour group by domain""")
def domains_first_category(v: Views):
    """AG21: every domain of the trailing hours; who shows them orders by bytes and domain."""
    return analytics.domain_stats(periods.trailing_hours(v("visits"), "timestamp", 240), last_category=False)


@query("""
with l as (select doc_id, case when contains(lower(text), 'the')::int + contains(lower(text), 'and')::int + contains(lower(text), 'or')::int + contains(lower(text), 'but')::int + contains(lower(text), 'in')::int + contains(lower(text), 'on')::int
  + contains(lower(text), 'at')::int + contains(lower(text), 'to')::int + contains(lower(text), 'for')::int + contains(lower(text), 'of')::int + contains(lower(text), 'with')::int + contains(lower(text), 'by')::int > 3 then 'en' else 'unknown' end as language from documents)
select language, count(*) as pages from l group by language""")
def content_languages(v: Views):
    return analytics.content_languages(v("documents").select(scalars.language(F.col("text")).alias("language")))


@query(r"""
select doc_id, case when length(c) > 200 then concat(substr(c, 1, 200), '...') else c end as summary from (select doc_id, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) as c from documents)""")
def text_summaries(v: Views):
    return v("documents").select("doc_id", scalars.summary(F.col("text")).alias("summary"))


@query("""
with p as (select id, name, row_number() over (order by name) as place from device_groups where is_active) select id, name from p""")
def active_groups(v: Views):
    return pipeline.active_by_name(v("device_groups")).select("id", "name")
