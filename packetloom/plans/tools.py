"""Queries over readers, fields, rule types, vendors and sinks that take their rows from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.functions import periods, scalars, tables
from packetloom.operators import filters, joins, pipeline, sessions, topk
from packetloom.plans.views import Views, registry
from packetloom.sources import readers

query, QUERIES, ORACLE = registry()

TOTAL = "(coalesce(bytes_sent, 0) + coalesce(bytes_received, 0))"
def part_key():
    return F.col("p_partkey")


def text(column):
    return column.cast("string")


def _values(table: dict, names: str) -> str:
    return f"(values {', '.join(str((k, v)) for k, v in table.items())}) as {names}"


# ---- readers


@query("""
select p_partkey * 256 as range_start, p_partkey * 256 + 255 as range_end, cast(p_partkey % 500 as bigint) as range_asn, case when p_partkey % 2 = 0 then 'US' else 'DE' end as range_country,
  case when p_partkey % 3 = 2 then 'net' || p_partkey else p_brand end as range_name from part where p_partkey % 7 <> 0""")
def asn_lines(v: Views):
    """SRC3: tab, bar and blank separated lines, with comments and short lines between."""
    ends = [text(part_key() * 256), text(part_key() * 256 + 255)]
    country = F.when(part_key() % 2 == 0, "US").otherwise("DE")
    tabs = F.concat_ws("\t", *ends, text(part_key() % 500), country, F.col("p_brand"))
    bars = F.concat_ws("|", *ends, F.concat(F.lit("AS"), text(part_key() % 500)), country, F.col("p_brand"))
    blanks = F.concat_ws("  ", *ends, text(part_key() % 500), country, F.concat(F.lit("net"), text(part_key())))
    line = F.when(part_key() % 7 == 0, F.when(part_key() % 2 == 0, F.concat(F.lit("# "), tabs)).otherwise("short line")).when(part_key() % 3 == 0, tabs).when(part_key() % 3 == 1, bars).otherwise(blanks)
    return readers.ip2asn(v("part").select(line.alias("value")))


@query("""
select src_ip, dst_ip, dst_port, case id % 3 when 0 then upper(protocol) when 1 then upper(protocol) else '' end as protocol, application as app, case id % 2 when 0 then cast(id % 10 / 10.0 as double) else 0.6 end as confidence from packets where id % 5 <> 0""")
def label_lines(v: Views):
    """SRC6: JSON lines in both naming styles; those without addresses are left out."""
    n = F.col("id")
    one = F.to_json(F.struct("src_ip", "dst_ip", "dst_port", F.lower("protocol").alias("proto"), F.col("application").alias("app"), F.when(n % 2 == 0, text(n % 10 / 10)).otherwise("high").alias("confidence")))
    two = F.to_json(F.struct(F.col("src_ip").alias("ip_src"), F.col("dst_ip").alias("ip_dst"), text(F.col("dst_port")).alias("port_dst"), F.when(n % 3 == 1, F.lower("protocol")).alias("ip_proto"), F.col("application").alias("app"), F.when(n % 2 == 0, n % 10 / 10).alias("risk")))
    line = F.when(n % 5 == 0, F.when(n % 2 == 0, '{"src_ip": "a"}').otherwise("no json")).when(n % 3 == 0, one).otherwise(two)
    return readers.ndpi_flows(v("packets").select(line.alias("value"))).select("src_ip", "dst_ip", "dst_port", "protocol", "app", "confidence")


@query("""
select id as snapshot_ts, 'tcp' as protocol, src_ip as local_ip, src_port as local_port, dst_ip as remote_ip, case when id % 4 = 1 then null else dst_port end as remote_port, case when id % 4 = 1 then 'LISTEN' else 'ESTABLISHED' end as state from packets where id % 4 < 2""")
def connection_lines(v: Views):
    """SRC7: lines of two layouts; other states and local peers are left out."""
    n, end = F.col("id"), lambda ip, port: F.concat_ws(":", ip, port)
    here, there = end("src_ip", text(F.col("src_port"))), end("dst_ip", text(F.col("dst_port")))
    line = F.when(n % 4 == 0, F.concat_ws(" ", F.lit("TCP"), here, there, F.lit("ESTABLISHED"))).when(n % 4 == 1, F.concat_ws("  ", F.lit("tcp 0 0"), here, F.concat(F.col("dst_ip"), F.lit(":*")), F.lit("LISTEN")))
    line = line.when(n % 4 == 2, F.concat_ws(" ", F.lit("TCP"), here, F.lit("127.0.0.1:9"), F.lit("ESTABLISHED"))).otherwise(F.concat_ws(" ", F.lit("TCP"), here, there, F.lit("TIME_WAIT")))
    out = readers.connection_snapshots(v("packets").select(n.alias("snapshot_ts"), line.alias("line")))
    return out.select("snapshot_ts", "protocol", "local_ip", "local_port", "remote_ip", "remote_port", "state")


@query("""
select domain, client from (select id, 1000000 - id as timestamp, domain, src_mac as client, id % 9 as status from packets) where timestamp >= 1000000 - 900 and status between 1 and 6 and domain is not null order by timestamp desc, domain, client limit 200""")
def answered_queries(v: Views):
    log = v("packets").select((F.lit(1_000_000) - F.col("id")).alias("timestamp"), "domain", F.col("src_mac").alias("client"), (F.col("id") % 9).alias("status"))
    return readers.dns_queries(log, 1_000_000, 900).select("domain", "client")


@query("""
select id, case id % 4 when 0 then 'TCP' when 1 then 'UDP' when 2 then 'ICMP' else 'IP-' || (id % 200) end as protocol, coalesce(case when id % 4 < 2 then src_port end, 0) as src_port, coalesce(case when id % 4 < 2 then dst_port end, 0) as dst_port from packets where id % 10 <> 9""")
def raw_packets(v: Views):
    n = F.col("id")
    number = F.when(n % 4 == 0, 6).when(n % 4 == 1, 17).when(n % 4 == 2, 1).otherwise(n % 200)
    port = lambda c: F.when(n % 4 < 2, F.col(c)).alias(c)
    raw = v("packets").select("id", F.when(n % 10 != 9, F.col("src_ip")).alias("src_ip"), "dst_ip", number.cast("int").alias("protocol_number"), port("src_port"), port("dst_port"))
    return readers.normalized_packets(raw).select("id", "protocol", "src_port", "dst_port")


@query("select cast(k as bigint) as priority, concat('App', p_partkey) as app, concat('site', p_partkey, case k when 0 then '.com' else '.org' end) as pattern from part, (values (0), (1)) as s(k)")
def application_domains(v: Views):
    """SRC4: one JSON object for each part, so every priority is the pattern's place in its list."""
    site = F.concat(F.lit("Site"), text(part_key()))
    line = F.to_json(F.create_map(F.concat(F.lit("App"), text(part_key())), F.array(F.concat(site, F.lit(".com")), F.concat(site, F.lit(".ORG")))))
    return readers.app_domains(v("part").select(line.alias("value")))


# ---- fields


PORTS = tuple(dict.fromkeys([*tables.PORT_APPLICATION, *tables.PORT_PROTOCOL_LIVE, 9]))
APPS = (*tables.APPLICATION_CATEGORY, "Web")


@query(f"""
with p as (select p_partkey as id, [{', '.join(map(str, PORTS))}][1 + p_partkey % {len(PORTS)}] as port, {list(APPS)}[1 + p_partkey % {len(APPS)}] as application from part)
select id, coalesce(a, 'Unknown') as port_application, coalesce(b, 'TCP') as port_protocol, coalesce(c, 'TCP') as live_protocol, coalesce(k, 'Other') as category from p
left join {_values(tables.PORT_APPLICATION, 'x(pa, a)')} on pa = port left join {_values(tables.PORT_PROTOCOL, 'y(pb, b)')} on pb = port left join {_values(tables.PORT_PROTOCOL_LIVE, 'z(pc, c)')} on pc = port
left join {_values(tables.APPLICATION_CATEGORY, 'w(pk, k)')} on pk = application""")
def port_names(v: Views):
    port = F.element_at(F.array(*map(F.lit, PORTS)), (1 + part_key() % len(PORTS)).cast("int"))
    app = F.element_at(F.array(*map(F.lit, APPS)), (1 + part_key() % len(APPS)).cast("int"))
    return v("part").select(
        part_key().alias("id"), scalars.port_application(port).alias("port_application"), scalars.port_protocol(port).alias("port_protocol"),
        scalars.port_protocol(port, True).alias("live_protocol"), scalars.application_category(app).alias("category"),
    )


@query(r"""
with t as (select p_partkey as n, concat(case p_partkey % 3 when 0 then 'AS' when 1 then 'asn ' else '' end, case when p_partkey % 5 = 0 then 'none' else cast(p_partkey as varchar) end, ' net') as asn, concat(p_partkey % 90, '.5,', case when p_partkey % 4 = 0 then '' else cast(-(p_partkey % 180) as varchar) end) as place,
  concat('www.site', p_partkey, '.org', repeat('.', p_partkey % 3)) as name, concat('https://me@host', p_partkey, ':80', case p_partkey % 3 when 0 then '/x' when 1 then '?q' else '' end) as url from part)
select n as id, nullif(regexp_replace(asn, '\D', '', 'g'), '') as asn_digits, nullif(regexp_extract(asn, '^AS(\d+)', 1), '') as asn_prefix, cast(split_part(place, ',', 1) as double) as latitude, cast(nullif(split_part(place, ',', 2), '') as double) as longitude,
  regexp_replace(name, '\.+$', '') as name, concat('me@host', n, ':80') as authority, case n % 3 when 0 then '' else concat('a', n) end as json_items, case n % 3 when 0 then '' else concat('k=v', n) end as json_pairs, n % 4 < 3 as private_prefix from t""")
def text_fields(v: Views):
    t = v("part").select(
        part_key().alias("n"), F.concat(F.when(part_key() % 3 == 0, "AS").when(part_key() % 3 == 1, "asn ").otherwise(""), F.when(part_key() % 5 == 0, "none").otherwise(text(part_key())), F.lit(" net")).alias("asn"),
        F.concat(text(part_key() % 90), F.lit(".5,"), F.when(part_key() % 4 == 0, "").otherwise(text(-(part_key() % 180)))).alias("place"), F.concat(F.lit("www.site"), text(part_key()), F.lit(".org"), F.repeat(F.lit("."), (part_key() % 3).cast("int"))).alias("name"),
        F.concat(F.lit("https://me@host"), text(part_key()), F.lit(":80"), F.when(part_key() % 3 == 0, "/x").when(part_key() % 3 == 1, "?q").otherwise("")).alias("url"),
        F.when(part_key() % 3 == 0, "broken").when(part_key() % 3 == 1, F.concat(F.lit('["a'), text(part_key()), F.lit('"]'))).otherwise(F.concat(F.lit('["a'), text(part_key()), F.lit('"]'))).alias("items"),
        F.when(part_key() % 3 == 0, None).otherwise(F.concat(F.lit('{"k": "v'), text(part_key()), F.lit('"}'))).alias("pairs"), F.concat(F.when(part_key() % 4 == 0, "10.").when(part_key() % 4 == 1, "192.168.").when(part_key() % 4 == 2, "172.").otherwise("11."), F.lit("1.1")).alias("ip"),
    )
    latitude, longitude = scalars.split_location(F.col("place"))
    pairs = F.array_join(F.transform(F.map_entries(scalars.json_map(F.col("pairs"))), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return t.select(
        F.col("n").alias("id"), scalars.asn_digits(F.col("asn")).alias("asn_digits"), scalars.asn_prefix(F.col("asn")).alias("asn_prefix"), latitude.alias("latitude"), longitude.alias("longitude"),
        scalars.without_final_dot(F.col("name")).alias("name"), scalars.url_authority(F.col("url")).alias("authority"), F.array_join(scalars.json_list(F.col("items")), ",").alias("json_items"), pairs.alias("json_pairs"),
        scalars.has_private_prefix(F.col("ip")).alias("private_prefix"),
    )


AGENTS = (
    ("Mozilla (Windows NT 10)", "laptop", "Windows"), ("Mozilla (Macintosh; Mac OS X)", "laptop", "macOS"), ("X11; Linux x86", "laptop", "Linux"), ("Linux; Android 14; Mobile", "phone", "Linux"),
    ("Android app", "phone", "Android"), ("iPhone", "phone", "iOS"), ("iPad; like Mac OS X", "tablet", "macOS"), ("iPad", "tablet", "iOS"), ("curl", "unknown", "unknown"),
)


@query(f"""
with a(k, kind, os) as (values {', '.join(f"({k}, '{kind}', '{os}')" for k, (_, kind, os) in enumerate(AGENTS))})
select p_partkey as id, coalesce(kind, 'unknown') as device_type, coalesce(os, 'unknown') as operating_system, case when p_partkey % 2 = 0 then 'Own' when p_partkey % 3 = 0 then null else 'Other' end as app, case when p_partkey % 3 = 0 then null else 'high' end as confidence
from part left join a on k = p_partkey % 10""")
def agents_and_labels(v: Views):
    """SC11 and SC9: device and system of user agents; labels of two sources merged field by field."""
    agent = F.element_at(F.array(*(F.lit(a) for a, _, _ in AGENTS), F.lit(None).cast("string")), (1 + part_key() % 10).cast("int"))
    kind, system = scalars.device_of_agent(agent)
    label = lambda app, sure: F.struct(app.alias("app"), F.lit(None).cast("string").alias("category"), sure.alias("confidence"))
    none = F.lit(None).cast("string")
    first = label(F.when(part_key() % 2 == 0, "Own"), none)
    second = label(F.when(part_key() % 3 != 0, "Other"), F.when(part_key() % 3 != 0, "high"))
    merged = scalars.merge_labels(first, second)
    return v("part").select(part_key().alias("id"), kind.alias("device_type"), system.alias("operating_system"), merged["app"].alias("app"), merged["confidence"].alias("confidence"))


# ---- rules, networks and vendors


@query("""
with h as (select distinct domain as host from visits)
select host, case when host = 'example.org' or host like '%.example.org' then 'Org' when host like 'www.%' and host like '%.net' then null end as app from h""")
def anchored_rules(v: Views):
    hosts = v("visits").select(F.col("domain").alias("host")).distinct()
    rules = v.spark.createDataFrame([(2, "xample.org", "Wrong"), (3, "example.org", "Org"), (4, "org", "Later")], "priority int, pattern string, app string").where("pattern <> 'org'")
    return joins.ordered_rules(hosts, "host", rules, anchored=True)


TYPED = (
    (1, "sni", "site1.example.com", "Work", "One"), (2, "regex", r"^site[2-4]\.", "Play", "Pattern"), (3, "regex", r"site4", "Later", "Late"), (4, "cidr", "203.0.113.0/30", "Net", "Narrow"),
    (5, "cidr", "203.0.0.0/16", "Net", "Wide"), (6, "ip", "203.0.113.6", "Net", "Exact"), (7, "cidr", "bad", "Net", "Bad"),
)


@query("""
select id, case when lower(domain) = 'site1.example.com' then 'One' when dst_ip = '203.0.113.6' then 'Exact' when regexp_matches(lower(domain), '^site[2-4]\\.') then 'Pattern'
  when dst_ip in ('203.0.113.0', '203.0.113.1', '203.0.113.2', '203.0.113.3') then 'Narrow' else 'Wide' end as app from packets""")
def typed_rules(v: Views):
    """PL15: rule types sni, regex and cidr beside exact hosts and addresses."""
    rules = v.spark.createDataFrame([(*r, 0.7) for r in TYPED], "id long, type string, value string, category string, app string, confidence double")
    rows = v("packets").withColumn("root", scalars.naive_root_domain(F.lower("domain")))
    return joins.typed_rules(rows, "domain", "root", "dst_ip", rules).select("id", "app")


@query("""
select concat('8.', p_partkey % 250, '.', p_partkey // 250 % 250, '.', p_partkey % 7) as ip_address, case when p_partkey % 3 = 0 then 7 else cast(p_partkey % 5 + 1 as bigint) end as asn, case when p_partkey % 4 = 0 then 'FR' else 'US' end as country_code, case p_partkey % 6 when 0 then 'Own' else concat('Net', p_partkey % 5) end as organization
from part where p_partkey % 2 = 0""")
def fill_networks(v: Views):
    """PL8: what enriched public addresses lack comes from the range table."""
    part = v("part").where("p_partkey % 2 = 0")
    ip = F.concat_ws(".", F.lit("8"), text(part_key() % 250), text(F.floor(part_key() / 250) % 250), text(part_key() % 7))
    rows = part.select(ip.alias("ip_address"), F.when(part_key() % 3 == 0, 7).cast("long").alias("asn"), F.when(part_key() % 4 == 0, "FR").alias("country_code"), F.when(part_key() % 6 == 0, "Own").alias("organization"), part_key().alias("key"))
    low = scalars.ipv4_number(F.col("ip_address"))
    ranges = rows.select(low.alias("range_start"), low.alias("range_end"), (F.col("key") % 5 + 1).alias("range_asn"), F.lit("US").alias("range_country"), F.concat(F.lit("Net"), text(F.col("key") % 5)).alias("range_name"))
    return pipeline.fill_networks(rows.drop("key").withColumn("number", low), ranges, "number").drop("number")


@query("""
select ts, concat('host', id % 50, '.example.org') as name, ip from (select *, unnest([dst_ip, 'fe80::1', src_ip]) as ip from packets where domain is not null) where ip not like '%:%'""")
def name_bindings(v: Views):
    answers = v("packets").where("domain is not null").select("ts", F.concat(F.lit("host"), text(F.col("id") % 50), F.lit(".example.org."), F.when(F.col("id") % 2 == 0, ".").otherwise("")).alias("name"), F.array("dst_ip", F.lit("fe80::1"), F.col("src_ip")).alias("addresses"))
    return pipeline.name_bindings(answers)


@query("""
with d as (select s_suppkey as id, md5(s_name) as h, case s_suppkey % 5 when 0 then null when 1 then 'Unknown' when 2 then ' local device ' when 3 then 'device-7' else 'Real' end as vendor from supplier)
select id, vendor as old_vendor, concat('six ', id) as new_vendor from d where id % 2 = 0 and id % 5 <> 4
union all select id, vendor, 'Unknown' from d where id % 2 = 1 and id % 5 in (0, 2, 3)""")
def backfill_vendors(v: Views):
    """PL10; a prefix is the whole first half of the address, so it is one device's own."""
    key = F.col("s_suppkey")
    rows = v("supplier").select(key.alias("id"), F.lpad(F.hex(key), 6, "0").alias("head"), F.when(key % 5 == 1, "Unknown").when(key % 5 == 2, " local device ").when(key % 5 == 3, "device-7").when(key % 5 == 4, "Real").alias("vendor"))
    oui = rows.where("id % 2 = 0").select(F.col("head").alias("prefix"), F.concat(F.lit("six "), text(F.col("id"))).alias("vendor_short"), F.lit(None).cast("string").alias("vendor_long"))
    devices = rows.select("id", F.concat("head", F.lit("000000")).alias("mac_address"), "vendor")
    found = pipeline.backfill_vendors(devices, oui)
    return found.join(devices.select("id", "mac_address"), "mac_address").select("id", "old_vendor", "new_vendor")


# ---- filters and dimension upkeep


@query("select id, start_time from flows where start_time between timestamp '1995-03-01 00:00:00' and timestamp '1996-02-01 12:00:00'")
def period_to_end(v: Views):
    """FLT3: an ISO start with an end."""
    return periods.since(v("flows"), "start_time", "1995-03-01T00:00:00Z", end="1996-02-01T12:00:00Z").select("id", "start_time")


@query("select id, src_mac from flows")
def sessions_of_no_device(v: Views):
    """FLT6: an id that no device has is no filter."""
    return filters.of_device(v("flows"), "src_mac", v("devices"), -7).select("id", "src_mac")


@query("select id, start_time, end_time from flows where start_time >= (select max(start_time) from flows) - interval '200' day or end_time >= (select max(start_time) from flows) - interval '200' day order by start_time desc, id desc limit 50")
def newest_touched(v: Views):
    """FLT13."""
    return topk.newest(filters.touched_since(v("flows"), v("flows").select((F.max("start_time") - F.expr("INTERVAL 200 days")).alias("x")).scalar()), "start_time", 50, ["id"]).select("id", "start_time", "end_time")


@query(f"""
select id from flows where application in ('Brand#11', 'Brand#12', 'Brand#23', 'Brand#31') and src_mac in (select mac_address from devices where user_id in (1, 2, 3, 4, 5, 6, 7, 8)) and {TOTAL} between 100000 and 9000000
  and coalesce(epoch(end_time - start_time), 0) between 60 and 2400 and end_time is not null""")
def live_ranges(v: Views):
    """FLT15: ranges of duration and data, status and owners beside lists of values."""
    own = filters.of_users(v("flows"), "src_mac", v("devices"), list(range(1, 9)))
    return filters.live_filter(own, application=["Brand#11", "Brand#12", "Brand#23", "Brand#31"], seconds=(60, 2400), data=(100_000, 9_000_000), status="closed").select("id")


@query("""
with gone as (select p_partkey as id from part where p_partkey % 5 = 0), apps as (select s_suppkey as id, s_suppkey % 20 as category_id from supplier)
select 'category' as kind, p_partkey as id from part where p_partkey % 5 <> 0 union all select 'app', id from apps where category_id not in (select id from gone)
union all select 'rule', l.id from (select o_orderkey as id, o_custkey % 10 as app_id from orders) l where l.app_id not in (select id from apps where category_id in (select id from gone))""")
def cascade_deletes(v: Views):
    key = F.col("s_suppkey")
    categories, apps = v("part").select(part_key().alias("id")), v("supplier").select(key.alias("id"), (key % 20).alias("category_id"))
    rules = v("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 10).alias("app_id"))
    left = pipeline.cascade_delete(categories, apps, rules, v("part").where(part_key() % 5 == 0).select(part_key().alias("category_id")))
    kinds = [df.select(F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id")) for kind, df in zip(("category", "app", "rule"), left, strict=True)]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


@query("select s_suppkey as id, s_name as name from supplier where s_suppkey % 3 = 0 union all select s_suppkey, 'default' from supplier where s_suppkey % 3 <> 0")
def table_with_defaults(v: Views):
    own = v("supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return pipeline.with_defaults(own, v("supplier").select(F.col("s_suppkey").alias("id"), F.lit("default").alias("name")), "id")


@query("with x as (select mac_address, max(ts) as last_seen, min(ts) as first_seen, max_by(src_ip, struct_pack(t := ts, i := id)) as ip_address from (select *, src_mac as mac_address from packets) group by mac_address) select * from x")
def merged_devices(v: Views):
    """PL4: the device table of an early half merged with the sightings of the rest."""
    half = v("packets").select(F.expr("percentile_disc(0.5) within group (order by id)").alias("x")).scalar()
    old, new = (sessions.discover_devices(v("packets").where(c)) for c in (F.col("id") <= half, F.col("id") > half))
    return sessions.merge_devices(old, new).select("mac_address", "first_seen", "last_seen", "ip_address")
