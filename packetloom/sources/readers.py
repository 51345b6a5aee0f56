"""Readers: schema-checked tables and the text layouts of network tools, parsed with Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions.scalars import asn_digits, ipv4_number

SCHEMAS = {
    "users": "id long, username string, email string, full_name string, role string, is_active boolean, time_zone string, department string, notification_preferences map<string,string>",
    "devices": "id long, mac_address string, ip_address string, hostname string, vendor string, device_type string, operating_system string, device_name string, first_seen timestamp_ntz, last_seen timestamp_ntz, is_active boolean, user_id long, manufacturer string, model string, serial_number string",
    "traffic_sessions": "id long, src_mac string, dst_mac string, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, start_time timestamp_ntz, end_time timestamp_ntz, bytes_sent long, bytes_received long, packet_count int, application string, application_category string, classification_confidence double, is_encrypted boolean, flow_duration int",
    "website_visits": "id long, device_mac string, domain string, url string, title string, timestamp timestamp_ntz, bytes_transferred long, response_code int, method string, duration int, category string, subcategory string, content_type string, user_agent string, referrer string",
    "content_analysis": "website_visit_id long, content_summary string, keywords array<string>, meta_description string, images_count int, links_count int, forms_count int, scripts_count int, language string, sentiment_score double",
    "user_sessions": "id long, user_id long, device_mac string, start_time timestamp_ntz, end_time timestamp_ntz, total_bytes long, websites_visited int, applications_used array<string>, session_duration int",
    "enriched_data": "ip_address string, hostname string, country string, country_code string, city string, region string, latitude double, longitude double, isp string, organization string, asn long, is_vpn boolean, is_proxy boolean, is_tor boolean, threat_level string, updated_at timestamp_ntz",
    "packets": "id long, ts timestamp, src_ip string, dst_ip string, src_mac string, dst_mac string, src_port int, dst_port int, protocol string, size long, domain string, application string, payload string",
}


def table(spark: SparkSession, path: str, name: str, stream: bool = False) -> DataFrame:
    """A table by its fixed schema, as a batch or as a stream of files."""
    return (spark.readStream if stream else spark.read).schema(SCHEMAS[name]).parquet(path)


def normalized_packets(raw: DataFrame) -> DataFrame:
    """Packet rows of any IP protocol number: TCP, UDP, ICMP or ``IP-<n>``; ports are 0 where there are none; others are skipped."""
    n = F.col("protocol_number")
    name = F.when(n == 6, "TCP").when(n == 17, "UDP").when(n == 1, "ICMP").otherwise(F.concat(F.lit("IP-"), n.cast("string")))
    ports = {p: F.coalesce(p, F.lit(0)) for p in ("src_port", "dst_port")}
    return raw.where("src_ip is not null and dst_ip is not null and protocol_number is not null").withColumns({"protocol": name, **ports})


def address_bound(token: Column) -> Column:
    return F.coalesce(token.try_cast("long"), ipv4_number(token))


def ip2asn(lines: DataFrame, column: str = "value") -> DataFrame:
    """Ranges of a text table: tab, else ``|``, else blanks between fields; start and end as numbers or dotted addresses.

    The ASN is the first of fields 3 to 7 with digits, the country the first two- or three-letter word among them, the
    name the last field of five or more. Comments, short lines and lines without an ASN are left out.
    """
    text = F.trim(column)
    parts = F.when(text.contains("\t"), F.split(text, "\t")).when(text.contains("|"), F.split(text, r"\|")).otherwise(F.split(text, r"\s+"))
    rows = lines.where((text != "") & ~text.startswith("#")).withColumn("f", F.transform(parts, lambda x: F.trim(x))).where(F.size("f") >= 4)
    some = F.slice("f", 3, 5)
    number = F.try_element_at(F.filter(some, lambda x: x.rlike(r"\d")), F.lit(1))
    country = F.try_element_at(F.filter(some, lambda x: x.rlike("^[A-Za-z]{2,3}$")), F.lit(1))
    out = rows.select(
        address_bound(F.try_element_at("f", F.lit(1))).alias("range_start"), address_bound(F.try_element_at("f", F.lit(2))).alias("range_end"), asn_digits(number).cast("long").alias("range_asn"),
        country.alias("range_country"), F.when(F.size("f") >= 5, F.try_element_at("f", F.lit(-1))).alias("range_name"),
    )
    return out.where("range_start is not null and range_end is not null and range_asn is not null")


def dns_queries(log: DataFrame, as_of_epoch: int, seconds: int, limit: int = 200) -> DataFrame:
    """The newest answered queries (status 1 to 6) with a domain and a client of the last ``seconds``."""
    recent = log.where((F.col("timestamp") >= as_of_epoch - seconds) & F.col("status").between(1, 6) & F.col("domain").isNotNull() & F.col("client").isNotNull())
    return recent.orderBy(F.desc("timestamp"), "domain", "client").limit(limit).withColumn("ts", F.timestamp_seconds("timestamp"))


def ndpi_flows(lines: DataFrame, column: str = "value") -> DataFrame:
    """Flow labels from JSON lines in either naming style; rows without addresses, port or application are left out."""
    names = ("src_ip", "ip_src", "dst_ip", "ip_dst", "dst_port", "port_dst", "l4_proto", "proto", "ip_proto", "app", "category", "confidence", "risk", "ts")
    row = F.from_json(column, ", ".join(f"{n} string" for n in names))
    pick = lambda *keys: F.coalesce(*(row[k] for k in keys))
    out = lines.select(
        pick("src_ip", "ip_src").alias("src_ip"), pick("dst_ip", "ip_dst").alias("dst_ip"), pick("dst_port", "port_dst").try_cast("int").alias("dst_port"),
        F.upper(F.coalesce(pick("l4_proto", "proto", "ip_proto"), F.lit(""))).alias("protocol"), row["app"].alias("app"), row["category"].alias("category"),
        F.coalesce(pick("confidence", "risk").try_cast("double"), F.lit(0.6)).alias("confidence"), row["ts"].try_cast("timestamp").alias("ts"),
    )
    return out.where("src_ip is not null and dst_ip is not null and dst_port is not null and app is not null")


def connection_snapshots(lines: DataFrame, at: str = "snapshot_ts", column: str = "line", states=("ESTABLISHED", "LISTEN")) -> DataFrame:
    """Connections of netstat lines in the given states: local and remote address and port, split at the last colon."""
    parts = F.split(F.trim(column), r"\s+")
    ends = F.filter(parts, lambda x: x.rlike(r":(\d+|\*)$"))
    state = F.try_element_at(F.filter(parts, lambda x: x.isin(*states)), F.lit(1))
    host = lambda x: F.regexp_replace(x, r":[^:]*$", "")
    port = lambda x: F.substring_index(x, ":", -1).try_cast("int")
    local, remote = F.try_element_at(ends, F.lit(1)), F.try_element_at(ends, F.lit(2))
    out = lines.select(at, F.lower(F.try_element_at(parts, F.lit(1))).alias("protocol"), host(local).alias("local_ip"), port(local).alias("local_port"), host(remote).alias("remote_ip"), port(remote).alias("remote_port"), state.alias("state"))
    return out.where(F.col("state").isNotNull() & F.col("local_ip").isNotNull() & ~F.coalesce(F.col("remote_ip"), F.lit("")).startswith("127."))


def app_domains(text: DataFrame, column: str = "value") -> DataFrame:
    """(priority, app, pattern) of a JSON object of arrays, in the order of the file."""
    pairs = F.map_entries(F.from_json(column, "map<string,array<string>>"))
    apps = text.select(F.posexplode(pairs).alias("n", "entry"))
    out = apps.select("n", F.col("entry.key").alias("app"), F.posexplode("entry.value").alias("k", "pattern"))
    return out.select((F.col("n") * 100_000 + F.col("k")).alias("priority"), "app", F.lower("pattern").alias("pattern"))
