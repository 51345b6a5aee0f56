"""The driver's tables as the engine's facts and dimensions, in SQL that Spark and the oracle both run."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")

VIEWS = {
    "packets": """
select event_id as id, ts, user_id, concat('dev-', cast(user_id % 20 as varchar(9))) as src_mac, concat('192.168.0.', cast(user_id % 20 as varchar(9))) as src_ip,
  concat('203.0.113.', cast(event_id % 7 as varchar(9))) as dst_ip, cast(1024 + event_id % 3 as int) as src_port, concat('gw-', cast(event_id % 2 as varchar(9))) as dst_mac,
  case event_type when 'click' then 443 when 'view' then 80 when 'purchase' then 8443 when 'signup' then 53 else 22 end as dst_port,
  case event_type when 'signup' then 'UDP' else 'TCP' end as protocol, cast(round(value * 10) as bigint) + 40 as size,
  case when event_type in ('click', 'view') then concat('Site', cast(event_id % 13 as varchar(9)), '.example.com') end as domain,
  case event_type when 'click' then 'Web' when 'view' then 'Web' when 'purchase' then 'Web' when 'signup' then 'DNS' else 'SSH' end as application
from {events}""",
    "visits": """
select e.event_id as id, concat('dev-', cast(e.user_id % 20 as varchar(9))) as device_mac, e.ts as timestamp, cast(round(e.value * 100) as bigint) as bytes_transferred, p.page_id, p.url,
  regexp_extract(p.url, '^https?://([^/:?#]+)', 1) as domain, cast(e.event_id % 97 as bigint) as duration,
  case e.event_id % 4 when 1 then 'News' when 2 then 'Shop' when 3 then 'Work' end as category
from (select *, event_id % (select count(*) from {pages}) as page_key from {events}) e join {pages} p on p.page_id = e.page_key where e.event_type in ('view', 'click')""",
    "flows": """
select (l_orderkey * 10 + l_linenumber) * 1000000000 + l_suppkey * 100000 + l_partkey as id, concat('dev-', cast(l_suppkey as varchar(12))) as src_mac,
  concat('dev-', cast((l_suppkey * 7) % 50 as varchar(12))) as dst_mac, concat('10.1.', cast(l_suppkey % 9 as varchar(12)), '.', cast(l_partkey % 250 as varchar(12))) as src_ip,
  concat('dst-', cast(l_partkey as varchar(12))) as dst_ip, case l_linenumber % 4 when 0 then 443 when 1 then 80 when 2 then 22 else 5432 end as dst_port, l_shipdate as start_time,
  case when l_linenumber % 3 = 0 then null else l_shipdate + interval '1' minute * cast(l_quantity as int) end as end_time,
  cast(round(l_extendedprice * 100) as bigint) as bytes_sent, cast(round(l_quantity * 100) as bigint) as bytes_received,
  case when l_orderkey % 11 = 0 then null else p_brand end as application, l_returnflag as protocol
from {lineitem} join {part} on p_partkey = l_partkey""",
    "devices": """
select s_suppkey as id, concat('dev-', cast(s_suppkey as varchar(12))) as mac_address, s_name as hostname, case s_suppkey % 4 when 0 then 'Unknown' else concat('Vendor', cast(s_suppkey % 4 as varchar(9))) end as vendor,
  case s_suppkey % 3 when 1 then 'laptop' when 2 then 'phone' end as device_type, concat('10.0.', cast(s_suppkey % 5 as varchar(9)), '.', cast(s_suppkey % 250 as varchar(9))) as ip_address,
  s_acctbal > 0 as is_active, case when s_suppkey % 7 = 0 then null else cast(s_nationkey as bigint) end as user_id
from {supplier}""",
    "users": """
select cast(n_nationkey as bigint) as id, n_name as username, concat(lower(n_name), '@example.com') as email, case when n_nationkey % 6 = 0 then null else r_name end as department, n_nationkey % 5 <> 0 as is_active
from {nation} join {region} on n_regionkey = r_regionkey""",
    "user_sessions": "select o_orderkey as id, o_custkey % 25 as user_id, o_orderdate as start_time, cast(round(o_totalprice * 100) as bigint) as total_bytes from {orders}",
    "device_groups": "select cast(r_regionkey as bigint) as id, r_name as name, r_regionkey <> 4 as is_active from {region}",
    "members": "select cast(s_suppkey % 4 as bigint) as group_id, s_suppkey as device_id, s_suppkey % 3 as profile_id, s_acctbal as added_at from {supplier} where s_suppkey % 9 <> 0",
    "enriched": """
select concat('dst-', cast(p_partkey as varchar(12))) as ip_address, concat('Host', cast(p_partkey as varchar(12)), case p_partkey % 3 when 0 then '.botnet' else '.shop' end, '.example.org') as hostname,
  case p_partkey % 5 when 0 then 'Fast VPN Ltd' when 1 then null else 'Carrier' end as organization
from {part} where p_partkey % 2 = 0""",
    "networks": "select p_partkey * 1000 as range_start, p_partkey * 1000 + 699 as range_end, cast(64500 + p_partkey % 100 as bigint) as range_asn, p_brand as range_name from {part}",
}


def names_in(sql: str, known) -> list[str]:
    return [n for n in known if re.search(rf"\b{n}\b", sql)]


def oracle(sql: str) -> str:
    """The SQL with the views that it names in front."""
    used = [f"{n} as ({VIEWS[n].replace('{', '').replace('}', '')})" for n in names_in(sql, VIEWS)]
    sql = sql.strip()
    if not used:
        return sql
    if sql[:5].lower() == "with ":
        return "with " + ",\n".join(used) + ",\n" + sql[5:]
    return "with " + ",\n".join(used) + "\n" + sql


class Views:
    """Calling it with a view's or a table's name gives the DataFrame."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.view = cache(self._view)

    def __call__(self, name: str) -> DataFrame:
        return self.view(name)

    def _view(self, name: str) -> DataFrame:
        if name not in VIEWS:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self.spark.sql(VIEWS[name], **{n: self(n) for n in RAW if f"{{{n}}}" in VIEWS[name]})


def registry() -> tuple[Callable, dict, dict]:
    """A decorator that registers a function of ``Views`` with its oracle SQL, and what it fills."""
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None = None):
        def add(function):
            queries[function.__name__] = lambda spark, folder: function(Views(spark, folder))
            if sql is not None:
                oracles[function.__name__] = oracle(sql)
            return function

        return add

    return query, queries, oracles


def rounded(expression: str) -> str:
    """Two places, half up, as Spark rounds a double."""
    return f"cast(round(cast({expression} as decimal(38, 12)), 2) as double)"
