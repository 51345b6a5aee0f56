"""Queries of the life of sessions, devices, alerts and lookups, and of comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.functions import scalars, tables
from packetloom.operators import lifecycle, pipeline
from packetloom.plans.entities import _case
from packetloom.plans.streams import shared
from packetloom.plans.upkeep import profile_sessions
from packetloom.plans.views import Views, registry

query, QUERIES, ORACLE = registry()

BYTES = "coalesce(bytes_sent, 0) + coalesce(bytes_received, 0)"


def merged_sql(keys: str) -> str:
    """Common table expressions that end in ``merged``: the intervals of the keys, over gaps of five minutes."""
    return f"""closed as (select {keys}, start_time, coalesce(end_time, start_time) as end_time, {BYTES} as bytes from flows),
reach as (select *, max(end_time) over (partition by {keys} order by start_time, end_time rows between unbounded preceding and 1 preceding) as reach from closed),
marked as (select *, sum(case when start_time <= reach + interval '5' minute then 0 else 1 end) over (partition by {keys} order by start_time, end_time rows unbounded preceding) as island from reach),
merged as (select {keys}, min(start_time) as start_time, max(end_time) as end_time, count(*) as sessions, cast(sum(bytes) as bigint) as bytes from marked group by {keys}, island)"""


STATES = f"""{merged_sql("src_mac, application")},
states as (select *, cast(floor(epoch(end_time - start_time) / 60) as bigint) as minutes, case when end_time >= t - interval '5' minute then 'active' when end_time < t - interval '24' hour then 'completed' else 'inactive' end as state
  from merged, (select max(start_time) - interval '200' day as t from flows))"""


def states(v: Views) -> DataFrame:
    at = v("flows").agg((F.max("start_time") - F.expr("interval '200' day")).alias("t")).first()[0]
    return lifecycle.session_states(v("flows"), at)


@query(f"with {STATES} select src_mac, application, start_time, end_time, sessions, bytes, minutes, state from states")
def session_states(v: Views):
    """Functionality 7.4: merged sessions, active, inactive or completed."""
    return states(v)


@query(f"with {STATES} select state = 'completed' as history, count(*) as sessions, cast(sum(bytes) as bigint) as bytes, min(start_time) as first_start, max(end_time) as last_end from states group by all")
def session_history(v: Views):
    """The live table and the history apart."""
    sums = [F.count("*").alias("sessions"), F.sum("bytes").alias("bytes"), F.min("start_time").alias("first_start"), F.max("end_time").alias("last_end")]
    live, history = lifecycle.split_history(states(v))
    return live.groupBy(F.lit(False).alias("history")).agg(*sums).unionByName(history.groupBy(F.lit(True).alias("history")).agg(*sums))


@query(f"with {merged_sql('src_mac')} select src_mac, start_time, end_time, sessions, cast(epoch(end_time - start_time) as bigint) as duration from merged")
def connection_history(v: Views):
    return lifecycle.connection_history(v("flows"))


@query("""
with f as (select src_mac, min(start_time) as first_seen, count(*) as sessions from flows group by src_mac)
select * from f where first_seen >= (select max(start_time) from flows) - interval '2495' day""")
def new_devices(v: Views):
    return lifecycle.new_devices(v("flows"), "2495 days")


# ---- alerts


POLICY = "profile long, restricted array<string>, hour_from int, hour_to int, max_bytes long"
PROFILES = "select device_id, max_by(profile_id, struct_pack(a := added_at, p := profile_id)) as profile from members group by device_id"
FOUND = f"""p as ({PROFILES}),
s as (select profile, application, start_time as time from flows join devices d on d.mac_address = src_mac join p on p.device_id = d.id),
found as (select distinct profile, 'restricted application' as title, application as description, time from s where application in ('Brand#11', 'Brand#21', 'Brand#31') and profile in (0, 1))"""
TURNS = "old as (select *, day(time) % 2 = 0 as seen from found where day(time) % 3 = 0), ledger as (select f.*, coalesce(o.seen, false) as seen from found f left join old o using (profile, title, description, time))"
LATER = f"""{TURNS}, clicked as (select profile, title, description, time, seen <> (day(time) % 5 in (1, 2) and day(time) % 7 <> 0) as seen from ledger),
kept as (select * from clicked where profile <> 1 or time > (select max(time) - interval '900' day from ledger where profile = 1))"""


def stored(v: Views, name: str, rows: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read back, so that what reads them several times doesn't derive them again."""
    path = shared(v, name)
    rows.write.parquet(path)
    return v.spark.read.schema(rows.schema).parquet(path)


def ledger(v: Views) -> DataFrame:
    """The alerts found now and those kept from before, some of them seen."""
    policies = v.spark.createDataFrame([(k, ["Brand#11", "Brand#21", "Brand#31"], None, None, None) for k in (0, 1)], POLICY)
    found = stored(v, "alerts-found", pipeline.alerts(profile_sessions(v), policies).where("title = 'restricted application'"))
    old = found.where(F.dayofmonth("time") % 3 == 0).withColumn("seen", F.dayofmonth("time") % 2 == 0)
    return lifecycle.merge_alerts(old, found)


def after_clicks(v: Views) -> DataFrame:
    """The ledger after clicks (one, or two where the day is a multiple of 7) and profile 1's clearing of what was old."""
    alerts = stored(v, "alert-ledger", ledger(v))
    once = alerts.where(F.dayofmonth("time") % 5 == 1).select(*lifecycle.ALERT)
    more = alerts.where(F.dayofmonth("time") % 5 == 2).select(*lifecycle.ALERT)
    twice = once.unionByName(more).where(F.dayofmonth("time") % 7 == 0)
    clears = alerts.where("profile = 1").groupBy("profile").agg((F.max("time") - F.expr("interval '900' day")).alias("cleared_at"))
    return lifecycle.clear_alerts(lifecycle.toggle_alerts(alerts, once.unionByName(more).unionByName(twice)), clears)


@query(f"with {FOUND}, {TURNS} select profile, title, description, time, seen from ledger")
def alert_ledger(v: Views):
    """Alerts found again keep their seen flag."""
    return ledger(v)


@query(f"with {FOUND}, {LATER} select * from kept")
def alerts_after_clicks(v: Views):
    return after_clicks(v)


@query(f"with {FOUND}, {LATER}, every as (select distinct profile from p) select e.profile, count(k.profile) as unseen from every e left join kept k on k.profile = e.profile and not k.seen group by e.profile")
def alert_badges(v: Views):
    return lifecycle.alert_badges(after_clicks(v), pipeline.one_profile(v("members")).select(F.col("profile_id").alias("profile")))


# ---- lookups


ATTEMPTS = """tries as (select concat('dst-', cast(l_partkey as varchar)) as ip, l_shipdate as tried, l_linenumber % 3 = 1 as ok from lineitem where l_partkey % 4 <> 0 and l_shipdate <= timestamp '1997-06-01 00:00:00'),
good as (select ip, max(tried) as good_at from tries where ok group by ip), wanted as (select distinct concat('dst-', cast(l_partkey as varchar)) as ip from lineitem),
last as (select t.ip, max(good_at) as good_at, max(tried) as last_at, count(*) filter (not ok and (good_at is null or tried > good_at)) as failures from tries t left join good using (ip) where good_at is null or tried >= good_at group by t.ip),
timed as (select w.ip, coalesce(failures, 0) as failures, case when failures > 0 then last_at + to_seconds(case failures when 1 then 60 when 2 then 300 else 1800 end) else good_at + interval '24' hour end as next_at from wanted w left join last using (ip))"""


@query(f"with {ATTEMPTS} select ip, failures, next_at, next_at is null or next_at <= timestamp '1997-06-01 00:04:00' as due from timed")
def lookup_schedule(v: Views):
    """Functionality 9.1.1: retries after 60 s, 5 min and 30 min; successes hold a day."""
    at = F.concat(F.lit("dst-"), F.col("l_partkey").cast("string"))
    items = v("lineitem").select(at.alias("ip"), F.col("l_shipdate").alias("at"), (F.col("l_linenumber") % 3 == 1).alias("ok"), "l_partkey")
    tries = items.where("l_partkey % 4 <> 0 and at <= timestamp_ntz '1997-06-01 00:00:00'")
    return lifecycle.lookup_schedule(items, tries.select("ip", "at", "ok"), "1997-06-01 00:04:00")


# ---- comparisons


def compared_sql(own: str, ids: tuple) -> str:
    return f"""with own as ({own}), e(entity) as (values {', '.join(f'({k}::bigint)' for k in ids)}),
s as (select entity, sum({BYTES}) as b, count(*) as n from flows join own on mac = src_mac group by entity), w as (select entity, count(*) as n from visits join own on mac = device_mac group by entity)
select entity, coalesce(cast(b as bigint), 0) as total_bytes, coalesce(s.n, 0) as total_sessions, coalesce(w.n, 0) as total_visits from e left join s using (entity) left join w using (entity)"""


def matrix_sql(own: str, kind: str, ids: tuple) -> str:
    columns = ", ".join(f"cast(coalesce(sum({BYTES}) filter (entity = {k}), 0) as bigint) as {kind}_{k}" for k in ids)
    return f"with own as ({own}) select coalesce(application, 'Unknown') as application, {columns} from flows join own on mac = src_mac where entity in {ids} group by all"


USER = "select user_id as entity, mac_address as mac from devices where user_id is not null"
GROUP = "select distinct group_id as entity, mac_address as mac from members join devices on id = device_id"
DEVICE = "select cast(id as bigint) as entity, mac_address as mac from devices"
USERS, GROUPS, DEVICES = (1, 3, 9, 99), (0, 2, 3), (1, 2, 7, 10**9)


@query(compared_sql(USER, USERS))
def compare_users(v: Views):
    """AG24: two or more users side by side; one of them has no devices."""
    return lifecycle.compared("user", USERS, v("flows"), v("visits"), v("devices"))


@query(compared_sql(GROUP, GROUPS))
def compare_groups(v: Views):
    return lifecycle.compared("group", GROUPS, v("flows"), v("visits"), v("devices"), v("members"))


@query(compared_sql(DEVICE, DEVICES))
def compare_devices(v: Views):
    return lifecycle.compared("device", DEVICES, v("flows"), v("visits"), v("devices"))


@query(matrix_sql(USER, "user", USERS))
def compare_users_applications(v: Views):
    return lifecycle.compared_applications("user", USERS, v("flows"), v("devices"))


@query(matrix_sql(GROUP, "group", GROUPS))
def compare_groups_applications(v: Views):
    return lifecycle.compared_applications("group", GROUPS, v("flows"), v("devices"), v("members"))


# ---- options of the classifiers


@query("with a as (select p_partkey as id, concat(cast(p_partkey % 256 as varchar), '.', cast(p_partkey * 7 % 130 as varchar), '.0.', cast(p_size as varchar)) as ip from part) select id, ip, " + _case((f"starts_with(ip, '{p}')", f"'{a}'") for p, a, _ in sorted(tables.ADDRESS_PREFIXES, key=lambda r: -len(r[0]))) + " as app from a")
def address_labels_longest(v: Views):
    """SC8 with the longest prefix: no entry is hidden by a shorter one before it."""
    ip = F.concat_ws(".", (F.col("p_partkey") % 256).cast("string"), (F.col("p_partkey") * 7 % 130).cast("string"), F.lit("0"), F.col("p_size").cast("string"))
    return v("part").select(F.col("p_partkey").alias("id"), ip.alias("ip")).withColumn("app", scalars.address_label(F.col("ip"), longest=True)["app"])
