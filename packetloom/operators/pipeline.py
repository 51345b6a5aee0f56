"""Enrichment, alerts and the maintenance of dimension tables, as batch operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.periods import ago, moment, present
from packetloom.functions.scalars import is_public, threat_level, without_final_dot
from packetloom.operators.blocks import previous
from packetloom.operators.filters import display_name, session_columns
from packetloom.operators.joins import classify_flows, flow_labels, range_lookup, rule_cascade, vendor_lookup, with_devices, with_enrichment
from packetloom.operators.topk import newest


def enrichment_candidates(packets: DataFrame, known: DataFrame) -> DataFrame:
    """Destinations without a record, with their first domain and application."""
    named = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("ts", "id"))).alias(c)
    found = packets.groupBy(F.col("dst_ip").alias("ip_address")).agg(named("domain"), named("application"))
    return found.join(known, "ip_address", "left_anti")


def merge_enrichment(old: DataFrame, new: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Old and new records by address; only fields that the new one knows overwrite."""
    a, b = old.alias("a"), new.alias("b")
    fields = [F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in fields]
    return a.join(b, F.col("a.ip_address") == F.col("b.ip_address"), "full").select(F.coalesce("a.ip_address", "b.ip_address").alias("ip_address"), *fields)


def enrichment_due(ips: DataFrame, enriched: DataFrame, as_of, ttl: str = "24 hours") -> DataFrame:
    """Addresses other than 127.* with no record or an old one; those unknown, or without host and organization, first (0, else 5)."""
    own = enriched.select(F.col("ip_address").alias("known_ip"), "hostname", "organization", "updated_at")
    seen = ips.select("ip").where(~F.col("ip").startswith("127.")).distinct().join(own, F.col("ip") == F.col("known_ip"), "left")
    due = seen.where(F.col("known_ip").isNull() | (F.col("updated_at") < ago(moment(as_of), ttl)))
    urgent = F.col("known_ip").isNull() | (F.col("hostname").isNull() & F.col("organization").isNull())
    return due.select("ip", F.when(urgent, 0).otherwise(5).alias("priority"))


def fill_networks(enriched: DataFrame, ranges: DataFrame, number: str) -> DataFrame:
    """ASN, country and organization of public addresses from the range table, where missing."""
    found = range_lookup(enriched, number, ranges, "range_start", "range_end")
    public = is_public(F.col("ip_address"))
    fill = lambda mine, theirs: F.coalesce(mine, F.when(public, F.col(theirs))).alias(mine)
    rest = [c for c in enriched.columns if c not in ("asn", "country_code", "organization")]
    return found.select(*rest, fill("asn", "range_asn"), fill("country_code", "range_country"), fill("organization", "range_name"))


def with_threat_level(enriched: DataFrame) -> DataFrame:
    return enriched.withColumn("threat_level", threat_level(F.col("hostname"), F.col("organization")))


def name_bindings(answers: DataFrame) -> DataFrame:
    """(ts, ip, name) of DNS answers: one for each address with three dots, names without their final dot.

    ``answers``: ts, name, addresses array.
    """
    out = answers.select("ts", without_final_dot(F.col("name")).alias("name"), F.explode("addresses").alias("ip"))
    return out.where(F.col("ip").rlike(r"^[^.]+(\.[^.]+){3}$"))


def backfill_vendors(devices: DataFrame, oui: DataFrame) -> DataFrame:
    """Devices whose vendor is missing or a placeholder and for which the prefix table has another one: mac, old, new."""
    old = F.lower(F.trim(F.coalesce("old_vendor", F.lit(""))))
    weak = old.isin("", "unknown", "local device") | old.startswith("device-")
    found = vendor_lookup(devices.withColumnRenamed("vendor", "old_vendor"), "mac_address", oui)
    return found.where(weak & (F.col("vendor") != F.coalesce("old_vendor", F.lit("")))).select("mac_address", "old_vendor", F.col("vendor").alias("new_vendor"))


def live_table(sessions: DataFrame, devices: DataFrame, enriched: DataFrame, rules: DataFrame, as_of=None, limit: int = 200, idle: str = "90 seconds", labels: DataFrame | None = None) -> DataFrame:
    """The live session table: the newest sessions first, then everything else joined to those few rows alone.

    With ``labels`` (see ``flow_labels``) each row has a ``label`` too: the label of its flow, else that of its host,
    port, address or protocol.
    """
    few = newest(session_columns(sessions, as_of, idle), "start_time", limit, ["id"])
    named = with_enrichment(with_devices(few, devices), enriched)
    named = named.withColumn("root_domain", F.lower(F.substring_index("hostname", ".", -2))).withColumn("device", display_name("device_hostname", "src_ip", "src_mac"))
    if labels is not None:
        named = classify_flows(flow_labels(named, labels), "hostname", "dst_port", "dst_ip", "protocol")
        named = named.withColumn("label", F.coalesce("ndpi_app", "found.app"))
    return rule_cascade(named, "hostname", "root_domain", "dst_ip", rules)


#: Policies that may be broadcast, and the shares that a profile's sessions are dealt over where there are more.
POLICIES, SHARES = 100_000, 64


def with_policy(sessions: DataFrame, rule: DataFrame) -> DataFrame:
    """Sessions joined to their profile's rule. Profiles are few and busy, so no profile's sessions meet in one task."""
    if rule.count() <= POLICIES:
        return sessions.join(F.broadcast(rule), "profile")
    dealt = sessions.withColumn("share", F.pmod(F.xxhash64(*sessions.columns), F.lit(SHARES)))
    shares = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long")))
    return dealt.join(rule.withColumn("share", shares), ["profile", "share"]).drop("share")


def alerts(sessions: DataFrame, policies: DataFrame) -> DataFrame:
    """Breaches of each profile's policy: a restricted application, use in restricted hours, or bytes over its threshold.

    ``sessions``: profile, application, start_time, bytes. ``policies``: profile, restricted array, hour_from, hour_to, max_bytes.
    """
    rule = policies.select("profile", "restricted", "hour_from", "hour_to", "max_bytes")
    seen = with_policy(sessions, rule)
    hour = F.hour("start_time")
    inside = F.when(F.col("hour_from") <= F.col("hour_to"), hour.between(F.col("hour_from"), F.col("hour_to"))).otherwise((hour >= F.col("hour_from")) | (hour <= F.col("hour_to")))
    row = lambda title: [F.lit(title).alias("title"), F.col("application").alias("description"), F.col("start_time").alias("time")]
    by_app = seen.where(F.array_contains("restricted", F.col("application"))).select("profile", *row("restricted application"))
    by_hour = seen.where(inside).select("profile", *row("restricted hours"))
    used = seen.groupBy("profile").agg(F.sum("bytes").alias("used"), F.max("max_bytes").alias("most"), F.max("start_time").alias("time"))
    over = used.where("used > most").select("profile", F.lit("threshold exceeded").alias("title"), F.col("used").cast("string").alias("description"), "time")
    return by_app.unionByName(by_hour).unionByName(over).withColumn("seen", F.lit(False))


# ---- dimension maintenance


def apply_changes(table: DataFrame, changes: DataFrame, key: str, fields: Sequence[str], order: str) -> DataFrame:
    """The table after a batch of partial updates: for each field the latest non-null change, else the old value."""
    last = changes.groupBy(F.col(key).alias("changed")).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"new_{c}") for c in fields))
    out = table.join(last, table[key] == last["changed"], "left").drop("changed")
    return out.withColumns({c: F.coalesce(f"new_{c}", c) for c in fields}).drop(*(f"new_{c}" for c in fields))


def soft_delete(table: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    gone = removed.select(F.col(key).alias("gone")).distinct()
    return table.join(gone, table[key] == gone["gone"], "left").withColumn("is_active", F.col("is_active") & F.col("gone").isNull()).drop("gone")


def active_by_name(table: DataFrame, name: str = "name") -> DataFrame:
    return table.where("is_active").orderBy(name)


def cascade_delete(categories: DataFrame, apps: DataFrame, rules: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the removed categories, their apps and those apps' rules."""
    kept = categories.join(removed, categories["id"] == removed["category_id"], "left_anti")
    kept_apps = apps.join(removed, "category_id", "left_anti")
    lost = apps.join(removed, "category_id", "left_semi").select(F.col("id").alias("app_id"))
    return kept, kept_apps, rules.join(lost, "app_id", "left_anti")


def with_defaults(table: DataFrame, defaults: DataFrame, key: str) -> DataFrame:
    """The table and those default rows whose key it lacks."""
    return table.unionByName(defaults.join(table, key, "left_anti").select(*table.columns))


def unassign(devices: DataFrame, removed_users: DataFrame) -> DataFrame:
    gone = removed_users.select(F.col("user_id").alias("gone")).distinct()
    out = devices.join(gone, devices["user_id"] == gone["gone"], "left")
    return out.withColumn("user_id", F.when(F.col("gone").isNull(), F.col("user_id"))).drop("gone")


def duplicates(table: DataFrame, *columns: str) -> DataFrame:
    """Values that stand more than once: column, value, rows."""
    found = table.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")).select("x.*")
    return found.where("value is not null").groupBy("column", "value").agg(F.count("*").alias("rows")).where("rows > 1")


def one_profile(assignments: DataFrame) -> DataFrame:
    """The latest assignment of each device."""
    order = Window.partitionBy("device_id").orderBy(F.desc("added_at"), F.desc("profile_id"))
    return assignments.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def add_members(members: DataFrame, wanted: DataFrame, devices: DataFrame) -> DataFrame:
    """What happens to each wanted (group_id, device_id): added, or skipped with a reason."""
    known = devices.select(F.col("id").alias("known_id"))
    held = members.select(F.col("group_id").alias("held_group"), F.col("device_id").alias("held_device"), F.lit(True).alias("held")).distinct()
    asked = wanted.select("group_id", "device_id").distinct().join(known, F.col("device_id") == F.col("known_id"), "left")
    asked = asked.join(held, (F.col("group_id") == F.col("held_group")) & (F.col("device_id") == F.col("held_device")), "left")
    reason = F.when(F.col("known_id").isNull(), "unknown device").when(F.col("held"), "already a member")
    return asked.select("group_id", "device_id", F.when(reason.isNull(), "added").otherwise("skipped").alias("status"), reason.alias("reason"))


def retained(fact: DataFrame, ts: str, days: int = 90, as_of=None) -> DataFrame:
    return fact.where(F.col(ts) >= ago(present(fact, ts, as_of), f"{int(days)} days"))


def new_connections(snapshots: DataFrame, at: str, keys: Sequence[str]) -> DataFrame:
    """Connections of each snapshot that the one before it lacks; the first snapshot's are all new."""
    mine = snapshots.where(F.col(at).isNotNull()).select(at, *keys).distinct().join(previous(snapshots, at), at)
    past = snapshots.select(F.col(at).alias("past_at"), *(F.col(k).alias(f"past_{k}") for k in keys)).distinct()
    same: Column = F.col("before") == F.col("past_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"past_{k}"))
    return mine.join(past, same, "left_anti").drop("before")
