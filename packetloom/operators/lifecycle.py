"""What becomes of sessions, devices, alerts and lookups over time, and entities held against each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.periods import ago, moment, present
from packetloom.operators.analytics import UNKNOWN, bytes_sum, zero
from packetloom.operators.filters import total_bytes
from packetloom.operators.sessions import interval_union

# ---- sessions and devices


def session_states(sessions: DataFrame, as_of=None, gap: str = "5 minutes", kept: str = "24 hours") -> DataFrame:
    """Sessions of a device and application merged over gaps of up to ``gap``, with bytes, whole minutes and state.

    Active: the last packet is at most ``gap`` ago. Completed: it is longer ago than ``kept``, and the session belongs to
    the history. Inactive: between the two.
    """
    now = present(sessions, "start_time", as_of)
    rows = sessions.withColumn("bytes", total_bytes()).select("src_mac", "application", "start_time", "end_time", "bytes")
    merged = interval_union(rows, ["src_mac", "application"], gap=gap, sums=("bytes",))
    state = F.when(F.col("end_time") >= ago(now, gap), "active").when(F.col("end_time") < ago(now, kept), "completed").otherwise("inactive")
    return merged.select("src_mac", "application", "start_time", "end_time", "sessions", zero(F.col("bytes")).alias("bytes"), F.floor(F.col("duration") / 60).cast("long").alias("minutes"), state.alias("state"))


def split_history(states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The live table (at most a day old) and the history."""
    done = F.col("state") == "completed"
    return states.where(~done), states.where(done)


def connection_history(sessions: DataFrame, gap: str = "5 minutes") -> DataFrame:
    """The intervals in which each device was connected, whatever it ran: start, end, sessions and seconds."""
    return interval_union(sessions.select("src_mac", "start_time", "end_time"), ["src_mac"], gap=gap)


def new_devices(sessions: DataFrame, span: str = "24 hours", as_of=None) -> DataFrame:
    """Devices whose first session of all is at most ``span`` ago."""
    now = present(sessions, "start_time", as_of)
    first = sessions.groupBy("src_mac").agg(F.min("start_time").alias("first_seen"), F.count("*").alias("sessions"))
    return first.where(F.col("first_seen") >= ago(now, span))


# ---- alerts

ALERT = ("profile", "title", "description", "time")


def merge_alerts(old: DataFrame, found: DataFrame) -> DataFrame:
    """The alerts of both; one that is there already stays as it is, seen or not, so finding it again changes nothing."""
    rows = old.select(*ALERT, "seen", F.lit(0).alias("turn")).unionByName(found.select(*ALERT, "seen", F.lit(1).alias("turn")))
    return rows.groupBy(*ALERT).agg(F.min_by("seen", "turn").alias("seen"))


def toggle_alerts(alerts: DataFrame, clicks: DataFrame) -> DataFrame:
    """The alerts after ``clicks`` (a row for each click, naming its alert): an odd number turns seen into unseen and back."""
    rows = alerts.select(*ALERT, "seen", F.lit(0).alias("clicks")).unionByName(clicks.select(*ALERT, F.lit(None).cast("boolean").alias("seen"), F.lit(1).alias("clicks")))
    out = rows.groupBy(*ALERT).agg(F.max("seen").alias("seen"), F.sum("clicks").alias("clicks")).where("seen is not null")
    return out.select(*ALERT, F.when(F.col("clicks") % 2 == 1, ~F.col("seen")).otherwise(F.col("seen")).alias("seen"))


def clear_alerts(alerts: DataFrame, clears: DataFrame) -> DataFrame:
    """The alerts that are younger than their profile's last clearing (``profile``, ``cleared_at``), or never were cleared."""
    last = clears.groupBy(F.col("profile").alias("cleared")).agg(F.max("cleared_at").alias("cleared_at"))
    out = alerts.join(last, F.col("profile") == F.col("cleared"), "left")
    return out.where(F.col("cleared_at").isNull() | (F.col("time") > F.col("cleared_at"))).select(*alerts.columns)


def alert_badges(alerts: DataFrame, profiles: DataFrame) -> DataFrame:
    """Unseen alerts of every profile (``profile``), 0 where there is none."""
    unseen = alerts.where(~F.col("seen")).groupBy(F.col("profile").alias("of")).agg(F.count("*").alias("n"))
    return profiles.select("profile").distinct().join(unseen, F.col("profile") == F.col("of"), "left").select("profile", zero(F.col("n")).alias("unseen"))


# ---- lookups

#: Seconds to wait after one, two, and three or more failures in a row.
BACKOFF = (60, 300, 1800)


def lookup_schedule(ips: DataFrame, attempts: DataFrame, as_of, ttl: str = "24 hours", waits: Sequence[int] = BACKOFF) -> DataFrame:
    """When each address is looked up next: ``ip``, failures since the last success, ``next_at`` (null: at once) and ``due``.

    ``attempts``: ip, at, ok. A success holds for ``ttl``; after failures the wait grows to the last of ``waits``.
    Only addresses of ``ips`` other than 127.* are asked for.
    """
    wanted = ips.select("ip").where(F.col("ip").isNotNull() & ~F.col("ip").startswith("127.")).distinct()
    good = attempts.where("ok").groupBy(F.col("ip").alias("good_ip")).agg(F.max("at").alias("good_at"))
    tries = attempts.groupBy(F.col("ip").alias("tried_ip"), "at").agg(F.count_if(~F.col("ok")).alias("failed"))
    after = tries.join(good, F.col("tried_ip") == F.col("good_ip"), "left").where(F.col("good_at").isNull() | (F.col("at") >= F.col("good_at")))
    last = after.groupBy("tried_ip").agg(F.max("good_at").alias("good_at"), F.max("at").alias("last_at"), F.sum(F.when(F.col("good_at").isNull() | (F.col("at") > F.col("good_at")), F.col("failed")).otherwise(0)).alias("failures"))
    out = wanted.join(last, F.col("ip") == F.col("tried_ip"), "left").withColumn("failures", zero(F.col("failures")))
    wait = F.element_at(F.array(*map(F.lit, waits)), F.least(F.col("failures"), F.lit(len(waits))).cast("int"))
    retry = F.col("last_at") + F.make_dt_interval(secs=wait)
    next_at = F.when(F.col("failures") > 0, retry).otherwise(F.col("good_at") + F.expr(f"interval {ttl}"))
    return out.select("ip", "failures", next_at.alias("next_at"), (next_at.isNull() | (next_at <= moment(as_of))).alias("due"))


# ---- comparisons


def macs_of(kind: str, devices: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(entity, mac) of a device, user or group."""
    if kind == "device":
        return devices.select(F.col("id").alias("entity"), F.col("mac_address").alias("mac"))
    if kind == "user":
        return devices.where("user_id is not null").select(F.col("user_id").alias("entity"), F.col("mac_address").alias("mac"))
    if kind == "group" and members is not None:
        return members.select(F.col("group_id").alias("entity"), "device_id").distinct().join(devices.select(F.col("id").alias("device_id"), F.col("mac_address").alias("mac")), "device_id").select("entity", "mac")
    raise ValueError("kind must be device, user or group (with members)")


def compared(kind: str, entities: Sequence, sessions: DataFrame, visits: DataFrame, devices: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Bytes, sessions and visits of each of two or more entities, zeros kept. Facts of other entities are left out first."""
    if len(entities) < 2:
        raise ValueError("name at least two entities")
    spark = sessions.sparkSession
    own = macs_of(kind, devices, members).where(F.col("entity").isin(list(entities)))
    used = sessions.join(own, F.col("src_mac") == F.col("mac")).groupBy("entity").agg(bytes_sum().alias("total_bytes"), F.count("*").alias("total_sessions"))
    web = visits.join(own, F.col("device_mac") == F.col("mac")).groupBy("entity").agg(F.count("*").alias("total_visits"))
    asked = spark.createDataFrame([(e,) for e in dict.fromkeys(entities)], f"entity {own.schema['entity'].dataType.simpleString()}")
    out = asked.join(used, "entity", "left").join(web, "entity", "left")
    return out.select("entity", *(zero(F.col(c)).alias(c) for c in ("total_bytes", "total_sessions", "total_visits")))


def compared_applications(kind: str, entities: Sequence, sessions: DataFrame, devices: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Each application that one of the entities used, with a column of bytes for each entity, 0 where it wasn't used."""
    own = macs_of(kind, devices, members).where(F.col("entity").isin(list(entities)))
    rows = sessions.join(own, F.col("src_mac") == F.col("mac")).withColumn("application", F.coalesce("application", F.lit(UNKNOWN)))
    out = rows.groupBy("application").pivot("entity", list(entities)).agg(bytes_sum()).na.fill(0)
    names: list[Column] = [F.col(f"`{e}`").alias(f"{kind}_{e}") for e in entities]
    return out.select("application", *names)
