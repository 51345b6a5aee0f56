"""Filters and derived columns of sessions, visits, devices and users."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.periods import ago, present


def of_users(fact: DataFrame, mac: str, devices: DataFrame, users: Sequence | None) -> DataFrame:
    """Rows of the devices assigned to the users; none if they have no devices, all rows if ``users`` is None."""
    if users is None:
        return fact
    own = devices.where(F.col("user_id").isin(list(users))).select(F.col("mac_address").alias("own_mac"))
    return fact.join(own, fact[mac] == own["own_mac"], "left_semi")


def of_device(fact: DataFrame, mac: str, devices: DataFrame, device_id) -> DataFrame:
    """Rows of one device; an id that no device has is no filter."""
    own = devices.where(F.col("id") == device_id).select(F.col("mac_address").alias("own_mac"))
    if own.isEmpty():
        return fact
    return fact.join(own, fact[mac] == own["own_mac"], "left_semi")


def either_endpoint(sessions: DataFrame, mac: str) -> DataFrame:
    return sessions.where((F.col("src_mac") == mac) | (F.col("dst_mac") == mac))


def total_bytes() -> Column:
    return F.coalesce(F.col("bytes_sent"), F.lit(0)) + F.coalesce(F.col("bytes_received"), F.lit(0))


def significant(sessions: DataFrame, least: int = 1024) -> DataFrame:
    """More than ``least`` bytes and a known application."""
    return sessions.where((total_bytes() > least) & F.col("application").isNotNull())


def matching(df: DataFrame, **equal) -> DataFrame:
    """Rows equal to every given value; values of None are no condition."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def search(df: DataFrame, text: str, columns: Sequence[str]) -> DataFrame:
    """Rows with the text in one of the columns, A-Z and a-z alike; ``%`` and ``_`` in it are ordinary characters."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    wanted = text.translate(str.maketrans(upper, lower))
    return df.where(reduce(lambda a, b: a | b, (F.translate(F.col(c), upper, lower).contains(wanted) for c in columns)))


def touched_since(sessions: DataFrame, start) -> DataFrame:
    since = F.lit(start).cast("timestamp_ntz") if not isinstance(start, Column) else start
    return sessions.where((F.col("start_time") >= since) | (F.col("end_time") >= since))


def open_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.where(F.col("end_time").isNull())


def live_filter(
    df: DataFrame, window: str | None = None, as_of=None, seconds: tuple | None = None, data: tuple | None = None, status: str | None = None, alerted: DataFrame | None = None, **kinds: Sequence
) -> DataFrame:
    """The live view's filters: any of the values of a kind, all kinds together, within a window of at most 24 hours.

    ``seconds`` and ``data`` are ranges of duration and bytes, both ends counted; ``status`` is open or closed; ``alerted``
    holds the ids (session_id) of sessions with an alert.
    """
    spans = {"15m": "15 minutes", "1h": "1 hour", "2h": "2 hours", "24h": "24 hours"}
    if window == "today":
        until = present(df, "start_time", as_of)
        df = df.where(F.col("start_time") >= F.greatest(F.date_trunc("day", until).cast("timestamp_ntz"), ago(until, "24 hours")))
    elif window is not None:
        df = df.where(F.col("start_time") >= ago(present(df, "start_time", as_of), spans[window]))
    if seconds is not None:
        second = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
        df = df.where(F.coalesce(second("end_time") - second("start_time"), F.lit(0)).between(*seconds))
    if data is not None:
        df = df.where(total_bytes().between(*data))
    if status is not None:
        df = df.where(F.col("end_time").isNull() if status == "open" else F.col("end_time").isNotNull())
    if alerted is not None:
        df = df.join(alerted, df["id"] == alerted["session_id"], "left_semi")
    for name, values in kinds.items():
        if values:
            df = df.where(F.col(name).isin(list(values)))
    return df


def session_columns(sessions: DataFrame, as_of=None, idle: str = "90 seconds") -> DataFrame:
    """Total bytes, last time seen, whole minutes, whether still active within the idle time, and whether encrypted."""
    now = present(sessions, "start_time", as_of)
    last = F.coalesce("end_time", "start_time", now)
    seconds = F.unix_seconds(last.cast("timestamp")) - F.unix_seconds(F.col("start_time").cast("timestamp"))
    return sessions.withColumns({
        "total_bytes": total_bytes(),
        "last_seen": last,
        "duration_minutes": F.floor(seconds / 60),
        "is_active": last >= ago(now, idle),
        "is_encrypted": F.coalesce(F.col("dst_port") == 443, F.lit(False)),
    })


def display_name(*columns: str) -> Column:
    """The first of the columns that is neither null nor empty."""
    return F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in columns))
