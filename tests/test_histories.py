"""Rollup tables, session states, alerts, lookups and comparisons on small awkward rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from packetloom.functions import scalars
from packetloom.operators import analytics, lifecycle, pipeline, rollups
from packetloom.plans import histories
from packetloom.plans.views import Views
from packetloom.sources import sinks
from packetloom.streaming import streams

T0 = datetime(2024, 1, 1)
PACKET = "id long, ts timestamp_ntz, src_mac string, application string, size long, user_id long"


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def packets(spark, rows):
    return spark.createDataFrame([(k, None if s is None else at(s), mac, app, size, k % 4) for k, (s, mac, app, size) in enumerate(rows)], PACKET)


def rows(df, *order):
    return sorted(map(str, (tuple(r) for r in df.select(*order).collect())))


ROWS = [(0, "a", "x", 5), (299, "a", "x", 7), (300, "a", "x", 1), (301, "a", None, 2), (302, "a", None, None), (86_400 * 3 + 1, "b", "y", 4), (None, "a", "x", 100), (300, None, "x", 3)]


def by_hand(given, width=300):
    out = {}
    for s, mac, app, size in given:
        if s is not None:
            b = out.setdefault((at(s - s % width), mac, app), [0, 0, None, None])
            b[0] += size or 0
            b[1] += 1
            b[2], b[3] = min(b[2] or at(s), at(s)), max(b[3] or at(s), at(s))
    return sorted(str((*k, *v)) for k, v in out.items())


ALL = ("bucket", "src_mac", "application", "bytes", "packets", "first_ts", "last_ts")


def test_rollup(spark):
    assert rows(rollups.rollup(packets(spark, ROWS)), *ALL) == by_hand(ROWS)
    assert rollups.rollup(packets(spark, [])).collect() == []
    hours = rollups.coarser(rollups.rollup(packets(spark, ROWS)), "hour")
    assert rows(hours, *ALL) == by_hand(ROWS, 3600)


def test_table_survives_reruns_late_rows_and_compactions(spark, tmp_path):
    path = str(tmp_path / "rollup")
    with pytest.raises(ValueError):
        rollups.read_rollup(spark, path)
    first, late = packets(spark, ROWS[4:]), packets(spark, ROWS[:4])
    rollups.write_delta(packets(spark, ROWS), path, 0)  # fails after writing: the batch runs again with what it should be
    rollups.write_delta(first, path, 0)
    rollups.write_delta(late, path, 1)
    assert rows(rollups.read_rollup(spark, path), *ALL) == by_hand(ROWS)
    assert rollups.compact(spark, path) == 1
    assert rows(rollups.read_rollup(spark, path), *ALL) == by_hand(ROWS)
    assert rollups.compact(spark, path) == 1
    rollups.write_delta(late, path, 2)
    assert rows(rollups.read_rollup(spark, path), *ALL) == by_hand(ROWS + ROWS[:4])
    assert rollups.compact(spark, path) == 2
    assert rows(rollups.read_rollup(spark, path), *ALL) == by_hand(ROWS + ROWS[:4])
    assert rows(rollups.read_rollup(spark, path, first_day="2024-01-02", last_day="2024-01-04"), *ALL) == by_hand(ROWS[5:6])


def test_unfinished_parts_are_not_read(spark, tmp_path):
    path = str(tmp_path / "rollup")
    rollups.write_delta(packets(spark, ROWS), path, 0)
    rollups.compact(spark, path)
    for part in ("base/version=7", "delta/batch=8"):
        packets(spark, ROWS).write.parquet(f"{path}/{part}")
        (tmp_path / "rollup" / part / "_SUCCESS").unlink()
    assert rows(rollups.read_rollup(spark, path), *ALL) == by_hand(ROWS)


def test_old_days_of_a_rollup_are_dropped(spark, tmp_path):
    path = str(tmp_path / "rollup")
    rollups.write_delta(packets(spark, ROWS), path, 0)
    rollups.compact(spark, path)
    rollups.write_delta(packets(spark, ROWS[5:6]), path, 1)
    gone = sinks.drop_expired(spark, path, 1, (T0 + timedelta(days=4)).date())
    assert sorted(x.rpartition("/rollup/")[2] for x in gone) == ["base/version=0/date=2024-01-01", "delta/batch=0/date=2024-01-01"]
    assert rows(rollups.read_rollup(spark, path), *ALL) == by_hand([ROWS[5], ROWS[5]])


@pytest.mark.parametrize("span", [(0, 600), (1, 2), (0, 299), (0, 300), (10, 899), (299, 300), (-50, 10_000), (600, 600), (301, 302), (100, 86_400 * 9)])
def test_range_totals(spark, span):
    given = [(s, "ab"[s % 2], "x" if s % 3 else None, s) for s in range(0, 1000, 7)] + [(span[0], "e", "x", 1), (span[1], "e", "x", 2)]
    start, end = map(at, span)
    found = rollups.range_totals(packets(spark, given), rollups.rollup(packets(spark, given)), start, end)
    want = {}
    for s, mac, app, size in given:
        if span[0] <= s <= span[1]:
            w = want.setdefault((mac, app), [0, 0])
            w[0] += size
            w[1] += 1
    assert rows(found, "src_mac", "application", "bytes", "packets") == sorted(str((*k, *v)) for k, v in want.items())


def test_range_reads_few_packets(spark, tmp_path):
    """The packets' filter is of the two edges alone and reaches the scan."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    packets(spark, ROWS).write.parquet(str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    plan = rollups.range_totals(stored, rollups.rollup(packets(spark, ROWS)), at(10), at(86_400))._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts,2024-01-01T00:00:10), LessThanOrEqual(ts,2024-01-02T00:00), Or(LessThan(ts" in plan


def test_sketches_merge(spark):
    many = spark.range(30_000).select(F.col("id"), F.lit(T0).cast("timestamp_ntz").alias("ts"), F.lit("a").alias("src_mac"), F.lit("x").alias("application"), F.lit(1).alias("size"), (F.col("id") % 9000).alias("user_id"))
    halves = [rollups.rollup(many.where(f"id % 2 = {k}"), distinct=("user_id",)) for k in (0, 1)]
    one = rollups.estimates(rollups.merged(halves[0].unionByName(halves[1]))).first()
    assert one.packets == 30_000 and abs(one.user_id - 9000) < 450


def test_stream_keeps_the_table(spark, tmp_path):
    path = str(tmp_path / "rollup")
    for k in range(3):
        packets(spark, ROWS[k::3]).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(PACKET).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    streams.each_batch(stream, streams.rollup_upkeep(path), str(tmp_path / "checkpoint"), None).awaitTermination()
    assert rows(rollups.read_rollup(spark, path), *ALL) == by_hand(ROWS)


SESSION = "id long, src_mac string, application string, start_time timestamp_ntz, end_time timestamp_ntz, bytes_sent long, bytes_received long"


def test_session_states(spark):
    day = 86_400
    given = [
        (1, "a", "x", at(0), at(60), 5, 1), (2, "a", "x", at(360), at(400), 2, None), (3, "a", "x", at(701), None, 4, 4),  # gaps of 300 and 301 s
        (4, "a", "y", at(2 * day), at(2 * day + 90), None, None), (5, "b", None, at(2 * day - 200), at(2 * day - 200), 1, 1), (6, "b", None, at(day), at(day + 20), 7, 0),
    ]
    found = lifecycle.session_states(spark.createDataFrame(given, SESSION), at(2 * day + 100))
    assert rows(found, "src_mac", "application", "sessions", "bytes", "minutes", "state") == sorted(map(str, [
        ("a", "x", 2, 8, 6, "completed"), ("a", "x", 1, 8, 0, "completed"), ("a", "y", 1, 0, 1, "active"), ("b", None, 1, 2, 0, "active"), ("b", None, 1, 7, 0, "completed"),
    ]))
    later = lifecycle.session_states(spark.createDataFrame(given, SESSION), at(2 * day + 500))
    live, history = lifecycle.split_history(later)
    assert {r.state for r in live.collect()} == {"inactive"} and history.count() == 3
    assert lifecycle.session_states(spark.createDataFrame([], SESSION)).collect() == []
    new = lifecycle.new_devices(spark.createDataFrame(given, SESSION), "25 hours")
    assert rows(new, "src_mac", "sessions") == ["('b', 2)"]


ALERTS = "profile long, title string, description string, time timestamp_ntz, seen boolean"


def test_alerts(spark):
    table = lambda found: spark.createDataFrame(found, ALERTS)
    a, b, c, d = ((p, t, x, at(s)) for p, t, x, s in [(1, "t", "app", 0), (1, "t", None, 5), (2, "u", "app", 9), (3, "t", "app", 0)])
    kept = lifecycle.merge_alerts(table([(*a, True), (*d, False)]), table([(*a, False), (*b, False), (*b, False), (*c, False)]))
    assert rows(kept, *lifecycle.ALERT, "seen") == sorted(map(str, [(*a, True), (*b, False), (*c, False), (*d, False)]))
    clicks = spark.createDataFrame([a, b, b, c, c, c, (9, "t", "app", at(1))], ALERTS.replace(", seen boolean", ""))
    turned = lifecycle.toggle_alerts(kept, clicks)
    assert rows(turned, *lifecycle.ALERT, "seen") == sorted(map(str, [(*a, False), (*b, False), (*c, True), (*d, False)]))
    clears = spark.createDataFrame([(1, at(0)), (1, at(-9)), (3, None), (2, at(8))], "profile long, cleared_at timestamp_ntz")
    left = lifecycle.clear_alerts(turned, clears)
    assert rows(left, "profile", "time") == sorted(map(str, [(1, at(5)), (2, at(9)), (3, at(0))]))
    badges = lifecycle.alert_badges(left, spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 4)], "profile long"))
    assert rows(badges, "profile", "unseen") == ["(1, 1)", "(2, 0)", "(3, 1)", "(4, 0)"]


def test_a_busy_profile_is_no_single_task(spark, monkeypatch):
    """Few policies are broadcast; many meet shares of a profile's sessions. Both give the same alerts."""
    use = spark.range(0, 600, numPartitions=3).select((F.col("id") % 2).alias("profile"), F.when(F.col("id") % 3 == 0, "Game").otherwise("Web").alias("application"), F.lit(T0).cast("timestamp_ntz").alias("start_time"), F.col("id").alias("bytes"))
    policies = spark.createDataFrame([(0, ["Game"], 0, 1, 10)], "profile long, restricted array<string>, hour_from int, hour_to int, max_bytes long")
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables
    found = pipeline.alerts(use, policies)
    plan = found._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert "SortMergeJoin" not in plan
    want = rows(found, "title", "description", "time")
    assert len(want) == 100 + 300 + 1
    monkeypatch.setattr(pipeline, "POLICIES", 0)
    dealt = pipeline.alerts(use, policies)
    assert "share" in dealt._jdf.queryExecution().executedPlan().toString() and rows(dealt, "title", "description", "time") == want


def test_alerts_are_found_once(spark, sf_dir):
    """Alerts of now and of before come from one pass over the sessions."""
    found = histories.alert_ledger(Views(spark, sf_dir)).inputFiles()
    assert found and all("/alerts-found-" in f for f in found)


def test_clicks_and_clears_read_the_ledger(spark, sf_dir):
    """The sessions are joined for the ledger alone, not again for each kind of click, and no task holds all of these joins."""
    left = histories.after_clicks(Views(spark, sf_dir))
    assert left.inputFiles() and all("/alert-ledger-" in f for f in left.inputFiles())


def test_badges_read_the_ledger(spark, sf_dir):
    """Badges need the profiles and the ledger, no sessions."""
    read = histories.alert_badges(Views(spark, sf_dir)).inputFiles()
    assert any("/supplier" in f for f in read) and not any("/lineitem" in f or "/part.parquet" in f for f in read)


def test_lookup_schedule(spark):
    tries = [
        ("new failure", 0, False), ("two", 0, False), ("two", 60, False), ("many", 0, False), ("many", 1, False), ("many", 2, False), ("many", 3, False),
        ("fresh", 0, True), ("fresh", -9, False), ("mended", 0, False), ("mended", 7, True), ("broken", 0, True), ("broken", 7, False), ("same time", 5, True), ("same time", 5, False), ("other", 0, False),
    ]
    ips = [(x,) for x, _, _ in tries if x != "other"] + [("unseen",), ("127.0.0.9",), (None,)]
    schedule = lifecycle.lookup_schedule(spark.createDataFrame(ips, "ip string"), spark.createDataFrame([(x, at(s), ok) for x, s, ok in tries], "ip string, at timestamp_ntz, ok boolean"), at(361))
    assert rows(schedule, "ip", "failures", "next_at", "due") == sorted(map(str, [
        ("new failure", 1, at(60), True), ("two", 2, at(360), True), ("many", 4, at(1803), False), ("fresh", 0, at(86_400), False), ("mended", 0, at(86_407), False),
        ("broken", 1, at(67), True), ("same time", 0, at(86_405), False), ("unseen", 0, None, True),
    ]))


def test_comparisons(spark):
    sessions = spark.createDataFrame([(1, "m1", "x", at(0), None, 5, 1), (2, "m2", None, at(0), None, 2, None), (3, "m3", "x", at(0), None, 9, 9)], SESSION)
    visits = spark.createDataFrame([("m1",), ("m1",), ("m9",)], "device_mac string")
    devices = spark.createDataFrame([(1, "m1", 7), (2, "m2", 7), (3, "m3", None)], "id long, mac_address string, user_id long")
    members = spark.createDataFrame([(5, 1), (5, 1), (5, 3), (6, 2)], "group_id long, device_id long")
    assert rows(lifecycle.compared("user", [7, 8], sessions, visits, devices), "entity", "total_bytes", "total_sessions", "total_visits") == ["(7, 8, 2, 2)", "(8, 0, 0, 0)"]
    assert rows(lifecycle.compared("group", [5, 6, 6], sessions, visits, devices, members), "entity", "total_bytes", "total_sessions", "total_visits") == ["(5, 24, 2, 2)", "(6, 2, 1, 0)"]
    assert rows(lifecycle.compared_applications("device", [1, 2], sessions, devices), "application", "device_1", "device_2") == ["('Unknown', 0, 2)", "('x', 6, 0)"]
    for kind, ids in (("user", [7]), ("group", [5, 6]), ("site", [1, 2])):
        with pytest.raises(ValueError):
            lifecycle.compared(kind, ids, sessions, visits, devices)


def test_classifier_options(spark):
    agents = spark.createDataFrame([("Linux; Android 14; Mobile",), ("iPhone; like Mac OS X",), ("Windows NT",), (None,)], "agent string")
    kind, system = scalars.device_of_agent(F.col("agent"), strict=True)
    assert [r[0] for r in agents.select(system).collect()] == ["Android", "iOS", "Windows", "unknown"]
    ips = spark.createDataFrame([("13.64.0.1",), ("13.1.0.1",), ("9.9.9.9",), (None,)], "ip string")
    first, longest = (ips.select(scalars.address_label(F.col("ip"), x)["app"]).collect() for x in (False, True))
    assert first[0] == first[1] and longest[0] != longest[1] and longest[1] == first[1] and first[3][0] is None
