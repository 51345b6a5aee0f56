"""Operators on hand-written rows: boundaries, ties, nulls and empty tables."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from packetloom.functions import periods, scalars
from packetloom.operators import filters, joins, pipeline, sessions
from packetloom.sources import readers, sinks
from packetloom.streaming import streams

T0 = datetime(2024, 1, 1)
PACKET = "id long, ts timestamp_ntz, src_mac string, dst_ip string, dst_port int, protocol string, size long, src_ip string, src_port int, dst_mac string, application string, domain string, user_id long"


def packet(id_, at, **values):
    row = {"src_mac": "m", "dst_ip": "9.9.9.9", "dst_port": 443, "protocol": "TCP", "size": 10, "src_ip": "10.0.0.2", "src_port": 1, "dst_mac": "g", "application": None, "domain": None, "user_id": 1} | values
    return (id_, T0 + timedelta(seconds=at), *(row[k] for k in ("src_mac", "dst_ip", "dst_port", "protocol", "size", "src_ip", "src_port", "dst_mac", "application", "domain", "user_id")))


def test_sessionizer_gaps(spark):
    rows = [packet(1, 0, src_port=7), packet(2, 90, src_port=8, application="Web"), packet(3, 181), packet(4, 0, dst_port=80, size=5), packet(5, 400, application="")]
    packets = spark.createDataFrame(rows, PACKET)
    got = sorted((r.dst_port, r.start_time, r.packet_count, r.bytes_sent, r.src_port, r.application, r.is_encrypted) for r in sessions.sessionize(packets).collect())
    at = lambda s: T0 + timedelta(seconds=s)
    assert got == [(80, at(0), 1, 5, 1, None, False), (443, at(0), 2, 20, 7, "Web", True), (443, at(181), 1, 10, 1, None, True), (443, at(400), 1, 10, 1, None, True)]
    assert sessions.sessionize_by_gaps(packets).groupBy("dst_port").agg(F.max("session")).count() == 2
    assert sessions.sessionize(packets.limit(0)).count() == 0


def test_sessionizers_agree_on_random_packets(spark):
    rng = random.Random(1)
    packets = spark.createDataFrame([packet(k, rng.randrange(20_000), dst_port=rng.choice([80, 443]), size=k) for k in range(500)], PACKET)
    one = sessions.sessionize(packets).agg(F.count("*"), F.sum("bytes_sent"), F.sum("packet_count")).first()
    marked = sessions.sessionize_by_gaps(packets)
    two = marked.select("dst_port", "session").distinct().count()
    assert one[0] == two and one[1] == sum(range(500)) and one[2] == 500


def test_interval_union(spark):
    at = lambda m: T0 + timedelta(minutes=m)
    rows = [("a", at(0), at(10)), ("a", at(15), at(16)), ("a", at(21), None), ("a", at(2), at(3)), ("a", at(27), at(28)), ("b", at(0), at(1))]
    got = sorted((r.k, r.start_time, r.end_time, r.sessions, r.duration) for r in sessions.interval_union(spark.createDataFrame(rows, "k string, start_time timestamp_ntz, end_time timestamp_ntz"), ["k"]).collect())
    assert got == [("a", at(0), at(21), 4, 1260), ("a", at(27), at(28), 1, 60), ("b", at(0), at(1), 1, 60)]


def test_range_lookup_equals_between(spark):
    rng = random.Random(2)
    ranges = [(s, s + rng.choice([0, 5, 900, 70_000, 40_000_000, 3_000_000_000]), k) for k, s in enumerate(rng.sample(range(4_000_000_000), 150))]
    points = [(rng.choice([r[0], r[1], r[0] - 1, rng.randrange(4_294_967_296)]),) for r in ranges for _ in range(4)] + [(None,), (5,), (5,)]
    got = joins.range_lookup(spark.createDataFrame(points, "p long"), "p", spark.createDataFrame(ranges, "lo long, hi long, k int"), "lo", "hi").collect()
    want = []
    for (p,) in points:
        hit = max(((lo, -hi, k) for lo, hi, k in ranges if p is not None and lo <= p <= hi), default=None)
        want.append((p, hit and hit[2]))
    assert sorted(((r.p, r.k) for r in got), key=str) == sorted(want, key=str)


def most_rows(plan):
    """The most rows that an operator of a finished query gave."""
    kind = plan.nodeName()
    below = [plan.executedPlan()] if kind == "AdaptiveSparkPlan" else [plan.plan()] if "QueryStage" in kind else [plan.children().apply(k) for k in range(plan.children().size())]
    own = plan.metrics().get("numOutputRows")
    return max([own.get().value() if own.isDefined() else 0, *map(most_rows, below)])


def test_range_lookup_of_ranges_that_overlap_or_repeat(spark):
    """A point meets one range for each size of block, not every range that holds it."""
    points = [(50_000 + 3 * k,) for k in range(400)] + [(-7,), (-40,)]
    ranges = [(k, 200_000 - k, k) for k in range(300)] + [(7, 190_000, 7)] * 200 + [(-20, -5, -1), (-20, -5, -1), (9, 8, -2)]
    found = joins.range_lookup(spark.createDataFrame(points, "p long"), "p", spark.createDataFrame(ranges, "lo long, hi long, k int"), "lo", "hi")
    assert {r.p: r.k for r in found.collect()} == {p: 299 if p > 0 else -1 if p == -7 else None for (p,) in points}
    assert most_rows(found._jdf.queryExecution().executedPlan()) < 20_000


def test_as_of_and_trailing(spark):
    facts = spark.createDataFrame([(1, "a", T0), (2, "a", T0 + timedelta(seconds=181)), (3, "b", T0)], "id long, ip string, ts timestamp_ntz")
    bound = spark.createDataFrame([("a", T0, "x"), ("a", T0 + timedelta(seconds=1), "y"), ("b", T0 + timedelta(seconds=1), "z")], "ip string, ts timestamp_ntz, name string")
    assert {r.id: r.name for r in joins.as_of_join(facts, "ip", "ts", bound, "name").collect()} == {1: "x", 2: "y", 3: None}
    got = joins.trailing_join(facts, "ip", "ts", bound.withColumnRenamed("ts", "at"), "at", "name", 180)
    assert {r.id: r.name for r in got.collect()} == {1: "x", 2: "y", 3: None}


def test_rules_and_prefixes(spark):
    hosts = spark.createDataFrame([("www.reddit.com",), ("x.COM",), (None,), ("none.org",)], "host string")
    rules = spark.createDataFrame([(1, "t.co", "Twitter"), (2, "reddit.com", "Reddit"), (3, "x.com", "X")], "priority int, pattern string, app string")
    assert {r.host: r.app for r in joins.ordered_rules(hosts, "host", rules).collect()} == {"www.reddit.com": "Twitter", "x.COM": "X", None: None, "none.org": None}
    assert {r.host: r.app for r in joins.ordered_rules(hosts, "host", rules, anchored=True).collect()}["www.reddit.com"] == "Reddit"
    suffixes = spark.createDataFrame([("com",), ("co.uk",), ("uk",), ("github.io",)], "suffix string")
    names = ["a.b.Example.co.uk", "github.io", "me.github.io", "10.1.2.3", "local", None, "co.uk"]
    got = {r.host: r.root_domain for r in joins.registered_domain(spark.createDataFrame([(n,) for n in names], "host string"), "host", suffixes).collect()}
    assert got == {"a.b.Example.co.uk": "example.co.uk", "github.io": "github.io", "me.github.io": "me.github.io", "10.1.2.3": "10.1.2.3", "local": "local", None: "", "co.uk": "co.uk"}
    macs = spark.createDataFrame([("AA:BB:CC:DD:EE:FF",), ("aa-bb-cc-00-00-00",), ("11:22:33:44:55:66",)], "mac string")
    oui = spark.createDataFrame([("AABBCC", "Six", None), ("aabbccd", "Seven", "Seven Long"), ("aabbccdde", "Nine", None)], "prefix string, vendor_short string, vendor_long string")
    assert [r.vendor for r in joins.vendor_lookup(macs, "mac", oui).orderBy("mac").collect()] == ["Unknown", "Nine", "Six"]


def test_scalars(spark):
    c = F.col("x")
    one = lambda value, expr: spark.createDataFrame([(value,)], "x string").select(expr.alias("y")).first().y
    assert one("8.8.8.8", scalars.ipv4_number(c)) == 134744072 and one("1.2.3", scalars.ipv4_number(c)) is None
    assert one("::1", scalars.ipv6_key(c)) == "0" * 31 + "1" and one("2001:db8::a:1", scalars.ipv6_key(c)) == "20010db8000000000000000000" + "0a0001".rjust(6, "0")
    assert one("1:2", scalars.ipv6_key(c)) is None
    assert [one(ip, scalars.is_public(c)) for ip in ("8.8.8.8", "172.20.1.1", "fe80::1", "2600::1", "junk", None)] == [True, False, False, True, False, False]
    assert one("AS123 Net", scalars.asn_prefix(c)) == "123" and one("none", scalars.asn_digits(c)) is None
    assert one("www.example.com", scalars.fallback_app_name(c)) == "Example" and one("host", scalars.fallback_app_name(c)) == "Unknown"
    assert one("Mozilla (Linux; Android 14) Mobile", scalars.device_of_agent(c)[1]) == "Linux" and one("iPad", scalars.device_of_agent(c)[0]) == "tablet"
    lab = lambda text, proto="TCP", port=443: one(text, scalars.payload_label(c, F.lit(proto), F.lit(port)))
    assert tuple(lab("220 hello")) == ("SMTP", 0.9, False) and tuple(lab("\x16\x03\x01")) == ("HTTPS", 0.95, True)
    assert tuple(lab("GET / HTTP/1.1\r\nHost: a.b\r\n")) == ("HTTP", 0.95, False) and tuple(lab(None, "UDP", 53)) == ("DNS", 0.8, False)
    fields = scalars.http_fields(c)
    assert one("GET /x HTTP/1.1\r\nHost: a.b \r\nUser-Agent: me\r\n", fields["host"]) == "a.b" and one("GET /x HTTP/1.1", fields["url"]) == "/x"
    assert one("a" * 201, F.length(scalars.summary(c))) == 203 and one(" a  b ", scalars.summary(c)) == "a b"
    assert one("10.5,", scalars.split_location(c)[0]) == 10.5 and one("10.5,", scalars.split_location(c)[1]) is None
    label = lambda h, p, i, pr: tuple(one("", scalars.classify_flow(F.lit(h), F.lit(p).cast("int"), F.lit(i), F.lit(pr))))
    assert label("cdn.reddit.com", 443, None, None) == ("Twitter" if "t.co" in "cdn.reddit.com" else "Reddit", "SocialMedia", "high")
    assert label("unlisted", 22, None, None) == ("SSH", "RemoteAccess", "high") and label(None, 22, None, None)[2] == "medium"
    assert label(None, 9, "13.64.1.1", None) == ("AWS", "CloudServices", "low") and label(None, 9, None, "UDP") == ("UDP", "Network", "low")
    assert label(None, None, None, None) == ("Unknown", "Uncategorized", "low")


@pytest.mark.parametrize("day", ["2024-01-01", "2024-01-07", "2023-01-01", "2024-12-31"])
def test_week_key(spark, day):
    got = spark.sql(f"select date'{day}' as d").select(periods.bucket(F.col("d"), "week").alias("w")).first().w
    assert got == datetime.fromisoformat(day).strftime("%Y-W%U")


def test_sources(spark):
    text = lambda lines: spark.createDataFrame([(x,) for x in lines], "value string")
    got = readers.ip2asn(text(["# c", "1.0.0.0\t1.0.0.255\t13335\tUS\tCLOUD NET", "16777472|16777727|AS4134|CN|CHINA", "1 2 - x", "5 9 AS7 DE Some", "short"])).collect()
    assert [(r.range_start, r.range_end, r.range_asn, r.range_country, r.range_name) for r in got] == [(16777216, 16777471, 13335, "US", "CLOUD NET"), (16777472, 16777727, 4134, "CN", "CHINA"), (5, 9, 7, "DE", "Some")]
    flows = readers.ndpi_flows(text(['{"src_ip":"a","dst_ip":"b","dst_port":443,"proto":"tcp","app":"X","confidence":"high"}', '{"ip_src":"a","ip_dst":"b","port_dst":"1","app":"Y","risk":0.2}', '{"src_ip":"a"}', "bad"])).collect()
    assert [(r.app, r.protocol, r.dst_port, r.confidence) for r in flows] == [("X", "TCP", 443, 0.6), ("Y", "", 1, 0.2)]
    lines = spark.createDataFrame([(1, "TCP 10.0.0.1:50 8.8.8.8:443 ESTABLISHED"), (1, "tcp 0 0 0.0.0.0:22 0.0.0.0:* LISTEN"), (1, "TCP 1.1.1.1:1 127.0.0.1:9 ESTABLISHED"), (1, "TCP 1.1.1.1:1 2.2.2.2:9 TIME_WAIT")], "snapshot_ts int, line string")
    assert [(r.local_port, r.remote_ip, r.remote_port, r.state) for r in readers.connection_snapshots(lines).collect()] == [(50, "8.8.8.8", 443, "ESTABLISHED"), (22, "0.0.0.0", None, "LISTEN")]
    domains = readers.app_domains(text(['{"B": ["b.com", "c.com"], "A": ["a.com"]}'])).orderBy("priority").collect()
    assert [(r.app, r.pattern) for r in domains] == [("B", "b.com"), ("B", "c.com"), ("A", "a.com")]
    log = spark.createDataFrame([(100, "a", "c", 2), (100, "a", "c", 7), (10, "a", "c", 2), (99, None, "c", 2)], "timestamp long, domain string, client string, status int")
    assert readers.dns_queries(log, 100, 60).count() == 1
    raw = spark.createDataFrame([("a", "b", 6, None, 5), ("a", "b", 47, 1, None), (None, "b", 6, 1, 1)], "src_ip string, dst_ip string, protocol_number int, src_port int, dst_port int")
    assert sorted((r.protocol, r.src_port, r.dst_port) for r in readers.normalized_packets(raw).collect()) == [("IP-47", 1, 0), ("TCP", 0, 5)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, T0, "a", "b", "TCP", 5, None, "X")], "id long, start_time timestamp_ntz, src_ip string, dst_ip string, protocol string, bytes_sent long, bytes_received long, application string")
    sinks.export(sinks.export_rows(rows), f"{tmp_path}/csv")
    assert tuple(spark.read.csv(f"{tmp_path}/csv", header=True).columns) == sinks.TRAFFIC_FIELDS
    sinks.append_fact(rows, f"{tmp_path}/fact", "start_time")
    sinks.expire(spark.read.parquet(f"{tmp_path}/fact").drop("date"), "start_time", f"{tmp_path}/kept", 90, T0 + timedelta(days=91))
    assert spark.read.schema(rows.schema).parquet(f"{tmp_path}/kept").count() == 0
    sinks.export_report({"sessions": rows, "none": rows.limit(0)}, f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report/sessions").count() == 1


def test_dimensions(spark):
    devices = spark.createDataFrame([(1, "m1", 7, "A", True), (2, "m2", None, "B", True)], "id long, mac_address string, user_id long, name string, is_active boolean")
    changes = spark.createDataFrame([(1, "Old", None, 1), (1, "New", None, 2), (2, None, 9, 1)], "id long, name string, user_id long, turn int")
    assert sorted((r.id, r.name, r.user_id) for r in pipeline.apply_changes(devices, changes, "id", ["name", "user_id"], "turn").collect()) == [(1, "New", 7), (2, "B", 9)]
    gone = spark.createDataFrame([(2,)], "id long")
    assert [r.id for r in pipeline.active_by_name(pipeline.soft_delete(devices, gone, "id")).collect()] == [1]
    categories = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    apps = spark.createDataFrame([(10, 1), (11, 2)], "id long, category_id long")
    rules = spark.createDataFrame([(100, 10), (101, 11)], "id long, app_id long")
    left = pipeline.cascade_delete(categories, apps, rules, spark.createDataFrame([(2,)], "category_id long"))
    assert [[r.id for r in t.collect()] for t in left] == [[1], [10], [100]]
    assert pipeline.with_defaults(categories, spark.createDataFrame([(1, "x"), (9, "Uncategorized")], "id long, name string"), "id").count() == 3
    members = spark.createDataFrame([(1, 1)], "group_id long, device_id long")
    wanted = spark.createDataFrame([(1, 1), (1, 2), (1, 5), (1, 2)], "group_id long, device_id long")
    assert sorted((r.device_id, r.status, r.reason) for r in pipeline.add_members(members, wanted, devices).collect()) == [(1, "skipped", "already a member"), (2, "added", None), (5, "skipped", "unknown device")]
    policies = spark.createDataFrame([("kid", ["Game"], 22, 6, 100)], "profile string, restricted array<string>, hour_from int, hour_to int, max_bytes long")
    seen = spark.createDataFrame([("kid", "Game", T0 + timedelta(hours=12), 90), ("kid", "Web", T0 + timedelta(hours=23), 20)], "profile string, application string, start_time timestamp_ntz, bytes long")
    assert sorted(r.title for r in pipeline.alerts(seen, policies).collect()) == ["restricted application", "restricted hours", "threshold exceeded"]


def test_filters_and_merge(spark):
    s = spark.createDataFrame([(1, "x", 5, None, None, T0, None, 443), (2, "y", 2000, 1, "App", T0 - timedelta(seconds=91), T0 - timedelta(seconds=91), None)], "id long, src_mac string, bytes_sent long, bytes_received long, application string, start_time timestamp_ntz, end_time timestamp_ntz, dst_port int")
    assert [r.id for r in filters.significant(s).collect()] == [2]
    assert {r.id: (r.is_active, r.is_encrypted, r.duration_minutes) for r in filters.session_columns(s).collect()} == {1: (True, True, 0), 2: (False, False, 0)}
    people = spark.createDataFrame([("Ann_x",), ("bob%",), (None,)], "name string")
    assert [r.name for r in filters.search(people, "B%", ["name"]).collect()] == ["bob%"]
    old = sessions.discover_devices(spark.createDataFrame([packet(1, 0), packet(2, 5, src_mac="n")], PACKET))
    new = sessions.discover_devices(spark.createDataFrame([packet(3, 9, src_ip="192.168.0.1")], PACKET))
    got = {r.mac_address: (r.first_seen, r.last_seen, r.ip_address) for r in sessions.merge_devices(old, new).collect()}
    assert got["m"] == (T0, T0 + timedelta(seconds=9), "192.168.0.1") and got["n"][2] == "10.0.0.2"
    labels = spark.createDataFrame([("b", "a", 443, "tcp", T0, "App", "Cat", 0.9)], "src_ip string, dst_ip string, dst_port int, protocol string, ts timestamp_ntz, app string, category string, confidence double")
    flows = spark.createDataFrame([("a", "b", 443, "TCP"), ("a", "c", 443, "TCP")], "src_ip string, dst_ip string, dst_port int, protocol string")
    assert sorted(str(r.ndpi_app) for r in joins.flow_labels(flows, labels).collect()) == ["App", "None"]


def test_blocks_of_time_change_nothing(spark):
    rng = random.Random(4)
    at = lambda s: T0 + timedelta(seconds=s)
    facts = [(k, rng.choice(["a", "a", "b", None]), at(rng.randrange(9000))) for k in range(200)] + [(900, "a", None)]
    bound = [(rng.choice(["a", "b", None]), at(rng.randrange(9000)), f"n{k}") for k in range(60)]
    one, two = spark.createDataFrame(facts, "id long, ip string, ts timestamp_ntz"), spark.createDataFrame(bound, "ip string, ts timestamp_ntz, name string")
    want = {}
    for k, ip, ts in facts:
        seen = [(t, n) for i, t, n in bound if i == ip and ts is not None and t <= ts]
        want[k] = max(seen)[1] if seen else None
    for seconds in (60, 3600, 10**6):
        assert {r.id: r.name for r in joins.as_of_join(one, "ip", "ts", two, "name", block_seconds=seconds).collect()} == want
    rows = [(rng.choice("xy"), s := rng.randrange(200_000), s + rng.choice([0, 10, 400, 9000])) for _ in range(250)]
    frame = spark.createDataFrame([(k, at(a), at(b)) for k, a, b in rows], "k string, start_time timestamp_ntz, end_time timestamp_ntz")
    want = []
    for key in "xy":
        island = None
        for a, b in sorted((a, b) for k, a, b in rows if k == key):
            if island and a <= island[1] + 300:
                island = [island[0], max(island[1], b), island[2] + 1]
            else:
                want += [(key, *island)] if island else []
                island = [a, b, 1]
        want.append((key, *island))
    for seconds in (600, 3600, 10**7):
        got = sessions.interval_union(frame, ["k"], block_seconds=seconds).collect()
        assert sorted((r.k, r.start_time, r.end_time, r.sessions) for r in got) == sorted((k, at(a), at(b), n) for k, a, b, n in want)


def test_sessions_at_slot_borders(spark):
    rows = [packet(1, 0), packet(2, 89), packet(3, 179), packet(4, 269), packet(5, 360), packet(6, 450, src_ip="10.0.0.9", domain="x.org"), packet(7, 541, domain="")]
    packets = spark.createDataFrame(rows, PACKET)
    got = sorted((r.start_time, r.end_time, r.packet_count, r.src_ip, r.domain) for r in sessions.sessionize(packets).collect())
    at = lambda s: T0 + timedelta(seconds=s)
    assert got == [(at(0), at(269), 4, "10.0.0.2", None), (at(360), at(450), 2, "10.0.0.2", "x.org"), (at(541), at(541), 1, "10.0.0.2", None)]
    rng = random.Random(8)
    packets = spark.createDataFrame([packet(k, rng.randrange(40_000), dst_port=rng.choice([80, 443]), size=k) for k in range(400)], PACKET)
    marked = sessions.sessionize_by_gaps(packets).groupBy("dst_port", "session").agg(F.min("ts"), F.max("ts"), F.sum("size"), F.count("*")).drop("session")
    assert sorted(map(tuple, sessions.sessionize(packets).select("dst_port", "start_time", "end_time", "bytes_sent", "packet_count").collect())) == sorted(map(tuple, marked.collect()))


def test_new_connections_over_gaps(spark):
    rows = [(T0, "a"), (T0, "b"), (T0 + timedelta(seconds=2), "a"), (T0 + timedelta(hours=5), "a"), (T0 + timedelta(hours=5), "b"), (T0 + timedelta(hours=5, seconds=2), None), (T0 + timedelta(hours=5, seconds=4), None), (None, "z")]
    got = pipeline.new_connections(spark.createDataFrame(rows, "at timestamp_ntz, ip string"), "at", ["ip"]).collect()
    assert sorted(((r["at"] - T0).total_seconds(), r.ip) for r in got if r.ip) == [(0, "a"), (0, "b"), (18000, "b")] and [r["at"] for r in got if r.ip is None] == [T0 + timedelta(hours=5, seconds=2)]


def test_typed_rules_and_limits(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a.example.com", "example.com", "10.0.0.1"), (2, None, None, "10.0.0.1"), (3, "b.net", "b.net", "10.9.0.1"), (4, "c.net", "c.net", None)], "id long, domain string, root string, dst_ip string")
    rules = spark.createDataFrame([(1, "sni", "a.example.com", "C", "Exact", 1.0), (2, "regex", r"\.net$", "C", "Net", 0.5), (3, "cidr", "10.0.0.0/8", "C", "Wide", 0.4), (4, "cidr", "10.0.0.0/24", "C", "Narrow", 0.4)], "id long, type string, value string, category string, app string, confidence double")
    assert {r.id: r.app for r in joins.typed_rules(rows, "domain", "root", "dst_ip", rules).collect()} == {1: "Exact", 2: "Narrow", 3: "Net", 4: "Net"}
    monkeypatch.setattr(joins, "RULES", 1)
    with pytest.raises(ValueError):
        joins.ordered_rules(rows, "domain", rules.select("id", F.col("id").alias("priority"), F.col("value").alias("pattern"), "app"))


def test_facts_by_batch_and_day(spark, tmp_path):
    rows = spark.createDataFrame([(1, T0), (2, T0 + timedelta(days=2))], "id long, start_time timestamp_ntz")
    for _ in range(2):  # the same batch runs twice
        sinks.append_fact(rows, f"{tmp_path}/fact", "start_time", batch=3)
    sinks.append_fact(rows.where("id = 2").withColumn("id", F.lit(9).cast("long")), f"{tmp_path}/fact", "start_time", batch=4)
    read = lambda: sorted(r.id for r in spark.read.parquet(f"{tmp_path}/fact").collect())
    assert read() == [1, 2, 9]
    assert len(sinks.drop_expired(spark, f"{tmp_path}/fact", 1, (T0 + timedelta(days=2)).date())) == 1 and read() == [2, 9]
    people = spark.createDataFrame([(1, "ann", "secret")], "id long, username string, password string")
    assert sinks.entity_rows(people, "users").columns == ["id", "username"]


# ---- streams


STREAM = PACKET.replace("timestamp_ntz", "timestamp")


def run_batches(spark, folder, batches, operator):
    """Write a file, run the stream on it, stop, and go on from the checkpoint with the next one."""
    stream = operator(spark.readStream.schema(STREAM).parquet(f"{folder}/in/*"))
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, PACKET).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{folder}/in/{k}")
        stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).format("parquet").start(f"{folder}/out").awaitTermination(60)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").collect()


def test_session_stream_drops_late_rows(spark, tmp_path):
    batches = [[packet(1, 0), packet(2, 90)], [packet(3, 5000, src_mac="n")], [packet(4, 10, src_mac="late"), packet(5, 4900, src_mac="kept")], [packet(6, 90_000, src_mac="end")], [packet(7, 190_000, src_mac="end2")]]
    got = run_batches(spark, tmp_path, batches, lambda packets: streams.session_stream(packets, "90 seconds", "10 minutes"))
    assert sorted((r.src_mac, r.packet_count) for r in got if not r.src_mac.startswith("end")) == [("kept", 1), ("m", 2), ("n", 1)]


def test_named_stream_equals_as_of_join(spark, tmp_path):
    bound = [("9.9.9.9", 5, "a"), ("9.9.9.9", 20, "b")]
    rows = spark.createDataFrame([(T0 + timedelta(seconds=s), ip, n) for ip, s, n in bound], "ts timestamp, ip string, name string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/names")
    names = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/names")
    batches = [[packet(1, 0), packet(2, 10)], [packet(3, 20), packet(4, 30, dst_ip="other")]]
    got = {r.id: r.name for r in run_batches(spark, tmp_path, batches, lambda packets: streams.named_stream(packets, names, None))}
    assert got[1] is None and got[2] == "a" and got[4] is None and got[3] == "b"


def test_named_batches_carry_names(spark, tmp_path):
    """A name holds on in later batches and hours, also for a batch with rows from before it; a rerun changes nothing."""
    one = [packet(1, 0, domain=None), packet(2, 5, domain="a"), packet(3, 5, domain="b"), packet(4, 5, domain=None), packet(5, 9, domain=None, dst_ip="other")]
    two = [packet(6, 2, domain=None), packet(7, 9000, domain=None), packet(8, 9001, domain="c"), packet(9, 90_000, domain=None)]
    name = streams.named_batches(f"{tmp_path}/names")
    for number, rows in ((0, one), (1, two), (1, two), (2, [packet(10, 7, domain=None), packet(11, 99_000, domain=None)])):
        name(spark.createDataFrame(rows, PACKET), number)
    got = {r.id: r.name for r in spark.read.parquet(f"{tmp_path}/names/named").collect()}
    assert got == {1: None, 2: "b", 3: "b", 4: "b", 5: None, 6: None, 7: "b", 8: "c", 9: "c", 10: None, 11: "c"}


def test_session_log_is_rerun_safe(spark, tmp_path):
    log = streams.session_log(f"{tmp_path}/log", 2)
    for number, rows in ((0, [packet(1, 0), packet(2, 500), packet(3, 900)]), (1, [packet(4, 2000)]), (1, [packet(4, 2000)])):
        log(spark.createDataFrame(rows, PACKET), number)
    got = spark.read.parquet(f"{tmp_path}/log")
    assert sorted((r.batch, r.start_time) for r in got.collect()) == [(0, T0 + timedelta(seconds=500)), (0, T0 + timedelta(seconds=900)), (1, T0 + timedelta(seconds=2000))]


def test_device_upsert_and_snapshots(spark, tmp_path):
    stream = spark.readStream.schema(STREAM).parquet(f"{tmp_path}/in/*")
    for k, rows in enumerate([[packet(1, 0)], [packet(2, 9, src_ip="10.0.0.9"), packet(3, 1, src_mac="n")]]):
        spark.createDataFrame(rows, PACKET).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        streams.each_batch(stream, streams.device_upsert(f"{tmp_path}/devices"), f"{tmp_path}/c1", None).awaitTermination(60)
    got = {r.mac_address: r.ip_address for r in spark.read.parquet(f"{tmp_path}/devices/version=1").collect()}
    assert got == {"m": "10.0.0.9", "n": "10.0.0.2"}
    compare = streams.snapshot_changes(f"{tmp_path}/snap", "at", ["ip"])
    frame = lambda *rows: spark.createDataFrame(list(rows), "at int, ip string")
    compare(frame((1, "a"), (2, "a"), (2, "b")), 0)
    compare(frame((3, "b"), (3, "c")), 1)
    found = spark.read.parquet(f"{tmp_path}/snap/new").select("at", "ip").collect()
    assert sorted(map(tuple, found)) == [(1, "a"), (2, "b"), (3, "c")]
