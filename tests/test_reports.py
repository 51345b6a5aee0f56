"""Reports, trends and named packets on small awkward rows."""

from datetime import date, datetime, timedelta

import pytest

from packetloom.operators import reports, sessions as flows

T0 = datetime(2024, 1, 1, 12)
SESSION = "id long, src_mac string, dst_ip string, protocol string, application string, start_time timestamp_ntz, end_time timestamp_ntz, bytes_sent long, bytes_received long"
VISIT = "id long, device_mac string, domain string, category string, timestamp timestamp_ntz, bytes_transferred long, duration long"


def at(hours):
    return T0 + timedelta(hours=hours)


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


@pytest.fixture(scope="module")
def facts(spark):
    sessions = spark.createDataFrame([
        (1, "m1", "d1", "TCP", "x", at(0), None, 5, None), (2, "m1", "d2", "UDP", None, at(-24), None, 7, 1), (3, "m2", "d1", "TCP", "x", at(-1), None, 2, 2), (4, "m9", None, None, "y", at(-25), None, 100, 0),
    ], SESSION)
    visits = spark.createDataFrame([
        (1, "m1", "a.org", None, at(0), 5, None), (2, "m1", "a.org", "News", at(-2), 6, 3), (3, "m2", "b.org", "News", at(-24), None, 4), (4, "m2", "c.org", "Shop", at(-25), 50, 4),
    ], VISIT)
    devices = spark.createDataFrame([(1, "m1", "h1", 7, "phone", True), (2, "m2", "h2", 8, None, False), (3, "m3", "h3", None, "phone", True)], "id long, mac_address string, hostname string, user_id long, device_type string, is_active boolean")
    return sessions, visits, devices


def test_website_report(facts):
    _, visits, devices = facts
    found = reports.website_report(visits, devices)
    assert rows(found["summary"], "visits", "bytes", "duration", "average_duration") == [(3, 11, 7, 7 / 3)]
    assert rows(found["domains"], "domain", "visits", "category") == [("a.org", 2, "News"), ("b.org", 1, "News")]
    assert sorted(rows(found["categories"], "category", "visits")) == [("News", 2), ("Uncategorized", 1)]
    assert sorted(rows(found["hours"])) == [(10, 1, 6), (12, 2, 5)]
    assert rows(reports.website_report(visits, devices, user_id=7, category="News")["summary"], "visits", "bytes") == [(1, 6)]
    assert rows(reports.website_report(visits, devices, user_id=99)["summary"], "visits", "bytes", "average_duration") == [(0, 0, 0.0)]
    assert rows(reports.website_report(visits, devices, "7d", device_id=2)["summary"], "visits") == [(2,)]
    assert rows(reports.website_report(visits, devices, device_id=77)["summary"], "visits") == [(3,)]


def test_traffic_report(facts):
    sessions, _, devices = facts
    found = reports.traffic_report(sessions, devices)
    assert rows(found["summary"]) == [(3, 17)]
    assert sorted(rows(found["protocols"])) == [("TCP", 2, 9), ("UDP", 1, 8)]
    assert sorted(rows(found["applications"])) == [("Unknown", 1, 8), ("x", 2, 9)]
    assert rows(found["destinations"]) == [("d1", 2, 9), ("d2", 1, 8)]
    assert rows(reports.traffic_report(sessions, devices, user_id=8)["destinations"]) == [("d1", 1, 4)]
    assert rows(reports.traffic_report(sessions.limit(0), devices)["summary"]) == [(0, 0)]


def test_monitoring_and_devices(facts):
    sessions, visits, devices = facts
    found = reports.monitoring(sessions, visits, devices, span="90 minutes")
    assert sorted(rows(found["devices"], "id")) == [(1,), (2,)]
    assert rows(found["sessions"], "id") == [(1,), (3,)] and rows(found["visits"], "id") == [(1,)]
    assert sorted(rows(reports.devices_in_period(devices, sessions, visits, device_type="phone"), "id", "bytes", "sessions", "visits")) == [(1, 13, 2, 2), (3, 0, 0, 0)]
    assert rows(reports.devices_in_period(devices, sessions, visits, "30d", is_active=False), "id", "bytes", "visits") == [(2, 4, 2)]


def test_trends(spark, facts):
    sessions, _, devices = facts
    given = [("a", at(0), 5), ("a", at(0.1), 6), ("b", at(1), 1), ("a", at(50), None), (None, at(50), 2), ("c", None, 9)]
    packets = spark.createDataFrame(given, "src_mac string, ts timestamp_ntz, size long")
    stats = reports.stats_rows(packets)
    assert sorted(rows(stats)) == [(at(1), 11, 2, 1), (at(2), 12, 3, 2), (at(51), 14, 5, 2)]
    assert reports.stats_rows(packets.limit(0)).collect() == []
    assert sorted(rows(reports.system_trend(stats, 4), "day", "bytes", "grown", "devices")) == [(date(2023, 12, 31), 0, 0, 0), (date(2024, 1, 1), 23, 1, 2), (date(2024, 1, 2), 0, 0, 0), (date(2024, 1, 3), 14, 0, 2)]
    trend = reports.user_trend(sessions, devices, 2)
    assert sorted(rows(trend, "user_id", "day", "bytes", "devices")) == [(7, date(2023, 12, 31), 8, 1), (7, date(2024, 1, 1), 5, 1), (8, date(2023, 12, 31), 0, 0), (8, date(2024, 1, 1), 4, 1)]


PACKET = "id long, ts timestamp_ntz, dst_ip string, dns_query string, http_host string, dns_answers array<struct<name:string,ip:string>>"


def cache_by_hand(packets, bind_queries):
    """The reference's cache, packet by packet; bindings of a time are known to all packets of that time."""
    known, out = {}, {}
    for moment in sorted({p[1] for p in packets}):
        own = sorted(p for p in packets if p[1] == moment)
        for _, _, ip, query, host, answers in own:
            if query and query.rstrip(".") and bind_queries:
                known[ip] = query.rstrip(".")
            for name, address in answers or ():
                if address and address.count(".") == 3 and name and name.rstrip("."):
                    known[address] = name.rstrip(".")
            if host:
                known[ip] = host
        for i, _, ip, query, host, _ in own:
            out[i] = host or (query or "").rstrip(".") or known.get(ip)
    return out


@pytest.mark.parametrize("bind_queries", [True, False])
def test_named_packets(spark, bind_queries):
    packets = [
        (1, at(0), "1.1.1.1", "q.org.", None, [("a.org.", "9.9.9.9"), ("b.org", "fe80::1"), (None, "9.9.9.8"), ("c.org", None)]), (2, at(0), "9.9.9.9", None, "", None), (3, at(0), "1.1.1.1", None, None, None),
        (4, at(1), "9.9.9.9", None, "host.org", []), (5, at(2), "9.9.9.9", "", None, None), (6, at(2), "1.1.1.1", "r.org", None, None), (7, at(-1), "9.9.9.9", None, None, None), (8, at(3), None, None, None, None),
        (9, at(3), "2.2.2.2", "s.org", "t.org", [("u.org..", "2.2.2.2")]), (10, at(4), "2.2.2.2", None, None, None), (11, at(4), "fe80::1", None, None, None),
    ]
    found = reports.named_packets(spark.createDataFrame(packets, PACKET), bind_queries)
    assert dict(rows(found, "id", "domain")) == cache_by_hand(packets, bind_queries)
    assert reports.named_packets(spark.createDataFrame([], PACKET)).collect() == []


def test_flows_take_the_confidence_of_their_application(spark):
    given = [(1, at(0), "s", "d", 1, 2, "TCP", 5, None, 0.9), (2, at(1), "s", "d", 1, 2, "TCP", 5, "web", None), (3, at(2), "s", "d", 1, 2, "TCP", 5, "mail", 0.8), (4, at(0), "s", None, 1, 2, "TCP", 5, "web", 0.7), (5, at(0), "s", "e", 1, 2, "TCP", 5, "", 0.7)]
    packets = spark.createDataFrame(given, "id long, ts timestamp_ntz, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, size long, application string, confidence double")
    found = flows.flows_by_tuple(packets)
    assert sorted(rows(found, "dst_ip", "bytes", "packet_count", "application", "confidence")) == [("d", 15, 3, "web", None), ("e", 5, 1, None, None)]
    assert "confidence" not in flows.flows_by_tuple(packets.drop("confidence")).columns
