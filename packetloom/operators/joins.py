"""Joins that Spark has no single operator for: ranges, as-of, trailing interval, ordered rules, cascades and prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.periods import ago, in_period
from packetloom.functions.scalars import address_label, classify_flow, host_label, ipv4_number
from packetloom.operators.blocks import BLOCK_SECONDS, block_of, running

#: Rules of a theta join that may be broadcast; such a join has no other plan, so more of them are an error.
RULES = 100_000


def range_lookup(points: DataFrame, point: str, ranges: DataFrame, low: str, high: str) -> DataFrame:
    """Left join of each point with the range that holds it (both ends count; the one with the greatest start wins).

    Points and ends are whole numbers. Each range is cut into aligned blocks of a power of two, at most two of a size, and each block keeps the one range
    that wins in it, so a point meets one range for each size in use, however many ranges overlap or repeat. Distinct
    points are matched, then joined back, so frequent points cost nothing. Ranges' other columns are kept.
    """
    names = [c for c in ranges.columns]
    held = ranges.where(F.col(low) <= F.col(high)).select(F.struct(*names).alias("range"), F.col(low).cast("long").alias("first"), (F.col(high).cast("long") + 1).alias("beyond"))
    held = held.withColumn("level", F.explode(F.sequence(F.lit(0), F.length(F.bin(F.col("beyond") - F.col("first"))) - 1)))
    left, right = F.expr("-shiftright(-first, level)"), F.expr("shiftright(beyond, level)")  # whole blocks of the level: left up to right
    cut = held.where(left < right).select("range", "level", left.alias("left"), right.alias("right"))
    ends = F.array(F.when(F.col("left") % 2 != 0, F.col("left")), F.when(F.col("right") % 2 != 0, F.col("right") - 1))  # the others are halves of larger blocks
    listed = cut.select("range", "level", F.explode(ends).alias("block")).where("block is not null")
    wins = lambda row: F.struct(row[low], -row[high])
    listed = listed.repartition("level", "block").groupBy("level", "block").agg(F.max_by("range", wins(F.col("range"))).alias("range"))  # dealt first, as structs are sorted to be grouped; not broadcast, as a range has many blocks
    asked = points.select(F.col(point).alias("asked")).where("asked is not null").distinct()
    used = F.broadcast(listed.select("level").distinct())  # at most one row for each level
    asked = asked.crossJoin(used).withColumn("block", F.expr("shiftright(cast(asked as bigint), level)"))
    best = asked.join(listed.hint("merge"), ["level", "block"]).groupBy("asked").agg(F.max_by("range", wins(F.col("range"))).alias("best"))
    return points.join(best, points[point] == best["asked"], "left").select(points["*"], "best.*")


def as_of_join(facts: DataFrame, key: str, ts: str, bindings: DataFrame, value: str, order: str = "id", block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """``facts`` with the ``value`` that ``bindings`` (same key and time columns) last gave the key, at or before each row.

    A key's history is cut into blocks of time, so a busy key is no single task.
    """
    columns = [c for c in facts.columns if c != value]
    mine = facts.select(*columns, F.lit(1).alias("turn"), F.lit(None).cast("string").alias(value))
    theirs = bindings.select(*(F.col(c).cast(facts.schema[c].dataType) if c in (key, ts) else F.lit(None).cast(facts.schema[c].dataType).alias(c) for c in columns), F.lit(0).alias("turn"), F.col(value))
    both = mine.unionByName(theirs).withColumn("time_block", block_of(ts, block_seconds))
    found = running(both, [key], "time_block", [ts, "turn", order, value], value, "last")
    return found.where("turn = 1").select(*columns, F.col("running").alias(value))


def trailing_join(facts: DataFrame, key: str, ts: str, events: DataFrame, event_ts: str, value: str, span_seconds: int, id_: str = "id") -> DataFrame:
    """The most recent ``value`` of the key in the ``span_seconds`` before each fact (both ends count), else null.

    Times are cut into blocks of the span; an event can only matter to its own block and the next, so both sides meet by
    (key, block) instead of by key alone.
    """
    block = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / span_seconds)
    mine = facts.select(F.col(id_).alias("fact_id"), F.col(key).alias("fact_key"), F.col(ts).alias("fact_ts"), block(ts).alias("block"))
    theirs = events.select(F.col(key).alias("event_key"), F.col(event_ts).alias("at"), F.col(value).alias("found"), F.explode(F.array(block(event_ts), block(event_ts) + 1)).alias("event_block"))
    near = mine.join(theirs, (F.col("fact_key") == F.col("event_key")) & (F.col("block") == F.col("event_block")))
    near = near.where((F.col("at") <= F.col("fact_ts")) & (F.col("at") >= ago(F.col("fact_ts"), f"{span_seconds} seconds")))
    last = near.groupBy("fact_id").agg(F.max_by("found", F.struct("at", "found")).alias(value))
    return facts.join(last, facts[id_] == last["fact_id"], "left").drop("fact_id")


def ordered_rules(df: DataFrame, text: str, rules: DataFrame, kind: str = "contains", anchored: bool = False) -> DataFrame:
    """The first rule, by ``priority``, whose ``pattern`` fits the text: contains, prefix or regex. Adds ``app`` (null: none).

    Distinct texts are matched and joined back. ``anchored`` lets a pattern fit whole labels only. At most ``RULES`` rules.
    """
    if rules.count() > RULES:
        raise ValueError(f"more than {RULES} rules; split them, or turn prefixes into ranges for range_lookup")
    asked = df.select(F.col(text).alias("asked")).where("asked is not null").distinct()
    low = F.lower("asked")
    fits = {"contains": F.contains(low, F.col("pattern")), "prefix": F.startswith(F.col("asked"), F.col("pattern")), "regex": F.regexp_like(low, F.col("pattern"))}[kind]
    if anchored:
        fits = (low == F.col("pattern")) | F.endswith(low, F.concat(F.lit("."), F.col("pattern")))
    hit = asked.join(F.broadcast(rules), fits)
    best = hit.groupBy("asked").agg(F.min_by("app", "priority").alias("app"))
    return df.join(best, df[text] == best["asked"], "left").drop("asked")


def classify_flows(df: DataFrame, host: str, port: str, ip: str, protocol: str) -> DataFrame:
    """Adds ``found`` (app, category, confidence) as ``classify_flow`` gives it.

    Host patterns and address prefixes run on distinct hosts and addresses alone, and their labels are joined back.
    """

    def labelled(column: str, rule, name: str) -> DataFrame:
        asked = df.select(F.col(column).alias(f"{name}_key")).where(F.col(f"{name}_key") != "").distinct()
        return asked.withColumn(name, rule(F.col(f"{name}_key")))  # a filter on it would be run below and double the rules

    hosts, addresses = labelled(host, host_label, "by_host"), labelled(ip, address_label, "by_address")
    out = df.join(hosts, df[host] == hosts["by_host_key"], "left").join(addresses, df[ip] == addresses["by_address_key"], "left")
    found = classify_flow(F.col(host), F.col(port), F.col(ip), F.col(protocol), F.col("by_host"), F.col("by_address"))
    return out.withColumn("found", found).drop("by_host_key", "by_host", "by_address_key", "by_address")


def typed_rules(df: DataFrame, host: str, root: str, ip: str, rules: DataFrame, fallback: float = 0.2) -> DataFrame:
    """``rule_cascade`` with the rule types sni (a host name), regex (searched in the host) and cidr (the address's network).

    Exact rules come first (host, root, address, as in the cascade), then regex by the lowest id, then the narrowest
    network. ``rules``: id, type (domain, sni, ip, regex or cidr), value, category, app, confidence.
    """
    exact = rules.withColumn("type", F.when(F.col("type") == "sni", "domain").otherwise(F.col("type"))).where("type in ('domain', 'ip')")
    out = rule_cascade(df.drop("app", "category", "confidence"), host, root, ip, exact, fallback)
    kept = [c for c in out.columns if c not in ("app", "category", "confidence")]
    label = F.struct("category", "app", "confidence").alias("label")
    patterns = rules.where("type = 'regex'").select(F.col("id").alias("priority"), F.col("value").alias("pattern"), F.to_json(F.struct("category", "app", "confidence")).alias("app"))
    by_regex = ordered_rules(out.select(F.lower(F.col(host)).alias("regex_host")).distinct(), "regex_host", patterns, "regex").select("regex_host", F.from_json("app", "category string, app string, confidence double").alias("by_regex"))
    low, high = cidr_ends(F.col("value"))
    networks = rules.where("type = 'cidr'").select(low.alias("low"), high.alias("high"), "id", label)
    networks = networks.groupBy("low", "high").agg(F.min_by("label", "id").alias("by_network"))
    asked = out.select(F.col(ip).alias("asked_ip")).where("asked_ip is not null").distinct().withColumn("asked_number", ipv4_number(F.col("asked_ip")))
    found = range_lookup(asked, "asked_number", networks, "low", "high").select("asked_ip", "by_network")
    out = out.join(by_regex, F.lower(out[host]) == by_regex["regex_host"], "left").join(found, F.col(ip) == F.col("asked_ip"), "left")
    none = F.col("app") == "Unknown"
    rule = F.coalesce(F.when(~none, label), "by_regex", "by_network", label)
    return out.withColumn("rule_found", rule).select(*kept, *(F.col("rule_found")[n].alias(n) for n in ("category", "app", "confidence")))


def cidr_ends(cidr: Column) -> tuple[Column, Column]:
    """First and last IPv4 number of a network in ``a.b.c.d/n``; null if it can't be read."""
    bits = F.try_element_at(F.split(cidr, "/"), F.lit(2)).try_cast("int")
    size = F.when(bits.between(0, 32), F.pow(F.lit(2.0), F.lit(32) - bits).cast("long"))
    low = F.floor(ipv4_number(F.substring_index(cidr, "/", 1)) / size).cast("long") * size
    return low, low + size - 1


def rule_cascade(df: DataFrame, host: str, root: str, ip: str, rules: DataFrame, fallback: float = 0.2) -> DataFrame:
    """Category, app and confidence by exact host, then root domain, then address; the lowest rule id wins.

    ``rules``: id, type (domain or ip), value, category, app, confidence.
    """
    best = rules.groupBy("type", "value").agg(F.min_by(F.struct("category", "app", "confidence"), "id").alias("rule"))
    out = df
    for name, kind, column in (("by_host", "domain", host), ("by_root", "domain", root), ("by_ip", "ip", ip)):
        own = best.where(F.col("type") == kind).select(F.col("value").alias(f"{name}_value"), F.col("rule").alias(name))
        out = out.join(own, F.lower(F.col(column)) == F.col(f"{name}_value"), "left").drop(f"{name}_value")
    none = F.struct(F.lit("Uncategorized").alias("category"), F.lit("Unknown").alias("app"), F.lit(fallback).alias("confidence"))
    rule = F.coalesce("by_host", "by_root", "by_ip", none)
    return out.withColumns({n: rule[n] for n in ("category", "app", "confidence")}).drop("by_host", "by_root", "by_ip")


def vendor_lookup(devices: DataFrame, mac: str, oui: DataFrame) -> DataFrame:
    """Adds ``vendor``: the longest of the 9, 7 and 6 digit prefixes, its long name or else its short one, else Unknown."""
    digits = F.regexp_replace(F.lower(F.trim(F.col(mac))), "[^0-9a-f]", "")
    names = oui.select(F.lower("prefix").alias("prefix"), F.coalesce("vendor_long", "vendor_short").alias("name")).groupBy("prefix").agg(F.min("name").alias("name"))
    out, found = devices.withColumn("mac_digits", digits), []
    for size in (9, 7, 6):
        own = names.where(F.length("prefix") == size).select(F.col("prefix").alias(f"p{size}"), F.col("name").alias(f"n{size}"))
        out = out.join(own, F.substring("mac_digits", 1, size) == F.col(f"p{size}"), "left").drop(f"p{size}")
        found.append(f"n{size}")
    return out.withColumn("vendor", F.coalesce(*found, F.lit("Unknown"))).drop("mac_digits", *found)


def registered_domain(df: DataFrame, host: str, suffixes: DataFrame) -> DataFrame:
    """Adds ``root_domain``: the longest suffix of the table and one label more, in lower case.

    '' for a null host; an address, or a host without a listed suffix or equal to one, stays as it is, in lower case.
    """
    asked = df.select(F.lower(F.col(host)).alias("asked")).where("asked is not null").distinct()
    labels = F.split("asked", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.struct(k.alias("n"), F.array_join(F.slice(labels, -k, k), ".").alias("tail")))
    listed = suffixes.select(F.lower("suffix").alias("tail")).distinct()
    tried = asked.where(~F.col("asked").rlike(r"^[\d.]+$|:")).select("asked", F.explode(tails).alias("t")).select("asked", "t.n", "t.tail")
    best = tried.join(listed, "tail").groupBy("asked").agg(F.max("n").alias("n"))
    root = F.array_join(F.slice(labels, -(F.col("n") + 1), F.col("n") + 1), ".")
    best = best.select("asked", F.when(F.col("n") < F.size(labels), root).alias("root"))
    low = F.lower(df[host])
    return df.join(best, low == best["asked"], "left").withColumn("root_domain", F.coalesce("root", low, F.lit(""))).drop("asked", "root")


def flow_labels(flows: DataFrame, labels: DataFrame) -> DataFrame:
    """Left join of flows with the latest label of their (src_ip, dst_ip, dst_port, protocol), in either direction."""
    keys = ["src_ip", "dst_ip", "dst_port", "protocol"]
    ways = F.array(F.struct("src_ip", "dst_ip"), F.struct(F.col("dst_ip").alias("src_ip"), F.col("src_ip").alias("dst_ip")))
    both = labels.withColumn("way", F.explode(ways)).select("way.src_ip", "way.dst_ip", "dst_port", F.upper("protocol").alias("protocol"), "ts", "app", "category", "confidence")
    last = both.groupBy(keys).agg(F.max_by(F.struct("app", "category", "confidence"), F.struct("ts", "app")).alias("label"))
    out = flows.join(last, [flows[k] == (F.upper(last[k]) if k == "protocol" else last[k]) for k in keys], "left")
    return out.select(flows["*"], F.col("label.app").alias("ndpi_app"), F.col("label.category").alias("ndpi_category"), F.col("label.confidence").alias("ndpi_confidence"))


def with_devices(sessions: DataFrame, devices: DataFrame) -> DataFrame:
    """Each session with its source device's name and user (null if unknown)."""
    own = devices.select(F.col("mac_address").alias("own_mac"), F.col("hostname").alias("device_hostname"), F.col("user_id").alias("device_user_id"))
    return sessions.join(own, sessions["src_mac"] == own["own_mac"], "left").drop("own_mac")


def with_users(devices: DataFrame, users: DataFrame) -> DataFrame:
    names = users.select(F.col("id").alias("owner_id"), F.col("username").alias("owner"))
    return devices.join(names, devices["user_id"] == names["owner_id"], "left").withColumn("owner", F.coalesce("owner", F.lit("Unassigned"))).drop("owner_id")


def with_enrichment(sessions: DataFrame, enriched: DataFrame) -> DataFrame:
    own = enriched.withColumnRenamed("ip_address", "enriched_ip")
    return sessions.join(own, sessions["dst_ip"] == own["enriched_ip"], "left").drop("enriched_ip")


def content_of_visits(content: DataFrame, visits: DataFrame, period: str, as_of=None) -> DataFrame:
    """Page content (``website_visit_id``) of the visits of a period; visits without content have no row."""
    near = in_period(visits, "timestamp", period, as_of).select(F.col("id").alias("visit_id"))
    return content.join(near, content["website_visit_id"] == near["visit_id"]).drop("visit_id")


def unassigned(devices: DataFrame) -> DataFrame:
    return devices.where(F.col("user_id").isNull())
