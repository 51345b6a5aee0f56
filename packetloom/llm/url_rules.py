"""URL allow/block rules as a sort-merge range join, in DataFrame operations alone.

A host's labels are reversed and closed by a dot, so that a rule host is a byte prefix of the keys of its subdomains:
an interval from the prefix to the prefix followed by 0xFF, a byte that UTF-8 never holds. Intervals of prefixes nest.
A sweep over the sorted keys therefore keeps a stack of open rules: the running sum of openings and closings is its
depth, and its level L is the last rule opened at depth L. The key space is dealt by range; each range starts from
the depth and the levels that earlier ranges left open. A first sweep over distinct hosts finds the rule hosts above
each, a second over (rule host, path) finds the longest path rule of each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.common import written

DEFAULT_VERDICT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Bytes that UTF-8 never holds: the first sorts after every key with a prefix, the second parts host and path.
AFTER_ALL, BETWEEN = bytearray(b"\xff"), bytearray(b"\xfe")


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")).cast("binary")


def open_prefixes(keys: DataFrame, prefixes: DataFrame) -> DataFrame:
    """For each distinct binary ``key`` the stack of distinct ``prefix`` rows that it starts with, shortest first.

    Returns (key, stack array<binary>), without the keys that no prefix fits. Null keys and prefixes fit nothing.
    """
    prefixes = prefixes.select("prefix").where("prefix is not null").distinct()
    none = F.lit(None).cast("binary")
    events = (
        prefixes.select(F.col("prefix").alias("at"), F.lit(1).alias("step"), F.col("prefix").alias("opened"))
        .unionAll(prefixes.select(F.concat("prefix", F.lit(AFTER_ALL)), F.lit(-1), none))
        .unionAll(keys.select("key").where("key is not null").distinct().select("key", F.lit(0), none))
    )
    dealt = written(events.repartitionByRange("at").withColumn("range", F.spark_partition_id()), "url-events")
    sweep = Window.partitionBy("range").orderBy("at", F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range of keys

    ranges = dealt.groupBy("range").agg(F.min("at").alias("first"), F.sum("step").alias("left_open"))
    ranges = ranges.select("range", F.coalesce(F.sum("left_open").over(earlier), F.lit(0)).alias("before"))
    deep = dealt.withColumn("run", F.sum("step").over(sweep)).join(F.broadcast(ranges), "range")
    deep = written(deep.select("range", "at", "step", "opened", (F.col("run") + F.col("before")).alias("depth")), "url-depths")

    levels = range(1, (deep.agg(F.max("depth")).first()[0] or 0) + 1)
    if not levels:
        return keys.select("key").limit(0).withColumn("stack", F.array(none))
    opened = {n: F.when((F.col("step") == 1) & (F.col("depth") == n), F.col("opened")) for n in levels}
    carried = deep.groupBy("range").agg(F.min("at").alias("first"), *(F.max_by(opened[n], F.when(opened[n].isNotNull(), F.col("at"))).alias(f"open_{n}") for n in levels))
    carried = carried.select("range", *(F.last(f"open_{n}", ignorenulls=True).over(earlier).alias(f"carried_{n}") for n in levels))
    swept = deep.select("*", *(F.last(opened[n], ignorenulls=True).over(sweep).alias(f"level_{n}") for n in levels))
    stack = F.array(*(F.coalesce(f"level_{n}", f"carried_{n}") for n in levels))
    return swept.where("step = 0 and depth > 0").join(F.broadcast(carried), "range").select(F.col("at").alias("key"), F.slice(stack, 1, F.col("depth").cast("int")).alias("stack"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT) -> DataFrame:
    """Judge each row of ``pages`` (``page_id``, ``url``) by ``rules`` (``host``, ``path``, ``verdict``).

    A rule fits its host and all subdomains if the url's path starts with the rule's path; the rule with the longest
    text wins, a block before an allow of the same text. A url without ``://`` or a null one has an empty host and path.
    Rules with a null host or verdict are left out; a null path is an empty one. Repeated and null ids stay as they are;
    an empty table gives no rows. Returns page_id, host, path, rule (null: none fits) and verdict.
    """
    rules = (
        rules.where("host is not null and verdict is not null")
        .select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "verdict")
        .groupBy("rule_host", "rule_path")
        .agg(F.max("verdict").alias("rule_verdict"))
        .withColumn("host_key", reversed_host(F.col("rule_host")))
    )
    pages = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    targets = pages.select("host", "path").distinct().withColumn("key", reversed_host(F.col("host")))

    above = open_prefixes(targets.select("key"), rules.select(F.col("host_key").alias("prefix")))
    tried = targets.join(above, "key").select("host", "path", F.explode("stack").alias("host_key"))
    path_key = lambda path: F.concat("host_key", F.lit(BETWEEN), F.col(path).cast("binary"))
    tried = written(tried.withColumn("key", path_key("path")), "url-targets")
    rules = rules.withColumn("prefix", path_key("rule_path"))
    fitting = open_prefixes(tried.select("key"), rules.select("prefix")).select("key", F.element_at("stack", -1).alias("prefix"))

    rank = F.struct(F.length(F.concat("rule_host", "rule_path")), F.length("rule_host"), "rule_host")
    best = (
        tried.join(fitting, "key")
        .join(rules, "prefix")
        .groupBy("host", "path")
        .agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict")), rank).alias("best"))
    )
    return pages.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


def rule_rows(spark, rows: list[tuple[str, str, str]]) -> DataFrame:
    """A rule table from (host, path, verdict) literals."""
    one = spark.range(1)
    return reduce(DataFrame.unionAll, [one.select(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rows])
