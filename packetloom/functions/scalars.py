"""Column expressions of the classification, fingerprint, enrichment, page and payload jobs. All run inside Spark's own code."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetloom.functions import tables


def lookup(key: Column, table: Mapping, default=None) -> Column:
    """The table's value of a key, as one map literal."""
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.element_at(entries, key.cast("int") if isinstance(next(iter(table)), int) else key), F.lit(default))


def first_match(pairs) -> Column:
    """The value of the first true condition, else null."""
    (condition, value), *rest = pairs
    return reduce(lambda chain, pair: chain.when(*pair), rest, F.when(condition, value))


def label(app: str | None, category: str | None) -> Column:
    return F.struct(F.lit(app).cast("string").alias("app"), F.lit(category).cast("string").alias("category"))


# ---- hosts and addresses


def naive_root_domain(host: Column) -> Column:
    """The last two labels."""
    return F.substring_index(host, ".", -2)


def fallback_app_name(host: Column) -> Column:
    """The second-to-last label with a capital first letter, else Unknown."""
    parts = F.split(host, r"\.")
    name = F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(-2)))
    return F.coalesce(F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.substring(name, 2, 1 << 30))), F.lit("Unknown"))


def without_final_dot(name: Column) -> Column:
    return F.regexp_replace(name, r"\.+$", "")


def url_authority(url: Column) -> Column:
    """The network location of a url, user info and port included."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def visit_url(domain: Column, port: Column) -> Column:
    return F.concat(F.when(port == 443, F.lit("https://")).otherwise(F.lit("http://")), domain)


def ipv4_number(ip: Column) -> Column:
    """A dotted address as a long; null unless it has four numbers up to 255."""
    parts = F.split(ip, r"\.")
    number = lambda k: F.try_element_at(parts, F.lit(k)).cast("long")
    value = reduce(lambda a, k: a * 256 + number(k), (2, 3, 4), number(1))
    valid = ip.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$")
    return F.when(valid, value)


def ipv6_key(ip: Column) -> Column:
    """An IPv6 text as 32 hex digits, which sort like the addresses; null if it isn't one."""
    low = F.lower(ip)
    head, tail = F.split(F.substring_index(low, "::", 1), ":"), F.split(F.substring_index(low, "::", -1), ":")
    short = low.contains("::")
    clean = lambda groups: F.filter(groups, lambda g: g != "")
    head, tail = clean(head), F.when(short, clean(tail)).otherwise(F.array().cast("array<string>"))
    gap = F.lit(8) - F.size(head) - F.size(tail)
    zeros = F.when(gap > 0, F.array_repeat(F.lit("0"), gap.cast("int"))).otherwise(F.array().cast("array<string>"))
    groups = F.concat(head, zeros, tail)
    valid = low.rlike(r"^[0-9a-f:]+$") & (F.size(groups) == 8) & (short | (F.size(head) == 8)) & F.forall(groups, lambda g: F.length(g) <= 4)
    return F.when(valid, F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), ""))


#: Ranges of IPv4 numbers that aren't public: private, loopback, link-local, this network, shared, reserved and documentation.
SPECIAL_RANGES = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16",
    "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
)


def cidr_bounds(cidr: str) -> tuple[int, int]:
    address, bits = cidr.split("/")
    low = int.from_bytes(bytes(map(int, address.split("."))), "big")
    return low, low + (1 << (32 - int(bits))) - 1


def is_public(ip: Column, ranges=("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16")) -> Column:
    """Not private, loopback or link-local (pass ``SPECIAL_RANGES`` for all reserved ranges); false if it can't be read."""
    number, key = ipv4_number(ip), ipv6_key(ip)
    inside = reduce(lambda a, b: a | b, (number.between(*cidr_bounds(c)) for c in ranges))
    inside6 = key.rlike("^(f[cd]|fe[89ab]|0{31}[01]$)")
    return F.coalesce(F.when(number.isNotNull(), ~inside).when(key.isNotNull(), ~inside6), F.lit(False))


def has_private_prefix(ip: Column) -> Column:
    return ip.rlike(r"^(192\.168\.|10\.|172\.)")


def subnet24(ip: Column) -> Column:
    return F.substring_index(ip, ".", 3)


def asn_digits(text: Column) -> Column:
    """The digits of an AS number with or without its prefix; null if there are none."""
    return F.nullif(F.regexp_replace(text, r"\D", ""), F.lit(""))


def asn_prefix(text: Column) -> Column:
    """The number after a leading ``AS``."""
    return F.nullif(F.regexp_extract(text, r"^AS(\d+)", 1), F.lit(""))


def threat_level(hostname: Column, organization: Column) -> Column:
    org, host = F.lower(F.coalesce(organization, F.lit(""))), F.lower(F.coalesce(hostname, F.lit("")))
    return F.when(org.rlike("tor|proxy|vpn"), "medium").when(host.rlike("malware|botnet|spam"), "high").otherwise("low")


def split_location(text: Column) -> tuple[Column, Column]:
    """Latitude and longitude of ``lat,lon``; null where missing."""
    parts = F.split(text, ",")
    return tuple(F.try_element_at(parts, F.lit(k)).try_cast("double") for k in (1, 2))


# ---- labels


def port_application(port: Column) -> Column:
    return lookup(port, tables.PORT_APPLICATION, "Unknown")


def port_protocol(port: Column, live: bool = False) -> Column:
    return lookup(port, tables.PORT_PROTOCOL_LIVE if live else tables.PORT_PROTOCOL, "TCP")


def application_category(application: Column) -> Column:
    return lookup(application, tables.APPLICATION_CATEGORY, "Other")


def port_label(port: Column) -> Column:
    apps = lookup(port, {k: v[0] for k, v in tables.PORT_LABELS.items()})
    categories = lookup(port, {k: v[1] for k, v in tables.PORT_LABELS.items()})
    return F.when(apps.isNotNull(), F.struct(apps.alias("app"), categories.alias("category")))


def ranked_label(conditions, labels) -> Column:
    """The label of the first true condition. The conditions give a number and the labels are one literal, which keeps
    the generated code of a hundred rules small enough to compile."""
    place = first_match((condition, F.lit(k)) for k, condition in enumerate(conditions, 1))
    return F.try_element_at(F.array(*(label(a, c) for a, c in labels)), place)


def host_label(host: Column) -> Column:
    low = F.lower(host)
    return ranked_label((low.rlike(p) for p, _, _ in tables.HOST_PATTERNS), [(a, c) for _, a, c in tables.HOST_PATTERNS])


def address_label(ip: Column, longest: bool = False) -> Column:
    """The first listed prefix that fits, or with ``longest`` the longest one, so that no entry is hidden by a shorter one."""
    rules = sorted(tables.ADDRESS_PREFIXES, key=lambda r: -len(r[0])) if longest else tables.ADDRESS_PREFIXES
    return ranked_label((ip.startswith(p) for p, _, _ in rules), [(a, c) for _, a, c in rules])


def classify_flow(host: Column, port: Column, ip: Column, protocol: Column, by_host: Column | None = None, by_ip: Column | None = None) -> Column:
    """Struct (app, category, confidence): host name, then port, then address prefix, then protocol.

    A port match is of high confidence if a host name was given, even one that no pattern fits. ``by_host`` and
    ``by_ip`` are the labels of host and address where they are known already.
    """
    named = F.coalesce(host, F.lit("")) != ""
    by_host, by_port, by_ip = F.when(named, host_label(host) if by_host is None else by_host), port_label(port), address_label(ip) if by_ip is None else by_ip
    web = lambda p, n: (F.coalesce(port, F.lit(0)) == n) | (F.coalesce(protocol, F.lit("")) == p)
    default = F.when(web("HTTPS", 443), label("HTTPS", "Web")).when(web("HTTP", 80), label("HTTP", "Web"))
    default = default.when(F.coalesce(protocol, F.lit("")) != "", F.struct(protocol.alias("app"), F.lit("Network").alias("category")))
    found = F.coalesce(by_host, by_port, by_ip, default, label("Unknown", "Uncategorized"))
    sure = F.when(by_host.isNotNull(), "high").when(by_port.isNotNull(), F.when(named, "high").otherwise("medium")).otherwise("low")
    return F.struct(found["app"].alias("app"), found["category"].alias("category"), sure.alias("confidence"))


def merge_labels(first: Column, second: Column) -> Column:
    """Each field of ``first`` (app, category, confidence), filled from ``second`` where missing."""
    return F.struct(*(F.coalesce(first[n], second[n]).alias(n) for n in ("app", "category", "confidence")))


# ---- devices


def device_type_of_address(ip: Column) -> Column:
    return F.when(ip.endswith(".1"), "router").when(ip.startswith("192.168."), "computer").otherwise("device")


def device_of_agent(agent: Column, strict: bool = False) -> tuple[Column, Column]:
    """Device type and operating system of a user agent; the first that fits wins, so Android counts as Linux.

    With ``strict`` the systems whose names hold another's come first: Android before Linux, iOS before macOS.
    """
    low = F.lower(F.coalesce(agent, F.lit("")))
    kind = F.when(low.contains("ipad"), "tablet").when(low.rlike("mobile|android|iphone"), "phone").when(low.rlike("windows|macintosh|linux"), "laptop")
    system = F.when(low.contains("windows"), "Windows").when(low.rlike("macintosh|mac os"), "macOS").when(low.contains("linux"), "Linux")
    system = system.when(low.contains("android"), "Android").when(low.rlike("iphone|ipad"), "iOS")
    if strict:
        system = F.when(low.contains("android"), "Android").when(low.rlike("iphone|ipad"), "iOS").when(low.contains("windows"), "Windows")
        system = system.when(low.rlike("macintosh|mac os"), "macOS").when(low.contains("linux"), "Linux")
    return kind.otherwise("unknown"), system.otherwise("unknown")


def pseudo_mac(ip: Column) -> Column:
    """The first 12 hex digits of the address's md5, in pairs."""
    return F.regexp_replace(F.substring(F.md5(ip.cast("binary")), 1, 12), r"(..)(?=.)", "$1:")


# ---- numbers and JSON


def percent_change(now: Column, before: Column) -> Column:
    return F.when(before > 0, F.round((now - before) / before * 100, 2)).otherwise(F.lit(0.0))


def ratio(part: Column, whole: Column, scale: float = 1.0) -> Column:
    return F.when(whole > 0, F.round(part / whole * scale, 2)).otherwise(F.lit(0.0))


def json_list(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def json_map(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


# ---- pages


def visible_text(html: Column) -> Column:
    """Text without scripts, styles and tags. By expression, so malformed markup may differ from a document parser."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    return F.regexp_replace(bare, r"(?s)<[^>]*>", " ")


def page_features(html: Column) -> dict[str, Column]:
    tag = lambda name: F.regexp_count(html, F.lit(rf"(?i)<{name}\b"))
    metas = F.regexp_extract_all(html, F.lit(r"(?is)(<meta\b[^>]*>)"), 1)
    described = F.filter(metas, lambda m: m.rlike(r"""(?is)\bname\s*=\s*["']description["']""") & m.rlike(r"(?is)\bcontent\s*="))
    content = F.regexp_extract(F.try_element_at(described, F.lit(1)), r"""(?is)\bcontent\s*=\s*(["'])(.*?)\1""", 2)
    return {
        "title": F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit("")),
        "meta_description": F.nullif(content, F.lit("")),
        "images_count": tag("img"), "links_count": tag("a"), "forms_count": tag("form"), "scripts_count": tag("script"),
    }


def summary(text: Column, size: int = 200) -> Column:
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(clean) > size, F.concat(F.substring(clean, 1, size), F.lit("..."))).otherwise(clean)


def _present(text: Column, words) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a + b, (low.contains(w).cast("int") for w in words))


def language(text: Column) -> Column:
    return F.when(_present(text, tables.ENGLISH_WORDS) > 3, "en").otherwise("unknown")


def sentiment(text: Column) -> Column:
    good, bad = _present(text, tables.POSITIVE_WORDS), _present(text, tables.NEGATIVE_WORDS)
    return F.when(good + bad > 0, (good - bad) / (good + bad)).otherwise(F.lit(0.0))


# ---- payloads


def payload_label(payload: Column, protocol: Column, port: Column) -> Column:
    """Struct (app, confidence, encrypted) of a packet.

    TCP payloads: an HTTP verb anywhere over a TLS prefix over signatures (the last application wins) over the port; UDP:
    the port alone. A TLS handshake or an SSH banner marks the packet as encrypted. ``payload`` has a character for a byte.
    """
    text = F.when(protocol == "TCP", F.coalesce(payload, F.lit(""))).otherwise(F.lit(""))
    has = lambda patterns: reduce(lambda a, b: a | b, (text.contains(p) for p in patterns))
    signatures = {app: patterns for app, patterns, _ in tables.PAYLOAD_SIGNATURES}
    hidden = has(signatures["https"] + signatures["ssh"])
    result = lambda app, sure: F.struct(app.alias("app"), F.lit(sure).alias("confidence"), hidden.alias("encrypted"))
    signed = first_match((has(p), result(F.lit(app.upper()), 0.9)) for app, p in reversed(signatures.items()))
    by_port = lookup(port, tables.PAYLOAD_PORTS)
    ported = F.when(by_port.isNotNull(), F.when(protocol == "UDP", result(by_port, 0.8)).when(protocol == "TCP", result(by_port, 0.7)))
    verb = F.when(has(signatures["http"]), result(F.lit("HTTP"), 0.95))
    handshake = F.when(text.startswith("\x16\x03"), result(F.lit("HTTPS"), 0.95))
    return F.coalesce(verb, handshake, signed, ported, result(F.lit("Unknown"), 0.0))


def http_fields(payload: Column) -> dict[str, Column]:
    """Method and url of the request line, and the Host and User-Agent fields; null where missing."""
    field = lambda name: F.nullif(F.trim(F.regexp_extract(payload, rf"\r\n{name}: ([^\r\n]*)", 1)), F.lit(""))
    part = lambda k: F.nullif(F.regexp_extract(payload, r"^([^ \r]+) ([^ \r]+) [^\r]", k), F.lit(""))
    return {"method": part(1), "url": part(2), "host": field("Host"), "user_agent": field("User-Agent")}
