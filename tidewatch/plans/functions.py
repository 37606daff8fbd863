"""Queries of functions and small detectors over made-up rows, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import indicators, ip, names
from tidewatch.operators import alerts, detectors, host, live

from . import views
from .network import DAY, query
from .views import ALERTS_SQL, PACKETS_SQL


def _listed(values: tuple[str, ...], by: str = "seq") -> str:
    """An expression for both engines: one of the values by a number."""
    quoted = ["'" + v.replace("'", "''") + "'" for v in values]
    return f"CASE {by} % {len(values)} " + " ".join(f"WHEN {i} THEN {q}" for i, q in enumerate(quoted)) + " END"


def _spark(values: tuple[str, ...], by: str = "seq"):
    """The same for Spark, whose texts read backslashes."""
    out = F.lit(values[0])
    for i, v in reversed(list(enumerate(values))):
        out = F.when(F.col(by) % len(values) == i, F.lit(v)).otherwise(out)
    return out


# addresses ---------------------------------------------------------------------------------------------------------------

_FIRST = (10, 127, 169, 172, 192, 198, 203, 224, 240, 100, 0, 8)
_ADDRESS = "concat(cast({a} AS STRING), '.', cast({b} AS STRING), '.', cast(seq * 13 % 256 AS STRING), '.', cast(seq * 31 % 256 AS STRING))".format(
    a="CASE seq % 12 " + " ".join(f"WHEN {i} THEN {n}" for i, n in enumerate(_FIRST)) + " END", b="CASE seq % 5 WHEN 0 THEN 168 WHEN 1 THEN 254 WHEN 2 THEN 0 WHEN 3 THEN 18 ELSE seq * 7 % 256 END"
)
_RANGES = (
    ("loopback", 127 << 24, (128 << 24) - 1), ("link_local", (169 << 24) + (254 << 16), (169 << 24) + (255 << 16) - 1), ("multicast", 224 << 24, (240 << 24) - 1),
    *(("private", lo, hi) for lo, hi in ((0, (1 << 24) - 1), (10 << 24, (11 << 24) - 1), ((172 << 24) + (16 << 16), (172 << 24) + (32 << 16) - 1), (192 << 24, (192 << 24) + 7), ((192 << 24) + 170, (192 << 24) + 171), ((192 << 24) + 512, (192 << 24) + 767),
      ((192 << 24) + (168 << 16), (192 << 24) + (169 << 16) - 1), ((198 << 24) + (18 << 16), (198 << 24) + (20 << 16) - 1), ((198 << 24) + (51 << 16) + (100 << 8), (198 << 24) + (51 << 16) + (101 << 8) - 1), ((203 << 24) + (113 << 8), (203 << 24) + (114 << 8) - 1), (240 << 24, (1 << 32) - 1))),
)


@query(f"""
WITH {PACKETS_SQL}, a AS (SELECT seq, {_ADDRESS} AS address FROM packets),
n AS (SELECT *, list_reduce(list_transform(string_split(address, '.'), lambda x: x::BIGINT), lambda p, x: p * 256 + x) AS n FROM a),
c AS (SELECT *, CASE {" ".join(f"WHEN n BETWEEN {lo} AND {hi} THEN '{k}'" for k, lo, hi in _RANGES)} ELSE 'public' END AS class FROM n)
SELECT seq, address, class, class = 'public' AND NOT n BETWEEN {(100 << 24) + (64 << 16)} AND {(100 << 24) + (128 << 16) - 1} AS is_global, n % 256 = 255 OR class = 'multicast' AS to_many,
  CASE WHEN seq % 3 = 0 THEN array_to_string(list_reverse(string_split(address, '.')), '.') END AS reversed,
  CASE WHEN address LIKE '10.%' THEN 'outbound' WHEN seq % 2 = 0 THEN 'inbound' ELSE 'transit' END AS direction, CASE WHEN address LIKE '10.%' AND seq % 2 = 1 THEN '9.9.9.9' WHEN address NOT LIKE '10.%' AND seq % 2 = 0 THEN address END AS remote FROM c WHERE NOT (address LIKE '10.%' AND seq % 2 = 0)""")
def address_tests(spark, sf_dir):
    a = views.packets(spark, sf_dir).select("seq", F.expr(_ADDRESS).alias("address"))
    arpa = F.when(F.col("seq") % 3 == 0, F.concat("address", F.lit(".IN-ADDR.arpa.")))
    local = F.when(F.col("address").startswith("10."), "own").otherwise(F.col("address"))
    other = F.when(F.col("seq") % 2 == 0, "own").otherwise("9.9.9.9")
    rows = a.withColumns({"src": local, "dst": other}).filter("not (src = 'own' and dst = 'own')")
    return rows.select(
        "seq", "address", ip.classify(F.col("address")).alias("class"), ip.is_global(F.col("address")).alias("is_global"), ip.is_multicast_or_broadcast(F.col("address")).alias("to_many"), ip.from_arpa(arpa).alias("reversed"),
        ip.direction(F.col("src"), F.col("dst"), ["own"]).alias("direction"), ip.remote(F.col("src"), F.col("dst"), ["own"]).alias("remote"),
    )


# names ---------------------------------------------------------------------------------------------------------------------

_ZONES = ("www.shop.co.uk", "a.b.example.com", "x.gov.de", "deep.sub.or.jp", "one", "Mixed.Case.ORG.", "news.com.au", "b.co")


@query(rf"""
WITH {PACKETS_SQL}, l AS (SELECT seq, substr(md5(seq::VARCHAR), 1, 8 + (seq % 20)::INT) AS label, {_listed(_ZONES)} AS name FROM packets),
c AS (SELECT seq, label, unnest(string_split(label, '')) AS ch FROM l), f AS (SELECT seq, ch, count(*) / any_value(length(label)) AS q FROM c GROUP BY seq, ch), h AS (SELECT seq, sum(-q * log2(q)) AS entropy FROM f GROUP BY seq),
w AS (SELECT *, list_sum(list_transform(range(1, length(label)), lambda i: ((label[i] BETWEEN '0' AND '9') <> (label[i + 1] BETWEEN '0' AND '9'))::INT))::INT AS switches, string_split(rtrim(lower(name), '.'), '.') AS p FROM l)
SELECT seq, label, switches, length(label) >= 16 AND round(entropy, 9) >= 3.5 AND switches >= greatest(3, length(label) // 6) AS encoded,
  CASE WHEN len(p) >= 3 AND length(p[-1]) = 2 AND p[-2] IN ('co', 'com', 'net', 'org', 'gov', 'edu', 'ac', 'or', 'ne', 'go') THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END AS by_zone,
  CASE WHEN array_to_string(p[-2:], '.') IN ('co.uk', 'or.jp', 'com.au') THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END AS by_list FROM w JOIN h USING (seq)""")
def name_tests(spark, sf_dir):
    r = views.packets(spark, sf_dir).select("seq", F.expr("substr(md5(cast(cast(seq AS STRING) AS BINARY)), 1, 8 + cast(seq % 20 AS INT))").alias("label"), _spark(_ZONES).alias("name"))
    return r.select("seq", "label", names.class_switches(F.col("label")).alias("switches"), names.looks_encoded(F.col("label")).alias("encoded"), names.registered_domain_by_zone(F.col("name")).alias("by_zone"), names.registered_domain(F.col("name")).alias("by_list"))


_ASKED = ("mail.example.org", "a1b2c3d4e5f6g7h8i9j0.t.example.org", "x." + "long-part-" * 6 + ".example.net", "www.shop.co.uk", "q9w8e7r6t5z4u3i2o1p0.evil.co.uk", "deadbeef-dead-beef-dead-beefdeadbeef.example.org")


@query(f"""
WITH {PACKETS_SQL}, q AS (SELECT seq, {_listed(_ASKED)} AS name FROM packets)
SELECT seq, name, CASE WHEN name LIKE 'a1b2%' OR name LIKE 'x.long%' THEN array_to_string(string_split(name, '.')[-2:], '.') ELSE 'evil.co.uk' END AS domain, CASE WHEN name LIKE 'x.long%' THEN 'long' ELSE 'encoded' END AS reason FROM q WHERE name LIKE 'a1b2%' OR name LIKE 'x.long%' OR name LIKE 'q9w8%'""")
def encoded_names(spark, sf_dir):
    return detectors.encoded_names(views.packets(spark, sf_dir).select("seq", _spark(_ASKED).alias("name"))).select("seq", "name", "domain", "reason")


def _subdomains(p):
    return p.select("seq", "ts_us", F.concat(F.lit("h"), F.col("dst_port").cast("string"), F.lit(".z"), (F.col("bytes") % 40).cast("string"), F.lit(".org")).alias("name"))


@query(f"""
WITH RECURSIVE {PACKETS_SQL}, e AS (SELECT 'z' || bytes % 40 || '.org' AS domain, dst_port AS v, ts_us, seq FROM packets),
a AS (SELECT domain, min(ts_us) AS t FROM e GROUP BY domain UNION ALL SELECT a.domain, min(e.ts_us) FROM a JOIN e ON e.domain = a.domain AND e.ts_us > a.t + {2 * DAY} GROUP BY a.domain, a.t),
w AS (SELECT e.*, a.t FROM e JOIN a ON e.domain = a.domain AND e.ts_us BETWEEN a.t AND a.t + {2 * DAY}),
f AS (SELECT *, row_number() OVER (PARTITION BY domain, t, v ORDER BY ts_us, seq) AS nth FROM w),
d AS (SELECT *, count(*) FILTER (nth = 1) OVER (PARTITION BY domain, t ORDER BY ts_us, seq) AS names FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY domain, t ORDER BY ts_us, seq) AS n FROM d WHERE names >= 12)
SELECT domain, ts_us, seq, names::INT AS names FROM r WHERE n = 1""")
def many_subdomains(spark, sf_dir):
    return detectors.many_subdomains(_subdomains(views.packets(spark, sf_dir)), 12, 2 * DAY)


# indicators ------------------------------------------------------------------------------------------------------------------

_MASKED = ("hxxps://a[.]example[dot]org/x", "me[at]b (dot) org", "h**p://1[.]2[.]3[.]4", "fxp://files{.}example{.}net", "plain text", "x[:]//y [.] z")
_TOKENS = ("http://a.b/c?d=1", "me@example.org", "10.1.2.3", "2001:db8::1", "CVE-2024-12345", "AS13335", "d41d8cd98f00b204e9800998ecf8427e", "a" * 40, "0" * 64, "sub.example.org", "setup.exe", "hello", "300.1.1.1", "cve-99-1")


@query(rf"""
WITH {PACKETS_SQL}, m AS (SELECT seq, {_listed(_MASKED)} AS masked, {_listed(_TOKENS)} AS token FROM packets),
r AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(masked, '\bh(?:xx|\*\*)p(s?)\b', 'http\1', 'gi'), '\bfxp\b', 'ftp', 'gi'), '\s?[\[({{]\s?(?:\.|dot)\s?[\])}}]\s?', '.', 'gi'), '\s?[\[({{]\s?(?:@|at)\s?[\])}}]\s?', '@', 'gi'), '[\[({{]\s?:\s?[\])}}]', ':', 'g'), '[\[({{]\s?://\s?[\])}}]', '://', 'g'), '[\[({{]\s?/\s?[\])}}]', '/', 'g') AS plain FROM m),
k AS (SELECT *, CASE seq % {len(_TOKENS)} WHEN 0 THEN 'url' WHEN 1 THEN 'email' WHEN 2 THEN 'ipv4' WHEN 3 THEN 'ipv6' WHEN 4 THEN 'cve' WHEN 5 THEN 'asn' WHEN 6 THEN 'md5' WHEN 7 THEN 'sha1' WHEN 8 THEN 'sha256' WHEN 9 THEN 'domain' END AS kind FROM r)
SELECT seq, plain, kind, CASE kind WHEN 'url' THEN replace(regexp_replace(token, '^http', 'hxxp'), '.', '[.]') WHEN 'email' THEN replace(replace(token, '.', '[.]'), '@', '[@]') WHEN 'ipv6' THEN replace(token, ':', '[:]') WHEN 'ipv4' THEN replace(token, '.', '[.]') WHEN 'domain' THEN replace(token, '.', '[.]') ELSE token END AS shown FROM k""")
def indicator_forms(spark, sf_dir):
    r = views.packets(spark, sf_dir).select("seq", _spark(_MASKED).alias("masked"), _spark(_TOKENS).alias("token"))
    kind = indicators.kind_of(F.col("token"))
    return r.select("seq", indicators.refang(F.col("masked")).alias("plain"), kind.alias("kind"), indicators.defang(F.col("token"), kind).alias("shown"))


_LINKS = (
    "https://www.google.com/url?q=https%3A%2F%2Fbit.ly%2Fz&x=1", "http://10.1.2.3/a", "https://user@example.org/", "https://xn--pple-43d.com/", "https://paypa1.com/login", "https://example.org/", "https://l.facebook.com/l.php?u=http%3A%2F%2Fa.example",
    "https://amaz0n-login.net/", "https://paypal.com/", "https://gogle.com/",
)


@query(f"""
WITH {PACKETS_SQL}, l AS (SELECT seq, {_listed(_LINKS)} AS link, seq % {len(_LINKS)} AS k FROM packets)
SELECT seq, CASE k WHEN 0 THEN 'https://bit.ly/z' WHEN 6 THEN 'http://a.example' ELSE link END AS url,
  CASE k WHEN 0 THEN 'unwrapped' WHEN 1 THEN 'ip_literal' WHEN 2 THEN 'userinfo' WHEN 3 THEN 'punycode' WHEN 4 THEN 'lookalike' WHEN 6 THEN 'unwrapped' WHEN 7 THEN 'lookalike' WHEN 9 THEN 'lookalike' ELSE '' END AS flags,
  CASE k WHEN 4 THEN 'paypal' WHEN 7 THEN 'amazon' WHEN 9 THEN 'google' END AS brand FROM l""")
def link_tests(spark, sf_dir):
    link = views.packets(spark, sf_dir).select("seq", _spark(_LINKS).alias("link"))
    return link.select("seq", indicators.unwrap(F.col("link")).alias("url"), F.array_join(indicators.link_flags(F.col("link")), ",").alias("flags"), indicators.imitated_brand(names.host_of(F.col("link"))).alias("brand"))


# detectors -------------------------------------------------------------------------------------------------------------------

_URIS = ("/search?q=1%27+or+%271%27%3D%271", "/a?x=%3Cscript%3Ealert(1)", "/../../etc/passwd", "/plain?id=7", "/%2e%2e/secret", "/x?y=1 UNION SELECT name")


@query(f"""
WITH {PACKETS_SQL}, r AS (SELECT seq, {_listed(_URIS)} AS uri, CASE WHEN dst_port % 4 = 0 THEN 'sqlmap/1.7' ELSE 'browser' END AS agent, seq % {len(_URIS)} AS k FROM packets)
SELECT seq, uri, 'sql_injection' AS attack, 4 AS severity FROM r WHERE k IN (0, 5) UNION ALL SELECT seq, uri, 'script_injection', 3 FROM r WHERE k = 1 UNION ALL SELECT seq, uri, 'path_traversal', 3 FROM r WHERE k IN (2, 4) UNION ALL SELECT seq, uri, 'scanner', 1 FROM r WHERE agent LIKE 'sqlmap%'""")
def web_attacks(spark, sf_dir):
    p = views.packets(spark, sf_dir).select("seq", _spark(_URIS).alias("uri"), F.when(F.col("dst_port") % 4 == 0, "sqlmap/1.7").otherwise("browser").alias("user_agent"))
    return detectors.web_attacks(p).select("seq", "uri", "attack", "severity")


@query(f"""
WITH {PACKETS_SQL}, h AS (SELECT seq, ts_us, src_ip, CASE WHEN dst_port % 3 = 0 THEN 'ads.track.example' WHEN dst_port % 3 = 1 THEN 'track.example' ELSE 'example.org' END AS host FROM packets)
SELECT src_ip, host, min(ts_us) AS ts_us, arg_min(seq, (ts_us, seq)) AS seq, 'ads' AS category FROM h WHERE host LIKE '%track.example' GROUP BY src_ip, host""")
def tracker_contacts(spark, sf_dir):
    name = F.when(F.col("dst_port") % 3 == 0, "ads.track.example").when(F.col("dst_port") % 3 == 1, "track.example").otherwise("example.org")
    p = views.packets(spark, sf_dir).select("seq", "ts_us", "src_ip", name.alias("host"))
    return detectors.tracker_hits(p, spark.createDataFrame([(".track.example", "ads")], "domain string, category string"))


@query(f"""
WITH {PACKETS_SQL}, a AS (SELECT seq, CASE seq % 4 WHEN 0 THEN '192.168.0.7' WHEN 1 THEN '127.0.0.1' WHEN 2 THEN '169.254.9.9' ELSE '8.8.4.4' END AS address FROM packets)
SELECT seq, address, CASE WHEN address = '8.8.4.4' THEN 'reflexive' ELSE 'leak' END AS finding, CASE WHEN address = '8.8.4.4' THEN 1 ELSE 3 END AS severity FROM a""")
def address_leaks(spark, sf_dir):
    return detectors.address_leaks(views.packets(spark, sf_dir).select("seq", _spark(("192.168.0.7", "127.0.0.1", "169.254.9.9", "8.8.4.4")).alias("address")))


_OWN_RULES = (("REC-1", True), ("CRED-1", True), ("C2-1", False), ("NEVER", True))


@query(f"""
WITH {ALERTS_SQL}, r(rule_id, enabled) AS (VALUES ('REC-1', true), ('CRED-1', true), ('C2-1', false), ('NEVER', true)), h AS (SELECT rule_id, count(*) AS n, max(ts_us) AS t FROM alerts GROUP BY rule_id)
SELECT r.rule_id, coalesce(n, 0) AS hits, t AS last_us, CASE WHEN NOT enabled THEN 'disabled' WHEN n > 0 THEN 'active' ELSE 'quiet' END AS status FROM r LEFT JOIN h USING (rule_id)""")
def rule_counts(spark, sf_dir):
    r = spark.createDataFrame(list(_OWN_RULES), "rule_id string, enabled boolean")
    return alerts.rule_stats(r, views.alerts(spark, sf_dir)).select("rule_id", "hits", "last_us", "status")


_EXES = ("/tmp/a/run", "/usr/bin/ssh", "/Applications/A.app/a", "/Users/x/Downloads/get", "/opt/homebrew/bin/t")


@query(f"""
WITH {PACKETS_SQL}, e AS (SELECT seq, ts_us, dst_ip, {_listed(_EXES)} AS exe, CASE WHEN seq % 2 = 0 THEN 'unsigned' ELSE 'developer_id' END AS status FROM packets WHERE dst_ip IN ('93.184.216.34', '151.101.1.69')),
a AS (SELECT *, exe LIKE '/tmp/%' OR exe LIKE '%Downloads%' AS odd FROM e WHERE exe NOT LIKE '/usr/bin/%'),
r AS (SELECT *, CASE WHEN odd THEN CASE status WHEN 'unsigned' THEN 3 ELSE 1 END WHEN status = 'unsigned' AND exe NOT LIKE '/opt/%' THEN 1 ELSE 0 END AS risk FROM a)
SELECT exe, min(ts_us) AS ts_us, arg_min(seq, (ts_us, seq)) AS seq, arg_min(risk, (ts_us, seq)) AS risk FROM r WHERE risk > 0 GROUP BY exe""")
def risky_programs(spark, sf_dir):
    p = views.packets(spark, sf_dir).select("seq", "ts_us", "dst_ip", _spark(_EXES).alias("exe"), F.when(F.col("seq") % 2 == 0, "unsigned").otherwise("developer_id").alias("status"))
    return detectors.risky_programs(p).select("exe", "ts_us", "seq", "risk")


_PLACES = ("/tmp/x", "/Applications/A.app/a", "/usr/bin/cron", "/gone/x", "/Users/u/Downloads/y")
_SIGNED = ("unsigned", "developer_id", "apple", "adhoc", "invalid")


@query(f"""
WITH i AS (SELECT o_orderkey, {list(_PLACES)}[1 + o_orderkey % 5] || o_orderkey % 700 AS path, {list(_SIGNED)}[1 + o_orderkey // 5 % 5] AS status, o_custkey AS modified_us, o_orderkey % 5 IN (0, 4) AS odd FROM orders),
f AS (SELECT DISTINCT path FROM i WHERE o_orderkey % 700 % 3 <> 0),
r AS (SELECT *, CASE WHEN status = 'invalid' THEN 3 WHEN odd THEN CASE WHEN status IN ('unsigned', 'adhoc') THEN 3 ELSE 1 END WHEN status IN ('unsigned', 'adhoc') THEN 1 ELSE 0 END AS risk FROM i)
SELECT 'l' || o_orderkey AS label, array_to_string(list_concat(list_concat(CASE WHEN odd THEN ['odd_path'] ELSE [] END, CASE status WHEN 'invalid' THEN ['invalid_signature'] WHEN 'unsigned' THEN ['unsigned'] WHEN 'adhoc' THEN ['adhoc'] ELSE [] END), CASE WHEN f.path IS NULL THEN ['missing_program'] ELSE [] END), ',') AS flags, risk
FROM r LEFT JOIN f ON f.path = r.path""")
def launch_items(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (n % 5 + 1).cast("int"))
    key = F.col("o_orderkey").cast("long")
    path = F.concat(pick(_PLACES, key), (key % 700).cast("string"))
    items = o.select(F.concat(F.lit("l"), key.cast("string")).alias("label"), path.alias("path"), pick(_SIGNED, F.floor(key / 5)).alias("status"), F.col("o_custkey").alias("modified_us"))
    files = o.filter("o_orderkey % 700 % 3 <> 0").select(path.alias("path"))
    return host.launch_items(items, files).select("label", F.array_join("flags", ",").alias("flags"), "risk")


@query(f"""
WITH {PACKETS_SQL}, f AS (SELECT DISTINCT src_ip, dst_ip FROM packets), k(ip, remote_host, country) AS (VALUES ('10.0.0.3', 'three.example', NULL), ('93.184.216.34', NULL, 'US'), ('10.0.1.7', 'seven.example', 'DE'))
SELECT src_ip, dst_ip, coalesce(d.remote_host, s.remote_host) AS remote_host, coalesce(d.country, s.country) AS country FROM f LEFT JOIN k d ON d.ip = dst_ip LEFT JOIN k s ON s.ip = src_ip""")
def flow_names(spark, sf_dir):
    known = spark.createDataFrame([("10.0.0.3", "three.example", None), ("93.184.216.34", None, "US"), ("10.0.1.7", "seven.example", "DE")], "remote_ip string, remote_host string, country string")
    return live.flow_names(views.packets(spark, sf_dir).select("src_ip", "dst_ip").distinct(), known)
