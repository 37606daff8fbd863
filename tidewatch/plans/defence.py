"""Queries of intelligence, allowlists, the host inspector and the sinks, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import host, intel, lookalikes
from tidewatch.sinks import alerts as sinks
from tidewatch.sources import pages

from . import views
from .live import _TAGGED_SQL, tagged
from .network import DAY, query
from .views import ALERTS_SQL, HOUR, PACKETS_SQL, rows_sql

_NUMBER = "list_reduce(list_transform(string_split({}, '.'), lambda x: x::BIGINT), lambda a, x: a * 256 + x)"


def _now(df):
    return df.agg(F.max("ts_us")).first()[0]


# intelligence ------------------------------------------------------------------------------------------------------------

_LOAD_1 = (("10.0.0.0/24", "scanner"), ("93.184.216.34", "c2"), ("10.0.1.0/24", "old"))
_LOAD_2 = (("10.0.1.0/24", "new"), ("10.0.0.16/28", "proxy"))
_BAD_NAMES = ((".h3.example.net", "tracker"), ("h7.example.net", "malware"), (".example.org", "phishing"))
_SEEN = {
    "query_name": "CASE WHEN dst_port % 10 < 5 THEN concat('h', cast(dst_port % 10 AS STRING), '.example.net') END",
    "sni": "CASE WHEN bytes % 2 = 0 THEN concat('h', cast(dst_port % 10 AS STRING), '.example.net') WHEN bytes % 7 = 0 THEN 'a.H3.example.net' END",
    "host": "CASE WHEN bytes % 3 = 0 THEN 'www.example.org:8080' WHEN bytes % 5 = 0 THEN concat('H', cast(dst_port % 10 AS STRING), '.example.net') END",
}
_SEEN_SQL = PACKETS_SQL + ",\nseen AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in _SEEN.items()) + " FROM packets)"


def _seen(spark, sf_dir):
    return views.packets(spark, sf_dir).select("*", *(F.expr(v).alias(k) for k, v in _SEEN.items()))


def _addresses(spark):
    loads = [(spark.createDataFrame(list(rows), "cidr string, category string"), "cidr", "malicious", severity) for rows, severity in ((_LOAD_1, 3), (_LOAD_2, 4))]
    return intel.union(*loads)


def _domains(spark):
    return intel.union((spark.createDataFrame(list(_BAD_NAMES), "domain string, category string"), "domain", "malicious", 3))


@query("""
WITH u AS (SELECT lower(trim(' Host' || s_suppkey % 300 || '.Example.NET')) AS indicator, 0 AS no, 'supplier ' || s_nationkey AS category, 3 AS severity, '' AS description FROM supplier
  UNION ALL SELECT 'host' || c_custkey % 900 || '.example.net', 1, 'customer', 2 + c_nationkey % 3, c_mktsegment FROM customer
  UNION ALL SELECT 'host' || p_partkey % 50 || '.example.net', 2, 'part', 4, '' FROM part WHERE p_partkey % 2 = 0)
SELECT indicator, x.category, x.severity::INT AS severity, x.description FROM (SELECT indicator, max({'no': no, 'category': category, 'severity': severity, 'description': description}) AS x FROM u GROUP BY indicator)""")
def intel_union(spark, sf_dir):
    """Three loads whose indicators come again, within a load and in later ones."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    name = lambda key, n, form: F.format_string(form, (F.col(key) % n).cast("long"))
    one = read("supplier").select(name("s_suppkey", 300, " Host%d.Example.NET").alias("host"), F.concat(F.lit("supplier "), F.col("s_nationkey").cast("string")).alias("category"))
    two = read("customer").select(name("c_custkey", 900, "host%d.example.net").alias("host"), (2 + F.col("c_nationkey") % 3).alias("severity"), F.col("c_mktsegment").alias("description"))
    three = read("part").filter("p_partkey % 2 = 0").select(name("p_partkey", 50, "host%d.example.net").alias("host"))
    return intel.union((one, "host", "malicious", 3), (two, "host", "customer", 1), (three, "host", "part", 4))


@query(f"""
WITH {_SEEN_SQL}, {rows_sql(_LOAD_1, "la", "cidr", "category")}, {rows_sql(_LOAD_2, "lb", "cidr", "category")}, {rows_sql(_BAD_NAMES, "d", "domain", "category")},
n AS (SELECT cidr, category, CASE WHEN contains(cidr, '/') THEN split_part(cidr, '/', 2)::INT ELSE 32 END AS len, {_NUMBER.format("split_part(cidr, '/', 1)")} AS base
      FROM (SELECT * FROM la WHERE cidr NOT IN (SELECT cidr FROM lb) UNION ALL SELECT * FROM lb)),
i AS (SELECT seq, 'src_ip' AS field, src_ip AS value FROM packets UNION ALL SELECT seq, 'dst_ip', dst_ip FROM packets),
h AS (SELECT seq, field, value, arg_max(cidr, len) AS indicator, arg_max(category, len) AS category FROM (SELECT *, {_NUMBER.format("value")} AS x FROM i) JOIN n ON x >> (32 - len) = base >> (32 - len) GROUP BY seq, field, value),
low AS (SELECT seq, query_name AS q, lower(sni) AS s, lower(split_part(host, ':', 1)) AS w FROM seen),
f AS (SELECT seq, 'query_name' AS field, q AS value FROM low WHERE q IS NOT NULL UNION ALL SELECT seq, 'sni', s FROM low WHERE s IS NOT NULL AND s IS DISTINCT FROM q
      UNION ALL SELECT seq, 'host', w FROM low WHERE w IS NOT NULL AND w IS DISTINCT FROM q AND w IS DISTINCT FROM s),
m AS (SELECT seq, field, value, arg_max(domain, length(domain)) AS indicator, arg_max(category, length(domain)) AS category FROM f JOIN d ON (NOT starts_with(domain, '.') AND value = domain) OR (starts_with(domain, '.') AND (value = substr(domain, 2) OR ends_with(value, domain))) GROUP BY seq, field, value)
SELECT * FROM h UNION ALL SELECT * FROM m""")
def intel_checks(spark, sf_dir):
    return intel.checks(_seen(spark, sf_dir), _addresses(spark), _domains(spark)).select("seq", "field", "value", "indicator", "category")


_ALLOW = (
    (1, "attack", None, "error", None, "10.0.0.3"), (2, None, "exf-1", None, None, None), (3, "threat", None, None, "example.net", None),
    (4, None, None, "click", "h4.example.net", None), (5, "quic", None, None, None, None), (6, None, None, None, None, None),
)


def _values(rows):
    return ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in r) + ")" for r in rows)


@query(f"""
WITH {_TAGGED_SQL},
r(no, r_kind, r_rule, r_app, r_host, r_ip) AS (VALUES {_values(_ALLOW)}),
a AS (SELECT alert_id, kind, rule_id, app, src_ip, dst_ip, CASE WHEN alert_id % 3 = 0 THEN NULL ELSE 'h' || alert_id % 10 || '.example.net' END AS remote_host, alert_id % 2 = 0 AS unverified, CASE WHEN alert_id % 5 = 0 THEN 'h4.example.net' END AS query_name FROM tagged),
n AS (SELECT *, CASE WHEN unverified AND kind IN ('threat', 'attack', 'beacon', 'host') THEN query_name ELSE coalesce(remote_host, query_name) END AS host FROM a)
SELECT alert_id, min(no)::INT AS allowed_by FROM n LEFT JOIN r ON coalesce(r_kind, r_rule, r_app, r_host, r_ip) IS NOT NULL AND (r_kind IS NULL OR r_kind = kind) AND (r_rule IS NULL OR upper(r_rule) = upper(rule_id)) AND (r_app IS NULL OR r_app = app)
  AND (r_host IS NULL OR host = r_host OR ends_with(host, '.' || r_host)) AND (r_ip IS NULL OR r_ip IN (src_ip, dst_ip)) GROUP BY alert_id""")
def allowlist(spark, sf_dir):
    a = tagged(spark, sf_dir)
    name = F.concat(F.lit("h"), (F.col("alert_id") % 10).cast("string"), F.lit(".example.net"))
    a = a.withColumns({"remote_host": F.when(F.col("alert_id") % 3 != 0, name), "unverified": F.col("alert_id") % 2 == 0, "query_name": F.when(F.col("alert_id") % 5 == 0, "h4.example.net")})
    rules = spark.createDataFrame(list(_ALLOW), "rule_no int, kind string, rule_id string, app string, host string, ip string")
    return intel.allowed(a, rules).select("alert_id", "allowed_by")


@query(f"""
WITH {_SEEN_SQL},
s AS (SELECT src_ip AS ip, ts_us, seq, lower(coalesce(query_name, sni)) AS name, query_name IS NOT NULL AND bytes % 4 = 0 AS from_dns FROM seen WHERE coalesce(query_name, sni) IS NOT NULL),
v AS (SELECT *, max(from_dns::INT) OVER (PARTITION BY ip, name ORDER BY ts_us, seq) = 1 AS sure FROM s),
k AS (SELECT *, last_value(CASE WHEN sure THEN name END IGNORE NULLS) OVER (PARTITION BY ip ORDER BY ts_us, seq ROWS UNBOUNDED PRECEDING) AS known FROM v)
SELECT ip, ts_us, seq, coalesce(known, name) AS name, known IS NOT NULL AS verified FROM k""")
def learned_names(spark, sf_dir):
    s = _seen(spark, sf_dir)
    rows = s.select(F.col("src_ip").alias("ip"), "ts_us", "seq", F.coalesce("query_name", "sni").alias("name"), (F.col("query_name").isNotNull() & (F.col("bytes") % 4 == 0)).alias("from_dns"))
    return intel.learned_names(rows)


@query(f"""
WITH {PACKETS_SQL},
p AS (SELECT seq, ts_us, src_ip, protocol, CASE WHEN dst_port % 6 = 0 THEN '8.8.8.8' ELSE dst_ip END AS dst_ip, CASE WHEN dst_port % 5 = 0 THEN 853 ELSE 443 END AS port, CASE WHEN bytes % 11 = 0 THEN 'mask.icloud.com' WHEN bytes % 7 = 0 THEN 'Dns.Google.' END AS sni, CASE WHEN bytes % 13 = 0 THEN 'doh.my.org' END AS q, app = 'view' AS answer FROM packets),
m AS (SELECT *, CASE WHEN sni = 'mask.icloud.com' THEN 'relay' WHEN sni IS NOT NULL THEN CASE port WHEN 853 THEN 'dot' ELSE 'doh' END WHEN port = 853 THEN CASE protocol WHEN 'tcp' THEN 'dot' ELSE 'doq' END WHEN dst_ip = '8.8.8.8' THEN 'doh' WHEN q IS NOT NULL AND NOT answer THEN 'bootstrap' END AS method FROM p),
r AS (SELECT *, CASE WHEN method = 'relay' THEN 'relay' WHEN sni IS NOT NULL THEN 'dns.google' WHEN method = 'bootstrap' THEN q ELSE dst_ip END AS resolver FROM m WHERE method IS NOT NULL)
SELECT src_ip, resolver, method, min(ts_us) AS ts_us, arg_min(seq, (ts_us, seq)) AS seq, arg_min(dst_ip, (ts_us, seq)) AS dst_ip, CASE WHEN method IN ('bootstrap', 'relay') THEN 1 ELSE 2 END AS severity FROM r GROUP BY src_ip, resolver, method""")
def encrypted_lookups(spark, sf_dir):
    p = views.packets(spark, sf_dir)
    p = p.select(
        "seq", "ts_us", "src_ip", "protocol", F.when(F.col("dst_port") % 6 == 0, "8.8.8.8").otherwise(F.col("dst_ip")).alias("dst_ip"), F.when(F.col("dst_port") % 5 == 0, 853).otherwise(443).alias("dst_port"),
        F.when(F.col("bytes") % 11 == 0, "mask.icloud.com").when(F.col("bytes") % 7 == 0, "Dns.Google.").alias("sni"), F.when(F.col("bytes") % 13 == 0, "doh.my.org").alias("query_name"), (F.col("app") == "view").alias("is_response"),
    )
    return intel.encrypted_lookups(p, spark.createDataFrame([("doh.my.org",)], "host string"))


@query(f"""
WITH {PACKETS_SQL},
l AS (SELECT 'ipv4' AS kind, dst_ip AS value, CASE bytes % 9 WHEN 0 THEN 'malicious' WHEN 1 THEN 'clean' WHEN 2 THEN 'suspicious' WHEN 3 THEN 'info' WHEN 4 THEN 'odd' ELSE 'unknown' END AS verdict, ts_us FROM packets WHERE dst_port < 3),
k AS (SELECT *, CASE verdict WHEN 'malicious' THEN 4 WHEN 'suspicious' THEN 3 WHEN 'clean' THEN 2 WHEN 'info' THEN 1 ELSE 0 END AS r FROM l)
SELECT kind, value, ['unknown', 'info', 'clean', 'suspicious', 'malicious'][max(r) + 1] AS verdict, count(*) AS n, max(ts_us) AS last_us FROM k GROUP BY kind, value""")
def indicator_verdicts(spark, sf_dir):
    v = F.expr("CASE bytes % 9 WHEN 0 THEN 'malicious' WHEN 1 THEN 'clean' WHEN 2 THEN 'suspicious' WHEN 3 THEN 'info' WHEN 4 THEN 'odd' ELSE 'unknown' END")
    rows = views.packets(spark, sf_dir).filter("dst_port < 3").select(F.lit("ipv4").alias("kind"), F.col("dst_ip").alias("value"), v.alias("verdict"), "ts_us")
    return intel.verdicts(rows)


# host --------------------------------------------------------------------------------------------------------------------

_PROGRAMS = ("/Applications/Chat.app/Contents/MacOS/Chat", "/Applications/Chat.app/Contents/Helpers/Net", "/tmp/x/run", "/Users/a/.hidden/bin", "/usr/sbin/cupsd", "/opt/homebrew/bin/tool")
_SOCKET = {
    "pid": "cast(seq % 23 AS INT)",
    "proto": "protocol",
    "local_ip": "CASE dst_port % 4 WHEN 0 THEN '0.0.0.0' WHEN 1 THEN '127.0.0.1' WHEN 2 THEN '10.0.0.5' ELSE '169.254.1.1' END",
    "local_port": "CASE WHEN dst_port % 7 = 0 THEN 5353 ELSE dst_port END",
    "remote_ip": "CASE WHEN app = 'signup' THEN NULL WHEN dst_port % 9 = 0 THEN '127.0.0.1' ELSE dst_ip END",
    "listening": "app = 'signup'",
    "exe": "CASE seq % 7 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PROGRAMS)) + " ELSE '' END",
    "app": "concat('app', cast(seq % 7 AS STRING))",
    "status": "CASE seq % 7 WHEN 0 THEN 'developer_id' WHEN 1 THEN 'adhoc' WHEN 2 THEN 'unsigned' WHEN 3 THEN 'apple' WHEN 5 THEN 'unsigned' ELSE 'apple' END",
}
_SOCKETS_SQL = PACKETS_SQL + ",\nsockets AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in _SOCKET.items()) + """ FROM packets),
assessed AS (SELECT *, exe LIKE '/tmp/%' OR exe LIKE '%/.%' AS odd, exe LIKE '/opt/homebrew/%' AS tool FROM sockets),
rated AS (SELECT *, CASE WHEN exe = '' THEN 0 WHEN odd AND status IN ('unsigned', 'adhoc') THEN 3 WHEN odd THEN CASE WHEN status IN ('apple', 'developer_id') THEN 1 ELSE 2 END WHEN status IN ('unsigned', 'adhoc') AND NOT tool THEN 1 ELSE 0 END AS own_risk,
  list_filter([CASE WHEN exe <> '' AND odd THEN 'odd_path' END, CASE WHEN exe <> '' AND status IN ('unsigned', 'adhoc') THEN status END], lambda x: x IS NOT NULL) AS own_flags FROM assessed)"""
_KNOWN = (("93.184.216.34", "cdn.example.net", "US"), ("10.0.1.7", None, None))
_CALLS = (("93.184.216.34", 7, 3, True, False), ("151.101.1.69", 2, 4, False, True), ("10.0.1.7", 1, 2, True, False))
_INTEL = (("93.184.216.34", "c2"), ("10.0.1.7", "lan"))
_TAGS = (("151.101.1.69", "cdn"), ("198.51.100.20", "Botnet"))
_CONNECTED_SQL = _SOCKETS_SQL + f""",
known(remote_ip, remote_host, country) AS (VALUES {_values(_KNOWN)}), calls(ip, n, worst, beacon, c2) AS (VALUES {_values(_CALLS)}),
joined AS (SELECT r.*, k.remote_host, k.country, c.n, c.worst, coalesce(c.beacon, false) AS beacon, coalesce(c.c2, false) AS c2, r.remote_ip = '93.184.216.34' AS known_bad, r.remote_ip = '198.51.100.20' AS infra
  FROM rated r LEFT JOIN known k ON r.remote_ip = k.remote_ip LEFT JOIN calls c ON r.remote_ip = c.ip WHERE NOT listening AND r.remote_ip IS NOT NULL AND r.remote_ip <> '127.0.0.1'),
connected AS (SELECT pid, proto, local_ip, local_port, remote_ip, listening, exe, app, status, CASE WHEN remote_ip LIKE '10.%' OR remote_ip LIKE '198.51.%' THEN 'lan' ELSE 'internet' END AS scope, remote_host, country, CASE WHEN known_bad THEN 'c2' END AS intel, coalesce(n, 0)::BIGINT AS alerts, worst,
  array_to_string(own_flags || list_filter([CASE WHEN known_bad THEN 'intel' END, CASE WHEN beacon THEN 'beacon' END, CASE WHEN c2 THEN 'c2' END, CASE WHEN infra THEN 'c2_infra' END], lambda x: x IS NOT NULL), ',') AS flags,
  CASE WHEN known_bad OR c2 OR infra THEN 3 ELSE greatest(own_risk, CASE WHEN beacon THEN CASE WHEN own_risk > 0 OR remote_host IS NULL THEN 2 ELSE 1 END ELSE 0 END) END AS risk FROM joined)"""


def _sockets(spark, sf_dir):
    return views.packets(spark, sf_dir).select(*(F.expr(v).alias(k) for k, v in _SOCKET.items()))


def _connected(spark, sf_dir):
    known = spark.createDataFrame(list(_KNOWN), "remote_ip string, remote_host string, country string")
    calls = spark.createDataFrame(list(_CALLS), "ip string, n long, worst int, beacon boolean, c2 boolean")
    bad, tags = spark.createDataFrame(list(_INTEL), "ip string, category string"), spark.createDataFrame(list(_TAGS), "ip string, tag string")
    return host.connections(_sockets(spark, sf_dir), known, calls, bad, tags)


@query("WITH " + _CONNECTED_SQL + " SELECT * FROM connected")
def host_connections(spark, sf_dir):
    return _connected(spark, sf_dir).withColumn("flags", F.array_join("flags", ","))


_LISTENING_SQL = """ SELECT pid::VARCHAR AS program, proto, local_port, string_agg(DISTINCT local_ip, ',' ORDER BY local_ip) AS addresses,
  ['this_mac', 'link_local', 'lan', 'all_networks'][max(CASE local_ip WHEN '0.0.0.0' THEN 4 WHEN '127.0.0.1' THEN 1 WHEN '169.254.1.1' THEN 2 ELSE 3 END)] AS exposure,
  array_to_string(list_concat(arg_max(own_flags, (own_risk, own_flags)), CASE WHEN local_port <> 5353 AND max(CASE local_ip WHEN '0.0.0.0' THEN 4 WHEN '127.0.0.1' THEN 1 WHEN '169.254.1.1' THEN 2 ELSE 3 END) >= 3 THEN ['exposed'] ELSE [] END), ',') AS flags, max(own_risk) AS risk
FROM rated WHERE listening GROUP BY pid, proto, local_port"""


@query(f"WITH {_SOCKETS_SQL}{_LISTENING_SQL}")
def host_listeners(spark, sf_dir):
    return host.listeners(_sockets(spark, sf_dir)).withColumns({c: F.array_join(c, ",") for c in ("addresses", "flags")})


_PROGRAMS_SQL = """ SELECT program, arg_max(exe, (risk, exe)) AS riskiest, min(app) AS app, count(DISTINCT pid) AS pids, count(DISTINCT exe) FILTER (exe <> '') AS binaries, count(*) FILTER (NOT l) AS connections, count(*) FILTER (l) AS listening, count(DISTINCT remote_ip) AS remotes,
  coalesce(array_to_string(list_sort(list_distinct(flatten(list(list_filter(string_split(flags, ','), lambda x: x <> ''))))), ','), '') AS flags, max(risk) AS risk
FROM (SELECT CASE WHEN contains(exe, '.app/') THEN '/Applications/Chat.app' WHEN exe <> '' THEN exe ELSE 'pid:' || pid END AS program, * FROM
  (SELECT pid, exe, app, flags, risk, false AS l, remote_ip FROM connected UNION ALL SELECT pid, exe, app, array_to_string(own_flags, ','), own_risk, true, NULL FROM rated WHERE listening)) GROUP BY program"""


@query("WITH " + _CONNECTED_SQL + _PROGRAMS_SQL)
def host_programs(spark, sf_dir):
    return host.programs(_sockets(spark, sf_dir), _connected(spark, sf_dir)).withColumn("flags", F.array_join("flags", ","))


@query("WITH " + _CONNECTED_SQL + f""", listening AS ({_LISTENING_SQL}), programs AS ({_PROGRAMS_SQL})
SELECT (SELECT count(*) FROM connected) AS connections, (SELECT count(*) FROM connected WHERE scope = 'internet') AS internet, (SELECT count(*) FROM listening WHERE contains(flags, 'exposed')) AS exposed_ports, (SELECT count(*) FROM programs) AS programs, (SELECT count(*) FROM programs WHERE risk >= 2) AS flagged_programs""")
def host_summary(spark, sf_dir):
    s, c = _sockets(spark, sf_dir), _connected(spark, sf_dir)
    return host.summary(c, host.listeners(s), host.programs(s, c))


@query(f"""
WITH {PACKETS_SQL}, d AS (SELECT 'a:0:' || (seq % 40) % 10 || ':2:3:' || (seq % 40) % 7 AS raw, src_ip AS ip, ts_us FROM packets), now AS (SELECT max(ts_us) AS t FROM packets), since AS (SELECT min(ts_us) AS t FROM packets),
m AS (SELECT array_to_string(list_transform(string_split(raw, ':'), lambda x: lpad(x, 2, '0')), ':') AS mac, ip, ts_us FROM d)
SELECT mac, arg_max(ip, (ts_us, ip)) AS ip, min(ts_us) AS first_us, max(ts_us) AS last_us, (SELECT t FROM now) - max(ts_us) < 600000000 AS online, (SELECT t FROM now) - min(ts_us) < 86400000000 AND min(ts_us) - (SELECT t FROM since) >= 3600000000 AS new, true AS random_mac FROM m GROUP BY mac""")
def lan_devices(spark, sf_dir):
    p = views.packets(spark, sf_dir)
    part = lambda m: ((F.col("seq") % 40) % m).cast("string")
    seen = p.select(F.concat(F.lit("A:0:"), part(10), F.lit(":2:3:"), part(7)).alias("mac"), F.col("src_ip").alias("ip"), "ts_us")
    ends = p.agg(F.min("ts_us"), F.max("ts_us")).first()
    return host.devices(seen, ends[1], ends[0])


@query(f"""
WITH {ALERTS_SQL}, w(ip) AS (VALUES ('10.0.0.5'), ('10.0.0.7'), ('8.8.8.8'))
SELECT DISTINCT w.ip, alert_id FROM alerts JOIN w ON w.ip = src_ip OR w.ip = dst_ip""")
def alert_mentions(spark, sf_dir):
    return host.mentions(views.alerts(spark, sf_dir), spark.createDataFrame([("10.0.0.5",), ("10.0.0.7",), ("8.8.8.8",)], "ip string"))


# sinks -------------------------------------------------------------------------------------------------------------------


@query(f"""
WITH {ALERTS_SQL}, c AS (SELECT alert_id, CASE app WHEN 'click' THEN '=' || message WHEN 'error' THEN '-' || dst_port WHEN 'view' THEN '@' || src_ip ELSE message END AS message FROM alerts)
SELECT alert_id, CASE WHEN regexp_matches(message, '^[=+@\t\r-]') AND try_cast(message AS DOUBLE) IS NULL THEN '''' || message ELSE message END AS message FROM c""")
def export_cells(spark, sf_dir):
    a = views.alerts(spark, sf_dir)
    m = F.when(F.col("app") == "click", F.concat(F.lit("="), "message")).when(F.col("app") == "error", F.concat(F.lit("-"), F.col("dst_port").cast("string"))).when(F.col("app") == "view", F.concat(F.lit("@"), "src_ip")).otherwise(F.col("message"))
    return sinks.export_rows(a.select("alert_id", m.alias("message")))


@query(f"""
WITH {ALERTS_SQL}
SELECT '<' || (128 + CASE severity WHEN 4 THEN 2 WHEN 3 THEN 3 WHEN 2 THEN 4 ELSE 5 END) || '>1 ' || strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S.%fZ') || ' sensor tidewatch - - [alert@0 id="' || alert_id || '" rule="' || rule_id || '" src="' || src_ip || '" dst="' || dst_ip || '" dport="' || dst_port || '"] ' || message AS value FROM alerts""")
def syslog_lines(spark, sf_dir):
    return sinks.syslog(views.alerts(spark, sf_dir))


@query(f"""
WITH RECURSIVE {ALERTS_SQL}, h AS (SELECT ts_us, alert_id, severity, message FROM alerts WHERE severity >= 3),
a AS (SELECT min(ts_us) AS t FROM h UNION ALL SELECT (SELECT min(ts_us) FROM h WHERE ts_us >= a.t + {6 * HOUR}) FROM a WHERE a.t IS NOT NULL)
SELECT t AS start_us, count(*) AS n, max(severity)::INT AS severity, arg_max(alert_id, (severity, ts_us, alert_id)) AS alert_id, arg_max(message, (severity, ts_us, alert_id)) AS message
FROM a JOIN h ON h.ts_us >= a.t AND h.ts_us < a.t + {6 * HOUR} GROUP BY t""")
def notices(spark, sf_dir):
    return sinks.notices(views.alerts(spark, sf_dir), 6 * HOUR)


@query(f"""
WITH RECURSIVE {PACKETS_SQL},
p AS (SELECT src_ip AS client, ts_us, seq, 'n' || substr(md5(seq::VARCHAR), 1, (bytes % 14)::INT) AS first, 'd' || dst_port || '.net' AS domain FROM packets),
q AS (SELECT *, (SELECT count(DISTINCT b.domain) FROM p b WHERE b.client = a.client AND b.ts_us >= a.ts_us - {4 * DAY} AND (b.ts_us, b.seq) <= (a.ts_us, a.seq)) AS d FROM p a),
e AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY ts_us, seq) AS n FROM q WHERE d >= 3),
f AS (SELECT client, ts_us, seq, d, n FROM e WHERE n = 1
      UNION ALL SELECT x.client, x.ts_us, x.seq, x.d, x.n FROM (SELECT e.*, row_number() OVER (PARTITION BY e.client ORDER BY e.n) AS k FROM f JOIN e ON e.client = f.client AND e.n > f.n AND e.ts_us - f.ts_us > {5 * DAY}) x WHERE x.k = 1)
SELECT f.client, f.ts_us, f.seq, f.d::INT AS distinct, CASE WHEN avg(length(first)) >= 10 AND avg((SELECT -sum(c / length(first) * log2(c / length(first))) FROM (SELECT count(*) AS c FROM (SELECT unnest(string_split(first, '')) AS ch) GROUP BY ch))) >= 3 THEN 3 ELSE 2 END AS severity
FROM f JOIN p ON p.client = f.client AND p.ts_us >= f.ts_us - {4 * DAY} AND (p.ts_us, p.seq) <= (f.ts_us, f.seq) GROUP BY f.client, f.ts_us, f.seq, f.d""")
def dns_bursts(spark, sf_dir):
    p = views.packets(spark, sf_dir)
    first = F.concat(F.lit("n"), F.substr(F.md5(F.col("seq").cast("string").cast("binary")), F.lit(1), (F.col("bytes") % 14).cast("int")))
    name = F.concat(first, F.lit(".d"), F.col("dst_port").cast("string"), F.lit(".net"))
    return intel.dns_bursts(p.select(F.col("src_ip").alias("client"), name.alias("name"), "ts_us", "seq"), 3, 4 * DAY, 5 * DAY)


@query(f"WITH {ALERTS_SQL}, now AS (SELECT max(ts_us) AS t FROM alerts) SELECT alert_id, ts_us FROM alerts, now WHERE ts_us >= t - {7 * DAY}")
def retention(spark, sf_dir):
    a = views.alerts(spark, sf_dir)
    return sinks.without_old(a, _now(a), 7).select("alert_id", "ts_us")


@query(f"""
WITH {ALERTS_SQL}, r AS (SELECT *, count(*) OVER (PARTITION BY rule_id, src_ip) AS n, row_number() OVER (PARTITION BY rule_id, src_ip ORDER BY ts_us DESC, alert_id DESC) AS k FROM alerts)
SELECT rule_id, src_ip, alert_id, n FROM r WHERE k = 1""")
def alert_panel(spark, sf_dir):
    return sinks.newest_by(views.alerts(spark, sf_dir), ["rule_id", "src_ip"]).select("rule_id", "src_ip", "alert_id", "n")


@query("""
WITH d AS (SELECT encode(text) AS content, doc_id FROM documents WHERE text IS NOT NULL)
SELECT sha256(content) AS sha256, octet_length(any_value(content))::BIGINT AS size, min(doc_id) AS first_us FROM d GROUP BY sha256(content)""")
def evidence(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text is not null").select(F.col("text").cast("binary").alias("content"), F.col("doc_id").alias("ts_us"))
    return sinks.keep_evidence(d).select("sha256", "size", "first_us")


@query(f"""
WITH {_SEEN_SQL},
n AS (SELECT DISTINCT src_ip, lower(coalesce(query_name, sni)) AS host FROM seen WHERE coalesce(query_name, sni) IS NOT NULL),
i AS (SELECT DISTINCT CASE WHEN dst_port % 2 = 0 THEN 'h' || dst_port % 10 || '.example.net' WHEN dst_port % 3 = 0 THEN 'example.net' ELSE 'none' || dst_port || '.org' END AS domain FROM packets)
SELECT domain AS indicator, src_ip, host FROM i JOIN n ON host = domain OR ends_with(host, '.' || domain)""")
def indicators_in_traffic(spark, sf_dir):
    p = views.packets(spark, sf_dir)
    wanted = p.select(F.expr("CASE WHEN dst_port % 2 = 0 THEN concat('h', dst_port % 10, '.example.net') WHEN dst_port % 3 = 0 THEN 'example.net' ELSE concat('none', dst_port, '.org') END").alias("domain"))
    s = _seen(spark, sf_dir).select("src_ip", F.lower(F.coalesce("query_name", "sni")).alias("host"))
    return intel.in_traffic(wanted, s)


# mail and pages ------------------------------------------------------------------------------------------------------------


@query(r"""
SELECT page_id, len(regexp_extract_all(html, '(?i)<script\b'))::INT AS scripts, len(regexp_extract_all(html, '(?i)<form\b'))::INT AS forms, len(regexp_extract_all(html, '(?i)<i?frame\b'))::INT AS frames,
  len(regexp_extract_all(html, '(?is)<(?:a|area|link|base|form|iframe|frame|script|img|embed|source|object|body|input|button)\b[^>]*?\b(?:href|src|action|data|background|formaction)\s*=\s*["'']?([^"''\s>]+)', 1))::INT AS links FROM pages""")
def page_features(spark, sf_dir):
    from tidewatch.operators import mail

    found = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", mail.page_features(F.col("html")).alias("p"))
    return found.select("page_id", "p.scripts", "p.forms", "p.frames", "p.links")


@query(r"""
WITH c AS (SELECT page_id, html, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)(<(?:script|style)\b[^>]*>).*?</(?:script|style)>', '\1', 'g') AS seen FROM (SELECT page_id, coalesce(html, '') || '<div style="display: none">under<a href="/hidden">link ' || page_id || '</a></div><!-- <a href="/no"> --><img src="/p.gif" width="1" height="0">' AS html FROM pages)),
l AS (SELECT page_id, html, seen, regexp_extract_all(seen, '(?is)<[a-z][a-z0-9]*\b[^>]*?\b(?:href|src|action|data)="([^"]+)"', 1) AS urls FROM c)
SELECT page_id, len(urls)::INT AS links, list_filter(urls, lambda x: x <> '/p.gif')[-1] AS last_link, 'link ' || page_id AS last_text, len(regexp_extract_all(seen, '(?i)<script\b'))::INT AS scripts, 1::INT AS hidden, (5 + length('link ' || page_id))::INT AS hidden_chars, 1::INT AS pixels FROM l""")
def page_elements(spark, sf_dir):
    """Pages with a hidden part, a link in it, one in a comment, and a counting image at their ends."""
    tail = F.concat(F.lit('<div style="display: none">under<a href="/hidden">link '), F.col("page_id").cast("string"), F.lit('</a></div><!-- <a href="/no"> --><img src="/p.gif" width="1" height="0">'))
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.concat(F.coalesce("html", F.lit("")), tail).alias("html"))
    last = F.element_at(F.filter("page.links", lambda x: x["url"] != "/p.gif"), -1)
    seen = pages.with_page(rows).withColumn("last", last)
    return seen.select("page_id", F.size("page.links").alias("links"), F.col("last.url").alias("last_link"), F.col("last.text").alias("last_text"), "page.scripts", "page.hidden", "page.hidden_chars", "page.pixels")


_IMITATION = """CASE seq % 7 WHEN 0 THEN b || '.com' WHEN 1 THEN replace(replace(b, 'o', '0'), 'l', '1') || '-login.net' WHEN 2 THEN 'secure.' || substr(b, 1, 2) || substr(b, 4) || '.example.org' WHEN 3 THEN 'www.' || b || '.evil' || bytes % 5 || '.io'
 WHEN 4 THEN substr(b, 1, 3) || 'x' || substr(b, 4) || '.info' WHEN 5 THEN replace(b, 'm', 'rn') || '_id.shop' ELSE 'host' || bytes % 100 || '.example.net' END"""
_BRANDS = "[" + ", ".join(f"'{d}'" for d in lookalikes.BRANDS) + "]"


@query(f"""
WITH {PACKETS_SQL},
h AS (SELECT seq, {_IMITATION} AS host FROM (SELECT seq, bytes, split_part({_BRANDS}[1 + (seq % {len(lookalikes.BRANDS)})::INT], '.', 1) AS b FROM packets)),
d AS (SELECT unnest({_BRANDS}) AS brand, split_part(unnest({_BRANDS}), '.', 1) AS name),
w AS (SELECT host, list_filter(string_split_regex(host, '[.\\-_]')[:-2], lambda x: x <> '') AS parts FROM (SELECT DISTINCT host FROM h) WHERE regexp_extract(host, '[^.]+\\.[^.]+$') NOT IN (SELECT brand FROM d)),
p AS (SELECT host, unnest(parts) AS part FROM w),
f AS (SELECT host, part, replace(replace(replace(replace(translate(part, '{lookalikes.SINGLE[0]}', '{lookalikes.SINGLE[1]}'), 'rn', 'm'), 'vv', 'w'), 'cl', 'd'), 'ii', 'u') AS fold FROM p),
m AS (SELECT host, min(brand) AS brand FROM f, d WHERE length(name) >= 4 AND (part = name OR fold = name OR (length(part) >= 5 AND levenshtein(part, name) = 1)) GROUP BY host)
SELECT seq, host, brand FROM h LEFT JOIN m USING (host)""")
def imitated_brands(spark, sf_dir):
    """Brands' own names, digits for letters, letters lost or put in, pairs that read as one, and hosts of no brand."""
    p = views.packets(spark, sf_dir)
    b = F.substring_index(F.element_at(F.array(*map(F.lit, lookalikes.BRANDS)), (F.col("seq") % len(lookalikes.BRANDS) + 1).cast("int")), ".", 1)
    host = F.expr(_IMITATION.replace("bytes % 5", "cast(bytes % 5 as string)").replace("bytes % 100", "cast(bytes % 100 as string)"))
    return lookalikes.imitated(p.select("seq", "bytes", b.alias("b")).select("seq", host.alias("host")), "host")
