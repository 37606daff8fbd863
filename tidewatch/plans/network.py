"""The registered queries over network data, and for each the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions import indicators, ip, names
from tidewatch.operators import alerts, detectors, flows, joins

from tidewatch.sinks import search
from tidewatch.sources import dissect

from . import builtin, rules, views
from .views import ALERTS_SQL, HOUR, MINUTE, PACKETS_SQL, SEGMENTS_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DAY = 24 * HOUR


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _now(df: DataFrame) -> int:
    return df.agg(F.max("ts_us")).first()[0]


# detectors -------------------------------------------------------------------------------------------------------------


@query(f"""
WITH {PACKETS_SQL},
c AS (SELECT src_ip, dst_ip, dst_port, ts_us, seq, count(*) OVER (PARTITION BY src_ip, dst_ip, dst_port ORDER BY ts_us RANGE BETWEEN {10 * DAY} PRECEDING AND CURRENT ROW) AS attempts
      FROM packets WHERE app = 'error'),
l AS (SELECT *, coalesce(lag(attempts) OVER (PARTITION BY src_ip, dst_ip, dst_port ORDER BY ts_us, seq), 0) AS before FROM c)
SELECT src_ip, dst_ip, dst_port, ts_us, seq, attempts FROM l WHERE attempts >= 2 AND before < 2""")
def brute_force(spark, sf_dir):
    return detectors.brute_force(views.packets(spark, sf_dir).filter("app = 'error'"), 2, 10 * DAY)


@query(f"""
WITH {PACKETS_SQL},
p AS (SELECT src_ip, dst_ip, 0 AS dst_port, ts_us, seq FROM packets),
g AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY src_ip, dst_ip ORDER BY ts_us, seq) AS raw FROM p),
h AS (SELECT src_ip, dst_ip, dst_port, ts_us, seq, CASE WHEN raw <= {20 * DAY} THEN raw / 1e6 END AS gap FROM g),
s AS (SELECT *, count(gap) OVER w AS n_gaps, avg(gap) OVER w AS mean_s, stddev_pop(gap) OVER w AS sd_s FROM h
      WINDOW w AS (PARTITION BY src_ip, dst_ip ORDER BY ts_us, seq ROWS BETWEEN 28 PRECEDING AND CURRENT ROW)),
r AS (SELECT *, sd_s / mean_s AS cv, row_number() OVER (PARTITION BY src_ip, dst_ip ORDER BY ts_us, seq) AS n FROM s WHERE n_gaps >= 5 AND mean_s >= 1 AND sd_s / mean_s <= 0.6)
SELECT src_ip, dst_ip, dst_port, ts_us, seq, n_gaps, round(mean_s, 3) AS mean_s, round(cv, 6) AS cv FROM r WHERE n = 1""")
def beaconing(spark, sf_dir):
    p = views.packets(spark, sf_dir).withColumn("dst_port", F.lit(0))
    found = detectors.beacons(p, longest_gap=20 * DAY, most_cv=0.6)
    return found.select("src_ip", "dst_ip", "dst_port", "ts_us", "seq", "n_gaps", F.round("mean_s", 3).alias("mean_s"), F.round("cv", 6).alias("cv"))


@query(f"""
WITH {PACKETS_SQL},
s AS (SELECT src_ip, dst_ip, dst_port, protocol, ts_us, seq, sum(bytes) OVER (PARTITION BY src_ip, dst_ip, dst_port, protocol ORDER BY ts_us, seq) AS sent FROM packets),
r AS (SELECT *, row_number() OVER (PARTITION BY src_ip, dst_ip, dst_port, protocol ORDER BY ts_us, seq) AS n FROM s WHERE sent >= 15000)
SELECT src_ip, dst_ip, dst_port, protocol, ts_us, seq, sent::BIGINT AS sent FROM r WHERE n = 1""")
def exfiltration(spark, sf_dir):
    return detectors.exfiltration(views.packets(spark, sf_dir), 15_000)


def _anchored_sql(by: str, value: str, least: int, window: int) -> str:
    keys = " AND ".join(f"e.{k} = a.{k}" for k in by.split(", "))
    return f"""
WITH RECURSIVE {PACKETS_SQL},
e AS (SELECT {by}, {value} AS v, ts_us, seq FROM packets),
a AS (SELECT {by}, min(ts_us) AS t FROM e GROUP BY ALL
      UNION ALL
      SELECT {", ".join("a." + k for k in by.split(", "))}, min(e.ts_us) FROM a JOIN e ON {keys} AND e.ts_us > a.t + {window} GROUP BY {", ".join("a." + k for k in by.split(", "))}, a.t),
w AS (SELECT {", ".join("e." + k for k in by.split(", "))}, e.v, e.ts_us, e.seq, a.t FROM e JOIN a ON {keys} AND e.ts_us BETWEEN a.t AND a.t + {window}),
f AS (SELECT *, row_number() OVER (PARTITION BY {by}, t, v ORDER BY ts_us, seq) AS nth FROM w),
d AS (SELECT *, count(*) FILTER (nth = 1) OVER (PARTITION BY {by}, t ORDER BY ts_us, seq) AS targets FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY {by}, t ORDER BY ts_us, seq) AS n FROM d WHERE targets >= {least})
SELECT {by}, ts_us, seq, targets::INT AS targets FROM r WHERE n = 1"""


@query(_anchored_sql("src_ip, dst_port", "dst_ip", 2, 5 * DAY))
def horizontal_scan(spark, sf_dir):
    return detectors.horizontal_scan(views.packets(spark, sf_dir), 2, 5 * DAY)


@query(_anchored_sql("src_ip, dst_ip", "dst_port", 4, 3 * DAY))
def vertical_scan(spark, sf_dir):
    return detectors.vertical_scan(views.packets(spark, sf_dir), 4, 3 * DAY)


def _burst_sql(least: int, window: int, cooldown: int, test: str, value: str = "dst_port") -> str:
    return f"""
WITH RECURSIVE {PACKETS_SQL},
q AS (SELECT src_ip, ts_us, seq, (SELECT count(DISTINCT b.{value}) FROM packets b WHERE b.src_ip = a.src_ip AND b.ts_us >= a.ts_us - {window} AND (b.ts_us < a.ts_us OR b.ts_us = a.ts_us AND b.seq <= a.seq)) AS d FROM packets a),
e AS (SELECT src_ip, ts_us, seq, d, row_number() OVER (PARTITION BY src_ip ORDER BY ts_us, seq) AS n FROM q WHERE d >= {least}),
f AS (SELECT src_ip, ts_us, seq, d, n FROM e WHERE n = 1
      UNION ALL
      SELECT x.src_ip, x.ts_us, x.seq, x.d, x.n FROM (SELECT e.*, row_number() OVER (PARTITION BY e.src_ip ORDER BY e.n) AS k FROM f JOIN e ON e.src_ip = f.src_ip AND e.n > f.n AND e.ts_us - f.ts_us {test} {cooldown}) x WHERE x.k = 1)
SELECT src_ip, ts_us, seq, d::INT AS "distinct" FROM f"""


@query(_burst_sql(6, 2 * DAY, 2 * DAY, ">"))
def failed_lookup_burst(spark, sf_dir):
    return detectors.burst(views.packets(spark, sf_dir), ["src_ip"], "dst_port", 6, 2 * DAY, 2 * DAY)


@query(_burst_sql(4, 1 * DAY, 1 * DAY, ">="))
def lookup_prefetch(spark, sf_dir):
    return detectors.burst(views.packets(spark, sf_dir), ["src_ip"], "dst_port", 4, DAY, DAY, strict=False)


@query(f"""
WITH RECURSIVE {PACKETS_SQL},
p AS (SELECT src_ip, ts_us, seq, ts_us // {DAY} AS w, row_number() OVER o AS n, count(*) OVER (PARTITION BY src_ip, ts_us // {DAY} ORDER BY ts_us, seq) AS c FROM packets WINDOW o AS (PARTITION BY src_ip ORDER BY ts_us, seq)),
f AS (SELECT src_ip, w, max(c) AS c, row_number() OVER (PARTITION BY src_ip ORDER BY w) AS k FROM p GROUP BY src_ip, w),
d AS (SELECT p.*, f.k, (SELECT CASE WHEN count(*) < 2 THEN 0 ELSE stddev_samp(x) END FROM (SELECT q.c AS x FROM f q WHERE q.src_ip = p.src_ip AND q.k < f.k AND q.k > f.k - 60 UNION ALL SELECT p.c)) AS sd, f.k >= 3 AS old FROM p JOIN f ON f.src_ip = p.src_ip AND f.w = p.w),
e AS (SELECT src_ip, n, ts_us, seq, c::DOUBLE AS c, CASE WHEN old THEN sd ELSE 0 END AS sd, c::DOUBLE AS a FROM d WHERE n = 1
      UNION ALL
      SELECT d.src_ip, d.n, d.ts_us, d.seq, d.c::DOUBLE, CASE WHEN d.old THEN d.sd ELSE 0 END, 0.3 * d.c + 0.7 * e.a FROM e JOIN d ON d.src_ip = e.src_ip AND d.n = e.n + 1)
SELECT src_ip, ts_us, seq, round(c, 6) AS rate, round(a, 6) AS average, round(sd, 6) AS deviation FROM e WHERE sd > 0 AND c > a + sd AND c > 3""")
def rate_spike(spark, sf_dir):
    found = detectors.rate_spikes(views.packets(spark, sf_dir), window=DAY, sigma=1.0, least_rate=0.0, least_count=3)
    return found.select("src_ip", "ts_us", "seq", *(F.round(F.col(c) * 86_400, 6).alias(c) for c in ("rate", "average", "deviation")))


@query(f"""
WITH RECURSIVE {PACKETS_SQL},
a AS (SELECT src_ip, app, min(ts_us) AS t FROM packets GROUP BY ALL
      UNION ALL
      SELECT a.src_ip, a.app, min(p.ts_us) FROM a JOIN packets p ON p.src_ip = a.src_ip AND p.app = a.app AND p.ts_us >= a.t + {3 * DAY} GROUP BY a.src_ip, a.app, a.t),
n AS (SELECT src_ip, app, t, (SELECT min(seq) FROM packets p WHERE p.src_ip = a.src_ip AND p.app = a.app AND p.ts_us = a.t) AS seq, lag(t) OVER (PARTITION BY src_ip, app ORDER BY t) AS before FROM a)
SELECT src_ip, app, t AS ts_us, seq, greatest((SELECT count(*) - 1 FROM packets p WHERE p.src_ip = n.src_ip AND p.app = n.app AND p.ts_us >= n.before AND p.ts_us < n.t), 0)::INT AS suppressed FROM n""")
def repeat_cooldown(spark, sf_dir):
    return detectors.repeats(views.packets(spark, sf_dir).select("src_ip", "app", "ts_us", "seq"), ["src_ip", "app"], 3 * DAY)


@query(f"""
WITH {PACKETS_SQL},
f AS (SELECT src_ip, dst_port, min(ts_us) AS ts_us, arg_min(seq, (ts_us, seq)) AS seq FROM packets GROUP BY ALL)
SELECT src_ip, dst_port, ts_us, seq FROM f WHERE ts_us - (SELECT min(ts_us) FROM f) > {DAY}""")
def first_seen(spark, sf_dir):
    return detectors.first_seen(views.packets(spark, sf_dir), ["src_ip", "dst_port"], DAY)


@query(f"""
WITH {PACKETS_SQL},
f AS (SELECT src_ip AS app, dst_ip AS country, min(ts_us) AS first_us FROM packets GROUP BY ALL),
k AS (SELECT *, min(first_us) OVER (PARTITION BY app) AS app_us FROM f)
SELECT app, country, first_us, (SELECT string_agg(x.country, ',' ORDER BY x.country) FROM f x WHERE x.app = k.app AND (x.first_us, x.country) < (k.first_us, k.country)) AS usual
FROM k WHERE first_us - app_us > {DAY}""")
def new_country(spark, sf_dir):
    e = views.packets(spark, sf_dir).select(F.col("src_ip").alias("app"), F.col("dst_ip").alias("country"), "ts_us")
    return detectors.new_countries(e, DAY).withColumn("usual", F.array_join("usual", ","))


@query(f"""
WITH {PACKETS_SQL},
p AS (SELECT protocol, CASE WHEN src_ip <= dst_ip THEN src_ip ELSE dst_ip END AS lo, CASE WHEN src_ip <= dst_ip THEN dst_ip ELSE src_ip END AS hi, src_ip, dst_ip, ts_us, seq, bytes FROM packets),
n AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY protocol, lo, hi ORDER BY ts_us, seq) <= {2 * DAY} THEN 0 ELSE 1 END AS new FROM p),
s AS (SELECT *, sum(new) OVER (PARTITION BY protocol, lo, hi ORDER BY ts_us, seq) AS session FROM n)
SELECT protocol, arg_min(src_ip, (ts_us, seq)) AS src_ip, arg_min(dst_ip, (ts_us, seq)) AS dst_ip, 0 AS dst_port, session::BIGINT AS session, min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) AS packets, sum(bytes)::BIGINT AS bytes
FROM s GROUP BY protocol, lo, hi, session""")
def flow_sessions(spark, sf_dir):
    return detectors.flow_sessions(views.packets(spark, sf_dir).withColumn("dst_port", F.lit(0)), 2 * DAY)


_FLOW_SQL = f"""{SEGMENTS_SQL},
k AS (SELECT *, row_number() OVER p AS rn, coalesce(ts_us - lag(ts_us) OVER p > CASE protocol WHEN 'tcp' THEN {8 * DAY} ELSE {2 * DAY} END, true) AS silent,
        protocol = 'tcp' AND tcp_flags = 2 AS fresh, CASE WHEN protocol <> 'tcp' THEN '' ELSE CASE tcp_flags WHEN 2 THEN 'S' WHEN 18 THEN 'H' WHEN 16 THEN 'A' WHEN 17 THEN 'F' WHEN 4 THEN 'R' WHEN 24 THEN CASE WHEN bytes = 0 THEN 'A' ELSE 'D' END END END AS letter,
        CASE WHEN protocol = 'tcp' AND tcp_flags IN (2, 18) THEN tcp_flags = 18 ELSE NOT outbound END AS reply
      FROM segments WINDOW p AS (PARTITION BY client, port, protocol ORDER BY ts_us, seq)),
f AS (SELECT k.client, k.port, k.protocol, rn, 1::BIGINT AS flow, reply AS inferred, outbound <> reply AS opened, outbound AND tcp_flags = 17 AS fin_c, NOT outbound AND tcp_flags = 17 AS fin_s,
        CASE WHEN k.protocol <> 'tcp' THEN 'new' WHEN tcp_flags = 4 THEN 'closed' WHEN tcp_flags = 17 THEN 'closing' WHEN fresh THEN 'new' ELSE 'established' END AS state,
        CASE WHEN reply THEN lower(letter) ELSE letter END AS history, ts_us, seq, bytes, outbound
      FROM k WHERE rn = 1
      UNION ALL
      SELECT client, port, protocol, rn, f_flow + opens::INT, CASE WHEN opens THEN reply ELSE f_inferred END, by_client, c2, s2,
        CASE WHEN protocol <> 'tcp' THEN 'new' WHEN tcp_flags = 4 OR (tcp_flags = 17 AND c2 AND s2) THEN 'closed' WHEN tcp_flags = 17 THEN 'closing' WHEN fresh THEN 'new' WHEN opens OR f_state = 'new' THEN 'established' ELSE f_state END,
        CASE WHEN opens THEN cased WHEN contains(f_history, cased) THEN f_history ELSE f_history || cased END, ts_us, seq, bytes, outbound
      FROM (SELECT *, CASE WHEN outbound = by_client THEN letter ELSE lower(letter) END AS cased,
              (outbound AND tcp_flags = 17) OR (NOT opens AND f_c) AS c2, (NOT outbound AND tcp_flags = 17) OR (NOT opens AND f_s) AS s2
            FROM (SELECT *, CASE WHEN opens THEN outbound <> reply ELSE f_opened END AS by_client
                  FROM (SELECT k.*, f.flow AS f_flow, f.inferred AS f_inferred, f.opened AS f_opened, f.fin_c AS f_c, f.fin_s AS f_s, f.state AS f_state, f.history AS f_history, silent OR (fresh AND f.state IN ('closing', 'closed')) AS opens
                        FROM f JOIN k ON k.client = f.client AND k.port = f.port AND k.protocol = f.protocol AND k.rn = f.rn + 1))))"""


@query(f"""
WITH RECURSIVE {_FLOW_SQL},
g AS (SELECT client, port, protocol, flow, bool_or(opened) AS opened, bool_or(inferred) AS inferred, arg_max(state, rn) AS state, arg_max(history, rn) AS h,
        min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) AS packets, count(*) FILTER (outbound = opened) AS packets_out, sum(bytes)::BIGINT AS bytes, coalesce(sum(bytes) FILTER (outbound = opened), 0)::BIGINT AS bytes_out
      FROM f GROUP BY client, port, protocol, flow)
SELECT md5(protocol || ':' || CASE WHEN client < '10.9.9.9' THEN client || ':' || port || ':10.9.9.9:443' ELSE '10.9.9.9:443:' || client || ':' || port END) AS flow_id, flow, protocol,
  CASE WHEN opened THEN client ELSE '10.9.9.9' END AS src_ip, CASE WHEN opened THEN port ELSE 443 END AS src_port, CASE WHEN opened THEN '10.9.9.9' ELSE client END AS dst_ip, CASE WHEN opened THEN 443 ELSE port END AS dst_port, state,
  CASE WHEN protocol <> 'tcp' THEN 'active' WHEN contains(lower(h), 'r') THEN CASE WHEN contains(h, 'r') AND contains(h, 'S') AND NOT contains(h, 'h') AND NOT contains(lower(h), 'd') THEN 'rejected' ELSE 'reset' END
    WHEN state IN ('closed', 'closing') THEN state WHEN contains(h, 'S') AND NOT contains(h, 'h') AND packets = packets_out THEN 'attempt' WHEN state = 'established' THEN state ELSE 'active' END AS outcome,
  h AS history, first_us, last_us, packets, packets_out, bytes, bytes_out, inferred FROM g""")
def connections(spark, sf_dir):
    return flows.connections(views.segments(spark, sf_dir), 2 * DAY, 8 * DAY)


#: Rules over what a packet's flow has come to.
FLOW_RULES = [
    {"id": "FLOW-LATE-SYN", "description": "SYN on a flow that had begun", "severity": "LOW", "match": {"all": [{"field": "tcp.syn", "op": "eq", "value": True}, {"field": "flow.packets", "op": "gt", "value": 1}]}},
    {"id": "FLOW-PUSHED", "description": "An initiator that sends much on an established flow", "severity": "HIGH", "match": {"all": [{"field": "flow.state", "op": "eq", "value": "established"}, {"field": "flow.bytes_from_src", "op": "gte", "value": 20000}]}},
    {"id": "FLOW-RESET", "description": "A flow that closes with more received than sent", "severity": "MEDIUM", "match": {"all": [{"field": "flow.state", "op": "in", "value": ["closed", "closing"]}, {"field": "flow.bytes_in", "op": "gt", "value": 0}, {"field": "flow.new", "op": "eq", "value": False}]}},
]


@query(f"""
WITH RECURSIVE {_FLOW_SQL},
r AS (SELECT f.*, tcp_flags, count(*) OVER w AS packets, coalesce(sum(f.bytes) FILTER (f.outbound = opened) OVER w, 0) AS sent, coalesce(sum(f.bytes) FILTER (f.outbound <> opened) OVER w, 0) AS got
      FROM f JOIN segments s USING (seq) WINDOW w AS (PARTITION BY f.client, f.port, f.protocol, flow ORDER BY rn))
SELECT rule_id, seq, state, packets, sent::BIGINT AS bytes_from_src FROM (
  SELECT 'FLOW-LATE-SYN' AS rule_id, * FROM r WHERE protocol = 'tcp' AND tcp_flags IN (2, 18) AND packets > 1
  UNION ALL SELECT 'FLOW-PUSHED', * FROM r WHERE state = 'established' AND sent >= 20000
  UNION ALL SELECT 'FLOW-RESET', * FROM r WHERE state IN ('closed', 'closing') AND got > 0 AND packets > 1)""")
def flow_rules(spark, sf_dir):
    p = flows.with_flow(views.segments(spark, sf_dir), 2 * DAY, 8 * DAY)
    return rules.hits(p, rules.validate(FLOW_RULES, p.schema)[0]).select("rule_id", "seq", "flow.state", "flow.packets", "flow.bytes_from_src")


_PAIR_SIGNALS = {"click": "['beacon']", "error": "['intel']", "signup": "['beacon', 'bare_ip']"}


@query(f"""
WITH RECURSIVE {PACKETS_SQL},
a AS (SELECT seq, ts_us, CASE WHEN seq % 11 = 0 THEN NULL ELSE 'p' || CASE WHEN seq % 3 = 0 THEN 0 ELSE bytes % 40 END END AS app, CASE WHEN seq % 13 = 0 THEN NULL ELSE '203.0.113.' || dst_port % 25 END AS remote_ip,
        CASE WHEN app = 'view' AND seq % 5 = 0 THEN ['new_program'] WHEN app = 'purchase' AND seq % 7 = 0 THEN ['untrusted_binary'] ELSE [] END AS s_app, CASE {" ".join(f"WHEN app = '{k}' AND seq % 4 = 0 THEN {v}" for k, v in _PAIR_SIGNALS.items())} ELSE [] END AS s_remote FROM packets),
g AS (SELECT * FROM a WHERE len(s_app) + len(s_remote) > 0),
m AS (SELECT app, remote_ip, ts_us, seq FROM g WHERE remote_ip IS NOT NULL),
t AS (SELECT app, remote_ip, ts_us, seq FROM m
      UNION SELECT g.app, m.remote_ip, g.ts_us, g.seq FROM g JOIN m ON g.app = m.app AND len(g.s_app) > 0 AND m.ts_us >= g.ts_us - {3 * HOUR} AND (m.ts_us, m.seq) <= (g.ts_us, g.seq)),
k AS (SELECT ts_us, seq, app, NULL::VARCHAR AS remote_ip, unnest(s_app) AS kind FROM g UNION ALL SELECT ts_us, seq, NULL::VARCHAR, remote_ip, unnest(s_remote) FROM g),
s AS (SELECT t.*, (SELECT list_sort(list(DISTINCT kind)) FROM (SELECT kind FROM k WHERE (k.app = t.app OR k.remote_ip = t.remote_ip) AND k.ts_us >= t.ts_us - {3 * HOUR} AND (k.ts_us, k.seq) <= (t.ts_us, t.seq) UNION ALL SELECT 'c2_infra' WHERE t.remote_ip = '203.0.113.7')) AS kinds FROM t),
e AS (SELECT *, row_number() OVER (PARTITION BY app, remote_ip ORDER BY ts_us, seq) AS n FROM s WHERE len(list_filter(kinds, lambda x: x <> 'bare_ip')) >= 2 AND list_has_any(kinds, ['beacon', 'intel', 'c2_infra'])),
f AS (SELECT app, remote_ip, ts_us, seq, kinds, n FROM e WHERE n = 1
      UNION ALL
      SELECT x.app, x.remote_ip, x.ts_us, x.seq, x.kinds, x.n FROM (SELECT e.*, row_number() OVER (PARTITION BY e.app, e.remote_ip ORDER BY e.n) AS k FROM f JOIN e ON e.app IS NOT DISTINCT FROM f.app AND e.remote_ip = f.remote_ip AND e.n > f.n AND e.ts_us - f.ts_us >= {3 * HOUR}) x WHERE x.k = 1)
SELECT app, remote_ip, ts_us, seq, array_to_string(kinds, ',') AS signals, round(least(0.95, 0.5 + 0.15 * len(kinds)), 6)::DOUBLE AS confidence FROM f""")
def control_pairs(spark, sf_dir):
    p = views.packets(spark, sf_dir)
    none = "cast(array() as array<string>)"
    a = p.select(
        "seq", "ts_us", F.expr("CASE WHEN seq % 11 <> 0 THEN concat('p', CASE WHEN seq % 3 = 0 THEN 0 ELSE bytes % 40 END) END").alias("app"), F.expr("CASE WHEN seq % 13 <> 0 THEN concat('203.0.113.', dst_port % 25) END").alias("remote_ip"),
        F.expr(f"CASE WHEN app = 'view' AND seq % 5 = 0 THEN array('new_program') WHEN app = 'purchase' AND seq % 7 = 0 THEN array('untrusted_binary') ELSE {none} END").alias("app_signals"),
        F.expr("CASE " + " ".join(f"WHEN app = '{k}' AND seq % 4 = 0 THEN array({v[1:-1]})" for k, v in _PAIR_SIGNALS.items()) + f" ELSE {none} END").alias("remote_signals"),
    )
    infra = a.filter("remote_ip = '203.0.113.7'").select("remote_ip").distinct()
    found = alerts.control_pairs(a, infra, window=3 * HOUR, most_pairs=5)
    return found.select("app", "remote_ip", "ts_us", "seq", F.array_join("signals", ",").alias("signals"), F.round("confidence", 6).alias("confidence"))


# joins -----------------------------------------------------------------------------------------------------------------


@query(f"""
WITH {PACKETS_SQL}, {views.rows_sql(views.NETWORKS, "nets", "cidr", "category")},
b AS (SELECT category, CASE WHEN contains(cidr, '/') THEN split_part(cidr, '/', 2)::INT ELSE 32 END AS len, list_reduce(list_transform(string_split(split_part(cidr, '/', 1), '.'), lambda x: x::BIGINT), lambda a, x: a * 256 + x) AS base FROM nets),
i AS (SELECT *, list_reduce(list_transform(string_split(src_ip, '.'), lambda x: x::BIGINT), lambda a, x: a * 256 + x) AS n FROM packets)
SELECT seq, src_ip, arg_max(category, len) AS category FROM i LEFT JOIN b ON n >> (32 - len) = base >> (32 - len) GROUP BY seq, src_ip""")
def intel_longest_prefix(spark, sf_dir):
    nets = spark.createDataFrame(list(views.NETWORKS), "cidr string, category string")
    return joins.longest_prefix(views.packets(spark, sf_dir).select("seq", "src_ip"), "src_ip", nets, ["category"])


_HOSTS_SQL = r"hosts AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host FROM pages)"
_TRACKERS = ((".example.net", "network"), ("example.org", "exact only"), (".example.com", "shop"), (".blog.example.com", "blog"))


@query(f"""
WITH {_HOSTS_SQL}, {views.rows_sql(_TRACKERS, "d", "domain", "category")},
m AS (SELECT page_id, host, category, length(domain) AS n FROM hosts LEFT JOIN d ON (NOT starts_with(domain, '.') AND host = domain) OR (starts_with(domain, '.') AND (host = substr(domain, 2) OR ends_with(host, domain))))
SELECT page_id, host, arg_max(category, n) AS category FROM m GROUP BY page_id, host""")
def domain_suffix(spark, sf_dir):
    hosts = _table(spark, sf_dir, "pages").select("page_id", names.host_of(F.col("url")).alias("host"))
    return joins.domain_suffix(hosts, "host", spark.createDataFrame(list(_TRACKERS), "domain string, category string"), ["category"])


@query(f"""
WITH {PACKETS_SQL},
f AS (SELECT src_ip, ts_us, max(dst_port) AS port FROM packets WHERE app = 'signup' GROUP BY ALL),
c AS (SELECT src_ip, ts_us, seq FROM packets WHERE app = 'click')
SELECT c.src_ip, c.ts_us, c.seq, CASE WHEN f.ts_us >= c.ts_us - {5 * DAY} THEN f.port END AS port FROM c ASOF LEFT JOIN f ON c.src_ip = f.src_ip AND c.ts_us >= f.ts_us""")
def as_of_process(spark, sf_dir):
    p = views.packets(spark, sf_dir)
    facts = p.filter("app = 'signup'").select("src_ip", "ts_us", F.col("dst_port").alias("port"))
    return joins.as_of(p.filter("app = 'click'").select("src_ip", "ts_us", "seq"), facts, ["src_ip"], "ts_us", ["port"], 5 * DAY)


@query("""
WITH r AS (SELECT n_nationkey, n_name, n_nationkey::BIGINT * 1000 AS lo, n_nationkey::BIGINT * 1000 + 899 AS hi FROM nation)
SELECT o_orderkey, n_name AS country FROM orders LEFT JOIN r ON (o_orderkey * 7919) % 25000 BETWEEN lo AND hi""")
def geo_range(spark, sf_dir):
    key = F.col("n_nationkey").cast("long") * 1000
    ranges = _table(spark, sf_dir, "nation").select(key.alias("lo"), (key + 899).alias("hi"), F.col("n_name").alias("country"))
    rows = _table(spark, sf_dir, "orders").select("o_orderkey")
    return joins.in_range(rows, (F.col("o_orderkey") * 7919) % 25000, ranges, "lo", "hi", ["country"], bits=9)


@query(f"""
WITH a AS (SELECT o_orderkey, o_orderkey * 7919 % 25000 AS n, o_orderkey % 2 = 0 AS six, o_orderkey % 17 = 0 AS far FROM orders),
r AS (SELECT n_nationkey * 1000 AS lo, n_nationkey * 1000 + 899 AS hi, n_name AS country FROM nation
      UNION ALL SELECT n_nationkey * 1000 + 100, n_nationkey * 1000 + 1300, 'wide ' || n_name FROM nation UNION ALL SELECT 0, 25000, 'all' UNION ALL SELECT n_nationkey * 1000 + 5, n_nationkey * 1000 + 5, 'one' FROM nation)
SELECT o_orderkey, CASE WHEN far THEN CASE WHEN six THEN 'every six' END ELSE arg_min(country, (hi - lo, country)) END AS country FROM a LEFT JOIN r ON n BETWEEN lo AND hi GROUP BY o_orderkey, far, six""")
def geo_addresses(spark, sf_dir):
    """Ranges of both versions, of which some lie in others, some overlap, and one is the whole space."""

    def address(n, six):
        four = F.concat(F.lit("10.7."), F.floor(n / 256).cast("string"), F.lit("."), (n % 256).cast("string"))
        return F.when(six, F.concat(F.lit("2001:db8::"), F.lower(F.hex(n)))).otherwise(four)

    nation = _table(spark, sf_dir, "nation").select((F.col("n_nationkey").cast("long") * 1000).alias("k"), "n_name")
    span = lambda lo, hi, name: nation.select((F.col("k") + lo).alias("lo"), (F.col("k") + hi).alias("hi"), name.alias("country"))
    numbers = span(0, 899, F.col("n_name")).unionByName(span(100, 1300, F.concat(F.lit("wide "), "n_name"))).unionByName(span(5, 5, F.lit("one")))
    numbers = numbers.unionByName(nation.agg(F.min("k").alias("lo"), (F.max("k") + 1000).alias("hi")).withColumn("country", F.lit("all")))
    ends = lambda six: numbers.select(address(F.col("lo"), F.lit(six)).alias("lo"), address(F.col("hi"), F.lit(six)).alias("hi"), "country")
    every = nation.limit(1).select(F.lit("::").alias("lo"), F.lit("ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff").alias("hi"), F.lit("every six").alias("country"))
    o = _table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 7919 % 25000).alias("n"))
    six = F.col("o_orderkey") % 2 == 0
    place = F.when(F.col("o_orderkey") % 17 == 0, F.when(six, "2001:4860::8888").otherwise("8.8.8.8")).otherwise(address(F.col("n"), six))
    ranges = ends(False).unionByName(ends(True)).unionByName(every)
    found = joins.in_address_range(o.select("o_orderkey", place.alias("ip")), "ip", ranges, "lo", "hi", ["country"])
    return found.select("o_orderkey", "country")


_SUPPRESS = (("CRED-1", "10.0.0.0/25"), ("*", "10.0.0.10/31"), ("C2-1", "*"))


@query(f"""
WITH {ALERTS_SQL}, {views.rows_sql(_SUPPRESS, "s", "rule", "cidr")},
i AS (SELECT *, list_reduce(list_transform(string_split(src_ip, '.'), lambda x: x::BIGINT), lambda a, x: a * 256 + x) AS n FROM alerts),
b AS (SELECT rule, cidr, CASE WHEN cidr = '*' THEN 0 ELSE split_part(cidr, '/', 2)::INT END AS len, CASE WHEN cidr = '*' THEN 0 ELSE list_reduce(list_transform(string_split(split_part(cidr, '/', 1), '.'), lambda x: x::BIGINT), lambda a, x: a * 256 + x) END AS base FROM s)
SELECT alert_id, rule_id, src_ip FROM i WHERE NOT EXISTS (SELECT 1 FROM b WHERE (rule = '*' OR rule = rule_id) AND (cidr = '*' OR n >> (32 - len) = base >> (32 - len)))""")
def suppression(spark, sf_dir):
    r = spark.createDataFrame(list(_SUPPRESS), "rule_id string, cidr string")
    return joins.not_suppressed(views.alerts(spark, sf_dir), r).select("alert_id", "rule_id", "src_ip")


# alert pipeline --------------------------------------------------------------------------------------------------------


@query(f"""
WITH RECURSIVE {ALERTS_SQL},
k AS (SELECT alert_id, ts_us, rule_id || '|' || src_ip AS key FROM alerts),
a AS (SELECT key, min(ts_us) AS t FROM k GROUP BY key
      UNION ALL
      SELECT a.key, min(k.ts_us) FROM a JOIN k ON k.key = a.key AND k.ts_us >= a.t + {2 * DAY} GROUP BY a.key, a.t)
SELECT arg_min(k.alert_id, (k.ts_us, k.alert_id)) AS alert_id, a.key, a.t AS ts_us, count(*) - 1 AS duplicate_count
FROM a JOIN k ON k.key = a.key AND k.ts_us >= a.t AND k.ts_us < a.t + {2 * DAY} GROUP BY a.key, a.t""")
def alert_dedup(spark, sf_dir):
    a = views.alerts(spark, sf_dir).withColumns({"dst_ip": F.lit(None).cast("string"), "dst_port": F.lit(None).cast("int")})
    out = alerts.without_duplicates(a, 2 * DAY)
    return out.select("alert_id", F.concat_ws("|", "rule_id", "src_ip").alias("key"), "ts_us", "duplicate_count")


@query(f"""
WITH RECURSIVE {ALERTS_SQL},
g AS (SELECT src_ip, ts_us, alert_id, rule_id AS kind FROM alerts WHERE severity >= 2),
q AS (SELECT src_ip, ts_us, alert_id, (SELECT count(DISTINCT b.kind) FROM g b WHERE b.src_ip = a.src_ip AND b.ts_us >= a.ts_us - {DAY} AND (b.ts_us < a.ts_us OR b.ts_us = a.ts_us AND b.alert_id <= a.alert_id)) AS d FROM g a),
e AS (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY ts_us, alert_id) AS n FROM q WHERE d >= 3),
f AS (SELECT src_ip, ts_us, alert_id, d, n FROM e WHERE n = 1
      UNION ALL
      SELECT x.src_ip, x.ts_us, x.alert_id, x.d, x.n FROM (SELECT e.*, row_number() OVER (PARTITION BY e.src_ip ORDER BY e.n) AS k FROM f JOIN e ON e.src_ip = f.src_ip AND e.n > f.n AND e.ts_us - f.ts_us >= {DAY}) x WHERE x.k = 1)
SELECT src_ip, ts_us, alert_id, d::INT AS kinds FROM f""")
def correlation(spark, sf_dir):
    return alerts.correlated(views.alerts(spark, sf_dir), 3, DAY, DAY)


@query(f"""
WITH RECURSIVE {PACKETS_SQL},
s AS (SELECT src_ip AS app, ts_us, seq, CASE app WHEN 'click' THEN 'beacon' WHEN 'view' THEN 'bare_ip' WHEN 'error' THEN 'new_program' ELSE 'intel' END AS kind FROM packets),
q AS (SELECT app, ts_us, seq, (SELECT list_sort(list(DISTINCT b.kind)) FROM s b WHERE b.app = a.app AND b.ts_us >= a.ts_us - {6 * HOUR} AND (b.ts_us < a.ts_us OR b.ts_us = a.ts_us AND b.seq <= a.seq)) AS kinds FROM s a),
e AS (SELECT *, len(list_filter(kinds, lambda x: x <> 'bare_ip')) AS strong, row_number() OVER (PARTITION BY app ORDER BY ts_us, seq) AS n FROM q WHERE len(list_filter(kinds, lambda x: x <> 'bare_ip')) >= 2 AND list_has_any(kinds, ['beacon', 'intel', 'c2_infra'])),
f AS (SELECT app, ts_us, seq, kinds, strong, n FROM e WHERE n = 1
      UNION ALL
      SELECT x.app, x.ts_us, x.seq, x.kinds, x.strong, x.n FROM (SELECT e.*, row_number() OVER (PARTITION BY e.app ORDER BY e.n) AS k FROM f JOIN e ON e.app = f.app AND e.n > f.n AND e.ts_us - f.ts_us >= {6 * HOUR}) x WHERE x.k = 1)
SELECT app, '10.9.9.9' AS remote_ip, ts_us, seq, array_to_string(kinds, ',') AS signals, round(least(0.95, 0.5 + 0.15 * strong), 6)::DOUBLE AS confidence FROM f""")
def likely_control(spark, sf_dir):
    kind = F.when(F.col("app") == "click", "beacon").when(F.col("app") == "view", "bare_ip").when(F.col("app") == "error", "new_program").otherwise("intel")
    signals = views.packets(spark, sf_dir).select(F.col("src_ip").alias("app"), F.lit("10.9.9.9").alias("remote_ip"), kind.alias("kind"), "ts_us", "seq")
    found = alerts.likely_control(signals, window=6 * HOUR)
    return found.select("app", "remote_ip", "ts_us", "seq", F.array_join("signals", ",").alias("signals"), F.round("confidence", 6).alias("confidence"))


def _claims_sql() -> str:
    """Spans of each kind that no kind before has taken: each starts where the pieces and matches before it end."""
    steps, before = [], []
    for kind, pattern in indicators.CLAIMS:
        p = pattern.replace("'", "''")
        steps.append(f"""m_{kind} AS (SELECT doc_id, "end" - length(hit) AS start, "end", hit FROM (
  SELECT doc_id, hit, sum(length(piece) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS "end" FROM (
    SELECT doc_id, unnest(range(len(hits))) AS i, unnest(hits) AS hit, unnest(pieces[1:len(hits)]) AS piece FROM (
      SELECT doc_id, regexp_extract_all(text, '{p}') AS hits, string_split_regex(text, '{p}') AS pieces FROM t WHERE regexp_matches(text, '{p}')))){_NO_FILES if kind == "domain" else ""})""")
        taken = " AND ".join(f'NOT EXISTS (SELECT 1 FROM c_{b} b WHERE b.doc_id = m.doc_id AND b.start < m."end" AND b."end" > m.start)' for b in before) or "true"
        steps.append(f"c_{kind} AS MATERIALIZED (SELECT * FROM m_{kind} m WHERE {taken})")
        before.append(kind)
    return ",\n".join(steps)


_NO_FILES = " WHERE lower(split_part(hit, '.', -1)) NOT IN (" + ", ".join(f"'{e}'" for e in indicators.NOT_ZONES) + ")"
_CLAIMED_TEXT = """concat_ws(' ', text, 'seen at http://h' || doc_id % 50 || '.example.net/a?m=u' || doc_id || '@mail.example.org, CVE-2024-' || (1000 + doc_id % 9000), md5(doc_id::VARCHAR), 'from 10.0.' || doc_id % 300 || '.7 and update.exe')"""


@query(f"""
WITH t AS (SELECT doc_id, {_CLAIMED_TEXT} AS text FROM documents),
{_claims_sql()},
n AS (SELECT doc_id, start, 'url' AS kind, regexp_replace(hit, '[.,;:!?)\\]]+$', '') AS value FROM c_url
  UNION ALL SELECT doc_id, start, 'email', regexp_replace(hit, '@[^@]*$', '') || '@' || lower(split_part(hit, '@', -1)) FROM c_email
  UNION ALL SELECT doc_id, start, CASE length(hit) WHEN 32 THEN 'md5' WHEN 40 THEN 'sha1' ELSE 'sha256' END, lower(hit) FROM c_hash WHERE length(hit) IN (32, 40, 64)
  UNION ALL SELECT doc_id, start, 'cve', upper(hit) FROM c_cve
  UNION ALL SELECT doc_id, start, 'ipv4', array_to_string(list_transform(string_split(hit, '.'), lambda x: x::INT::VARCHAR), '.') FROM c_ipv4 WHERE list_max(list_transform(string_split(hit, '.'), lambda x: x::INT)) < 256
  UNION ALL SELECT doc_id, start, 'domain', lower(hit) FROM c_domain),
f AS (SELECT doc_id, kind, value, min(start) AS place FROM n WHERE kind <> 'url' OR split_part(value, '://', 2) <> '' GROUP BY doc_id, kind, value)
SELECT doc_id, place::INTEGER AS place, kind, value FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY place, kind, value) <= 500""")
def claimed_indicators(spark, sf_dir):
    """The documents' own addresses, and kinds that lie in one another; none of them has an address of the sixth version."""
    doc = F.col("doc_id").cast("string")
    number = lambda n: (F.col("doc_id") % n).cast("string")
    more = F.concat(F.lit("seen at http://h"), number(50), F.lit(".example.net/a?m=u"), doc, F.lit("@mail.example.org, CVE-2024-"), (1000 + F.col("doc_id") % 9000).cast("string"))
    text = F.concat_ws(" ", "text", more, F.md5(doc.cast("binary")), F.concat(F.lit("from 10.0."), number(300), F.lit(".7 and update.exe")))
    found = indicators.claims(_table(spark, sf_dir, "documents").select("doc_id", text.alias("text")))
    return found.filter("kind <> 'ipv6'")


@query(f"""
WITH {ALERTS_SQL},
w AS (SELECT *, regexp_extract_all(lower(message), '[A-Za-z0-9_.:\\-]+') AS words FROM alerts)
SELECT alert_id, ts_us, message FROM w WHERE list_contains(words, 'error') AND regexp_matches(lower(message), '(^| )to 10\\.0\\.1\\.7 port( |$)') AND list_contains(words, '5') AND technique LIKE 'T1110%' ORDER BY ts_us DESC, alert_id DESC LIMIT 1000""")
def alert_phrases(spark, sf_dir):
    """The alerts of the table are indexed in the shared folder, and the index is asked."""
    a, path = views.alerts(spark, sf_dir), f"{views.shared(spark)}/alert-index-{uuid.uuid4().hex}"
    search.write(a, path, 4)
    return search.search(a, path, 'error "to 10.0.1.7 port" 5', technique="T1110", parts=4).select("alert_id", "ts_us", "message")


# a rule of each kind of evidence over dissected payloads ------------------------------------------------------------------

_PAYLOAD = {
    "click": ("GET /.env?s=", " HTTP/1.1\r\nHost: h\r\nUser-Agent: CertUtil URL Agent\r\n\r\n", "tcp", 80),
    "error": ("PASS secret", "\r\n", "tcp", 21),
    "purchase": ("stratum {\"method\": \"mining.submit\", \"id\": ", "}", "tcp", 3333),
    "signup": ("x () { :; }; ping ", "", "tcp", 8000),
    "view": ("SSH-2.0-x", "\r\n", "tcp", 4444),
}


@query(f"""
WITH {PACKETS_SQL},
r AS (SELECT seq, app, src_ip, dst_ip, bytes FROM packets)
SELECT seq, rule_id FROM (
  SELECT seq, unnest(CASE app WHEN 'click' THEN ['REQUEST-secret-file', 'HEADER-scripted-fetch'] WHEN 'error' THEN ['LOGIN-ftp'] WHEN 'purchase' THEN ['SPEAKS-stratum'] WHEN 'signup' THEN ['CVE-2014-6271'] ELSE ['SPEAKS-ssh-elsewhere'] END) AS rule_id FROM r WHERE bytes % 4 <> 0
  UNION ALL SELECT seq, 'OPEN-IN-' || CASE bytes % 3 WHEN 0 THEN 'rdp' WHEN 1 THEN 'redis' ELSE 'ssh' END FROM r WHERE bytes % 4 = 0 AND app IN ('error', 'signup'))""")
def builtin_hits(spark, sf_dir):
    """Three of four packets carry a payload by their app; the fourth opens a connection, some of them from outside."""
    p, case = views.packets(spark, sf_dir), lambda at: F.expr("CASE app " + " ".join(f"WHEN '{k}' THEN {v[at]}" for k, v in _PAYLOAD.items() if at == 3) + " END")
    part = lambda at: F.element_at(F.create_map(*(F.lit(x) for k, v in _PAYLOAD.items() for x in (k, v[at]))), F.col("app"))
    opens = F.col("bytes") % 4 == 0
    payload = F.when(~opens, F.concat(part(0), F.col("bytes").cast("string"), part(1)).cast("binary"))
    port = F.when(opens, F.element_at(F.array(*map(F.lit, (3389, 6379, 22))), (F.col("bytes") % 3 + 1).cast("int"))).otherwise(case(3))
    src = F.when(opens & F.col("app").isin("error", "signup"), "8.8.4.4").otherwise("10.0.0.9")
    rows = p.select("seq", "ts_us", src.alias("src_ip"), F.lit("10.0.0.5").alias("dst_ip"), F.lit("tcp").alias("protocol"), F.lit(50_000).alias("src_port"), port.cast("int").alias("dst_port"), F.when(opens, 2).otherwise(24).alias("tcp_flags"), payload.alias("payload"))
    seen = dissect.dissected(rows)
    good, _ = rules.validate([r for r in builtin.RULES if "threshold" not in r], seen.schema)
    return rules.hits(seen, good).select("seq", "rule_id")


# aggregations and searches -----------------------------------------------------------------------------------------------

_TECHNIQUES_SQL = views.rows_sql(views.TECHNIQUES, "t", "technique_id", "name", "tactic", "place")


@query(f"""
WITH {ALERTS_SQL},
x AS (SELECT 'total' AS dimension, '' AS value, ts_us FROM alerts UNION ALL SELECT 'severity', severity::VARCHAR, ts_us FROM alerts UNION ALL SELECT 'type', alert_type, ts_us FROM alerts
      UNION ALL SELECT 'source', src_ip, ts_us FROM alerts UNION ALL SELECT 'technique', technique, ts_us FROM alerts),
c AS (SELECT dimension, value, count(*) AS n, min(ts_us) AS first_us, max(ts_us) AS last_us FROM x GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY n DESC, value) AS r FROM c)
SELECT dimension, value, n, first_us, last_us FROM r WHERE dimension NOT IN ('source', 'technique') OR r <= 10""")
def alert_stats(spark, sf_dir):
    return alerts.stats(views.alerts(spark, sf_dir))


@query(f"""
WITH {ALERTS_SQL}, {_TECHNIQUES_SQL},
m AS (SELECT a.*, coalesce(o.name, p.name, technique) AS name, coalesce(o.tactic, p.tactic, 'Other') AS tactic, coalesce(o.place, p.place, 99) AS place
      FROM alerts a LEFT JOIN t o ON technique = o.technique_id LEFT JOIN t p ON split_part(technique, '.', 1) = p.technique_id)
SELECT tactic, place::INT AS place, name, count(*) AS n, max(severity)::INT AS worst, arg_max(message, (ts_us, alert_id)) AS last_message FROM m GROUP BY tactic, place, name""")
def detections(spark, sf_dir):
    t = spark.createDataFrame(list(views.TECHNIQUES), "technique_id string, name string, tactic string, place int")
    return alerts.detections(views.alerts(spark, sf_dir), t)


@query(f"""
WITH {ALERTS_SQL}
SELECT src_ip, count(*) AS n, max(severity)::INT AS worst, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rules, min(ts_us) AS first_us, max(ts_us) AS last_us
FROM alerts GROUP BY src_ip ORDER BY worst DESC, n DESC, src_ip LIMIT 100""")
def offenders(spark, sf_dir):
    return alerts.offenders(views.alerts(spark, sf_dir))


@query(f"""
WITH {ALERTS_SQL}, now AS (SELECT max(ts_us) AS t FROM alerts),
b AS (SELECT *, row_number() OVER (PARTITION BY rule_id, src_ip ORDER BY severity DESC, ts_us DESC, alert_id DESC) AS n FROM alerts, now WHERE ts_us > t - {3 * DAY} AND severity >= 2)
SELECT rule_id, src_ip, severity::INT AS severity, ts_us, alert_id FROM b WHERE n = 1 ORDER BY severity DESC, ts_us DESC, alert_id DESC LIMIT 8""")
def attention(spark, sf_dir):
    a = views.alerts(spark, sf_dir)
    return alerts.attention(a, _now(a), 3 * DAY)


@query(f"""
WITH {ALERTS_SQL}, now AS (SELECT max(ts_us) AS t FROM alerts)
SELECT CASE max(severity) WHEN 4 THEN 'critical' WHEN 3 THEN 'warning' WHEN 2 THEN 'notice' ELSE 'ok' END AS level FROM alerts, now WHERE ts_us > t - {10 * MINUTE}""")
def threat_level(spark, sf_dir):
    a = views.alerts(spark, sf_dir)
    return alerts.threat_level(a, _now(a))


@query(f"""
WITH {ALERTS_SQL}, now AS (SELECT max(ts_us) // {MINUTE} AS m FROM alerts),
g AS (SELECT unnest(range(m - 59, m + 1)) AS minute FROM now),
c AS (SELECT ts_us // {MINUTE} AS minute, count(*) AS events, count(*) FILTER (severity >= 3) AS threats FROM alerts GROUP BY 1)
SELECT minute, coalesce(events, 0) AS events, coalesce(threats, 0) AS threats FROM g LEFT JOIN c USING (minute)""")
def timeline(spark, sf_dir):
    a = views.alerts(spark, sf_dir)
    return alerts.timeline(a, _now(a))


@query(f"""
WITH {ALERTS_SQL}
SELECT alert_id, ts_us, rule_id, severity::INT AS severity, message FROM alerts
WHERE severity >= 3 AND message LIKE 'click from %' AND ' ' || message || ' ' LIKE '% 93.184.216.34 %' ORDER BY ts_us DESC, alert_id DESC LIMIT 50""")
def alert_search(spark, sf_dir):
    return alerts.search(views.alerts(spark, sf_dir), "CLICK 93.184.216.34", 3, most=50).select("alert_id", "ts_us", "rule_id", "severity", "message")


@query(f"""
WITH {ALERTS_SQL},
w AS (SELECT *, dst_ip AS ip FROM alerts WHERE severity >= 3 AND app = 'click')
SELECT ip, arg_min(alert_id, (ts_us, alert_id)) AS alert_id, min(ts_us) AS ts_us, min(ts_us) + 3600000000 AS expires_us FROM w GROUP BY ip""")
def block_decisions(spark, sf_dir):
    a = views.alerts(spark, sf_dir).withColumn("severity", F.when(F.col("app") == "click", 4).otherwise(F.col("severity")))
    return alerts.block_decisions(a, spark.createDataFrame([("8.8.8.8",)], "ip string"))


@query(f"""
WITH {PACKETS_SQL},
h AS (SELECT app, src_ip, sum(bytes) AS b, row_number() OVER (PARTITION BY app ORDER BY sum(bytes) DESC, src_ip) AS n FROM packets GROUP BY app, src_ip),
t AS (SELECT app, string_agg(src_ip, ',' ORDER BY n) AS top_hosts FROM h WHERE n <= 6 GROUP BY app)
SELECT app, sum(bytes)::BIGINT AS bytes, count(*) AS packets, count(DISTINCT src_ip) AS remotes, min(ts_us) AS first_us, max(ts_us) AS last_us, any_value(top_hosts) AS top_hosts FROM packets JOIN t USING (app) GROUP BY app""")
def apps(spark, sf_dir):
    by_host = views.packets(spark, sf_dir).groupBy("app", "src_ip").agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n"), F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi"))
    ranked = by_host.withColumn("r", F.row_number().over(Window.partitionBy("app").orderBy(F.desc("b"), "src_ip"))).filter("r <= 6")
    top = ranked.groupBy("app").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "src_ip"))), lambda x: x["src_ip"]), ",").alias("top_hosts"))
    whole = by_host.groupBy("app").agg(F.sum("b").alias("bytes"), F.sum("n").alias("packets"), F.count(F.lit(1)).alias("remotes"), F.min("lo").alias("first_us"), F.max("hi").alias("last_us"))
    return whole.join(top, "app")


@query(f"""
WITH {PACKETS_SQL}
SELECT src_ip, dst_ip, dst_port, sum(bytes)::BIGINT AS bytes, count(*) AS packets FROM packets GROUP BY ALL ORDER BY bytes DESC, src_ip, dst_ip, dst_port LIMIT 50""")
def flows_top(spark, sf_dir):
    found = views.packets(spark, sf_dir).groupBy("src_ip", "dst_ip", "dst_port").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("packets"))
    return found.orderBy(F.desc("bytes"), "src_ip", "dst_ip", "dst_port").limit(50)


# rules -------------------------------------------------------------------------------------------------------------------


@query(f"""
WITH {PACKETS_SQL},
x AS (SELECT seq, 'REC-EMPTY' AS rule_id, 1 AS severity FROM packets WHERE bytes = 0 AND dst_port < 1024
  UNION ALL SELECT seq, 'EXF-LARGE', 3 FROM packets WHERE bytes >= 20000 AND dst_ip NOT LIKE '10.%'
  UNION ALL SELECT seq, 'POL-UDP', 1 FROM packets WHERE protocol = 'udp' AND dst_ip = '93.184.216.34')
SELECT seq, rule_id, severity FROM x""")
def rule_hits(spark, sf_dir):
    p = views.packets(spark, sf_dir)
    good, _ = rules.validate([r for r in rules.DEFAULT_RULES if "threshold" not in r], p.schema)
    return rules.alerts(p, good).select("seq", "rule_id", "severity")


@query(f"""
WITH RECURSIVE {PACKETS_SQL},
p AS (SELECT *, row_number() OVER (PARTITION BY src_ip, dst_ip ORDER BY ts_us, seq) AS n FROM packets WHERE app = 'error'),
f AS (SELECT src_ip, dst_ip, 0::BIGINT AS n, 0::BIGINT AS hit FROM p GROUP BY ALL
      UNION ALL
      SELECT x.src_ip, x.dst_ip, x.n, x.n FROM (SELECT a.src_ip, a.dst_ip, min(a.n) AS n FROM f JOIN p a ON a.src_ip = f.src_ip AND a.dst_ip = f.dst_ip AND a.n >= f.n + 3 JOIN p b ON b.src_ip = a.src_ip AND b.dst_ip = a.dst_ip AND b.n = a.n - 2 AND a.ts_us - b.ts_us <= {2 * DAY} GROUP BY a.src_ip, a.dst_ip, f.n) x)
SELECT p.seq, p.ts_us, p.src_ip, p.dst_ip, 'CRED-BURST' AS rule_id, 3 AS hits, p.src_ip || ' keeps failing on ' || p.dst_ip AS message FROM f JOIN p ON p.src_ip = f.src_ip AND p.dst_ip = f.dst_ip AND p.n = f.hit""")
def rule_threshold(spark, sf_dir):
    p = views.packets(spark, sf_dir)
    good, _ = rules.validate([r for r in rules.DEFAULT_RULES if "threshold" in r], p.schema)
    return rules.alerts(p, good).select("seq", "ts_us", "src_ip", "dst_ip", "rule_id", "hits", "message")


# functions over text -------------------------------------------------------------------------------------------------------


@query(rf"""
WITH {_HOSTS_SQL},
p AS (SELECT page_id, host, string_split(host, '.') AS parts FROM hosts),
c AS (SELECT page_id, host, unnest(string_split(host, '')) AS ch, length(host) AS n FROM hosts),
f AS (SELECT page_id, ch, count(*) / any_value(n) AS q FROM c WHERE ch <> '' GROUP BY page_id, ch),
h AS (SELECT page_id, sum(-q * log2(q)) AS entropy FROM f GROUP BY page_id)
SELECT page_id, host, array_to_string(parts[-2:], '.') AS domain, round(entropy, 6) AS entropy FROM p JOIN h USING (page_id)""")
def host_names(spark, sf_dir):
    host = names.host_of(F.col("url"))
    hosts = _table(spark, sf_dir, "pages").select("page_id", host.alias("host"))
    return hosts.select("page_id", "host", names.registered_domain(F.col("host")).alias("domain"), F.round(names.entropy(F.col("host")), 6).alias("entropy"))


_PLAIN_SQL = "coalesce(text, '')"
for _pattern, _put in ((r"\bh(?:xx|\*\*)p(s?)\b", r"http\1"), (r"\bfxp\b", "ftp"), (r"\s?[\[({]\s?(?:\.|dot)\s?[\])}]\s?", "."), (r"\s?[\[({]\s?(?:@|at)\s?[\])}]\s?", "@"), (r"[\[({]\s?:\s?[\])}]", ":"), (r"[\[({]\s?://\s?[\])}]", "://"), (r"[\[({]\s?/\s?[\])}]", "/")):
    _PLAIN_SQL = f"regexp_replace({_PLAIN_SQL}, '{_pattern}', '{_put}', 'gi')"


@query(rf"""
WITH t AS (SELECT doc_id, regexp_extract_all({_PLAIN_SQL}, '(?i)(?:https?|ftp)://[^\s"''<>]+|[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|CVE-[0-9]{{4}}-[0-9]{{4,7}}|[A-Za-z0-9][A-Za-z0-9.:-]*[A-Za-z0-9]') AS tokens FROM documents),
u AS (SELECT doc_id, unnest(tokens) AS token, unnest(range(len(tokens))) AS i FROM t),
d AS (SELECT doc_id, regexp_replace(token, '[.,;:!?)]+$', '') AS value, min(i) AS i FROM u GROUP BY 1, 2),
k AS (SELECT *, CASE WHEN regexp_full_match(value, '(?i)(?:https?|ftp)://[^\s]+') THEN 'url' WHEN regexp_full_match(value, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') THEN 'email'
  WHEN regexp_full_match(value, '(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){{3}}') THEN 'ipv4' WHEN regexp_full_match(value, '(?i)[0-9a-f:]{{2,39}}') AND value LIKE '%:%:%' THEN 'ipv6' WHEN regexp_full_match(value, '(?i)CVE-[0-9]{{4}}-[0-9]{{4,7}}') THEN 'cve'
  WHEN regexp_full_match(value, '(?i)AS[0-9]{{1,10}}') THEN 'asn' WHEN regexp_full_match(value, '(?i)[0-9a-f]{{32}}') THEN 'md5' WHEN regexp_full_match(value, '(?i)[0-9a-f]{{40}}') THEN 'sha1' WHEN regexp_full_match(value, '(?i)[0-9a-f]{{64}}') THEN 'sha256'
  WHEN regexp_full_match(value, '(?i)(?:[a-z0-9](?:[a-z0-9-]{{0,61}}[a-z0-9])?\.)+[a-z]{{2,24}}') AND lower(string_split(value, '.')[-1]) NOT IN {indicators.NOT_ZONES} THEN 'domain' END AS kind FROM d)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS place, kind, value FROM k WHERE kind IS NOT NULL""")
def indicators_in_text(spark, sf_dir):
    return indicators.find(_table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(f"""
WITH {PACKETS_SQL},
i AS (SELECT DISTINCT dst_ip FROM packets)
SELECT dst_ip, CASE WHEN dst_ip LIKE '10.%' OR dst_ip LIKE '198.51.100.%' THEN 'private' ELSE 'public' END AS class FROM i""")
def address_classes(spark, sf_dir):
    return views.packets(spark, sf_dir).select("dst_ip").distinct().withColumn("class", ip.classify(F.col("dst_ip")))
