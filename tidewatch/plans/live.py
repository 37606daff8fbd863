"""Queries of the live views, and for each the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import flows, live

from . import views
from .network import DAY, query
from .views import ALERTS_SQL, HOUR, PACKETS_SQL

#: Traffic as the views read it: the user is the remote side.
_TRAFFIC = {
    "direction": "CASE WHEN bytes % 5 = 0 THEN 'local' WHEN bytes % 3 = 0 THEN 'inbound' ELSE 'outbound' END",
    "remote_host": "CASE WHEN dst_port % 3 = 0 THEN NULL ELSE concat('h', cast(dst_port % 10 AS STRING), '.example.net') END",
    "country": "CASE dst_port % 4 WHEN 1 THEN 'DE' WHEN 2 THEN 'FR' WHEN 3 THEN 'US' END",
}
_TRAFFIC_CTE = "traffic AS (SELECT seq, ts_us, bytes, src_ip AS remote_ip, CASE WHEN app = 'view' THEN NULL ELSE app END AS app, " + ", ".join(f"{v} AS {k}" for k, v in _TRAFFIC.items()) + " FROM packets)"
_TRAFFIC_SQL = PACKETS_SQL + ",\n" + _TRAFFIC_CTE
#: Alerts with tags and the remote side; the rule's name is missing where the detector has none.
_TAGGED = {
    "rule_id": "CASE app WHEN 'signup' THEN 'stealth-quic-1' WHEN 'error' THEN NULL WHEN 'click' THEN '' ELSE rule_id END",
    "tags": "CASE app WHEN 'error' THEN array('x', 'brute_force') WHEN 'click' THEN array('beaconing', 'web') WHEN 'view' THEN array('new_device') ELSE array('policy') END",
}
_TAGGED_SQL = ALERTS_SQL + """,
tagged AS (SELECT alert_id, ts_us, severity::INT AS severity, alert_type, message, src_ip, dst_ip, app, CASE WHEN dst_port % 2 = 0 THEN dst_ip END AS remote_ip, CASE app WHEN 'signup' THEN 'stealth-quic-1' WHEN 'error' THEN NULL WHEN 'click' THEN '' ELSE rule_id END AS rule_id,
  CASE app WHEN 'error' THEN ['x', 'brute_force'] WHEN 'click' THEN ['beaconing', 'web'] WHEN 'view' THEN ['new_device'] ELSE ['policy'] END AS tags,
  CASE app WHEN 'click' THEN 'threat' WHEN 'signup' THEN 'quic' WHEN 'view' THEN 'host' ELSE 'attack' END AS kind,
  CASE app WHEN 'signup' THEN 'stealth-quic-1' WHEN 'error' THEN 'detector:brute_force' WHEN 'click' THEN 'detector:beaconing' ELSE rule_id END AS name FROM alerts)"""


def traffic(spark, sf_dir):
    return views.packets(spark, sf_dir).select("seq", "ts_us", "bytes", F.col("src_ip").alias("remote_ip"), F.when(F.col("app") != "view", F.col("app")).alias("app"), *(F.expr(v).alias(k) for k, v in _TRAFFIC.items()))


def tagged(spark, sf_dir):
    a = views.alerts(spark, sf_dir).select("alert_id", "ts_us", "severity", "alert_type", "message", "src_ip", "dst_ip", "app", F.expr("CASE WHEN dst_port % 2 = 0 THEN dst_ip END").alias("remote_ip"), *(F.expr(v).alias(k) for k, v in _TAGGED.items()))
    return a.withColumn("kind", live.kind(F.col("rule_id"), F.col("tags"), F.col("alert_type")))


def _now(df):
    return df.agg(F.max("ts_us")).first()[0]


def _top_sql(value: str, name: str) -> str:
    return f"""(SELECT app, string_agg({value}, ',' ORDER BY n) AS {name} FROM (SELECT app, {value}, row_number() OVER (PARTITION BY app ORDER BY sum(bytes) DESC, {value}) AS n FROM t WHERE {value} IS NOT NULL GROUP BY app, {value}) WHERE n <= 6 GROUP BY app)"""


@query(f"""
WITH {_TAGGED_SQL}, {_TRAFFIC_CTE},
t AS (SELECT seq, ts_us, bytes, remote_ip, direction, remote_host, country, coalesce(app, 'Unattributed') AS app FROM traffic WHERE direction IN ('outbound', 'inbound', 'transit')),
a AS (SELECT app, coalesce(sum(bytes) FILTER (direction = 'outbound'), 0)::BIGINT AS bytes_out, coalesce(sum(bytes) FILTER (direction <> 'outbound'), 0)::BIGINT AS bytes_in, count(*) AS packets, count(DISTINCT remote_ip) AS remotes, min(ts_us) AS first_us, max(ts_us) AS last_us FROM t GROUP BY app)
SELECT a.*, h.top_hosts, c.countries, coalesce(n.alerts, 0) AS alerts FROM a LEFT JOIN {_top_sql("remote_host", "top_hosts")} h USING (app) LEFT JOIN {_top_sql("country", "countries")} c USING (app)
LEFT JOIN (SELECT app, count(*) AS alerts FROM tagged GROUP BY app) n USING (app)""")
def app_traffic(spark, sf_dir):
    out = live.apps(traffic(spark, sf_dir), tagged(spark, sf_dir))
    return out.withColumns({c: F.array_join(c, ",") for c in ("top_hosts", "countries")})


@query(f"""
WITH {_TAGGED_SQL}, {_TRAFFIC_CTE},
t AS (SELECT seq, ts_us, bytes, remote_ip, remote_host, country, coalesce(app, 'Unattributed') AS app FROM traffic WHERE direction IN ('outbound', 'inbound', 'transit'))
SELECT remote_ip, sum(bytes)::BIGINT AS bytes, count(*) AS packets, string_agg(DISTINCT app, ',' ORDER BY app) AS apps, min(ts_us) AS first_us, max(ts_us) AS last_us, arg_max(remote_host, (ts_us, seq)) FILTER (remote_host IS NOT NULL) AS remote_host, arg_max(country, (ts_us, seq)) FILTER (country IS NOT NULL) AS country,
  coalesce(any_value(n.alerts), 0) AS alerts FROM t LEFT JOIN (SELECT remote_ip, count(*) AS alerts FROM tagged WHERE remote_ip IS NOT NULL GROUP BY remote_ip) n USING (remote_ip) GROUP BY remote_ip""")
def remote_traffic(spark, sf_dir):
    return live.remotes(traffic(spark, sf_dir), tagged(spark, sf_dir)).withColumn("apps", F.array_join("apps", ","))


@query(f"""
WITH {PACKETS_SQL}, now AS (SELECT max(ts_us) // {HOUR} AS m FROM packets),
g AS (SELECT unnest(range(m - 60, m)) AS step FROM now),
c AS (SELECT ts_us // {HOUR} AS step, count(*) AS packets, sum(bytes)::BIGINT AS bytes FROM packets GROUP BY 1)
SELECT step, coalesce(packets, 0) AS packets, coalesce(bytes, 0) AS bytes FROM g LEFT JOIN c USING (step)""")
def traffic_rates(spark, sf_dir):
    p = views.packets(spark, sf_dir)
    return live.rates(p, _now(p), HOUR)


@query(f"""
WITH {PACKETS_SQL}, now AS (SELECT max(ts_us) // {HOUR} AS m FROM packets),
c AS (SELECT count(*) AS p, coalesce(sum(bytes), 0) AS b FROM packets, now WHERE ts_us // {HOUR} BETWEEN m - 5 AND m - 1)
SELECT round(p / 18000.0, 1)::DOUBLE AS pps, round(b * 8 / 18000.0)::BIGINT AS bps FROM c""")
def traffic_now(spark, sf_dir):
    return live.rate_now(traffic_rates(spark, sf_dir), HOUR)


@query(f"""
WITH {_TAGGED_SQL},
d AS (SELECT 'kind' AS dimension, unnest([{", ".join(repr(k) for k in live.KINDS)}]) AS value UNION ALL SELECT 'severity', unnest(['1', '2', '3', '4'])),
c AS (SELECT 'kind' AS dimension, kind AS value, count(*) AS n FROM tagged GROUP BY kind UNION ALL SELECT 'severity', severity::VARCHAR, count(*) FROM tagged GROUP BY severity)
SELECT dimension, value, coalesce(n, 0) AS n FROM d LEFT JOIN c USING (dimension, value)""")
def alert_summary(spark, sf_dir):
    return live.summary(tagged(spark, sf_dir))


@query(f"""
WITH {_TAGGED_SQL}
SELECT name, count(*) AS n, max(severity) AS worst, min(ts_us) AS first_us, max(ts_us) AS last_us, arg_max(message, (ts_us, alert_id)) AS example FROM tagged GROUP BY name""")
def detection_counts(spark, sf_dir):
    return live.by_detection(tagged(spark, sf_dir))


@query(f"""
WITH {_TAGGED_SQL}
SELECT coalesce(remote_ip, src_ip) AS ip, count(*) AS n, max(severity) AS worst, string_agg(DISTINCT name, ',' ORDER BY name) AS detections, min(ts_us) AS first_us, max(ts_us) AS last_us FROM tagged WHERE kind IN ('threat', 'attack', 'host')
GROUP BY 1 ORDER BY worst DESC, n DESC, ip LIMIT 100""")
def alert_offenders(spark, sf_dir):
    return live.by_offender(tagged(spark, sf_dir), latest=()).withColumn("detections", F.array_join("detections", ","))


@query(f"""
WITH {_TAGGED_SQL}
SELECT coalesce(remote_ip, dst_ip) AS ip, count(*) AS n, max(severity) AS worst, bool_or(list_contains(tags, 'beaconing')) AS beacon, bool_or(list_contains(tags, 'likely_c2')) AS c2 FROM tagged GROUP BY 1""")
def alert_index(spark, sf_dir):
    return live.alert_index(tagged(spark, sf_dir))


_FLOWS_SQL = f"""
WITH {PACKETS_SQL},
k AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY src_ip, dst_port, dst_ip ORDER BY ts_us, seq) <= {2 * DAY} THEN 0 ELSE 1 END AS new FROM packets WHERE protocol = 'udp'),
s AS (SELECT *, sum(new) OVER (PARTITION BY src_ip, dst_port, dst_ip ORDER BY ts_us, seq) AS flow FROM k),
f AS (SELECT md5(concat_ws(':', 'udp', CASE WHEN src_ip <= dst_ip THEN src_ip ELSE dst_ip END, CASE WHEN src_ip <= dst_ip THEN 40000 ELSE dst_port END, CASE WHEN src_ip <= dst_ip THEN dst_ip ELSE src_ip END, CASE WHEN src_ip <= dst_ip THEN dst_port ELSE 40000 END)) AS flow_id,
  flow::BIGINT AS flow, src_ip, dst_ip, dst_port, min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) AS packets, sum(bytes)::BIGINT AS bytes, 'new' AS state, 'active' AS outcome FROM s GROUP BY src_ip, dst_ip, dst_port, flow)"""


def _flows(spark, sf_dir):
    p = views.packets(spark, sf_dir).filter("protocol = 'udp'").withColumns({"src_port": F.lit(40000), "tcp_flags": F.lit(0)})
    return flows.connections(p, 2 * DAY)


@query(_FLOWS_SQL + """
SELECT 'protocol' AS dimension, 'udp' AS value, count(*) AS n FROM f UNION ALL SELECT 'state', state, count(*) FROM f GROUP BY state""")
def flow_counts(spark, sf_dir):
    return live.flow_counts(_flows(spark, sf_dir))


_FLOW_COLUMNS = ("flow_id", "flow", "dst_port", "first_us", "last_us", "packets", "bytes")


@query(_FLOWS_SQL + f""", r AS (SELECT {", ".join(_FLOW_COLUMNS)}, row_number() OVER (ORDER BY last_us - first_us DESC, flow_id, flow) AS n FROM f WHERE contains(concat_ws(' ', src_ip, dst_ip, 40000, dst_port, 'udp', state, outcome), '10.0.0.1'))
SELECT {", ".join(_FLOW_COLUMNS)} FROM r WHERE n <= 40""")
def flow_search(spark, sf_dir):
    return live.flow_list(_flows(spark, sf_dir), "duration", "10.0.0.1", "active", 40).select(*_FLOW_COLUMNS)


@query(f"""
WITH {_TRAFFIC_SQL},
g AS (SELECT remote_ip, country, remote_host, ts_us, seq FROM traffic)
SELECT remote_ip, arg_min(country, (ts_us, seq)) FILTER (country IS NOT NULL) AS country, arg_min(remote_host, (ts_us, seq)) FILTER (remote_host IS NOT NULL) AS remote_host FROM g GROUP BY remote_ip""")
def flow_annotation(spark, sf_dir):
    return live.annotated(traffic(spark, sf_dir), ["remote_ip"], ("country", "remote_host"))


@query(_FLOWS_SQL + """
SELECT (SELECT count(*) FROM packets) AS packets, (SELECT round((max(ts_us) - min(ts_us)) / 1e6, 3) FROM packets) AS seconds, (SELECT round(count(*) / ((max(ts_us) - min(ts_us)) / 1e6), 6) FROM packets) AS pps, (SELECT count(*) FROM f) AS flows, 4 AS rules""")
def engine_stats(spark, sf_dir):
    from .rules import DEFAULT_RULES

    return live.engine_stats(views.packets(spark, sf_dir), _flows(spark, sf_dir), min(len(DEFAULT_RULES), 4))
