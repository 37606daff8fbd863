"""Network views over the test tables: pure expressions, so that another engine computes the same ones.

``packets`` reads each event as a packet: the user is the source, the type is the destination and protocol, the number
in props is the port, and the value is the size. The SQL texts below are the same views for the oracle.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Destination and protocol by event type.
TARGETS = {
    "signup": ("10.0.0.5", "tcp"),
    "error": ("10.0.1.7", "tcp"),
    "click": ("93.184.216.34", "udp"),
    "view": ("198.51.100.20", "udp"),
    "purchase": ("151.101.1.69", "tcp"),
}


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where Spark runs on this machine
    alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidewatch-")
    return found.rstrip("/")


def _case(column: str, at: int) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v[at]}'" for k, v in TARGETS.items()) + " END"


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, ts_us, src_ip, dst_ip, dst_port, protocol, bytes, app."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col("event_id").cast("long").alias("seq"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        F.concat_ws(".", F.lit("10"), F.floor(F.col("user_id") / 65536).cast("string"), (F.floor(F.col("user_id") / 256) % 256).cast("string"), (F.col("user_id") % 256).cast("string")).alias("src_ip"),
        F.expr(_case("event_type", 0)).alias("dst_ip"),
        F.get_json_object("props", "$.k").cast("int").alias("dst_port"),
        F.expr(_case("event_type", 1)).alias("protocol"),
        F.round(F.abs("value") * 100).cast("long").alias("bytes"),
        F.col("event_type").alias("app"),
    )


PACKETS_SQL = f"""
packets AS (
  SELECT event_id::BIGINT AS seq, epoch_us(ts) AS ts_us,
         '10.' || (user_id // 65536) || '.' || (user_id // 256 % 256) || '.' || (user_id % 256) AS src_ip,
         {_case("event_type", 0)} AS dst_ip,
         json_extract_string(props, '$.k')::INT AS dst_port,
         {_case("event_type", 1)} AS protocol,
         round(abs(value) * 100)::BIGINT AS bytes, event_type AS app
  FROM events)"""

#: Segments between each user and one server, by the packet's app, port and size.
_SEGMENT = {
    "outbound": "bytes % 3 <> 0",
    "protocol": "CASE WHEN dst_port % 7 = 3 THEN 'udp' ELSE 'tcp' END",
    "tcp_flags": "CASE app WHEN 'signup' THEN 2 WHEN 'error' THEN CASE WHEN bytes % 2 = 0 THEN 4 ELSE 18 END WHEN 'click' THEN 16 WHEN 'view' THEN 24 ELSE 17 END",
    "bytes": "CASE WHEN app = 'view' THEN bytes ELSE 0 END",
}
_SERVER = "'10.9.9.9'"
_PORT = "40000 + dst_port % 2"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, ts_us, src_ip, src_port, dst_ip, dst_port, protocol, tcp_flags, bytes."""
    s = packets(spark, sf_dir).select("seq", "ts_us", F.col("src_ip").alias("user"), F.expr(_PORT).alias("port"), *(F.expr(v).alias(k) for k, v in _SEGMENT.items()))
    sides = {"src_ip": ("user", _SERVER), "src_port": ("port", "443"), "dst_ip": (_SERVER, "user"), "dst_port": ("443", "port")}
    return s.select("seq", "ts_us", *(F.expr(f"CASE WHEN outbound THEN {a} ELSE {b} END").alias(k) for k, (a, b) in sides.items()), "protocol", "tcp_flags", "bytes")


SEGMENTS_SQL = PACKETS_SQL + f""",
segments AS (SELECT seq, ts_us, src_ip AS client, {_PORT} AS port, {", ".join(f"{v} AS {k}" for k, v in _SEGMENT.items())} FROM packets)"""

HOUR = 3_600_000_000
MINUTE = 60_000_000


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An alert for each packet: alert_id, ts_us, rule_id, src_ip, dst_ip, dst_port, severity, alert_type, tag, technique, message."""
    p = packets(spark, sf_dir)
    return p.select(F.col("seq").alias("alert_id"), "ts_us", *(F.expr(v).alias(k) for k, v in _ALERT.items()), "src_ip", "dst_ip", "dst_port", "app")


_ALERT = {
    "rule_id": "CASE app WHEN 'signup' THEN 'REC-1' WHEN 'error' THEN 'CRED-1' WHEN 'click' THEN 'C2-1' WHEN 'view' THEN 'EXF-1' ELSE 'POL-1' END",
    "severity": "CASE WHEN app = 'error' AND dst_port % 2 = 0 THEN 4 WHEN app IN ('error', 'click') THEN 3 WHEN app = 'view' THEN 2 ELSE 1 END",
    "alert_type": "CASE WHEN app IN ('signup', 'purchase') THEN 'signature' WHEN app = 'error' THEN 'behavioral' WHEN app = 'click' THEN 'threat_intel' ELSE 'anomaly' END",
    "tag": "CASE WHEN app = 'error' THEN 'brute-force' WHEN app = 'click' THEN 'beacon' WHEN app = 'view' THEN 'exfiltration' WHEN app = 'signup' THEN 'scan' ELSE 'policy' END",
    "technique": "CASE WHEN app = 'error' THEN 'T1110.001' WHEN app = 'click' THEN 'T1071.001' WHEN app = 'view' THEN 'T1048' WHEN app = 'signup' THEN 'T1046' ELSE 'T9999' END",
    "message": "concat(app, ' from ', src_ip, ' to ', dst_ip, ' port ', cast(dst_port AS STRING))",
}
ALERTS_SQL = PACKETS_SQL + ",\nalerts AS (SELECT seq AS alert_id, ts_us, " + ", ".join(f"{v} AS {k}" for k, v in _ALERT.items()) + ", src_ip, dst_ip, dst_port, app FROM packets)"

#: Techniques and their tactics, with the tactic's place in the chain: fixed values.
TECHNIQUES = (
    ("T1046", "Network Service Discovery", "Discovery", 9),
    ("T1110", "Brute Force", "Credential Access", 8),
    ("T1071", "Application Layer Protocol", "Command and Control", 12),
    ("T1071.001", "Web Protocols", "Command and Control", 12),
    ("T1048", "Exfiltration Over Alternative Protocol", "Exfiltration", 13),
    ("T1190", "Exploit Public-Facing Application", "Initial Access", 3),
)
#: Networks with one inside another, to look addresses up in.
NETWORKS = (("10.0.0.0/8", "internal"), ("10.0.0.0/24", "first floor"), ("10.0.0.64/26", "lab"), ("10.0.1.0/24", "servers"), ("93.184.216.34", "known host"), ("198.51.100.0/24", "documentation"))


def rows_sql(rows: tuple[tuple, ...], name: str, *columns: str) -> str:
    """A common table expression of literal rows."""
    body = ", ".join("(" + ", ".join(repr(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    return f"{name}({', '.join(columns)}) AS (VALUES {body})"
