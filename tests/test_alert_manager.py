"""Alerts that come again, and allowlists after a shuffle."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import alerts, intel

ALERTS = "alert_id long, ts_us long, rule_id string, alert_type string, severity int, src_ip string, dst_ip string, dst_port int, message string"


def test_replayed_and_nameless_alerts_are_duplicates(spark):
    row = lambda i, t, src="10.0.0.1", m="m": (i, t, "R", "signature", 2, src, "8.8.8.8", 80, m)
    rows = [row(1, 0), row(1, 0), row(None, 5), row(2, 59), row(3, 60), row(3, 61), row(None, 10, "10.0.0.2"), row(None, 10, "10.0.0.2"), row(9, None), row(7, 0, "10.0.0.3", "z"), row(7, 0, "10.0.0.3", "a")]
    got = alerts.without_duplicates(spark.createDataFrame(rows, ALERTS).repartition(5), 60)
    assert got.columns == [*(c.split()[0] for c in ALERTS.split(", ")), "duplicate_count"]
    assert sorted(((r.alert_id, r.ts_us, r.src_ip, r.message, r.duplicate_count) for r in got.collect()), key=str) == sorted(
        [(1, 0, "10.0.0.1", "m", 3), (3, 60, "10.0.0.1", "m", 1), (None, 10, "10.0.0.2", "m", 1), (9, None, "10.0.0.1", "m", 0), (7, 0, "10.0.0.3", "a", 1)], key=str
    )
    assert alerts.without_duplicates(spark.createDataFrame([], ALERTS), 60).collect() == []


RULES = "rule_no int, kind string, rule_id string, app string, host string, ip string"


def plain_allowed(a, rules):
    name = lambda x: x.lower().rstrip(".") if x else None
    claimed = bool(a.unverified) and a.kind in intel.SECURITY_KINDS
    host = name(a.query_name if claimed else a.remote_host or a.query_name)
    for no, kind, rule, app, of, ip in sorted(rules):
        if (kind, rule, app, of, ip) == (None,) * 5:
            continue
        if kind not in (None, a.kind) or app not in (None, a.app) or ip not in (None, a.src_ip, a.dst_ip):
            continue
        if rule and rule.upper() != (a.rule_id or "").upper():
            continue
        if of and not (host and (host == of or host.endswith("." + of))):
            continue
        return no
    return None


@pytest.mark.parametrize("compiled", [True, False])
def test_allowed_after_a_shuffle(spark, monkeypatch, compiled):
    """Alerts that repeat, have no id, and come from a shuffle whose small partitions are joined as the query runs."""
    if not compiled:
        monkeypatch.setattr(intel, "MOST_COMPILED", 0)
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(F.xxhash64("id", F.lit(len(xs)), F.lit(str(xs))), F.lit(len(xs))) + 1).cast("int"))
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 3 > 0, F.col("id") % 50).alias("alert_id"), pick("threat", "info", "beacon").alias("kind"), pick("r1", "R2", None, "r3").alias("rule_id"), pick("curl", "ssh", None).alias("app"),
        pick("a.example.com", "example.com.", "other.net", None, "notexample.com").alias("remote_host"), pick("x.other.net", None).alias("query_name"), pick(True, False, None).alias("unverified"), pick("10.0.0.1", "10.0.0.2", None).alias("src_ip"), pick("8.8.8.8", "9.9.9.9").alias("dst_ip"),
    )
    rules = [(1, None, None, None, None, None), (2, "beacon", None, "curl", None, "9.9.9.9"), (3, None, None, None, "example.com", None), (4, None, "R1", "ssh", "other.net", None), (5, None, None, None, None, "10.0.0.2"), (6, "info", None, None, None, None), (7, None, "r3", None, None, None)]
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    try:
        got = intel.allowed(rows.repartition(64, "alert_id"), spark.createDataFrame(rules, RULES)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.parallelismFirst")
    assert len(got) == 20_000
    assert [r.allowed_by for r in got] == [plain_allowed(r, rules) for r in got]
    assert {r.allowed_by for r in got} == {None, 2, 3, 4, 5, 6, 7}
