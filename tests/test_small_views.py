from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import names
from tidewatch.operators import host, intel


def test_inner_hosts(spark):
    cases = {"printer.local": "a zone of its own network", "a.home.arpa.": "a zone of its own network", "intranet": "a zone of its own network", "server": "a name without a domain", "10.0.0.1": "an address of its own network", "fe80::1": "an address of its own network", "8.8.8.8": None, "example.org": None, "notlocal.org": None, "": "no name", None: "no name"}
    df = spark.createDataFrame([(h,) for h in cases], "h string").select("h", names.inner_reason(F.col("h")).alias("r"))
    assert {r.h: r.r for r in df.collect()} == cases


def test_orders_and_questions(spark):
    rows = [("curl", "1.1.1.1", 443, 0, [], "internet"), ("Safari", "2.2.2.2", 443, 2, ["intel"], "internet"), ("ssh", "10.0.0.2", 22, 2, ["x"], "lan"), (None, "3.3.3.3", 1, None, [], "internet")]
    df = spark.createDataFrame(rows, "app string, remote_ip string, remote_port int, risk int, flags array<string>, scope string")
    apps = lambda d: [r.app for r in d.collect()]
    assert apps(host.asked(df)) == ["Safari", "ssh", "curl", None]
    assert apps(host.asked(df, flagged=True, internet=True)) == ["Safari"] and apps(host.asked(df, app="SAF")) == ["Safari"] and apps(host.asked(df, most=1)) == ["Safari"]
    items = spark.createDataFrame([("a", 1, 5), ("b", 3, 1), ("c", 1, 9), ("d", 1, None)], "label string, risk int, modified_us long")
    assert [r.label for r in host.ordered(items, "launch_items").collect()] == ["b", "c", "a", "d"]


def test_names_explanations_and_certificates(spark):
    wanted = spark.createDataFrame([("Example.net.",), ("example.net",), ("h1.example.net",), ("",), (None,)], "domain string")
    seen = spark.createDataFrame([("s1", "H1.example.net"), ("s1", "h1.example.net"), ("s2", "notexample.net"), (None, "example.net")], "src_ip string, host string")
    assert sorted((tuple(r) for r in intel.in_traffic(wanted, seen).collect()), key=str) == sorted([("example.net", "s1", "h1.example.net"), ("h1.example.net", "s1", "h1.example.net"), ("example.net", None, "example.net")], key=str)
    alerts = spark.createDataFrame([(1,), (1,), (2,), (None,)], "alert_id long")
    said = spark.createDataFrame([(1, 5, "old"), (1, 9, "new")], "alert_id long, ts_us long, text string")
    assert sorted((tuple(r) for r in intel.explained(alerts, said).collect()), key=str) == sorted([(1, "new"), (1, "new"), (2, None), (None, None)], key=str)
    one, two = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id long, name string"), spark.createDataFrame([(2, "d", 7), (3, "e", 8)], "id long, name string, days int")
    assert sorted(tuple(r) for r in intel.certificates(one, two).collect()) == [(1, "a", None), (2, "c", None), (3, "e", 8)]
