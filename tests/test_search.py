"""The index of alerts against a plain search, and what a search reads; claims of indicators and ranges of addresses."""

from __future__ import annotations

import ipaddress
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import indicators
from tidewatch.operators import joins
from tidewatch.sinks import search

DAY = 86_400_000_000
ALERTS = "alert_id long, ts_us long, message string, src_ip string, dst_ip string, tag string, technique string"


def plain(rows, text, since=None, until=None):
    phrases = search.parsed(text)
    out = []
    for r in rows:
        fields = [re.findall(r"[\w.:\-]+", (x or "").lower()) for x in r[2:6]]
        there = all(any(f[i : i + len(p)] == p for f in fields for i in range(len(f))) for p in phrases)
        if phrases and there and r[1] is not None and (since is None or r[1] >= since) and (until is None or r[1] < until):
            out.append(r[0])
    return sorted(out)


def test_words_and_phrases(spark, tmp_path):
    rng = np.random.default_rng(1)
    said = ["port", "scan", "from", "lab", "Port", "scan-fast", "ünïcode", "10.0.0.1", "beacon", "to"]
    rows = [(i, int(i // 40 * DAY + i), " ".join(rng.choice(said, int(rng.integers(0, 12)))), f"10.0.0.{i % 3}", "8.8.8.8", str(rng.choice(["scan", "brute-force", ""])), str(rng.choice(["T1046", "T1046.001", "T10460"]))) for i in range(200)]
    rows += [(500, None, "port scan", None, None, None, None), (501, 5, None, None, None, None, None)]
    df = spark.createDataFrame(rows, ALERTS)
    path = str(tmp_path / "index")
    search.write(df, path, 8)
    search.write(df.filter("ts_us < 86400000000").unionByName(df.filter("alert_id = 3")), path, 8)  # a day again, one alert twice
    for text in ("port", "PORT scan", '"port scan"', '"scan from lab"', '"port scan" beacon', '"scan scan"', "10.0.0.1", '"8.8.8.8 scan"', "nothing", "", '""', "ünïcode to", '"from from" port to lab scan beacon x y z'):
        got = sorted(r.alert_id for r in search.matches(spark, path, text, parts=8).collect())
        assert got == plain(rows, text), text
    since, until = DAY, 3 * DAY + 130
    assert sorted(r.alert_id for r in search.matches(spark, path, "scan", since, until, 8).collect()) == plain(rows, "scan", since, until)
    found = search.search(df, path, '"port scan"', technique="T1046", parts=8)
    want = set(plain(rows, '"port scan"'))
    assert found.columns == df.columns and [r.alert_id for r in found.collect()] == sorted((r[0] for r in rows if r[0] in want and r[6] in ("T1046", "T1046.001")), reverse=True)
    files = {f.split("/part-")[0] for f in search.matches(spark, path, "beacon", DAY, 2 * DAY, 8).inputFiles()}
    read = search.matches(spark, path, "beacon", DAY, 2 * DAY, 8)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and re.search(r"PartitionFilters: \[[^\]]*part#\d+", plan) and files


CLAIMED = {
    "see http://evil.com/a?x=b@c.org, and b@c.org.": [("url", "http://evil.com/a?x=b@c.org"), ("email", "b@c.org")],
    "hxxps://bad[.]example/x)": [("url", "https://bad.example/x")],
    "10.0.0.1 10.0.0.300 setup.exe www.Example.ORG": [("ipv4", "10.0.0.1"), ("domain", "www.example.org")],
    "cve-2024-12345 and " + "A" * 32 + " " + "b" * 64 + " " + "c" * 50: [("cve", "CVE-2024-12345"), ("md5", "a" * 32), ("sha256", "b" * 64)],
    "2001:db8:0:0::1 and 12:30:45 x[::5]": [("ipv6", "2001:db8::1")],
    "a.com A.COM a.com": [("domain", "a.com")],
    "": [],
    None: [],
}


def test_claims(spark):
    df = spark.createDataFrame([(i, t, "p", 1) for i, t in enumerate(CLAIMED)], "id int, text string, kind string, place int").drop("kind", "place")
    got = {}
    for r in indicators.claims(df).orderBy("id", "place").collect():
        got.setdefault(r.id, []).append((r.kind, r.value))
    assert got == {i: v for i, v in enumerate(CLAIMED.values()) if v}
    many = spark.createDataFrame([(0, " ".join(f"h{i}.example.org" for i in range(700)))], "id int, text string")
    places = [r.place for r in indicators.claims(many).orderBy("place").collect()]
    assert len(places) == 500 and places[:3] == [0, 15, 30] and indicators.claims(many, most=3).count() == 3
    assert indicators.claims(many.limit(0)).collect() == []


@pytest.mark.parametrize("many", [False, True])
def test_ranges_of_addresses(spark, monkeypatch, many):
    if many:
        monkeypatch.setattr(joins, "MOST_LOCAL", 0)
    rng = np.random.default_rng(2)
    ranges = [("0.0.0.0", "255.255.255.255", "four"), ("::", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "six"), ("9.0.0.0", "8.0.0.0", "back"), ("1.1.1.1", "::1", "both"), (None, "1.1.1.1", "none"), ("x", "y", "text")]
    for i in range(40):
        a, b = sorted(rng.integers(0, 1 << 12, 2).tolist())
        four, six = int(ipaddress.ip_address("10.0.0.0")), int(ipaddress.ip_address("2001:db8::"))
        ranges += [(str(ipaddress.ip_address(four + a)), str(ipaddress.ip_address(four + b)), f"f{i}"), (str(ipaddress.IPv6Address(six + a * 7)), str(ipaddress.IPv6Address(six + b * 7)), f"s{i}")]
    ips = ["8.8.8.8", "::1", "no", None] + [str(ipaddress.ip_address(four + int(n))) for n in rng.integers(0, 1 << 12, 150)] + [str(ipaddress.IPv6Address(six + int(n))) for n in rng.integers(0, 7 << 12, 150)]

    def best(text):
        try:
            ip = ipaddress.ip_address(text)
        except ValueError:
            return None
        hits = []
        for lo, hi, name in ranges:
            try:
                lo, hi = ipaddress.ip_address(lo), ipaddress.ip_address(hi)
            except ValueError:
                continue
            if lo.version == hi.version == ip.version and lo <= ip <= hi:
                hits.append((int(hi) - int(lo), name))
        return min(hits)[1] if hits else None

    df = spark.createDataFrame([(i, x) for i, x in enumerate(ips)], "id int, ip string")
    dim = spark.createDataFrame(ranges, "lo string, hi string, country string")
    got = {r.id: r.country for r in joins.in_address_range(df, "ip", dim, "lo", "hi", ["country"]).collect()}
    assert got == {i: best(x) for i, x in enumerate(ips)}
    assert joins.in_address_range(df, "ip", dim.limit(0), "lo", "hi", ["country"]).filter(F.col("country").isNotNull()).count() == 0
