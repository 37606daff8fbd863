"""Detectors, joins, folds, rules and text functions on literal rows, and every query against its SQL."""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import indicators, ip, names
from tidewatch.operators import alerts, detectors, joins
from tidewatch.plans import network, rules

S = 1_000_000
SF = "/root/testdata/sf0.001"
PACKETS = "seq long, ts_us long, src_ip string, dst_ip string, dst_port int, protocol string, bytes long, app string"


def packets(spark, rows):
    """Rows of (seconds, src, dst, port) or longer."""
    full = [(n, int(r[0] * S), r[1], r[2], r[3], "tcp", r[4] if len(r) > 4 else 0, "x") for n, r in enumerate(rows)]
    return spark.createDataFrame(full, PACKETS)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def norm(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(network.QUERIES))
def test_queries_give_the_rows_of_their_sql(spark, con, name):
    df = network.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = norm(df.select(*columns).collect())
    if name in network.ORACLES:
        assert got == norm(con.execute("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({network.ORACLES[name]})").fetchall())


def test_port_scan_fires_once_a_window(spark):
    rows = [(1000, "a", "b", p) for p in range(20, 30)] + [(1100 + i, "a", "b", p) for i, p in enumerate(range(20, 30))]
    assert [r.seq for r in detectors.vertical_scan(packets(spark, rows), 5).orderBy("seq").collect()] == [4, 14]
    rows = [(1000 + i / 10, "a", f"h{i}", 80) for i in range(10)]
    assert detectors.horizontal_scan(packets(spark, rows), 5).count() == 1


def test_brute_force_fires_on_the_rise_only(spark):
    rows = [(1000 + i / 2, "a", "b", 22) for i in range(10)] + [(2000 + i / 2, "a", "b", 22) for i in range(10)]
    assert [r.seq for r in detectors.brute_force(packets(spark, rows), 5).orderBy("seq").collect()] == [4, 14]


def test_regular_gaps_are_a_beacon_and_irregular_ones_are_not(spark):
    gaps, at = [1, 5, 300, 0.5, 120, 0.2, 45, 200, 3], [2000.0]
    for g in gaps:
        at.append(at[-1] + g)
    rows = [(1000 + 30 * i, "a", "b", 4444) for i in range(10)] + [(t, "a", "c", 4444) for t in at]
    found = detectors.beacons(packets(spark, rows)).collect()
    assert [(r.dst_ip, r.n_gaps) for r in found] == [("b", 5)] and found[0].cv < 0.2 and found[0].confidence == 1.0


def test_exfiltration_once_a_flow(spark):
    rows = [(1000, "a", "b", 443, 600), (1001, "a", "b", 443, 600), (1002, "a", "b", 443, 600)]
    assert [(r.seq, r.sent) for r in detectors.exfiltration(packets(spark, rows), 1024).collect()] == [(1, 1200)]


def test_rate_spike_after_quiet_windows(spark):
    rows = [(1000 + 10 * w + k, "a", "b", 80) for w in range(20) for k in range(2)] + [(1200 + k / 20, "a", "b", 80) for k in range(100)]
    found = detectors.rate_spikes(packets(spark, rows), sigma=2.0, least_rate=0.0).collect()
    assert found and min(r.seq for r in found) > 40


def test_repeats_report_what_they_hid(spark):
    rows = [(600.0 * i, "a", "b", 1) for i in range(6)] + [(3000 + 3700.0, "a", "b", 1)]
    found = detectors.repeats(packets(spark, rows), ["src_ip"], 3600 * S).orderBy("seq").collect()
    assert [(r.seq, r.suppressed) for r in found] == [(0, 0), (6, 5)]


def test_flow_sessions_end_after_a_gap_and_join_both_ways(spark):
    rows = [(1000, "a", "b", 53), (1010, "b", "a", 53), (1070, "a", "b", 53), (1131, "a", "b", 53)]
    p = packets(spark, rows).withColumn("src_port", F.lit(53))
    assert [(r.src_ip, r.packets) for r in detectors.flow_sessions(p).orderBy("first_us").collect()] == [("a", 3), ("a", 1)]


def test_web_attacks_far_into_a_body(spark):
    df = spark.createDataFrame([(0, "/form", "x" * 20_000 + " <script>"), (1, "/form", None)], "id int, uri string, body string")
    assert [(r.id, r.attack) for r in detectors.web_attacks(df).collect()] == [(0, "script_injection")]


def test_web_attacks(spark):
    uris = ["/a?id=1%27%20OR%201=1", "/x?q=%3Cscript%3E", "/../../etc/passwd", "/plain", None]
    df = spark.createDataFrame([(i, u, "sqlmap/1.0" if i == 3 else None) for i, u in enumerate(uris)], "id int, uri string, user_agent string")
    assert {(r.id, r.attack) for r in detectors.web_attacks(df).collect()} == {(0, "sql_injection"), (1, "script_injection"), (2, "path_traversal"), (3, "scanner")}


def test_encoded_names(spark):
    data = [("aGVsbG8x2k3j4h5g6f7d8s9.evil.com",), ("www.example.com",), ("a" * 55 + ".evil.com",), (None,), ("123e4567-e89b-12d3-a456-426614174000.example.com",)]
    found = detectors.encoded_names(spark.createDataFrame(data, "name string")).collect()
    assert {(r.domain, r.reason) for r in found} == {("evil.com", "encoded"), ("evil.com", "long")}


def test_most_specific_network_and_zone_win(spark):
    nets = spark.createDataFrame([("10.0.0.0/8", "wide"), ("10.1.0.0/16", "near"), ("10.1.2.3", "one")], "cidr string, category string")
    rows = spark.createDataFrame([(x,) for x in ("10.9.9.9", "10.1.9.9", "10.1.2.3", "::ffff:10.1.2.3", "8.8.8.8", "attacker", None)], "a string")
    got = {r.a: r.category for r in joins.longest_prefix(rows, "a", nets, ["category"]).collect()}
    assert got == {"10.9.9.9": "wide", "10.1.9.9": "near", "10.1.2.3": "one", "::ffff:10.1.2.3": "one", "8.8.8.8": None, "attacker": None, None: None}
    zones = spark.createDataFrame([(".evil.com", "zone"), ("x.evil.com", "exact"), ("plain.org", "plain")], "domain string, category string")
    hosts = spark.createDataFrame([(x,) for x in ("evil.com", "a.EVIL.com.", "x.evil.com", "y.x.evil.com", "sub.plain.org", "notevil.com", None)], "h string")
    got = {r.h: r.category for r in joins.domain_suffix(hosts, "h", zones, ["category"]).collect()}
    assert got == {"evil.com": "zone", "a.EVIL.com.": "zone", "x.evil.com": "exact", "y.x.evil.com": "zone", "sub.plain.org": None, "notevil.com": None, None: None}


def test_alerts_are_dropped_only_inside_a_window(spark):
    rows = [(i, t * S, "R", "t", 3, "a", "b", 1) for i, t in enumerate([0, 59, 60, 100, 120])]
    df = spark.createDataFrame(rows, "alert_id long, ts_us long, rule_id string, alert_type string, severity int, src_ip string, dst_ip string, dst_port int")
    assert [(r.alert_id, r.duplicate_count) for r in alerts.without_duplicates(df).orderBy("alert_id").collect()] == [(0, 1), (2, 1), (4, 0)]
    assert alerts.without_duplicates(df, 0).count() == 5


def test_likely_control_needs_a_strong_signal(spark):
    rows = [("p", "r", k, t * S, t) for t, k in enumerate(["bare_ip", "beacon", "new_program", "beacon"])] + [("q", "r", k, t * S, t) for t, k in enumerate(["bare_ip", "new_program", "risk"])]
    found = alerts.likely_control(spark.createDataFrame(rows, "app string, remote_ip string, kind string, ts_us long, seq int")).collect()
    assert [(r.app, r.seq, r.signals) for r in found] == [("p", 2, ["bare_ip", "beacon", "new_program"])]


RULE_ROWS = [("10.0.0.1", 80, b"GET /a", "tcp", None), ("8.8.8.8", None, None, None, "x"), ("attacker", 22, b"\xa0bin", "udp", "")]


@pytest.mark.parametrize(
    ("match", "rows"),
    [
        ({"field": "port", "op": "ne", "value": 80}, {1, 2}),
        ({"field": "port", "op": "eq", "value": None}, {1}),
        ({"field": "missing", "op": "ne", "value": 1}, {0, 1, 2}),
        ({"field": "missing", "op": "gt", "value": 1}, set()),
        ({"not": {"field": "port", "op": "gt", "value": 30}}, {1, 2}),
        ({"field": "port", "op": "in", "value": [22, 80]}, {0, 2}),
        ({"field": "port", "op": "not_in", "value": [22]}, {0}),
        ({"field": "payload", "op": "contains", "value": "GET"}, {0}),
        ({"field": "payload", "op": "not_contains", "value": "GET"}, {2}),
        ({"field": "payload", "op": "regex", "value": r"^get\s"}, {0}),
        ({"field": "payload", "op": "regex", "value": r"\sbin$"}, {2}),
        ({"field": "ip", "op": "cidr", "value": ["10.0.0.0/8"]}, {0}),
        ({"field": "note", "op": "exists", "value": True}, {1, 2}),
        ({"field": "proto", "op": "startswith", "value": "ud"}, {2}),
        ({"any": [{"proto": "tcp"}, {"note": "x"}]}, {0, 1}),
        ({"proto": "tcp", "port": 80}, {0}),
    ],
)
def test_predicates_are_two_valued(spark, match, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(RULE_ROWS)], "n int, ip string, port int, payload binary, proto string, note string")
    c = rules.compile_match(df.schema, match)
    got = df.select("n", c.alias("hit")).collect()
    assert {r.n for r in got if r.hit} == rows and all(r.hit is not None for r in got)


def test_one_bad_rule_stops_no_other(spark):
    schema = packets(spark, []).schema
    raw = [{"id": "ok", "match": {"dst_port": 1}}, {"match": {}}, {"id": "ok", "match": {"dst_port": 2}}, {"id": "a", "match": {"field": "x", "op": "like"}}, {"id": "b", "severity": "BAD", "match": {"dst_port": 1}}, {"id": "c", "match": {"dst_port": 1}, "wrong": 1}, {"id": "off", "enabled": False, "match": {"dst_port": 1}}]
    good, problems = rules.validate(raw, schema)
    assert [r.id for r in good] == ["ok"] and len(problems) == 5
    assert rules.merge([{"id": "x", "match": 1, "severity": "LOW"}], [{"id": "x", "severity": "HIGH"}]) == [{"id": "x", "match": 1, "severity": "HIGH"}]


def test_threshold_counts_anew_after_it_fires(spark):
    p = packets(spark, [(i, f"s{i % 3}", "d", 1) for i in range(18)])
    good, _ = rules.validate([{"id": "t", "match": {"dst_port": 1}, "threshold": {"count": 3, "seconds": 60, "track_by": "pair"}, "message": "{src_ip} {missing} {dst_port}"}], p.schema)
    found = rules.alerts(p, good).collect()
    assert len(found) == 6 and {r.hits for r in found} == {3} and {r.message for r in found} == {f"s{i} ? 1" for i in range(3)}


@pytest.mark.parametrize(("text", "kind"), [("127.0.0.1", "loopback"), ("169.254.1.1", "link_local"), ("224.0.0.1", "multicast"), ("192.168.1.1", "private"), ("100.64.0.1", "public"), ("8.8.8.8", "public"), ("::ffff:10.0.0.1", "private"), ("256.1.1.1", "unknown"), ("attacker", "unknown"), (None, "unknown")])
def test_address_classes(spark, text, kind):
    assert value(spark, ip.classify(F.lit(text).cast("string"))) == kind


def test_address_functions(spark):
    assert value(spark, ip.text(ip.number(F.lit("1.2.3.4")))) == "1.2.3.4"
    assert value(spark, ip.from_arpa(F.lit("4.3.2.1.in-addr.arpa"))) == "1.2.3.4"
    assert value(spark, ip.is_global(F.lit("100.64.0.1"))) is False
    assert value(spark, ip.is_multicast_or_broadcast(F.lit("10.0.0.255"))) is True


@pytest.mark.parametrize(("host", "domain"), [("a.b.example.com", "example.com"), ("www.shop.co.uk", "shop.co.uk"), ("Localhost.", "localhost"), ("x.com", "x.com")])
def test_registered_domains(spark, host, domain):
    assert value(spark, names.registered_domain(F.lit(host))) == domain


@pytest.mark.parametrize(
    ("text", "kind"),
    [("https://a.b/c", "url"), ("1.2.3.4", "ipv4"), ("2001:db8::1", "ipv6"), ("d" * 32, "md5"), ("d" * 40, "sha1"), ("d" * 64, "sha256"), ("AS13335", "asn"), ("CVE-2024-12345", "cve"), ("a@b.org", "email"), ("evil.example.com", "domain"), ("payload.exe", None), ("settings.yaml", None), ("hello", None)],
)
def test_kinds_of_indicators(spark, text, kind):
    assert value(spark, indicators.kind_of(F.lit(text))) == kind


def test_masked_indicators_are_found(spark):
    df = spark.createDataFrame([(1, "see hxxps://bad[.]example[.]com/x and 1.2.3[.]4, mail me[at]evil.org or payload.exe. 1.2.3.4")], "id int, text string")
    found = [(r.kind, r.value) for r in indicators.find(df).orderBy("place").collect()]
    assert found == [("url", "https://bad.example.com/x"), ("ipv4", "1.2.3.4"), ("email", "me@evil.org")]
    assert value(spark, indicators.defang(F.lit("https://a.b/c"), F.lit("url"))) == "hxxps://a[.]b/c"


@pytest.mark.parametrize(("host", "brand"), [("paypa1.com", "paypal"), ("www.arnazon.com", "amazon"), ("paypal.com", None), ("login-gogle.net", "google"), ("example.org", None)])
def test_imitated_brands(spark, host, brand):
    assert value(spark, indicators.imitated_brand(F.lit(host))) == brand


def test_every_edit_of_a_brand_is_found(spark):
    def edits(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b))
        long, short = sorted((a, b), key=len, reverse=True)
        return 1 if any(long[:i] + long[i + 1 :] == short for i in range(len(long))) else 2

    made = [(b, i) for b in indicators.BRANDS for i in range(len(b) + 1)]
    labels = sorted({x for b, i in made for x in (b, b[:i] + "x" + b[i:], b[:i] + b[i + 1 :], b[:i] + "x" + b[i + 1 :], b[:i] + "xx" + b[i:])})
    hosts = [None, "", ".", "-.com", *(f"www.{x}.co.uk" for x in labels), *(f"my-{x}.Example." for x in labels), *(f"{x}.my.example" for x in labels)]
    df = spark.createDataFrame([(h,) for h in hosts], "host string").repartition(4)
    for r in df.select("host", indicators.imitated_brand(F.col("host")).alias("brand")).collect():
        parts = (r.host or "").rstrip(".").split(".")
        own = parts[-3 if parts[-2:] == ["co", "uk"] else -2] if len(parts) > 1 else parts[0]
        near = [b for b in indicators.BRANDS if b != own and any(t == b or (len(t) > 4 and edits(t, b) == 1) for t in own.split("-"))]
        assert r.brand == (near[0] if near else None), r.host


def test_a_link_is_taken_apart_once(spark):
    # what an expression names twice is computed twice: before, this plan held over 7000 searches
    link, df = F.col("link"), spark.createDataFrame([("https://paypa1.com/",)], "link string")
    plan = df.select(indicators.unwrap(link), indicators.link_flags(link), indicators.imitated_brand(names.host_of(link)))._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("regexp_") < 100


@pytest.mark.parametrize(("name", "domain"), [("a.b.Shop.co.uk.", "shop.co.uk"), ("co.uk", "co.uk"), ("a..co.uk", ".co.uk"), (".com", ".com"), ("x", "x"), ("...", None), ("", None), (None, None)])
def test_registered_domains_of_odd_names(spark, name, domain):
    assert value(spark, names.registered_domain(F.lit(name).cast("string"))) == domain
