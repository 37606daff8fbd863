from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import host
from tidewatch.operators import folds, intel, live
from tidewatch.operators import host as inspector
from tidewatch.plans import rules
from tidewatch.sinks import alerts as sinks

ALERTS = "alert_id string, ts_us long, rule_id string, alert_type string, severity int, src_ip string, dst_ip string, dst_port int, message string"


def some(spark, n=10, start=1_700_000_000_000_000, step=3_600_000_000 * 6):
    return spark.createDataFrame([(f"a{i}", start + i * step, "R-1", "signature", 1 + i % 4, f"10.0.0.{i}", "8.8.8.8", 80, f"m{i}") for i in range(n)], ALERTS)


def test_a_store_takes_an_alert_once_and_forgets(spark, tmp_path):
    path = str(tmp_path / "store")
    sinks.append(some(spark), path)
    sinks.append(some(spark, 12).unionByName(some(spark, 12)), path)
    assert spark.read.parquet(path).count() == 12
    now = 1_700_000_000_000_000 + 12 * 3_600_000_000 * 6
    gone = sinks.prune(spark, path, now, 2)
    left = spark.read.parquet(path)
    assert gone > 0 and gone + left.count() == 12 and left.filter(F.col("ts_us") >= now - 2 * sinks.DAY).count() == sinks.without_old(some(spark, 12), now, 2).count()


def test_a_stream_goes_to_the_store(spark, tmp_path):
    some(spark, 6).write.parquet(str(tmp_path / "in"))
    read = spark.readStream.schema(some(spark).schema).parquet(str(tmp_path / "in"))
    q = sinks.append_stream(read, str(tmp_path / "store"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "store")).count() == 6


def test_cells_and_lines(spark):
    cells = ["=1+1", "-5", "+x", "@a", "\tx", "plain", None, "-1e3"]
    got = [r.c for r in spark.createDataFrame([(c,) for c in cells], "c string").select(sinks.csv_cell(F.col("c")).alias("c")).collect()]
    assert got == ["'=1+1", "-5", "'+x", "'@a", "'\tx", "plain", None, "-1e3"]
    odd = some(spark, 1).withColumns({"rule_id": F.lit('a"]b'), "message": F.lit("x\ny")})
    line = sinks.syslog(odd).first().value
    assert line.startswith("<133>1 2023-11-14T22:13:20.000000Z sensor tidewatch - - [alert@0 ") and r'rule="a\"\]b"' in line and line.endswith("] x y")


def test_evidence_is_kept_once_and_checked(spark):
    files = spark.createDataFrame([(bytearray(b"a"), 2), (bytearray(b"a"), 1), (bytearray(b"b"), 3)], "content binary, ts_us long")
    kept = sinks.keep_evidence(files)
    assert {(r.size, r.first_us) for r in kept.collect()} == {(1, 1), (1, 3)} and sinks.damaged(kept).count() == 0
    assert sinks.damaged(kept.withColumn("content", F.lit(b"c"))).count() == 2


def test_places_of_programs(spark):
    cases = [
        ("/tmp/x", "unsigned", ["odd_path", "unsigned"], 3), ("/Users/a/Downloads/T.app/x", "developer_id", ["odd_path"], 1), ("/Volumes/D/T.app/x", "developer_id", [], 0), ("/Volumes/D/x", None, ["odd_path"], 2),
        ("/opt/homebrew/bin/x", "adhoc", ["adhoc"], 0), ("/usr/bin/x", "apple", [], 0), ("/Users/a/.x/y", "developer_id", ["odd_path"], 1), ("/Users/a/.cargo/bin/y", "adhoc", ["adhoc"], 0), ("/Applications/A.app/a", "invalid", ["invalid_signature"], 3),
        ("/private/var/folders/z/AppTranslocation/q/x", "developer_id", [], 0), ("/Applications/A/x", "unsigned", ["unsigned"], 1),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "exe string, status string").select("exe", host.assess(F.col("exe"), F.col("status")).alias("a"))
    got = {r.exe: (r.a.flags, r.a.risk) for r in df.collect()}
    assert all(got[e] == (f, r) for e, _, f, r in cases), got
    names = spark.createDataFrame([("/Applications/X Y.app/Contents/Z.app/q",), ("/usr/bin/ssh",), (None,)], "e string").select(host.app_name(F.col("e")).alias("n"), host.bundle(F.col("e")).alias("b")).collect()
    assert [(r.n, r.b) for r in names] == [("X Y", "/Applications/X Y.app"), ("ssh", None), (None, None)]
    m = spark.createDataFrame([("A:0:1:2:3:4",)], "m string").select(host.mac(F.col("m")).alias("m"), host.is_random_mac(host.mac(F.col("m"))).alias("r")).first()
    assert (m.m, m.r) == ("0a:00:01:02:03:04", True)


def test_launch_items_and_starters(spark):
    items = spark.createDataFrame([("l1", "/tmp/x", "unsigned", 1), ("l2", "/Applications/A.app/a", "developer_id", 2)], "label string, path string, status string, modified_us long")
    got = {r.label: (r.flags, r.risk) for r in inspector.launch_items(items, spark.createDataFrame([("/Applications/A.app/a",)], "path string")).collect()}
    assert got == {"l1": (["odd_path", "unsigned", "missing_program"], 3), "l2": ([], 0)}
    p = spark.createDataFrame([("/Applications/A.app",), ("/tmp/y",)], "program string")
    assert [tuple(r) for r in inspector.started_by(p, items).collect()] == [("/Applications/A.app", "l2")]


def test_kinds_of_alerts(spark):
    cases = [("X", ["likely_c2"], "behavioral", "threat"), ("stealth-webrtc-1", [], "behavioral", "webrtc"), ("STEALTH-ENCRYPTED-DNS", [], "behavioral", "doh"), (None, ["new_device", "quic"], "behavioral", "quic"), (None, None, "anomaly", "attack"), ("Z", [], "odd", "other"), (None, ["baseline"], "anomaly", "host")]
    df = spark.createDataFrame([c[:3] for c in cases], "rule_id string, tags array<string>, alert_type string").select(live.kind(F.col("rule_id"), F.col("tags"), F.col("alert_type")).alias("k"))
    assert [r.k for r in df.collect()] == [c[3] for c in cases]


def test_lookups_are_due_once(spark):
    found = spark.createDataFrame([("ipv4", "8.8.8.8"), ("ipv4", "10.0.0.1"), ("url", "http://a.b/x?y#z"), ("cve", "CVE-2024-1"), ("md5", "0" * 32)], "kind string, value string")
    cache = spark.createDataFrame([("addresses", "ipv4", "8.8.8.8", 100), ("flaws", "cve", "CVE-2024-1", 1)], "source string, kind string, value string, fetched_us long")
    got = {tuple(r) for r in intel.lookups_due(found, cache, 150, 100, 1).collect()}
    assert got == {("names", "url", "http://a.b/x", 0), ("flaws", "cve", "CVE-2024-1", 0), ("files", "md5", "0" * 32, 0)}


def test_indicators_meet_their_parents(spark):
    rows = spark.createDataFrame([("domain", "a.bad.example"), ("url", "http://x.bad.example/p"), ("ipv4", "9.9.9.9"), ("email", "me@good.example")], "kind string, value string")
    dom, adr = (spark.createDataFrame([(x, "m", 3, "")], "indicator string, category string, severity int, description string") for x in ("bad.example", "9.9.9.0/24"))
    got = {r.value: r.indicator for r in intel.lookup_indicators(rows, dom, adr).collect()}
    assert got == {"a.bad.example": "bad.example", "http://x.bad.example/p": "bad.example", "9.9.9.9": "9.9.9.0/24", "me@good.example": None}


def test_bursts_of_made_up_names_are_grave(spark):
    made = [(f"c{k}", f"{''.join(chr(97 + (i * 7 + j * j * (k + 3)) % 26) for j in range(14))}{i}.example{i}.org" if k == 0 else f"ab.example{i}.org", i, i) for k in range(2) for i in range(6)]
    df = spark.createDataFrame(made, "client string, name string, ts_us long, seq long")
    assert {r.client: (r.distinct, r.severity) for r in intel.dns_bursts(df, 6, 100, 100).collect()} == {"c0": (6, 3), "c1": (6, 2)}


PACKETS = "seq long, ts_us long, src_ip string, dst_ip string, protocol string, dst_port int, tcp_flags int, payload binary, context struct<direction:string,app:string>"


def test_rules_read_flags_payloads_and_context(spark):
    rows = [(0, 0, "1.1.1.1", "10.0.0.1", "tcp", 80, 41, bytearray(b""), ("inbound", "x")), (1, 1, "1.1.1.1", "10.0.0.1", "tcp", 80, 24, bytearray(b"GET \x90\x90 evil"), ("outbound", None)), (2, 2, "1.1.1.1", "10.0.0.1", "udp", 53, None, bytearray(b"q"), None)]
    p = spark.createDataFrame(rows, PACKETS)
    given = [
        {"id": "XMAS", "severity": "LOW", "match": {"all": [{"field": "tcp.xmas", "op": "eq", "value": True}, {"field": "tcp.syn", "op": "eq", "value": False}]}},
        {"id": "SLED", "severity": "HIGH", "match": {"field": "payload", "op": "contains", "value": "\\x90\\x90 ev"}},
        {"id": "OLD", "severity": "HIGH", "when": {"protocol": "tcp", "payload_contains": "evil"}},
        {"id": "OUT", "severity": "LOW", "match": {"direction": "outbound"}},
        {"id": "NODATA", "severity": "LOW", "match": {"field": "payload", "op": "not_contains", "value": "zzz"}},
    ]
    good, problems = rules.validate(given, p.schema)
    assert not problems
    got = sorted((r.seq, r.rule_id) for r in rules.hits(p, good).collect())
    assert got == [(0, "NODATA"), (0, "XMAS"), (1, "NODATA"), (1, "OLD"), (1, "OUT"), (1, "SLED"), (2, "NODATA")]
    seen = rules.hits(p, [r for r in good if r.id == "SLED"], with_evidence=True).first().evidence
    assert [(e.field, e.op, e.actual) for e in seen] == [("payload", "contains", "GET .. evil")]
    assert [rules.needs_data(g.get("match", rules.from_when(g.get("when", {})))) for g in given] == [False, True, True, False, False]


def test_thresholds_share_one_fold(spark):
    rows = [(i, i * 1_000_000, f"10.0.0.{i % 2}", "9.9.9.9", "tcp", 80, 2, bytearray(b""), None) for i in range(12)]
    p = spark.createDataFrame(rows, PACKETS)
    given = [{"id": f"T{n}", "severity": "LOW", "match": {"protocol": "tcp"}, "threshold": {"count": n, "seconds": 100, "track_by": t}} for n, t in ((3, "src_ip"), (4, "global"), (2, "pair"))]
    good, _ = rules.validate(given + [{"id": "ALL", "severity": "LOW", "match": {"dst_port": 80}}], p.schema)
    out = rules.alerts(p, good)
    got = sorted((r.rule_id, r.seq) for r in out.filter("hits is not null").collect())
    assert got == [("T2", s) for s in (2, 3, 6, 7, 10, 11)] + [("T3", s) for s in (4, 5, 10, 11)] + [("T4", s) for s in (3, 7, 11)]
    assert out.filter("hits is null").count() == 12
    plain = folds.fold(p.select("src_ip", "ts_us", "seq"), ["src_ip"], ["ts_us", "seq"], ["ts_us"], folds.threshold(100_000_000, 3), "hits", "int")
    assert sorted(r.seq for r in plain.filter("hits is not null").collect()) == [4, 5, 10, 11]


def test_rule_files(tmp_path):
    a, b, c = (tmp_path / f"{x}.yaml" for x in "abc")
    a.write_text("- {id: A, severity: LOW, match: {x: 1}}\n- {id: B, match: {y: 2}}\n")
    b.write_text("rules:\n- {id: A, severity: HIGH}\n- {id: B, match: {z: 3}}\n")
    c.write_text("{: bad")
    got = {r["id"]: r for r in rules.load(str(a), str(b), str(c), str(tmp_path / "none.yaml"))}
    assert got == {"A": {"id": "A", "severity": "HIGH", "match": {"x": 1}}, "B": {"id": "B", "match": {"z": 3}}}


def test_six_bit_addresses(spark):
    import ipaddress

    from tidewatch.functions import ip

    texts = ["::", "::1", "2001:db8::1", "fe80::1%en0", "ff02::fb", "2606:4700:4700::1111", "fd00::5", "::ffff:10.0.0.1", "64:ff9b::8.8.8.8", "1:2:3:4:5:6:7:8", "1::8", "1:2:3:4:5:6:7::", "1:::2", "12345::", "1:2:3:4:5:6:7:8:9", "", "x", "10.0.0.1", "1::2::3"]
    df = spark.createDataFrame([(t,) for t in texts], "a string").select("a", ip.bits(F.col("a")).alias("b"), ip.classify(F.col("a")).alias("c"))
    for r in df.collect():
        try:
            x = ipaddress.ip_address(r.a.split("%")[0])
            x = getattr(x, "ipv4_mapped", None) or x
        except ValueError:
            assert r.b is None and r.c == "unknown", r
            continue
        assert r.b == str(x.version) + f"{int(x):0{x.max_prefixlen}b}", r
        want = "loopback" if x.is_loopback else "link_local" if x.is_link_local else "multicast" if x.is_multicast else "private" if x.is_private else "public"
        assert r.c == want, r


def test_longest_prefix_of_both_kinds(spark, monkeypatch):
    from tidewatch.operators import joins

    nets = spark.createDataFrame([("2001:db8::/32", "doc"), ("2001:db8:1::/48", "lab"), ("10.0.0.0/8", "ten"), ("10.1.0.0/16", "one"), ("2001:db8:1::5", "host"), ("bad", "x")], "cidr string, category string")
    rows = spark.createDataFrame([("2001:db8::9",), ("2001:db8:1::9",), ("2001:db8:1::5",), ("10.1.2.3",), ("10.2.2.3",), ("::ffff:10.1.0.1",), ("8.8.8.8",), (None,), ("zz",)], "a string")
    want = {"2001:db8::9": "doc", "2001:db8:1::9": "lab", "2001:db8:1::5": "host", "10.1.2.3": "one", "10.2.2.3": "ten", "::ffff:10.1.0.1": "one", "8.8.8.8": None, None: None, "zz": None}
    for most in (joins.MOST_LOCAL, 1):
        monkeypatch.setattr(joins, "MOST_LOCAL", most)
        assert {r.a: r.category for r in joins.longest_prefix(rows, "a", nets, ["category"]).collect()} == want
    empty = nets.limit(0)
    assert all(r.category is None for r in joins.longest_prefix(rows, "a", empty, ["category"]).collect())


def test_guides_times_and_sizes(spark):
    from tidewatch.functions import guide

    df = spark.createDataFrame([(["x", "scanner"], "attack", 600_000_000, 1500), ([], "quic", 5_000_000, 17), (None, None, 7_200_000_000, 3_000_000)], "t array<string>, k string, us long, n long")
    got = df.select(guide.guide(F.col("t"), F.col("k")).alias("g"), guide.interval(F.col("us")).alias("i"), guide.size(F.col("n")).alias("s")).collect()
    assert [(r.g.verdict, r.i, r.s) for r in got] == [("know", "10 min", "1.5 KB"), ("fine", "5 s", "17 B"), ("know", "2 h", "3.0 MB")]
