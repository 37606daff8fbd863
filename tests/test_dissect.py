"""Payloads built byte by byte, and what must be read from them."""

from __future__ import annotations

import hashlib
import ipaddress
import struct

from tidewatch.sources import captures, dissect


def name(text):
    return b"".join(bytes([len(p)]) + p.encode() for p in text.split(".")) + b"\0"


def query(text, kind=1, flags=0x0100):
    return struct.pack(">6H", 7, flags, 1, 0, 0, 0) + name(text) + struct.pack(">2H", kind, 1)


def greeting(host="example.org", suites=(0x0A0A, 0x1301, 0xC02F), alpn=("h2", "http/1.1"), ech=False):
    def ext(kind, body):
        return struct.pack(">2H", kind, len(body)) + body

    listed = b"".join(bytes([len(p)]) + p.encode() for p in alpn)
    exts = ext(0x1A1A, b"") + (ext(0, struct.pack(">HBH", len(host) + 3, 0, len(host)) + host.encode()) if host else b"") + ext(16, struct.pack(">H", len(listed)) + listed)
    exts += ext(10, struct.pack(">4H", 6, 0x2A2A, 29, 23)) + ext(11, b"\1\0") + (ext(0xFE0D, b"x") if ech else b"")
    body = struct.pack(">H", 0x0303) + bytes(32) + b"\0" + struct.pack(">H", 2 * len(suites)) + struct.pack(f">{len(suites)}H", *suites) + b"\1\0" + struct.pack(">H", len(exts)) + exts
    hello = b"\1" + len(body).to_bytes(3) + body
    return b"\x16\x03\x01" + struct.pack(">H", len(hello)) + hello


def test_name_lookups_and_answers():
    q = dissect.dns(query("www.Example.org", 28))
    assert (q["query_name"], q["query_type"], q["is_response"], q["subdomain_depth"], q["name_length"]) == ("www.Example.org", "AAAA", False, 2, 15)
    head = struct.pack(">6H", 9, 0x8180, 1, 3, 0, 0) + name("a.b") + struct.pack(">2H", 1, 1)
    answers = b"\xc0\x0c" + struct.pack(">HHIH", 5, 1, 60, 4) + b"\1c\xc0\x0c" + b"\xc0\x0c" + struct.pack(">HHIH", 1, 1, 30, 4) + bytes([1, 2, 3, 4])
    answers += b"\xc0\x0c" + struct.pack(">HHIH", 28, 1, 30, 16) + ipaddress.IPv6Address("2001:db8::1").packed
    got = dissect.dns(head + answers)
    assert [(a["type"], a["data"], a["ttl"]) for a in got["answers"]] == [("CNAME", "c.a.b", 60), ("A", "1.2.3.4", 30), ("AAAA", "2001:db8::1", 30)]
    assert dissect.dns(query("x.y", flags=0x8183))["rcode_name"] == "NXDOMAIN"
    assert dissect.dns(b"\0\x1d" + query("t.cp"), over_tcp=True)["query_name"] == "t.cp"


def test_crafted_names_end():
    loop = struct.pack(">6H", 1, 0, 1, 0, 0, 0) + b"\xc0\x0c\0\1\0\1"
    assert "query_name" not in dissect.dns(loop)
    assert dissect.name_at(b"\1a\xc0\x05\0\1b\0", 0) == ("a", 4)  # a pointer forwards
    assert dissect.name_at(b"\x40abc", 0)[0] is None and dissect.name_at(b"\5ab", 0) == (None, 3)
    assert dissect.dns(b"short") == {} and dissect.dns(query("a" * 60 + "." + "b" * 60)[:40]).get("query_name") is None


def test_greetings_and_their_fingerprint():
    got = dissect.tls(greeting(ech=True))
    assert (got["sni"], got["alpn"], got["ech"], got["tls_version"], got["cipher_suites"], got["extensions"]) == ("example.org", ["h2", "http/1.1"], True, "TLS 1.2", [0x1301, 0xC02F], [0, 16, 10, 11, 0xFE0D])
    assert got["ja3_string"] == "771,4865-49199,0-16-10-11-65037,29-23,0" and got["ja3"] == hashlib.md5(got["ja3_string"].encode()).hexdigest()
    whole = greeting()
    for n in range(len(whole)):
        dissect.tls(whole[:n])  # cut anywhere, nothing is raised
    assert dissect.tls(b"\x17" + whole[1:]) == {} and "sni" not in dissect.tls(greeting(host=""))


def test_web_shell_and_mail():
    got = dissect.http(b"POST /collect HTTP/1.1\r\nHost: a.b:80\r\nContent-Length: 12\r\nX: 1\r\nx: 2\r\n\r\nhello")
    assert (got["direction"], got["method"], got["host"], got["headers"]["x"], got["body"], got["beacon_suspect"]) == ("request", "POST", "a.b:80", "2", "hello", True)
    assert dissect.http(b"GET /chat HTTP/1.1\r\nUpgrade: WebSocket\r\nConnection: keep-alive, Upgrade\r\n\r\n")["websocket_upgrade"]
    assert dissect.http(b"HTTP/1.1 404 Not Found\r\nServer: x\r\n\r\n")["status_code"] == 404 and dissect.http(b"nonsense") == {}
    assert not dissect.http(b"POST /x HTTP/1.1\r\nContent-Length: 12\r\nAccept: text/html\r\n\r\n")["beacon_suspect"]
    assert dissect.ssh(b"SSH-2.0-OpenSSH_9.6 Ubuntu\r\n") == {"proto_version": "2.0", "software": "OpenSSH_9.6", "comments": "Ubuntu"}
    assert dissect.smtp(b"EHLO me\r\nMAIL FROM:<a@b.c>\r\nRCPT TO: <d@e.f>\r\nAUTH LOGIN\r\n") == {"helo": "me", "mail_from": "a@b.c", "rcpt_to": "d@e.f", "auth_mechanism": "LOGIN"}


def test_stun_and_quic():
    ip, port = bytes([192, 168, 1, 5]), 4321
    masked = bytes(a ^ b for a, b in zip(ip, dissect.COOKIE))
    value = b"\0\1" + (port ^ 0x2112).to_bytes(2) + masked
    message = struct.pack(">2H", 0x0101, 12 + 4) + dissect.COOKIE + bytes(12) + struct.pack(">2H", 0x20, 8) + value
    got = dissect.stun(message)
    assert got["addresses"] == [{"family": "IPv4", "ip": "192.168.1.5", "port": 4321, "attribute": "XOR-MAPPED-ADDRESS"}] and got["is_response"] and not got["is_error"]
    assert dissect.stun(message[:19]) == {} and dissect.stun(b"\xff" + message[1:]) == {}
    q = dissect.quic(b"\xc3\0\0\0\1\4abcd\2xy" + bytes(20))
    assert (q["packet_type"], q["version"], q["dcid"], q["scid"]) == ("Initial", "QUIC v1", b"abcd".hex(), b"xy".hex())
    assert dissect.quic(b"\xd3\x6b\x33\x43\xcf\0\0")["packet_type"] == "Initial" and dissect.quic(b"\x40" + bytes(20)) == {}


def test_packets_are_dissected(spark):
    rows = [("udp", 5000, 53, query("a.example.org")), ("tcp", 5000, 443, greeting()), ("tcp", 5000, 9999, b"GET /x HTTP/1.1\r\nHost: h\r\n\r\n"), ("udp", 1, 2, b"\xc3\0\0\0\1\0\0" + bytes(20)), ("tcp", 1, 443, b"zz"), ("tcp", 1, 2, None), (None, None, None, b"x")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, protocol string, src_port int, dst_port int, payload binary")
    got = {r.seq: r for r in dissect.dissected(df).collect()}
    assert [got[i].app_proto for i in range(7)] == ["dns", "tls", "http", "quic", "tls", None, None]
    assert got[0].dns.query_name == "a.example.org" and got[1].tls.sni == "example.org" and got[2].http.headers == {"host": "h"} and got[4].tls is None
    assert dissect.dissected(df.limit(0)).collect() == []


def packet6(kind, body, extra=b""):
    src, dst = ipaddress.IPv6Address("2001:db8::1").packed, ipaddress.IPv6Address("fe80::2").packed
    first, rest = (kind, b"") if not extra else (extra[0], extra[1:])
    return struct.pack(">IHBB", 6 << 28, len(rest) + len(body), first, 64) + src + dst + rest + body


def test_six_addresses_and_headers():
    udp = struct.pack(">4H", 1000, 53, 8 + 4, 0) + b"data"
    plain = captures.decode(101, packet6(17, udp))
    assert (plain["src_ip"], plain["dst_ip"], plain["protocol"], plain["dst_port"], plain["payload"]) == ("2001:db8::1", "fe80::2", "udp", 53, b"data")
    with_options = captures.decode(1, bytes(12) + b"\x86\xdd" + packet6(17, udp, bytes([0, 17, 0]) + bytes(6)))
    assert with_options["dst_port"] == 53
    later = captures.decode(101, packet6(17, b"rest", bytes([44, 17, 0]) + struct.pack(">H", 8 << 3) + bytes(4)))
    assert (later["protocol"], later["payload"]) == ("other", b"rest")
    endless = packet6(0, b"", b"")[:40] + bytes([0, 0] + [0] * 6) * 40
    assert captures.decode(101, endless[:4] + struct.pack(">H", 320) + endless[6:])["malformed"]
    assert captures.decode(0, b"\x1e\0\0\0" + packet6(58, b"\x80" + bytes(7) + b"ping"))["payload"] == b"ping"
    assert captures.decode(113, bytes(16) + packet6(17, udp))["protocol"] == "udp" and captures.decode(276, bytes(20) + packet6(17, udp))["protocol"] == "udp"


def test_files_of_blocks():
    def block(kind, body):
        body += bytes(-len(body) % 4)
        return struct.pack("<2I", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)

    frame = packet6(17, struct.pack(">4H", 1, 2, 8, 0))
    section = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1))
    micro = block(1, struct.pack("<HHI", 101, 0, 65535))
    nano = block(1, struct.pack("<HHI", 101, 0, 65535) + struct.pack("<HHB3x", 9, 1, 9) + struct.pack("<HH", 0, 0))
    at = 1_700_000_000_000_001
    packets = block(6, struct.pack("<5I", 0, at >> 32, at & 0xFFFFFFFF, len(frame), len(frame)) + frame)
    at *= 1000
    packets += block(6, struct.pack("<5I", 1, at >> 32, at & 0xFFFFFFFF, len(frame), len(frame)) + frame)
    got = list(captures.records(section + micro + nano + block(5, b"stat") + packets + b"cut"))
    assert got == [(101, 1_700_000_000_000_001, frame)] * 2
