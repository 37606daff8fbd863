"""QUIC greetings: the example of RFC 9001, and greetings in pieces, out of order, repeated and overlapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from tests.test_dissect import greeting
from tidewatch.sources import dissect, quic

#: RFC 9001, appendix A: the connection id, the keys that follow from it, and the frame of a client's first packet.
DCID = bytes.fromhex("8394c8f03e515708")
KEYS = tuple(map(bytes.fromhex, ("1f369613dd76d5467730efcbe3b1a22d", "fa044b2f42a3fd3b46fb255c", "9f50449e04a0e810283a1e9933adedd2")))
FRAME = bytes.fromhex(
    "060040f1010000ed0303ebf8fa56f12939b9584a3896472ec40bb863cfd3e86804fe3a47f06a2b69484c00000413011302010000c000000010000e00000b6578616d706c652e636f6d"
    "ff01000100000a00080006001d0017001800100007000504616c706e000500050100000000003300260024001d00209370b2c9caa47fbabaf4559fedba753de171fa71f50f1ce15d43"
    "e994ec74d748002b0003020304000d0010000e0403050306030203080408050806002d00020101001c00024001003900320408ffffffffffffffff05048000ffff07048000ffff080110"
    "0104800075300901100f088394c8f03e51570806048000ffff"
)
HEADER = bytes.fromhex("c300000001088394c8f03e5157080000449e00000002")


def sealed(spark, contents):
    """Protected first packets of (version, dcid, number, content), with four bytes of packet number."""
    rows = []
    for version, dcid, number, content in contents:
        key, iv, hp = quic.client_keys(version, dcid)
        size = 4 + len(content) + 16
        first = 0xD3 if version == 0x6B3343CF else 0xC3
        head = bytes([first]) + version.to_bytes(4) + bytes([len(dcid)]) + dcid + b"\0\0" + (0x4000 | size).to_bytes(2) + number.to_bytes(4)
        nonce = bytes(a ^ b for a, b in zip(iv, number.to_bytes(12), strict=True))
        rows.append((key, nonce, head, content, hp))
    df = spark.createDataFrame([tuple(map(bytearray, r)) for r in rows], "key binary, nonce binary, head binary, content binary, hp binary")
    body = F.substring(F.aes_encrypt("content", "key", F.lit("GCM"), F.lit("NONE"), "nonce", "head"), 13, 1 << 20)
    masked = df.withColumn("body", body).withColumn("mask", F.substring(F.aes_encrypt(F.substring("body", 1, 16), "hp", F.lit("ECB")), 1, 16))
    out = []
    for r in masked.collect():
        first = r.head[0] ^ (r.mask[0] & 0x0F)
        out.append(bytes([first]) + bytes(r.head[1:-4]) + bytes(a ^ b for a, b in zip(r.head[-4:], r.mask[1:5], strict=True)) + bytes(r.body))
    return out


def crypto(offset, data):
    number = lambda n: (0x4000 | n).to_bytes(2)
    return b"\x06" + number(offset) + number(len(data)) + data


PACKETS = "ts_us long, seq long, src_ip string, src_port int, dst_ip string, dst_port int, protocol string, payload binary"


def read(spark, payloads, protocol="udp"):
    rows = [(i * 1000, i, "10.0.0.1", 5000, "8.8.8.8", 443, protocol, bytearray(p) if p is not None else None) for i, p in enumerate(payloads)]
    return quic.greetings(spark.createDataFrame(rows, PACKETS)).collect()


def test_the_example_of_the_standard(spark):
    assert quic.client_keys(1, DCID) == KEYS
    (packet,) = sealed(spark, [(1, DCID, 2, FRAME + bytes(1162 - len(FRAME)))])
    assert packet[:22] == bytes.fromhex("c000000001088394c8f03e5157080000449e7b9aec34") and len(packet) == 1200
    (r,) = read(spark, [packet])
    assert (r.tls.sni, r.tls.alpn, r.tls.tls_version, r.dcid) == ("example.com", ["alpn"], "TLS 1.2", DCID.hex().upper())
    assert r.tls.ja3_string.startswith("771,4865-4866,0-65281-10-16-5-51-43-13-45-28-57,29-23-24,") and len(r.tls.ja3) == 32
    plain = dissect.tls(b"\x16\x03\x01" + (len(FRAME) - 4).to_bytes(2) + FRAME[4:])
    assert r.tls.ja3 == plain["ja3"]


def test_greetings_in_pieces(spark):
    """Of two versions; in reverse order, twice, overlapping, two to a datagram, beside acknowledgements."""
    hello = greeting("pieces.example")[5:]
    cut = [crypto(60, hello[60:]), crypto(0, hello[:40]), crypto(30, hello[30:70])]
    for version in (1, 0x6B3343CF):
        one, two, three = sealed(spark, [(version, b"12345678", n, b"\x02\x05\x01\x00\x05" + c + bytes(40)) for n, c in enumerate(cut)])
        (r,) = read(spark, [one, one, two + three, two])
        assert (r.tls.sni, r.seq) == ("pieces.example", 2)
    assert read(spark, [one, two]) == []


def test_what_is_no_greeting(spark):
    hello = greeting("x.example")[5:]
    (packet,) = sealed(spark, [(1, DCID, 0, crypto(0, hello) + bytes(30))])
    bad = packet[:-1] + bytes([packet[-1] ^ 1])
    assert read(spark, [bad, packet[:-5], packet[:30], b"\x40" + packet[1:], b"\xc0" + bytes(60), bytes(100), None, b"", b"\xc3" + b"\xff" * 1200]) == []
    assert read(spark, [packet], "tcp") == [] and read(spark, []) == []
    assert [r.tls.sni for r in read(spark, [b"\xc3\0\0\0\5" + bytes(60), packet])] == ["x.example"]


def test_pieces_by_offset():
    p = quic.Pieces(wait=100, most=1000)
    message = b"\x01\0\0\x10" + bytes(range(16))
    assert p.run([0, 1, 2, 3], [10, 4, 0, 0], [message[10:], message[4:12], message[:6], message]) == [None, None, message, None]
    p = quic.Pieces(wait=100, most=1000)
    assert p.run([0, 200, 201], [0, 4, 0], [message[:4], message[4:], message[:4]]) == [None, None, message]  # what waits too long is given up
    p = quic.Pieces(wait=100, most=1000)
    assert p.run([0, 1, 2], [0, 990, 4], [message[:4], message, message[4:]]) == [None, None, message]
    first = quic.Pieces(wait=100, most=1000)  # of overlapping pieces the first counts
    assert first.run([0, 1], [4, 0], [b"a" * 16, message]) == [None, message[:4] + b"a" * 16]
