from __future__ import annotations

import struct

from pyspark.sql import functions as F

from tidewatch.operators import folds
from tidewatch.sources import captures
from tidewatch.streaming import detectors as streaming


def tcp(src, dst, sport, dport, flags=2, payload=b"", vlan=False):
    body = struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 5 << 4, flags, 0, 0, 0) + payload
    head = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 0, 0, 64, 6, 0, bytes(src), bytes(dst))
    return b"\0" * 12 + (b"\x81\x00\x00\x01" if vlan else b"") + b"\x08\x00" + head + body + b"\0" * 6  # padded


def capture(frames):
    out = b"\xd4\xc3\xb2\xa1" + struct.pack("<HHIIII", 2, 4, 0, 0, 65535, 1)
    for i, f in enumerate(frames):
        out += struct.pack("<IIII", 1000 + i, 5, len(f), len(f)) + f
    return out


def test_captures_are_decoded(spark, tmp_path):
    frames = [tcp((10, 0, 0, 1), (8, 8, 8, 8), 1234, 80, 24, b"GET /"), tcp((10, 0, 0, 1), (8, 8, 8, 8), 1, 2, vlan=True), b"\0" * 14, tcp((1, 1, 1, 1), (2, 2, 2, 2), 1, 2)[:40]]
    (tmp_path / "a.pcap").write_bytes(capture(frames) + b"cut")
    (tmp_path / "b.pcap").write_bytes(b"no capture")
    rows = captures.read_captures(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.protocol, r.src_ip, r.dst_port, r.payload, r.malformed) for r in rows] == [("tcp", "10.0.0.1", 80, b"GET /", False), ("tcp", "10.0.0.1", 2, b"", False), (None, None, None, b"", False), ("other", "1.1.1.1", None, b"", True)]
    assert rows[0].ts_us == 1_000_000_005 and rows[0].tcp_flags == 24


def test_feeds_are_parsed(spark, tmp_path):
    (tmp_path / "ip.txt").write_text("# list\n1.2.3.4 ; x\n10.0.0.0/8\n\n")
    (tmp_path / "hosts.txt").write_text("0.0.0.0 Bad.example.com # y\n127.0.0.1 localhost\n")
    (tmp_path / "drop.json").write_text('{"cidr": "5.0.0.0/8"}\n{"type": "meta"}\n')
    assert {r.cidr for r in captures.read_feed(spark, str(tmp_path / "ip.txt"), "ip").collect()} == {"1.2.3.4", "10.0.0.0/8"}
    assert [r.domain for r in captures.read_feed(spark, str(tmp_path / "hosts.txt"), "hosts").collect()] == ["bad.example.com"]
    assert [r.cidr for r in captures.read_feed(spark, str(tmp_path / "drop.json"), "drop").collect()] == ["5.0.0.0/8"]


def test_stream_and_batch_give_the_same_thresholds(spark, tmp_path):
    rows = [(i, 10**15 + i * 7_000_000, f"s{i % 3}", 10) for i in range(60)]
    df = spark.createDataFrame(rows, "seq long, ts_us long, src_ip string, bytes long")
    for k in range(3):
        df.filter((F.col("seq") >= 20 * k) & (F.col("seq") < 20 * k + 20)).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    read = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = streaming.thresholds(read, 60_000_000, 3).writeStream.format("memory").queryName("hits").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    said = folds.fold(df, ["src_ip"], ["ts_us", "seq"], ["ts_us"], folds.threshold(60_000_000, 3), "hits", "int").filter("hits is not null")
    assert sorted((r.src_ip, r.seq, r.hits) for r in spark.table("hits").collect()) == sorted((r.src_ip, r.seq, r.hits) for r in said.collect())
