"""Captures cut into ranges, and greetings put together from segments by number."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import functions as F

from tests.test_dissect import greeting
from tests.test_quic import crypto, sealed
from tests.test_sources_streaming import capture, tcp
from tidewatch.operators import detectors
from tidewatch.operators.intervals import Greetings, Intervals
from tidewatch.sources import captures, dissect, quic


def test_a_capture_in_ranges_is_the_capture(spark, tmp_path, monkeypatch):
    """Of many ranges each begins in the middle of a record, and payloads hold what looks like records."""
    rng = np.random.default_rng(1)
    fake = b"".join(struct.pack("<IIII", 1000, 7, 20, 20) + bytes(20) for _ in range(5))
    frames = [tcp((10, 0, 0, 1), (8, 8, 8, 8), int(p), 80, 24, bytes(rng.integers(0, 256, int(n), np.uint8)) + (fake if n % 3 == 0 else b"")) for p, n in zip(rng.integers(1, 60000, 3000), rng.integers(0, 300, 3000), strict=True)]
    data = capture(frames)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pcap").write_bytes(data)
    (tmp_path / "in" / "b.pcap").write_bytes(data[: len(data) - 11])  # the last record is cut
    (tmp_path / "in" / "none.txt").write_bytes(b"no capture at all" * 100)
    whole = captures.read_captures(spark, str(tmp_path / "in"))
    assert whole.count() == 3000 + 2999
    ranges = captures.read_captures(spark, str(tmp_path / "in"), split=len(data) // 8 + 1)
    assert ranges.rdd.getNumPartitions() == 17
    key = F.xxhash64(*(F.col(c) for c in whole.columns))
    assert sorted(r[0] for r in ranges.select(key).collect()) == sorted(r[0] for r in whole.select(key).collect())
    last = captures.read_captures(spark, str(tmp_path / "in" / "a.pcap"), split=1000).agg(F.count(F.lit(1)), F.countDistinct("seq"), F.max("seq")).first()
    assert last[:2] == (3000, 3000) and last[2] == len(data) - 16 - len(frames[-1])


def test_borders_are_found_without_the_beginning(monkeypatch, tmp_path):
    """Where a range is far from the file's beginning, the border comes from what the bytes look like."""
    monkeypatch.setattr(captures, "BEFORE", 3000)
    rng = np.random.default_rng(2)
    data = capture([tcp((1, 1, 1, 1), (2, 2, 2, 2), 1, 2, 24, bytes(rng.integers(0, 256, int(n), np.uint8))) for n in rng.integers(0, 400, 2000)])
    path = tmp_path / "a.pcap"
    path.write_bytes(data)
    with path.open("rb") as file:
        got = [r[0] for at in range(0, len(data), 7001) for r in captures.records_between(captures.Window(file, len(data)), at, min(at + 7001, len(data)))]
        assert got == [r[0] for r in captures.records_between(captures.Window(file, len(data)), 0, len(data))] and len(got) == 2000


def test_a_file_beyond_two_gigabytes(spark, tmp_path):
    """Sparse on disk: one record whose range lies beyond what one row can hold is read with those at the beginning."""
    frames = [tcp((1, 1, 1, 1), (2, 2, 2, 2), 1, 2)] * 40
    path = tmp_path / "big.pcap"
    path.write_bytes(capture(frames))
    gap = struct.pack("<IIII", 1100, 5, captures.LARGEST, captures.LARGEST)
    with path.open("r+b") as file:
        file.seek(0, 2)
        for _ in range(130):
            file.write(gap)
            file.seek(captures.LARGEST, 1)
        file.write(capture(frames)[24:])
    assert path.stat().st_size > 2**31
    with path.open("rb") as file:  # the end of it, found through the records before
        size, tail = path.stat().st_size, len(capture(frames)) - 24
        got = list(captures.records_between(captures.Window(file, size), size - tail, size))
    assert len(got) == 40 and got[0][3] == frames[0]


def test_tos_and_numbers_are_read():
    frame = tcp((1, 1, 1, 1), (2, 2, 2, 2), 1, 2)
    marked = frame[:15] + b"\xb8" + frame[16:38] + (77).to_bytes(4) + frame[42:]
    got = captures.decode(1, marked)
    assert (got["ip_tos"], got["tcp_seq"]) == (0xB8, 77)
    six = captures.decode(101, (6 << 28 | 0xB8 << 20).to_bytes(4) + struct.pack(">HBB", 20, 6, 64) + bytes(32) + frame[34:54])
    assert (six["ip_tos"], six["tcp_seq"]) == (0xB8, 0)


def test_intervals_against_bytes():
    rng = np.random.default_rng(3)
    for _ in range(200):
        held, plain = Intervals(), {}
        for _ in range(int(rng.integers(1, 12))):
            at, piece = int(rng.integers(-20, 40)), bytes(rng.integers(0, 256, int(rng.integers(0, 15)), np.uint8))
            held.put(at, piece)
            for i, b in enumerate(piece):
                plain.setdefault(at + i, b)
        assert held.starts == sorted(held.starts) and held.size() == len(plain)
        assert {s + i: b for s, p in zip(held.starts, held.parts, strict=True) for i, b in enumerate(p)} == plain
        for at in range(-22, 55):
            run = bytearray()
            while at + len(run) in plain:
                run.append(plain[at + len(run)])
            assert held.after(at) == bytes(run)


def test_greetings_from_segments(spark):
    """Shuffled, repeated, cut and overlapping segments, with numbers that pass 2 ** 32, give one greeting each."""
    rng = np.random.default_rng(4)
    rows, seq = [], 0
    for c in range(20):
        data, first = greeting(f"host{c}.example", alpn=("h2",) * 40), int(rng.integers(0, 1 << 32)) if c % 2 else (1 << 32) - 50
        cuts = sorted({0, len(data), *rng.integers(1, len(data), 5).tolist()})
        pieces = [(a, data[max(a - int(rng.integers(0, 9)), 0) if a else 0 : b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        pieces = [(b_ - len(p), p) for (_, p), b_ in zip(pieces, cuts[1:], strict=True)] + [(0, data[: cuts[1]])]
        for k in rng.permutation(len(pieces)):
            at, piece = pieces[k]
            rows.append((seq * 1000, seq, f"10.0.0.{c}", 5000 + c, "8.8.8.8", 443, "tcp", (first + at) % (1 << 32), bytearray(piece)))
            seq += 1
    df = spark.createDataFrame(rows, "ts_us long, seq long, src_ip string, src_port int, dst_ip string, dst_port int, protocol string, tcp_seq long, payload binary")
    got = dissect.whole_greetings(df.repartition(5))
    assert sorted(r.tls.sni for r in got.collect()) == sorted(f"host{c}.example" for c in range(20))
    late = Greetings(wait=100)
    data = greeting("late.example")
    assert late.run([0, 200, 201], [5, 35, 5], [data[:30], data[30:], data[:30]]) == [None, None, data]


def test_names_of_sessions_and_trackers(spark):
    hello = greeting("ads.tracker.example")[5:]
    (first,) = sealed(spark, [(1, b"12345678", 0, crypto(0, hello) + bytes(20))])
    rows = [(0, 0, "10.0.0.1", 5000, "8.8.8.8", 443, "udp", bytearray(first)), (1, 1, "10.0.0.1", 5001, "9.9.9.9", 443, "udp", bytearray(b"\xc3\0\0\0\1\4abcd\0" + bytes(40))), (2, 2, "10.0.0.2", 6000, "8.8.4.4", 443, "tcp", bytearray(greeting("Plain.Example")))]
    df = spark.createDataFrame(rows, "ts_us long, seq long, src_ip string, src_port int, dst_ip string, dst_port int, protocol string, payload binary")
    said, named = dissect.dissected(df), quic.greetings(df)
    assert {r.target for r in detectors.quic_sessions(said, named).collect()} == {"ads.tracker.example", "9.9.9.9:443"}
    assert {r.target for r in detectors.quic_sessions(said).collect()} == {"8.8.8.8:443", "9.9.9.9:443"}
    hosts = detectors.greeted_names(named, dissect.whole_greetings(df))
    assert {(r.src_ip, r.host) for r in hosts.collect()} == {("10.0.0.1", "ads.tracker.example"), ("10.0.0.2", "plain.example")}
    trackers = spark.createDataFrame([(".tracker.example", "ads")], "domain string, category string")
    assert [(r.src_ip, r.host) for r in detectors.tracker_hits(hosts, trackers).collect()] == [("10.0.0.1", "ads.tracker.example")]
