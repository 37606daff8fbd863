"""Flows on literal packets; the query over the test tables is held against its SQL with the others."""

from __future__ import annotations

import hashlib

import pytest

from tidewatch.operators import flows

S = 1_000_000
SYN, SYNACK, ACK, DATA, FIN, RST, RSTACK = 2, 18, 16, 24, 17, 4, 20
SCHEMA = "seq long, ts_us long, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, tcp_flags int, bytes long, flow string"
C, D = ("10.0.0.9", 50000), ("10.0.0.2", 443)


def table(spark, rows):
    """Rows of (side, flags, payload) or (side, flags, payload, seconds); c is the client. A column flow is in the way."""
    out = []
    for n, (side, flags, size, *at) in enumerate(rows):
        (a, b), (c, d) = (C, D) if side == "c" else (D, C)
        out.append((n, int((at[0] if at else 1000 + n) * S), a, c, b, d, "tcp" if flags is not None else "udp", flags, size, "x"))
    return spark.createDataFrame(out, SCHEMA)


def run(spark, rows):
    return flows.connections(table(spark, rows)).orderBy("first_us").collect()


HANDSHAKE = [("c", SYN, 0), ("s", SYNACK, 0), ("c", ACK, 0), ("c", DATA, 5), ("s", DATA, 7)]


@pytest.mark.parametrize(
    ("rows", "history", "state", "outcome"),
    [
        (HANDSHAKE, "ShADd", "established", "established"),
        (HANDSHAKE + [("c", FIN, 0)], "ShADdF", "closing", "closing"),
        (HANDSHAKE + [("c", FIN, 0), ("s", FIN, 0)], "ShADdFf", "closed", "closed"),
        (HANDSHAKE + [("s", RST, 0)], "ShADdr", "closed", "reset"),
        ([("c", SYN, 0)], "S", "new", "attempt"),
        ([("c", SYN, 0), ("c", SYN, 0)], "S", "new", "attempt"),
        ([("c", SYN, 0), ("s", RSTACK, 0)], "Sr", "closed", "rejected"),
        ([("c", SYN, 0), ("c", RST, 0)], "SR", "closed", "reset"),
        ([("c", DATA, 3)], "D", "established", "established"),
        ([("c", 0, 3)], "", "new", "active"),
    ],
)
def test_history_state_and_outcome(spark, rows, history, state, outcome):
    (r,) = run(spark, rows)
    assert (r.history, r.state, r.outcome) == (history, state, outcome)
    assert (r.src_ip, r.src_port, r.dst_ip, r.dst_port) == (*C, *D) and not r.inferred
    assert r.packets == len(rows) and r.packets_out == sum(x[0] == "c" for x in rows)
    assert r.bytes_out == sum(x[2] for x in rows if x[0] == "c") and r.bytes == sum(x[2] for x in rows)
    assert r.flow_id == hashlib.md5(b"tcp:10.0.0.2:443:10.0.0.9:50000").hexdigest()


def test_a_fresh_syn_after_an_end_opens_a_flow(spark):
    found = run(spark, [("c", SYN, 0), ("c", DATA, 4), ("c", RST, 0), ("c", ACK, 0), ("c", SYN, 0), ("c", SYN, 0)])
    assert [(r.flow, r.packets, r.bytes, r.state) for r in found] == [(1, 4, 4, "closed"), (2, 2, 0, "new")]


def test_silence_opens_a_flow(spark):
    udp = [("c", None, 1, t) for t in (1010, 1070, 1131)]
    assert [r.packets for r in run(spark, udp)] == [2, 1]
    tcp = [("c", FIN, 0, 1000), ("c", ACK, 0, 1300), ("c", SYN, 0, 1601), ("c", SYN, 0, 1602)]
    assert [(r.packets, r.history) for r in run(spark, tcp)] == [(2, "FA"), (2, "S")]


def test_initiator_is_inferred(spark):
    (r,) = run(spark, [("s", SYNACK, 0), ("c", ACK, 0)])
    assert (r.src_ip, r.history, r.inferred) == (C[0], "hA", True)
    (r,) = run(spark, [("s", None, 9)])
    assert (r.src_ip, r.bytes_out, r.outcome, r.inferred) == (C[0], 0, "active", True)


def test_nulls_self_talk_and_an_empty_table(spark):
    rows = [
        (1, S, None, "b", 1, 2, "tcp", SYN, 0, ""), (2, S, "a", "b", 1, 2, None, SYN, 0, ""), (3, S, "a", "a", None, None, "icmp", None, None, ""),
        (4, S, "a", "a", 5, 5, "tcp", FIN, 0, ""), (5, S, "a", "a", 5, 5, "tcp", FIN, 0, ""),
    ]
    found = flows.connections(spark.createDataFrame(rows, SCHEMA)).orderBy("protocol").collect()
    assert [(r.protocol, r.packets, r.packets_out, r.bytes, r.state) for r in found] == [("icmp", 1, 1, 0, "new"), ("tcp", 2, 2, 0, "closing")]
    assert flows.connections(spark.createDataFrame([], SCHEMA)).count() == 0
