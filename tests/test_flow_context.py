"""What a flow has come to at each packet, context on alerts, and pairs of apps and remotes."""

from __future__ import annotations

import json

import numpy as np
import pytest

from tidewatch.operators import alerts, flows
from tidewatch.plans import rules

PACKETS = "seq long, ts_us long, src_ip string, src_port int, dst_ip string, dst_port int, protocol string, tcp_flags int, bytes long"


def test_running_state_of_flows(spark):
    def p(seq, at, out, flags, size, protocol="tcp"):
        ends = [("10.0.0.1", 4000), ("8.8.8.8", 443)]
        (a, b), (c, d) = ends if out else ends[::-1]
        return seq, at * 1_000_000, a, b, c, d, protocol, flags, size

    rows = [p(1, 0, True, 2, 0), p(2, 1, False, 18, 0), p(3, 2, True, 16, 0), p(4, 3, True, 24, 100), p(5, 4, False, 24, 900), p(6, 5, True, 17, 0), p(7, 6, False, 17, 0), p(8, 7, True, 2, 0), p(9, 8, False, 4, 0)]
    rows += [p(20, 0, True, None, 7, "udp"), p(21, 100, False, None, 5, "udp"), (30, 0, None, 1, "8.8.8.8", 1, "tcp", 0, 0), (31, 0, "10.0.0.1", 1, "8.8.8.8", 1, None, 0, 0)]
    df = flows.with_flow(spark.createDataFrame(rows, PACKETS).repartition(3))
    got = {r.seq: r.flow for r in df.collect()}
    assert [got[i].state for i in range(1, 10)] == ["new", "established", "established", "established", "established", "closing", "closed", "new", "closed"]
    assert [got[i].packets for i in range(1, 10)] == [1, 2, 3, 4, 5, 6, 7, 1, 2] and [got[i].new for i in (1, 2, 8)] == [True, False, True]
    assert [(got[i].bytes_out, got[i].bytes_in, got[i].bytes_from_src) for i in (4, 5, 8)] == [(100, 0, 100), (100, 900, 100), (0, 0, 0)]
    assert got[5].duration == 4.0 and {got[i].initiator for i in range(1, 10)} == {"10.0.0.1"}
    assert (got[21].packets, got[21].initiator, got[21].state) == (1, "8.8.8.8", "new") or got[21].inferred
    assert got[30] is None and got[31] is None
    match = {"all": [{"field": "flow.state", "op": "eq", "value": "established"}, {"field": "flow.bytes_in", "op": "gt", "value": 500}]}
    (rule,), problems = rules.validate([{"id": "F", "description": "d", "severity": "LOW", "match": match}], df.schema)
    assert not problems and [r.seq for r in rules.hits(df, [rule]).collect()] == [5]
    assert flows.with_flow(spark.createDataFrame([], PACKETS)).collect() == []


def test_running_state_ends_as_connections_say(spark):
    rng = np.random.default_rng(9)
    at = np.cumsum(rng.integers(0, 30_000_000, 400))
    rows = [(i, int(t), f"10.0.0.{rng.integers(2)}", int(rng.choice([80, 4000])), f"8.8.8.{rng.integers(2)}", int(rng.choice([443, 5000])), str(rng.choice(["tcp", "udp"])), int(rng.choice([2, 18, 16, 24, 17, 4])), int(rng.integers(0, 50))) for i, t in enumerate(at)]
    df = spark.createDataFrame(rows, PACKETS)
    last = {}
    for r in flows.with_flow(df).orderBy("ts_us", "seq").collect():
        key = r.flow.flow_id
        last[key] = [*last.get(key, []), r.flow] if r.flow.new else [*last[key][:-1], r.flow]
    want = {}
    for r in flows.connections(df).orderBy("first_us").collect():
        want.setdefault(r.flow_id, []).append((r.src_ip, r.state, r.packets, r.packets_out, r.bytes, r.bytes_out, r.inferred))
    assert {k: [(f.initiator, f.state, f.packets, f.packets_from_src, f.bytes, f.bytes_out, f.inferred) for f in v] for k, v in last.items()} == want


def test_context_of_the_alert_goes_first(spark):
    flow = ("id", False, 3, 9, 5, 4, 5, 2, 1.5, "new", "a", "b", False)
    rows = [(1, {"app": "own"}, {"app": "packet", "user": "u"}, flow, None, "8.8.8.8"), (2, None, None, flow, None, None), (3, {"flow": "mine"}, None, flow, "x", None), (4, None, {"k": None}, None, None, "8.8.8.8")]
    df = spark.createDataFrame(rows, f"alert_id long, context map<string,string>, packet_context map<string,string>, flow struct<{flows.RUNNING.replace(', ', ',').replace(' ', ':')}>, flow_id string, dst_ip string")
    out = alerts.with_context(df)
    got = {r.alert_id: r for r in out.collect()}
    assert out.columns == ["alert_id", "context", "flow_id", "dst_ip"]
    assert got[1].context.keys() == {"app", "user", "flow"} and got[1].context["app"] == "own" and json.loads(got[1].context["flow"])["bytes_out"] == 5 and got[1].flow_id == "id"
    assert got[2].context == {} and got[2].flow_id is None
    assert got[3].context == {"flow": "mine"} and got[3].flow_id == "x"
    assert got[4].context == {"k": None} and got[4].flow_id is None


@pytest.mark.parametrize("most_pairs", [1, 1000])
def test_signals_of_apps_and_remotes_that_met(spark, most_pairs):
    hour = 3_600_000_000
    a = lambda seq, at, app, remote, own=(), theirs=(): (seq, int(at * hour), app, remote, list(own), list(theirs))
    rows = [
        a(1, 0, "curl", "r1", (), ("beacon",)), a(2, 1, "curl", "r2", (), ("bare_ip",)), a(3, 2, "curl", None, ("new_program",)),  # completes r1, not r2
        a(4, 3, "ssh", "r1", ("new_program",)),  # r1's beacon came with curl
        a(5, 7.5, "curl", None, ("untrusted_binary",)),  # r1 met too long ago
        a(6, 20, "curl", "r1", (), ("beacon", "intel")), a(7, 21, None, "r9", (), ("intel",)), a(8, 22, None, "r9", (), ("beacon",)), a(9, 23, "vi", "r7", ("new_program",)),  # r7 is listed
        a(10, 24, "vi", "r7"), a(11, 30, "none", None, (), ("beacon",)), a(12, 24.5, "curl", "r1", (), ("intel",)),  # told of already
    ]
    df = spark.createDataFrame(rows, "seq long, ts_us long, app string, remote_ip string, app_signals array<string>, remote_signals array<string>")
    infra = spark.createDataFrame([("r7",), ("r7",)], "remote_ip string")
    got = sorted((r.seq, r.app, r.remote_ip, ",".join(r.signals)) for r in alerts.control_pairs(df, infra, most_pairs=most_pairs).collect())
    assert got == [(3, "curl", "r1", "beacon,new_program"), (4, "ssh", "r1", "beacon,new_program"), (6, "curl", "r1", "beacon,intel"), (8, None, "r9", "beacon,intel"), (9, "vi", "r7", "c2_infra,new_program")]
    assert alerts.control_pairs(df.limit(0)).collect() == []
