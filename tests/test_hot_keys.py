"""Folds of keys that have most of the rows: windows whose starts are found block by block."""

from __future__ import annotations

import random

import pytest

from tidewatch.operators import alerts, folds
from tidewatch.sinks import alerts as sinks


def _plain(times, pause):
    out: list[int] = []
    for t in sorted(times):
        if not out or t >= out[-1] + pause:
            out.append(t)
    return out


@pytest.mark.parametrize("batch", [7, 10_000])
def test_starts_of_windows(spark, batch):
    rng = random.Random(5)
    pause = 20
    times = {
        "dense": [rng.randrange(4000) for _ in range(3000)],
        "sparse": [rng.randrange(-90_000, 90_000) for _ in range(300)],
        "regular": [k * pause for k in range(200)] + [k * pause + 7 for k in range(200)],
        "edges": [k * pause * folds.STEPS + d for k in range(-3, 4) for d in (-pause, -1, 0, 1, pause - 1, pause)],
        "one": [13],
        None: [5, 25, 26, 46],
    }
    df = spark.createDataFrame([(k, t) for k, v in times.items() for t in v + v[:5]] + [("one", None)], "key string, ts_us long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = folds.starts(df, ["key"], pause)
        got: dict = {k: [] for k in times}
        for r in found.collect():
            got[r.key].append(r.start_us)
        inside = folds.with_start(df.filter("key is not null and ts_us is not null"), ["key"], pause, found).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {k: sorted(v) for k, v in got.items()} == {k: _plain(v, pause) for k, v in times.items()}
    assert len(inside) == sum(len(v + v[:5]) for k, v in times.items() if k)
    assert all(r.start_us == max(s for s in got[r.key] if s <= r.ts_us) for r in inside)


def test_notices_fold_times_alone(spark, monkeypatch):
    folded, fold = [], folds.fold
    monkeypatch.setattr(folds, "fold", lambda rows, *a: (folded.append(set(rows.columns)), fold(rows, *a))[1])
    rng = random.Random(6)
    rows = [(k, rng.randrange(3000), rng.choice([2, 3, 4]), f"m{k}") for k in range(2000)]
    got = sinks.notices(spark.createDataFrame(rows, "alert_id long, ts_us long, severity int, message string"), 50).collect()
    grave = [r for r in rows if r[2] >= 3]
    want = []
    for t in _plain([r[1] for r in grave], 50):
        own = [r for r in grave if t <= r[1] < t + 50]
        worst = max(own, key=lambda r: (r[2], r[1], r[0]))
        want.append((t, len(own), worst[2], worst[0], worst[3]))
    assert sorted(map(tuple, got)) == want
    assert folded and not any({"message", "alert_id", "severity"} & c for c in folded)


def _plain_pairs(rows, window, listed):
    """control_pairs(), alert by alert: least 2, strong beacon, weak bare_ip."""
    rows = sorted((r for r in rows if r[4] or r[5]), key=lambda r: (r[1], r[0]))
    kinds, met, fired, out = [], {}, {}, []
    for seq, t, app, remote, own, theirs in rows:
        kinds += [(t, app, None, k) for k in own if app] + [(t, None, remote, k) for k in theirs if remote]
        if remote:
            met[app, remote] = t
        for (a, r), m in met.items():
            asked = (a, r) == (app, remote) or (a is not None and a == app and own)
            if not asked or t - m > window or t - fired.get((a, r), -window) < window:
                continue
            fresh = {k for since, ka, kr, k in kinds if t - since <= window and ((ka and ka == a) or (kr and kr == r))} | ({"c2_infra"} if r in listed else set())
            if len(fresh - {"bare_ip"}) >= 2 and fresh & {"beacon", "c2_infra"}:
                fired[a, r] = t
                out.append((str(a), r, t, seq, sorted(fresh)))
    return sorted(out)


@pytest.mark.parametrize("most_pairs", [2, 1000])
def test_signals_meet_pairs_once_a_cell(spark, monkeypatch, most_pairs):
    folded, fold = [], folds.fold
    monkeypatch.setattr(folds, "fold", lambda rows, *a: (folded.append(rows), fold(rows, *a))[1])
    rng = random.Random(7)
    some = lambda p, *kinds: [k for k in kinds if rng.random() < p]
    rows = [(k, rng.randrange(12_000), rng.choice([None, "a", "a", "b", "c"]), rng.choice([None, "r1", "r2", "r3", "r4"]), some(0.04, "new", "odd"), some(0.04, "beacon", "bare_ip")) for k in range(4000)]
    kind = "seq long, ts_us long, app string, remote_ip string, app_signals array<string>, remote_signals array<string>"
    infra = spark.createDataFrame([("r3",)], "remote_ip string")
    got = alerts.control_pairs(spark.createDataFrame(rows, kind), infra, 2, 100, ("beacon", "c2_infra"), ("bare_ip",), most_pairs).collect()
    want = _plain_pairs(rows, 100, {"r3"})
    assert len(want) > 100 and sorted((str(r.app), r.remote_ip, r.ts_us, r.seq, r.signals) for r in got) == want
    # signals that come often in a cell are not copied to each pair
    folded.clear()
    often = [(k, k, f"a{k % 20}", "r", [], ["beacon"]) for k in range(1000)]
    assert alerts.control_pairs(spark.createDataFrame(often, kind), None, 2, 5000, most_pairs=most_pairs).collect() == []
    assert folded[0].count() <= 1000 + 20 * 3
