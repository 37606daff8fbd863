"""Streams of folds against the batch folds of the same events, with late ones kept apart."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import alerts, detectors, flows, intel
from tidewatch.streaming import detectors as streaming
from tidewatch.streaming import stateful

START, END = 10**15, 10**15 + 10**12
PACKETS = "seq long, ts_us long, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, tcp_flags int, bytes long, client string, name string"


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.PROVIDER)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def packets(n=400):
    rng = np.random.default_rng(3)
    at = START + np.cumsum(rng.integers(0, 3_000_000, n) * (1 + 60 * (rng.random(n) < 0.05)))
    flags = [2, 18, 16, 24, 17, 4, 0]
    return [(i, int(t), f"10.0.0.{rng.integers(2)}", f"8.8.8.{rng.integers(2)}", int(rng.choice([80, 4000])), int(rng.choice([443, 5000, 5001, 5002])), str(rng.choice(["tcp", "tcp", "udp"])), int(rng.choice(flags)), int(rng.integers(0, 3) * 10), f"c{rng.integers(3)}", f"q{rng.integers(9)}x.d{rng.integers(12)}.com") for i, t in enumerate(at)]


def replay(spark, tmp_path, rows, schema, make, last, order=None):
    """What the stream says of rows in six files, in order, and of a last row long after, which moves the watermark on."""
    parts = np.array_split(np.array(order if order is not None else range(len(rows))), 6)
    for k, part in enumerate([*parts, None]):
        some = [rows[i] for i in part] if part is not None else [last]
        spark.createDataFrame(some, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in" / "*"))
    stateful.write(make(read), str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(200)
    return (spark.read.parquet(str(tmp_path / "out" / x)).drop("batch") for x in ("said", "late"))


LAST = (10**6, END, "z", "z", 1, 1, "udp", 0, 0, "z", "z.z.com")
SCANNED = ["src_ip", "dst_ip"]
CASES = {
    "scan": (lambda p: streaming.scans(p, SCANNED, "dst_port", 3, 20_000_000, "5 seconds"), lambda p: detectors.vertical_scan(p, 3, 20_000_000)),
    "burst": (lambda p: streaming.burst(p, ["client"], "name", 4, 10_000_000, 15_000_000, True, "5 seconds"), lambda p: detectors.burst(p, ["client"], "name", 4, 10_000_000, 15_000_000)),
    "dns": (lambda p: streaming.dns_bursts(p, 4, 10_000_000, 15_000_000, "5 seconds"), lambda p: intel.dns_bursts(p, 4, 10_000_000, 15_000_000)),
    "flows": (lambda p: streaming.connections(p, 10_000_000, 30_000_000, "5 seconds")[0].withColumn("late", F.lit(False)), lambda p: flows.connections(p, 10_000_000, 30_000_000).drop("flow").filter(F.col("src_ip") != "z")),
}


@pytest.mark.parametrize("case", CASES)
def test_a_replay_says_what_the_batch_says(spark, tmp_path, case):
    rows, (make, plain) = packets(), CASES[case]
    said, late = replay(spark, tmp_path, rows, PACKETS, make, LAST)
    want = plain(spark.createDataFrame(rows, PACKETS))
    assert late.count() == 0
    got = {tuple(r) for r in said.select(*want.columns).collect()}
    assert got == {tuple(r) for r in want.collect()} and len(got) > 10


ALERTS = "alert_id long, ts_us long, rule_id string, alert_type string, severity int, src_ip string, dst_ip string, dst_port int"


def test_alerts_out_of_order_and_late(spark, tmp_path):
    """Neighbours that change places are put in order; what comes after the watermark is late, and nothing is lost."""
    rng = np.random.default_rng(5)
    at = START + np.cumsum(rng.integers(0, 2_000_000, 200))
    rows = [(i, int(t), f"R{rng.integers(5)}", "signature", int(rng.integers(1, 5)), f"10.0.0.{rng.integers(3)}", "8.8.8.8", 80) for i, t in enumerate(at)]
    order = list(range(200))
    for i in range(0, 200, 2):
        order[i], order[i + 1] = order[i + 1], order[i]
    behind = [5, 40]  # come in the last part, long after their time
    order = [i for i in order if i not in behind] + behind
    last = (10**6, END, "z", "z", 4, "z", "z", 1)
    said, late = replay(spark, tmp_path / "m3", rows, ALERTS, lambda a: streaming.without_duplicates(a, 20_000_000, late="5 seconds"), last, order)
    ontime = spark.createDataFrame([r for i, r in enumerate(rows) if i not in behind], ALERTS)
    want = alerts.without_duplicates(ontime, 20_000_000)
    assert {r.alert_id for r in late.collect()} == set(behind)
    assert {tuple(r) for r in said.select(*want.columns).collect()} == {tuple(r) for r in want.collect()}
    assert want.agg(F.sum("duplicate_count") + F.count(F.lit(1))).first()[0] + late.count() == len(rows)
    said, late = replay(spark, tmp_path / "m4", rows, ALERTS, lambda a: streaming.correlated(a, 3, 10_000_000, 10_000_000, 2, "5 seconds"), last, order)
    want = alerts.correlated(ontime, 3, 10_000_000, 10_000_000)
    assert {tuple(r) for r in said.select(*want.columns).collect()} == {tuple(r) for r in want.collect()} and want.count() > 5
    assert late.count() == sum(rows[i][4] >= 2 for i in behind)
