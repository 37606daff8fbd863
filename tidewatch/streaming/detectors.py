"""The same detectors on streams.

Counts in event-time windows are Structured Streaming's own. Detectors whose state decides what comes next keep the
state of a key in the state store and use the very functions of the batch folds, so that both give the same alerts for
events that arrive in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewatch.operators import flows, folds, intel
from tidewatch.operators.alerts import dedup_key, kinds_of

from . import stateful


def counts(packets: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Packets and bytes of each window and source; what is later than `late` is left out."""
    timed = packets.withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "src_ip").agg(F.count(F.lit(1)).alias("packets"), F.sum("bytes").alias("bytes")).select("window.start", "src_ip", "packets", "bytes")


def thresholds(packets: DataFrame, window: int, least: int, late: str = "10 minutes") -> DataFrame:
    """Events at which the number in the last window of a source reaches `least`; counting then starts anew.

    The state of a source is the times of its last events, fewer than `least`; it goes when event time has passed the
    window.
    """

    def on(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        out = []
        rows = sorted((int(t), int(s)) for p in parts for t, s in zip(p["ts_us"], p["seq"], strict=True))
        for at, seq in rows:
            held = [t for t in held if at - t <= window] + [at]
            if len(held) >= least:
                out.append((key[0], at, seq, len(held)))
                held = []
        state.update((held,))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, rows[-1][0] // 1000 + window // 1000 + 1))
        yield pd.DataFrame(out, columns=["src_ip", "ts_us", "seq", "hits"])

    timed = packets.select("src_ip", "ts_us", "seq", F.timestamp_micros("ts_us").alias("ts")).withWatermark("ts", late)
    return timed.groupBy("src_ip").applyInPandasWithState(on, "src_ip string, ts_us long, seq long, hits int", "held array<long>", "append", GroupStateTimeout.EventTimeTimeout)


# detectors whose state decides what comes next, with the states of the batch folds; each gives late, too (see stateful.fold)


def scans(packets: DataFrame, by: list[str], value: str, least: int, window: int, late: str = "10 minutes") -> DataFrame:
    """horizontal_scan() and vertical_scan() on a stream: by, ts_us, seq, targets, late."""
    rows = packets.select(*by, value, "ts_us", "seq").filter(F.col(value).isNotNull())
    return stateful.fold(rows, by, ["ts_us", "seq"], ["ts_us", value], folds.anchored_distinct(window, least), "targets", "int", late).drop(value)


def burst(packets: DataFrame, by: list[str], value: str, least: int, window: int, cooldown: int, strict: bool = True, late: str = "10 minutes") -> DataFrame:
    """detectors.burst() on a stream: by, ts_us, seq, distinct, late."""
    rows = packets.select(*by, value, "ts_us", "seq").filter(F.col(value).isNotNull())
    return stateful.fold(rows, by, ["ts_us", "seq"], ["ts_us", value], folds.sliding_distinct(window, least, cooldown, strict), "distinct", "int", late).drop(value)


def dns_bursts(packets: DataFrame, least: int, window: int, cooldown: int, late: str = "10 minutes") -> DataFrame:
    """intel.dns_bursts() on a stream: client, ts_us, seq, distinct, severity, late."""
    said = stateful.fold(intel.looked_up(packets), ["client"], ["ts_us", "seq"], ["ts_us", "domain", "entropy", "size"], intel.bursts(window, least, cooldown), "burst", intel.BURST, late)
    return said.select("client", "ts_us", "seq", "burst.distinct", F.when(F.col("burst").isNotNull(), intel.burst_severity()).alias("severity"), "late")


def without_duplicates(alerts: DataFrame, window: int = 60_000_000, order: str = "alert_id", late: str = "10 minutes") -> DataFrame:
    """alerts.without_duplicates() on a stream: an alert leaves when its window is over, with what was dropped for it. Late
    alerts leave at once, marked late, without a count."""
    kind = alerts.schema
    rows = alerts.select(dedup_key().alias("dedup_key"), "ts_us", F.col(order).alias("alert_name"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in alerts.columns))).alias("alert_row"))
    said = stateful.fold(rows, ["dedup_key"], ["ts_us", "alert_name", "alert_row"], ["ts_us", "alert_row"], folds.duplicates(window), "told", "struct<first:string,duplicate_count:long>", late)
    row = F.from_json(F.when(F.col("late"), F.col("alert_row")).otherwise(F.col("told.first")), kind)
    return said.select(row.alias("x"), "told.duplicate_count", "late").select("x.*", "duplicate_count", "late")


def correlated(alerts: DataFrame, least: int = 3, window: int = 120_000_000, cooldown: int = 120_000_000, least_severity: int = 2, late: str = "10 minutes") -> DataFrame:
    """alerts.correlated() on a stream: src_ip, ts_us, alert_id, kinds, late."""
    said = stateful.fold(kinds_of(alerts, least_severity), ["src_ip"], ["ts_us", "seq"], ["ts_us", "kind"], folds.sliding_distinct(window, least, cooldown, strict=False), "kinds", "int", late)
    return said.select("src_ip", "ts_us", F.col("seq").alias("alert_id"), "kinds", "late")


def connections(packets: DataFrame, gap: int = 60_000_000, idle: int = 300_000_000, late: str = "10 minutes") -> tuple[DataFrame, DataFrame]:
    """flows.connections() on a stream, each flow when it is over, and its late packets.

    A flow is over when the next one opens or the watermark is past its silence. The number of a flow starts anew where
    its endpoints were silent. Both results are of one query each.
    """
    ends = [f"{x}_{y}" for x in ("lo", "hi") for y in ("ip", "port")]
    rows = flows.sided(packets).withColumns({e: F.col(e.replace("_", ".")) for e in ends}).drop("lo", "hi")
    inputs = ["ts_us", "protocol", "tcp_flags", "bytes", "from_lo", "served"]
    said = stateful.fold(rows, ["protocol", *ends], ["ts_us", "seq"], inputs, lambda: flows.Tracked(gap, idle), "now", f"struct<{flows.SUMMED.replace(', ', ',').replace(' ', ':')}>", late)
    lo, hi = (F.struct(F.col(f"{x}_ip").alias("ip"), F.col(f"{x}_port").alias("port")).alias(x) for x in ("lo", "hi"))
    return flows.described(said.filter("not late").select("protocol", lo, hi, "now.*")), said.filter("late").drop("now", "late")
