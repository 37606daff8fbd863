"""Operators whose every output decides what comes next: anchored windows, cooldowns, latches and thresholds.

Spark shuffles rows by key and sorts them; each task then reads its keys one after the other in Arrow batches and keeps
only the state of the key that is open. A key's rows are never collected: one key may have any number of them. A state
is asked once for each stretch of a key's rows in a batch, not for each row, and keeps what it needs in plain values, so
that streams can store it between batches (see tidewatch.streaming.stateful).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter, deque
from collections.abc import Callable, Iterator, Sequence
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class State(Protocol):
    """Of one key. After `idle` microseconds without an event it says the same as a new one."""

    idle: int

    def run(self, at: Sequence[int], *values: Sequence[Any]) -> list:
        """What to say of each of the next events, in order (None: nothing)."""


def _turns(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before; null is a value."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    if pa.types.is_nested(column.type):
        x = column.to_pylist()
        return np.array([p != q for p, q in zip(x[1:], x, strict=False)], bool)
    unequal = pc.fill_null(pc.not_equal(a, b), False)
    return pc.or_(unequal, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def fold(rows: DataFrame, by: list[str], order: list[str], inputs: list[str], state: Callable[[], State], out: str, kind: T.DataType | str) -> DataFrame:
    """rows with one more column, out: what the state of the row's key said of it.

    state() makes the state of a new key, which is given the rows' `inputs`, in the order of `order`. Null keys are a key
    of their own.
    """
    columns = [c for c in rows.columns if c != out]
    field = T.StructField(out, T._parse_datatype_string(kind) if isinstance(kind, str) else kind)
    schema = T.StructType([*(rows.schema[c] for c in columns), field])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        arrow, last, now = to_arrow_type(field.dataType), None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = [batch.column(c) for c in by]
            new = np.zeros(n, bool)
            for k in keys:
                new[1:] |= _turns(k)
            edges = [0, *np.flatnonzero(new).tolist(), n]
            values = [batch.column(c).to_pylist() for c in inputs]
            made: list = []
            for lo, hi in zip(edges, edges[1:], strict=False):
                key = tuple(k[lo].as_py() for k in keys)
                if now is None or key != last:
                    last, now = key, state()
                made += now.run(*(v[lo:hi] for v in values))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(made, arrow)], names=[*columns, out])

    dealt = rows.select(*columns).repartition(*(F.col(c) for c in by)).sortWithinPartitions(*by, *order)
    return dealt.mapInArrow(run, schema)


class anchored:  # noqa: N801  (used as functions that make states, as the other folds)
    """Windows that start at the first event of a key and again at the first event after they end.

    Says the start of the event's window. An event at exactly start + window is still inside only if inclusive.
    """

    def __init__(self, window: int, inclusive: bool = False):
        self.window, self.inside = window, bisect_right if inclusive else bisect_left

    def __call__(self) -> _Anchored:
        return _Anchored(self.window, self.inside)


class _Anchored:
    def __init__(self, window: int, inside: Callable):
        self.window, self.inside, self.start = window, inside, None
        self.idle = window + 1

    def run(self, at: Sequence[int]) -> list:
        out: list = []
        while len(out) < len(at):
            lo = len(out)
            hi = lo if self.start is None else self.inside(at, self.start + self.window, lo)
            if hi == lo:
                self.start = at[lo]
                hi = max(self.inside(at, self.start + self.window, lo), lo + 1)
            out += [self.start] * (hi - lo)
        return out


#: Steps that one task of starts() goes through at a time.
STEPS = 16


def starts(times: DataFrame, by: list[str], pause: int) -> DataFrame:
    """The starts of anchored windows of length `pause`, where one key may have most of the rows: by and start_us.

    times has by and ts_us, each once or more. A window starts at most once in a step of `pause`, so that STEPS steps
    are a block that says, for each time from which the next window may start in it, from which time on the first window
    after it may start: times that come to the same are one piece. Pieces tell where each block begins, one after the
    other, and blocks are then gone through each by itself.
    """
    block = F.expr(f"(ts_us - pmod(ts_us, {pause * STEPS}L)) div {pause * STEPS}L").alias("_block")
    once = times.filter("ts_us is not null").select(*by, "ts_us").distinct().select(*by, block, "ts_us")
    keys = [*by, "_block"]
    schema = T.StructType([*(once.schema[c] for c in keys), T.StructField("_upto", T.LongType()), T.StructField("_onto", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, last, now = None, None, None

        def said() -> pa.RecordBatch:
            values = [pa.repeat(pa.scalar(k, t), len(now.upto)) for k, t in zip(last, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*values, pa.array(now.upto), pa.array(now.onto)], names=[*keys, "_upto", "_onto"])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            values = [batch.column(c) for c in keys]
            kinds = [k.type for k in values]
            new = np.zeros(n, bool)
            for k in values:
                new[1:] |= _turns(k)
            edges = [0, *np.flatnonzero(new).tolist(), n]
            at = batch.column("ts_us").to_numpy()
            for lo, hi in zip(edges, edges[1:], strict=False):
                key = tuple(k[lo].as_py() for k in values)
                if now is None or key != last:
                    if now is not None:
                        yield said()
                    last, now = key, _Pieces(key[-1] * STEPS * pause, pause)
                now.run(at[lo:hi])
        if now is not None:
            yield said()

    pieces = once.repartition(*(F.col(c) for c in keys)).sortWithinPartitions(*keys, "ts_us").mapInArrow(run, schema)
    begun = fold(pieces, by, ["_block", "_upto"], ["_block", "_upto", "_onto"], _Chain, "_from", "long").filter("_from is not null")
    rows = once.withColumn("_from", F.lit(None).cast("long")).unionByName(begun.select(*keys, F.lit(None).cast("long").alias("ts_us"), "_from"))
    return fold(rows, keys, ["ts_us"], ["ts_us", "_from"], lambda: _Starts(pause), "start_us", "long").filter("start_us is not null").select(*by, "start_us")


def with_start(rows: DataFrame, by: list[str], pause: int, found: DataFrame) -> DataFrame:
    """rows (by, ts_us and others) with start_us, the start of the window that each is in; found are the starts()."""
    from .joins import sized

    step = lambda c: F.expr(f"({c} - pmod({c}, {pause}L)) div {pause}L")
    # a window is in its own step and the next, and no step has two starts
    near = found.select(*by, step("start_us").alias("_step"), F.col("start_us").alias("_own"), F.lit(None).cast("long").alias("_before"))
    near = near.unionByName(found.select(*by, (step("start_us") + 1).alias("_step"), F.lit(None).cast("long").alias("_own"), F.col("start_us").alias("_before")))
    near = near.groupBy(*by, "_step").agg(F.max("_own").alias("_own"), F.max("_before").alias("_before"))
    met = rows.withColumn("_step", step("ts_us")).join(sized(near), [*by, "_step"])
    return met.withColumn("start_us", F.when(F.col("ts_us") >= F.col("_own"), F.col("_own")).otherwise(F.col("_before"))).select(*rows.columns, "start_us")


class _Pieces:
    """What a block makes of the times from which its first window may start: up to _upto, the first window after the
    block may start from _onto."""

    def __init__(self, begin: int, pause: int):
        self.first, self.pause = begin + pause, pause  # a window that started before the block is over by then
        self.upto = self.onto = np.array([self.first], np.int64)

    def run(self, at: np.ndarray) -> None:
        own = at[at < self.first]
        upto, onto = (np.concatenate([x[:-1], own, x[-1:]]) for x in (self.upto, self.onto))
        while (due := np.flatnonzero(onto <= at[-1])).size:
            onto[due] = at[np.searchsorted(at, onto[due])] + self.pause
            apart = np.append(onto[1:] != onto[:-1], True)
            apart[-2:] = True  # times may yet come before the last piece
            upto, onto = upto[apart], onto[apart]
        self.upto, self.onto = upto, onto


class _Chain:
    """Says with one piece of each block from which time on the block's first window may start."""

    def __init__(self):
        self.block, self.next, self.told = None, -(1 << 62), False
        self.since = self.next
        self.idle = 1 << 62

    def run(self, blocks: Sequence[int], upto: Sequence[int], onto: Sequence[int]) -> list:
        out: list = []
        for block, up, to in zip(blocks, upto, onto, strict=True):
            if block != self.block:
                self.block, self.since, self.told = block, self.next, False
            hit = not self.told and up >= self.since
            out.append(self.since if hit else None)
            if hit:
                self.next, self.told = to, True
        return out


class _Starts:
    """The starts of a block's windows, after a row without a time that says from when on the first may start."""

    def __init__(self, pause: int):
        self.pause, self.next = pause, 0
        self.idle = 1 << 62

    def run(self, at: Sequence[int], since: Sequence[int]) -> list:
        out: list = [None] * len(at)
        i = 0
        if at[0] is None:
            self.next, i = since[0], 1
        while (i := bisect_left(at, self.next, i)) < len(at):
            out[i] = at[i]
            self.next = at[i] + self.pause
        return out


def anchored_distinct(window: int, least: int) -> Callable[[], State]:
    """Windows as anchored(inclusive=True); says the number of distinct values when it first reaches `least` in one."""
    return lambda: _AnchoredDistinct(window, least)


class _AnchoredDistinct:
    def __init__(self, window: int, least: int):
        self.window, self.least, self.start, self.seen = window, least, None, set()
        self.idle = window + 1

    def run(self, at: Sequence[int], values: Sequence[Any]) -> list:
        out: list = [None] * len(at)
        lo = 0
        while lo < len(at):
            if self.start is None or at[lo] - self.start > self.window:
                self.start, self.seen = at[lo], set()
            hi = bisect_right(at, self.start + self.window, lo)
            if self.seen is not None:  # else it was said in this window
                for i in range(lo, hi):
                    self.seen.add(values[i])
                    if len(self.seen) >= self.least:
                        out[i], self.seen = len(self.seen), None
                        break
            lo = hi
        return out


def sliding_distinct(window: int, least: int, cooldown: int, strict: bool = True) -> Callable[[], State]:
    """The number of distinct values in the last `window`, ends included, when it is `least` or more and the last time
    it was said is more than (not strict: at least) `cooldown` ago."""
    return lambda: _SlidingDistinct(window, least, cooldown, strict)


class _SlidingDistinct:
    def __init__(self, window: int, least: int, cooldown: int, strict: bool):
        self.window, self.least, self.rest = window, least, cooldown + 1 if strict else cooldown
        self.held: deque[tuple[int, Any]] = deque()
        self.count: Counter = Counter()
        self.fired: int | None = None
        self.idle = max(window, cooldown) + 1

    def run(self, at: Sequence[int], values: Sequence[Any]) -> list:
        held, count, window, out = self.held, self.count, self.window, []
        for t, value in zip(at, values, strict=True):
            held.append((t, value))
            count[value] += 1
            while t - held[0][0] > window:
                old = held.popleft()[1]
                if count[old] == 1:
                    del count[old]
                else:
                    count[old] -= 1
            n = len(count)
            if n >= self.least and (self.fired is None or t - self.fired >= self.rest):
                self.fired = t
                out.append(n)
            else:
                out.append(None)
        return out


def threshold(window: int | None = None, least: int | None = None) -> Callable[[], State]:
    """The number of events in the last `window`, ends included, when it reaches `least`; counting then starts anew.

    Both may be given with each event instead, if they are of the key.
    """
    return lambda: _Threshold(window, least)


class _Threshold:
    def __init__(self, window: int | None, least: int | None):
        self.window, self.least = window, least
        self.held: deque[int] = deque()
        self.idle = (window or 0) + 1

    def run(self, at: Sequence[int], windows: Sequence[int] | None = None, leasts: Sequence[int] | None = None) -> list:
        if windows is not None:
            self.window, self.least = windows[0], leasts[0]
            self.idle = self.window + 1
        held, window, least, out = self.held, self.window, self.least, []
        for t in at:
            held.append(t)
            while t - held[0] > window:
                held.popleft()
            if len(held) < least:
                out.append(None)
            else:
                out.append(len(held))
                held.clear()
        return out


def cooled(cooldown: int) -> Callable[[], State]:
    """True for the first event of a key and for each at least `cooldown` after the last that was true; the others are
    counted, and the count so far is said with the next: (fires, suppressed before)."""
    return lambda: _Cooled(cooldown)


class _Cooled:
    def __init__(self, cooldown: int):
        self.cooldown, self.last, self.hidden = cooldown, None, 0
        self.idle = 1 << 62  # the count is said however late the next event comes

    def run(self, at: Sequence[int]) -> list:
        out: list = []
        while len(out) < len(at):
            lo = len(out)
            hi = lo if self.last is None else bisect_left(at, self.last + self.cooldown, lo)
            self.hidden += hi - lo
            out += [{"fires": False, "suppressed": 0}] * (hi - lo)
            if hi < len(at):
                out.append({"fires": True, "suppressed": self.hidden})
                self.last, self.hidden = at[hi], 0
        return out


def record(ttl: int = 10_000_000, most: int = 16_389) -> Callable[[], State]:
    """A TLS record put together from the payloads of a connection's side: its bytes when it is whole.

    What began more than `ttl` ago, or grows beyond `most`, is given up.
    """
    return lambda: _Record(ttl, most)


class _Record:
    def __init__(self, ttl: int, most: int):
        self.ttl, self.most, self.held, self.since = ttl, most, b"", 0
        self.idle = ttl + 1

    def run(self, at: Sequence[int], payloads: Sequence[bytes]) -> list:
        return [self._on(t, p) for t, p in zip(at, payloads, strict=True)]

    def _on(self, at: int, payload: bytes) -> bytes | None:
        if self.held and at - self.since > self.ttl:
            self.held = b""
        if not self.held:
            if payload[:1] != b"\x16":
                return None
            self.since = at
        self.held += payload
        need = 5 + int.from_bytes(self.held[3:5])
        if len(self.held) < 5 or len(self.held) < need <= self.most:
            return None
        out, self.held = self.held[:need] if need <= self.most else None, b""
        return out


def rate_spike(window: int, alpha: float, sigma: float, least_rate: float, least_count: int, history: int = 60) -> Callable[[], State]:
    """Events in windows of fixed length against their smoothed rate.

    The average moves with every event, with the rate of the window so far; the deviation is that of the sample of the
    last `history` windows with events, this one included, and 0 for fewer than three. Says (rate, average, deviation,
    spike) in events per second for a window in microseconds, where there is a spike. An average of exactly 0 starts
    again from the rate.
    """
    return lambda: _RateSpike(window, alpha, sigma, least_rate, least_count, history)


class _RateSpike:
    def __init__(self, window: int, alpha: float, sigma: float, least_rate: float, least_count: int, history: int):
        self.window, self.alpha, self.sigma, self.least_rate, self.least_count = window, alpha, sigma, least_rate, least_count
        self.windows: deque[list] = deque(maxlen=history)  # [start, count]
        self.average = 0.0
        self.idle = 1 << 62  # windows without events are no part of the history

    def run(self, at: Sequence[int]) -> list:
        windows, seconds, out = self.windows, self.window / 1e6, []
        for t in at:
            start = t - t % self.window
            if windows and windows[-1][0] == start:
                windows[-1][1] += 1
            else:
                windows.append([start, 1])
            count = windows[-1][1]
            rate = count / seconds
            self.average = rate if self.average == 0.0 else self.alpha * rate + (1 - self.alpha) * self.average
            said = None
            if count > self.least_count and rate >= self.least_rate and rate > self.average and len(windows) >= 3:
                rates = [c / seconds for _, c in windows]
                mean = sum(rates) / len(rates)
                deviation = (sum((r - mean) ** 2 for r in rates) / (len(rates) - 1)) ** 0.5
                if deviation > 0 and rate > self.average + self.sigma * deviation:
                    said = {"rate": rate, "average": self.average, "deviation": deviation, "spike": True}
            out.append(said)
        return out


def duplicates(window: int) -> Callable[[], State]:
    """For streams: nothing of an event that opens a window; where the next window opens, or the key is idle, the first
    event's values and how many came after it in its window."""
    return lambda: _Duplicates(window)


class _Duplicates:
    def __init__(self, window: int):
        self.window, self.start, self.first, self.hidden = window, None, None, 0
        self.idle = window

    def run(self, at: Sequence[int], firsts: Sequence[Any]) -> list:
        out: list = []
        for t, first in zip(at, firsts, strict=True):
            if self.start is not None and t - self.start < self.window:
                self.hidden += 1
                out.append(None)
            else:
                out.append(self.end())
                self.start, self.first, self.hidden = t, first, 0
        return out

    def end(self) -> dict | None:
        return None if self.start is None else {"first": self.first, "duplicate_count": self.hidden}
