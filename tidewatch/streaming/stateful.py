"""Folds on streams: the states of batch folds, kept in the state store, with event time put in order.

Events of a key wait in its state until the watermark has passed them and are then given to the state in order, so that
a stream says what the batch fold says of the same events, however they were cut into batches. What comes later than the
watermark is not lost: it leaves as a row of its own, marked late. A state that has been idle for as long as it remembers
is flushed and forgotten. The state store must be RocksDB's (see PROVIDER), as timers need column families.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor

from tidewatch.operators.folds import State

#: The state store that timers need, as spark.sql.streaming.stateStore.providerClass.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Fold(StatefulProcessor):
    """The state of one key and the events that wait: (order columns, other columns), by time."""

    def __init__(self, by: list[str], columns: list[str], order: list[str], inputs: list[str], state: Callable[[], State], out: str):
        self.by, self.columns, self.state, self.out = by, columns, state, out
        self.order = [columns.index(c) for c in order]
        self.inputs = [[*by, *columns].index(c) for c in inputs]

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "held binary")

    def _load(self) -> dict[str, Any]:
        return pickle.loads(self.kept.get()[0]) if self.kept.exists() else {"state": None, "wait": [], "last": None}

    def _frame(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        names = [*self.by, *self.columns, self.out, "late"]
        return pd.DataFrame([(*key, *r) for r in rows], columns=names).astype(object)

    def _place(self, row: tuple) -> tuple:
        """How a row sorts: null before all else."""
        return tuple((row[i] is not None, row[i]) for i in self.order)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed, kept, late = timerValues.getCurrentWatermarkInMs() * 1000, self._load(), []
        for part in rows:
            for row in part[self.columns].astype(object).itertuples(index=False, name=None):
                row = tuple(None if x is None or x is pd.NaT or x != x else x for x in row)
                if row[self.order[0]] is None or row[self.order[0]] < passed:
                    late.append((*row, None, True))
                else:
                    kept["wait"].append(row)
        self._keep(kept)
        yield self._frame(key, late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, kept, out = timerValues.getCurrentWatermarkInMs() * 1000, self._load(), []
        at = self.order[0]
        ready = sorted((r for r in kept["wait"] if r[at] < passed), key=self._place)
        kept["wait"] = [r for r in kept["wait"] if r[at] >= passed]
        if ready:
            kept["state"] = kept["state"] or self.state()
            said = kept["state"].run(*([(*key, *r)[i] for r in ready] for i in self.inputs))
            out = [(*r, s, False) for r, s in zip(ready, said, strict=True) if s is not None]
            kept["last"] = ready[-1]
        if kept["state"] is not None and not kept["wait"] and kept["last"][at] + kept["state"].idle < passed:
            end = kept["state"].end() if hasattr(kept["state"], "end") else None
            out += [(*kept["last"], end, False)] if end is not None else []
            kept = {"state": None, "wait": [], "last": None}
        self._keep(kept)
        yield self._frame(key, out)

    def _keep(self, kept: dict[str, Any]) -> None:
        """Store what is left, with a timer for the first event that waits or else for the end of the state."""
        if kept["wait"]:
            self.handle.registerTimer(min(r[self.order[0]] for r in kept["wait"]) // 1000 + 1)
        elif kept["state"] is None:
            self.kept.clear()
            return
        elif kept["state"].idle < 1 << 60:
            self.handle.registerTimer((kept["last"][self.order[0]] + kept["state"].idle) // 1000 + 1)
        self.kept.update((pickle.dumps(kept),))

    def close(self) -> None:
        pass


def fold(rows: DataFrame, by: list[str], order: list[str], inputs: list[str], state: Callable[[], State], out: str, kind: T.DataType | str, late: str = "10 minutes") -> DataFrame:
    """folds.fold() on a stream: the rows of which the state says something, with out and late.

    The first of order is the time of an event in microseconds. Rows that come when the watermark, `late` behind the
    greatest time seen, has passed them have late true and a null out; so have rows without a time. Null keys are a key; a key
    must not be a struct, and no name may begin with an underscore.
    The last word of a state that goes for being idle (see end()) comes with the last row of its key. Keys and columns
    come in the order: by, the others, out, late.
    """
    columns = [c for c in rows.columns if c not in (*by, out, "late")]
    field = T.StructField(out, T._parse_datatype_string(kind) if isinstance(kind, str) else kind)
    schema = T.StructType([*(rows.schema[c] for c in (*by, *columns)), field, T.StructField("late", T.BooleanType())])
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
    timed = rows.withColumn("_event_time", F.timestamp_micros(order[0])).withWatermark("_event_time", late)
    # without the time itself Spark does not take late rows out before the processor sees them
    return timed.select(*by, *columns).groupBy(*by).transformWithStateInPandas(_Fold(by, columns, order, inputs, state, out), schema, "Append", "EventTime")


def write(said: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Write what fold() says to path/said and late rows to path/late, by batch: a batch that is written again replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.persist()
        for name, part in (("said", batch.filter("not late").drop("late")), ("late", batch.filter("late").drop("late"))):
            part.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        batch.unpersist()

    return said.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
