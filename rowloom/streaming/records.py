"""The same specifications over unbounded input."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.transforms import Options
from ..operators.compiler import apply_spec

# Processors travel by value, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class FirstInOrder(StatefulProcessor):
    """Keeps a key's first row in an order until the watermark has passed its first arrival by ``delay`` ms, then gives it
    out and forgets the key."""

    def __init__(self, schema: T.StructType, order_by: list[str], event_time: str, delay: int):
        self.schema, self.order_by, self.event_time, self.delay = schema, order_by, event_time, delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.best = handle, handle.getValueState("best", self.schema)

    def _place(self, row: dict) -> list:
        """Sorts as Spark does: nulls first."""
        return [(row[c] is not None and row[c] == row[c], row[c]) if row[c] is not None and row[c] == row[c] else (False,) for c in self.order_by]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = self.schema.names
        known = self.best.get() if self.best.exists() else None
        first = dict(zip(names, known, strict=True)) if known is not None else None
        arrived = None
        for part in rows:
            arrived = part[self.event_time].min() if arrived is None else min(arrived, part[self.event_time].min())
            for row in part.astype(object).where(part.notna(), None).to_dict("records"):
                if first is None or self._place(row) < self._place(first):
                    first = row
        if known is None:
            self.handle.registerTimer(int(arrived.timestamp() * 1000) + self.delay)
        self.best.update(tuple(v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in (first[n] for n in names)))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        row = self.best.get()
        self.best.clear()
        yield pd.DataFrame([row], columns=self.schema.names)

    def close(self) -> None:
        pass


def milliseconds(spark, delay: str) -> int:
    """An interval such as '1 hour' as milliseconds."""
    return spark.range(1).select((F.unix_millis(F.expr(f"TIMESTAMP'2000-01-01' + INTERVAL {delay}")) - F.unix_millis(F.expr("TIMESTAMP'2000-01-01'"))).alias("ms")).first()["ms"]


def first_in_order(stream: DataFrame, keys: list[str], order_by: list[str], event_time: str, delay: str = "1 hour") -> DataFrame:
    """Of rows with equal keys the first in ``order_by`` of those that come until the watermark has passed the key's first
    row by ``delay``. A row that comes later but stands earlier in the order wins; one that comes after starts anew.

    ``stream`` needs a watermark on ``event_time`` (a timestamp). A key's state is one row and a timer, in the RocksDB
    state store, and is dropped when the row is given out; null keys are equal. One shuffle, on the keys. Python, by
    Arrow batches: built-in stream operators keep the first arrival only (see apply_stream).
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    processor = FirstInOrder(stream.schema, order_by, event_time, milliseconds(stream.sparkSession, delay))
    return stream.groupBy(*keys).transformWithStateInPandas(processor, stream.schema, "Append", "EventTime")


def apply_stream(stream: DataFrame, config: dict, options: Options = Options(), event_time: str | None = None, delay: str = "1 hour", order_by: list[str] | None = None) -> DataFrame:
    """A streaming DataFrame through a specification. Transforms keep no state; ``unique_on`` of the specification's
    export keeps keys for ``delay`` of event time and needs ``event_time``: the first arrival wins, or with ``order_by``
    (output fields) the first in that order."""
    keys = (config.get("export") or {}).get("unique_on")
    if not keys:
        return apply_spec(stream, config, options)
    if event_time is None:
        raise ValueError("unique_on over a stream needs an event time")
    out = apply_spec(stream, config, options, keep=(event_time,)).withWatermark(event_time, delay)
    known = [k for k in keys if k in out.columns]
    if order_by:
        return first_in_order(out, known, order_by, event_time, delay)
    return out.dropDuplicatesWithinWatermark(known)


def write_stream(out: DataFrame, path: str, checkpoint: str, format: str = "parquet") -> StreamingQuery:
    return out.writeStream.format(format).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
