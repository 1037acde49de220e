"""The regime filter on streams whose points arrive out of order.

Points wait in a list per symbol until the watermark has passed them and are then folded in event-time order, so the result does
not depend on how they were dealt to micro-batches. An event-time timer at the earliest waiting point releases a symbol that has gone
silent. A point at or before the time up to which its symbol has been released can no longer be put in order: it comes out as a late
row, with its values, and changes nothing.

State per symbol: the filter (two 252-value buffers and the regime parameters), the release time, and the points of one watermark delay.
Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
"""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidepanel.streaming.monitor import _COLUMNS, OUTPUT, STATE, _pack, _unpack, advance, fresh

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ORDERED = OUTPUT + ", late boolean, price double, volume double"
_OUT = [*_COLUMNS, "late", "price", "volume"]


class _Reorder(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.filter = handle.getValueState("filter", STATE)
        self.released = handle.getValueState("released", "at bigint")
        self.waiting = handle.getListState("waiting", "at bigint, price double, volume double")

    def _release(self, symbol: str, points: list[tuple], watermark: int) -> list[dict]:
        """Fold what the watermark has passed, keep the rest, and wake up for the earliest of it. Microseconds; the watermark is in milliseconds."""
        limit = watermark * 1000
        due = sorted(p for p in points if p[0] <= limit)
        rest = [p for p in points if p[0] > limit]
        out = []
        if due:
            state = _unpack(self.filter.get()) if self.filter.exists() else fresh()
            for at, price, volume in due:
                state, result = advance(state, price, volume)
                if result is not None:
                    out.append({"symbol": symbol, "date": pd.Timestamp(at, unit="us"), **result, "late": False, "price": price, "volume": volume})
            self.filter.update(_pack(state))
            self.released.update((limit,))
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(min(p[0] for p in rest) // 1000 + 1)
        else:
            self.waiting.clear()
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        until = self.released.get()[0] if self.released.exists() else None
        points, out = list(self.waiting.get()) if self.waiting.exists() else [], []
        for batch in rows:
            for at, price, volume in zip(batch["at"].tolist(), batch["price"].tolist(), batch["volume"].tolist(), strict=True):
                if until is not None and at <= until:
                    out.append({**dict.fromkeys(_OUT), "symbol": key[0], "date": pd.Timestamp(at, unit="us"), "late": True, "price": price, "volume": volume})
                else:
                    points.append((at, price, volume))
        out += self._release(key[0], points, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame(out, columns=_OUT, dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        points = list(self.waiting.get()) if self.waiting.exists() else []
        yield pd.DataFrame(self._release(key[0], points, timerValues.getCurrentWatermarkInMs()), columns=_OUT, dtype=object)

    def close(self) -> None:
        pass


def filter_ordered(points: DataFrame, late: str = "1 hour") -> DataFrame:
    """The filter on a stream of (symbol, date, price, volume) in any order within ``late`` of the newest point.

    Points of equal symbol and time are folded by price, then volume. Output rows are those of ``filter_batch``, with ``late`` false, and late points.
    """
    timed = points.withWatermark("date", late)
    # the plain number carries no watermark, so that late rows reach the processor and can be reported
    timed = timed.select("symbol", F.unix_micros("date").alias("at"), F.col("price").cast("double").alias("price"), F.col("volume").cast("double").alias("volume"))
    return timed.groupBy("symbol").transformWithStateInPandas(statefulProcessor=_Reorder(), outputStructType=ORDERED, outputMode="append", timeMode="eventTime")


def results(out: DataFrame) -> DataFrame:
    return out.where("not late").select(*_COLUMNS)


def late_counts(out: DataFrame) -> DataFrame:
    """Late points per symbol, from the rows of the sink."""
    return out.where("late").groupBy("symbol").agg(F.count(F.lit(1)).alias("late"), F.min("date").alias("first"), F.max("date").alias("last"))
