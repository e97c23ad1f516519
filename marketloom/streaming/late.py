"""Closed bars that account for every tick: what comes too late for its bar is an output of its own, not lost."""

from __future__ import annotations

import math
from collections.abc import Iterator
from datetime import timedelta
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import keyed_state

BAR, LATE, UNDATED = "bar", "late", "undated"
STATE = "first bigint, open double, high double, low double, last bigint, close double, volume double, symbol string, start bigint"
ROWS = "symbol string, kind string, at bigint, open double, high double, low double, close double, volume double"
_COLUMNS = [x.split()[0] for x in ROWS.split(", ")]


def _known(x: float) -> float | None:
    return None if x is None or math.isnan(x) else float(x)


def _of(pick, *values: float | None) -> float | None:
    known = [x for x in values if x is not None]
    return pick(known) if known else None


class BarProcessor(StatefulProcessor):
    """One value per (symbol, window): the bar so far. Its timer is the window's end; a tick that comes when the watermark
    has passed that end is handed on as late."""

    def __init__(self, width_micros: int) -> None:
        self.width = width_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bar = handle.getValueState("bar", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        head = next(rows)
        frames, symbol, start = chain([head], rows), head["symbol"].iloc[0], head["start"].iloc[0]
        dated = not pd.isna(start)
        end = (int(start) + self.width) // 1000 if dated else 0
        if not dated or end <= timerValues.getCurrentWatermarkInMs():
            for f in frames:
                out = pd.DataFrame({"symbol": f["symbol"], "kind": LATE if dated else UNDATED, "at": f["at"].astype("Int64"), "volume": f["amount"]})
                for column in ("open", "high", "low", "close"):
                    out[column] = f["price"]
                yield out[_COLUMNS]
            return
        held = self.bar.get() if self.bar.exists() else None
        for f in frames:
            f = f.sort_values(["at", "price"], kind="stable")
            at, price = f["at"].tolist(), [_known(x) for x in f["price"].tolist()]
            new = (int(at[0]), price[0], _of(max, *price), _of(min, *price), int(at[-1]), price[-1], float(f["amount"].sum()))
            held = new if held is None else _joined(held[:7], new)
        self.bar.update((*held, symbol, int(start)))
        self.handle.registerTimer(end)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, opened, high, low, _, close, volume, symbol, start = self.bar.get()
        self.bar.clear()
        yield pd.DataFrame([(symbol, BAR, start, opened, high, low, close, volume)], columns=_COLUMNS)

    def close(self) -> None:
        pass


def _joined(a, b) -> tuple:
    """Two parts of one bar. Of equal times the lower price opens and the higher closes, whatever came first."""
    ahead, behind = (-math.inf, math.inf)

    def opens(x):
        return x[0], behind if x[1] is None else x[1]

    def closes(x):
        return x[4], ahead if x[5] is None else x[5]

    one, two = min(a, b, key=opens), max(a, b, key=closes)
    return one[0], one[1], _of(max, a[2], b[2]), _of(min, a[3], b[3]), two[4], two[5], a[6] + b[6]


def bars_and_late_ticks(
    ticks: DataFrame, width: timedelta = timedelta(minutes=5), delay: str = "1 minute", price: str = "price", volume: str | None = None
) -> DataFrame:
    """A stream of (symbol, kind, ts, open, high, low, close, volume) from ticks ``(symbol, ts, price)``.

    ``bar`` is a closed window, ``ts`` its start; it is emitted once, when the watermark has passed its end. ``late`` is a tick
    that came after that, ``ts`` its own time, its price in all four columns; ``undated`` is one without a time. A tick whose window
    is still open counts, however far behind the watermark it is. So the volume of all rows and of the windows still
    open is that of all ticks. State is one row per open (symbol, window), so a busy symbol is dealt over tasks by its windows.
    """
    keyed_state(ticks.sparkSession)
    micros = width // timedelta(microseconds=1)
    at = F.unix_micros("ts")
    amount = F.lit(1.0) if volume is None else F.coalesce(F.col(volume).cast("double"), F.lit(0.0))
    # The watermark goes with column ts. It is dropped here, so that Spark leaves late rows to the processor.
    rows = ticks.withWatermark("ts", delay).select(
        "symbol", (at - F.pmod(at, F.lit(micros))).alias("start"), at.alias("at"), F.col(price).cast("double").alias("price"), amount.alias("amount"))
    # One text without nulls: timers of keys with several or null columns don't find their state.
    keyed = rows.withColumn("bar", F.to_json(F.struct("symbol", "start")))
    out = keyed.groupBy("bar").transformWithStateInPandas(
        statefulProcessor=BarProcessor(micros), outputStructType=ROWS, outputMode="append", timeMode="EventTime")
    return out.select("symbol", "kind", F.timestamp_micros("at").alias("ts"), "open", "high", "low", "close", "volume")
