"""Wilder's average true range along a stream, in order of event time whatever the order of arrival."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "close double, n int, average double, newest long, at array<long>, high array<double>, low array<double>, last array<double>"
RANGES = "instrument_key string, at timestamp, true_range double, atr double"
Bar = tuple[int, float, float, float]


def wilder(bars: Iterable[Bar], close: float | None, n: int, average: float, period: int) -> Iterator[tuple[int, float, float | None, float, int, float]]:
    """(at, true range, atr or None, close, n, average) after each bar: the mean of the first ``period`` ranges, then one part in ``period`` new."""
    for at, high, low, last in bars:
        span = high - low if close is None else max(high - low, abs(high - close), abs(low - close))
        n += 1
        average = average + (span - average) / n if n <= period else (average * (period - 1) + span) / period
        close = last
        yield at, span, average if n >= period else None, close, n, average


def atr(bars: DataFrame, period: int = 14, late: str = "2 days") -> DataFrame:
    """(instrument_key, at, true_range, atr) of a stream of bars (instrument_key, at, high, low, close), one state a series.

    A bar waits in the state until the watermark has passed it, so bars that come up
    to ``late`` out of order give what the sorted series gives; a timer takes up what
    waits when the watermark moves on. Bars behind the watermark are dropped by Spark and counted in
    its metrics; a bar of an instant that was applied already, or with a null, is
    left out. Of bars of one instant the one of least close, high and low counts.
    """

    def walk(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        close, n, average, newest, *held = state.get if state.exists else (None, 0, 0.0, None, [], [], [], [])
        waiting: list[Bar] = list(zip(*held, strict=True))
        for batch in [] if state.hasTimedOut else batches:
            batch = batch.dropna()
            waiting += zip((batch["at"].astype("datetime64[us]").astype("int64")).tolist(), batch["high"], batch["low"], batch["close"], strict=True)
        reached = state.getCurrentWatermarkMs() * 1000
        ready: dict[int, Bar] = {}
        for bar in sorted((b for b in waiting if b[0] < reached and (newest is None or b[0] > newest)), key=lambda b: (b[0], b[3], b[1], b[2])):
            ready.setdefault(bar[0], bar)
        waiting = [b for b in waiting if b[0] >= reached]
        out = []
        for at, span, value, close, n, average in wilder(ready.values(), close, n, average, period):  # noqa: B020, PLR1704
            out.append((key[0], pd.Timestamp(at, unit="us"), span, value))
            newest = at
        state.update((close, n, average, newest, *([list(x) for x in zip(*waiting, strict=True)] or [[], [], [], []])))
        if waiting:
            state.setTimeoutTimestamp(max(min(b[0] for b in waiting) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["instrument_key", "at", "true_range", "atr"]).astype({"true_range": "float64", "atr": "float64", "at": "datetime64[us]"})

    own = bars.select("instrument_key", "at", "high", "low", "close").withWatermark("at", late)
    return own.groupBy("instrument_key").applyInPandasWithState(walk, RANGES, STATE, "append", GroupStateTimeout.EventTimeTimeout)
