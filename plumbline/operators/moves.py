"""Moves: candidates, tiers, non-overlapping selection, ZigZag legs and regimes."""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import times
from plumbline.functions.text import sign_label
from plumbline.operators.joins import as_of
from plumbline.operators.series import baseline, order, returns, unbroken, with_gaps


def candidates(series: DataFrame, bars: int, threshold: float, length: int = 90) -> DataFrame:
    """Windows of ``bars`` steps, not across gaps, whose change is at least the threshold in size; with their baseline and range."""
    frame = order().rowsBetween(-bars, 0)
    low, high = F.min("low").over(frame), F.max("high").over(frame)
    made = (
        baseline(returns(with_gaps(series), bars), bars, length)
        .withColumn("start_time", F.lag("open_time", bars).over(order()))
        .withColumn("start_price", F.lag("close", bars).over(order()))
        .withColumn("range_percent", F.when(low > 0, (high - low) / low * 100))
    )
    return made.where(F.abs("change") >= threshold).select(
        "instrument_key",
        "start_time",
        F.col("open_time").alias("end_time"),
        "start_price",
        F.col("close").alias("end_price"),
        "change",
        sign_label(F.col("change")).alias("direction"),
        "range_percent",
        "base_n",
        "z",
        (F.col("n") - bars).alias("start_n"),
        F.col("n").alias("end_n"),
    )


def tiers(moves: DataFrame, thresholds: Sequence[int]) -> DataFrame:
    """Each move once for every threshold that it clears."""
    cleared = F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: F.abs(F.col("change")) >= t)
    return moves.withColumn("threshold", F.explode(cleared)).withColumn("tier", F.concat(F.lit("p"), F.col("threshold").cast("string")))


def clear(taken: list[tuple[int, int]], start: int, end: int, apart: int) -> bool:
    """Whether a span is ``apart`` or more from its neighbours in a sorted list of spans that do not overlap."""
    at = bisect.bisect_left(taken, (start, end))
    return (at == 0 or start - taken[at - 1][1] >= apart) and (at == len(taken) or taken[at][0] - end >= apart)


def select_largest(moves: DataFrame, cooldown_bars: int = 0) -> DataFrame:
    """The largest moves of each series that do not overlap; of one direction they stay ``cooldown_bars`` apart.

    Greedy choice is sequential within a series; only candidates get here.
    """

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        ranked = group.assign(size=group["change"].abs()).sort_values(["size", "start_n"], ascending=[False, True], kind="stable")
        every: list[tuple[int, int]] = []
        same: dict[str, list[tuple[int, int]]] = {}
        kept = []
        for i, start, end, direction in zip(ranked.index, ranked["start_n"], ranked["end_n"], ranked["direction"], strict=True):
            alike = same.setdefault(direction, [])
            if clear(every, start, end, 0) and clear(alike, start, end, cooldown_bars):
                bisect.insort(every, (start, end))
                bisect.insort(alike, (start, end))
                kept.append(i)
        return group.loc[sorted(kept)]

    return moves.groupBy("instrument_key").applyInPandas(choose, moves.schema)


def current(series: DataFrame, bars: int, threshold: float) -> DataFrame:
    """The newest window of each series and its status."""
    made = returns(with_gaps(series), bars).withColumn("newest", F.row_number().over(Window.partitionBy("instrument_key").orderBy(F.desc("open_time"))))
    made = made.withColumn("whole", unbroken(bars)).where("newest = 1")
    status = F.when(F.col("n") <= bars, "insufficient_bars").when(~F.col("whole"), "gap").when(F.abs("change") >= threshold, "move").otherwise("calm")
    return made.select("instrument_key", F.col("open_time").alias("as_of"), "change", status.alias("status"))


def pre_windows(moves: DataFrame, hours: int, reach: DataFrame) -> DataFrame:
    """The hours before each move, clipped to the first bar of its series."""
    first = reach.groupBy("instrument_key").agg(F.min("open_time").alias("first_bar"))
    start = F.greatest(F.col("start_time") - times.hours(hours), F.col("first_bar"))
    return moves.join(F.broadcast(first), "instrument_key").select("instrument_key", "start_time", start.alias("pre_start"), F.col("start_time").alias("pre_end"))


def verify(moves: DataFrame, series: DataFrame) -> DataFrame:
    """Whether stored moves still have both bars, their closes and no gap between."""
    known = with_gaps(series).select("instrument_key", "open_time", "close", "gaps")
    start = known.select("instrument_key", F.col("open_time").alias("start_time"), F.col("close").alias("start_close"), F.col("gaps").alias("start_gaps"))
    end = known.select("instrument_key", F.col("open_time").alias("end_time"), F.col("close").alias("end_close"), F.col("gaps").alias("end_gaps"))
    both = moves.join(start, ["instrument_key", "start_time"], "left").join(end, ["instrument_key", "end_time"], "left")
    status = (
        F.when(F.col("start_close").isNull(), "start_missing")
        .when(F.col("end_close").isNull(), "end_missing")
        .when(F.col("end_gaps") != F.col("start_gaps"), "gap")
        .when((F.col("start_close") != F.col("start_price")) | (F.col("end_close") != F.col("end_price")), "changed")
        .otherwise("verified")
    )
    return both.select("instrument_key", "start_time", "end_time", status.alias("status"))


LEG = "instrument_key string, direction string, start_time timestamp_ntz, end_time timestamp_ntz, start_price double, end_price double, magnitude double"


def zigzag_points(times_: list, prices: list[float], threshold: float) -> list[tuple[int, int, str]]:
    """(start, end, direction) of legs: a leg ends at its extreme once price turns back by the threshold."""
    legs, start, extreme, way = [], 0, 0, 0
    for i, price in enumerate(prices):
        if way == 0:
            change = (price / prices[0] - 1) * 100
            if abs(change) > threshold:
                way, extreme = (1 if change > 0 else -1), i
        elif (price - prices[extreme]) * way > 0:
            extreme = i
        elif (prices[extreme] - price) * way / prices[extreme] * 100 >= threshold:
            legs.append((start, extreme, "up" if way > 0 else "down"))
            start, extreme, way = extreme, i, -way
    if way and extreme != start:
        legs.append((start, extreme, "up" if way > 0 else "down"))
    return legs


def swings(prices: list[float], threshold: float) -> list[int]:
    """Places of prices without which ``zigzag_points`` would find other legs, in any surroundings.

    Repeats of the price before, prices inside a rise or fall, and a turn and turn
    back that are smaller than the threshold and lie within the prices around them
    change nothing, however the series goes on.
    """
    kept: list[int] = []
    for i, price in enumerate(prices):
        if kept and price == prices[kept[-1]]:
            continue
        kept.append(i)
        while len(kept) >= 3:
            b, c, d = (prices[k] for k in kept[-3:])
            if (b < c) == (c < d):
                del kept[-2]
                continue
            if len(kept) < 4:
                break
            a = prices[kept[-4]]
            up = a <= c and b < d and b > c and (b - c) / b * 100 < threshold
            down = a >= c and b > d and b < c and (c - b) / b * 100 < threshold
            if not (up or down):
                break
            del kept[-3:-1]
    return kept


def zigzag(series: DataFrame, threshold: float, block_hours: int = 24 * 30) -> DataFrame:
    """Legs of each series. Bars without a positive close take no part.

    A series is cut into blocks of time, which are reduced to their ``swings`` apart
    from each other; the state then runs along those, a series' turns instead of its
    bars.
    """

    def reduce(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("open_time", kind="stable")
        return group.iloc[swings(group["close"].tolist(), threshold)][["instrument_key", "open_time", "close"]]

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("open_time", kind="stable")
        at, price, key = group["open_time"].tolist(), group["close"].tolist(), group["instrument_key"].iloc[0]
        rows = [(key, d, at[s], at[e], price[s], price[e], (price[e] / price[s] - 1) * 100) for s, e, d in zigzag_points(at, price, threshold)]
        return pd.DataFrame(rows, columns=["instrument_key", "direction", "start_time", "end_time", "start_price", "end_price", "magnitude"])

    block = F.floor(times.epoch_seconds(F.col("open_time")) / (3600 * block_hours))
    bars = series.where("close > 0").select("instrument_key", "open_time", "close", block.alias("block"))
    turns = bars.groupBy("instrument_key", "block").applyInPandas(reduce, bars.drop("block").schema)
    return turns.groupBy("instrument_key").applyInPandas(walk, LEG)


def regimes(series: DataFrame, points: DataFrame, hours: int, threshold: float) -> DataFrame:
    """bull, bear, range or unknown for each point (instrument_key, start_time, start_price), by the close at or before ``hours`` earlier."""
    asked = points.withColumn("target", F.col("start_time") - times.hours(hours))
    found = as_of(asked, series.select("instrument_key", "open_time", "close"), "target", "open_time", "close", ["instrument_key"])
    change = F.when(F.col("as_of_close") != 0, (F.col("start_price") - F.col("as_of_close")) / F.col("as_of_close") * 100)
    label = F.when(F.col("lookback_return").isNull(), "unknown").when(F.col("lookback_return") > threshold, "bull").when(F.col("lookback_return") < -threshold, "bear").otherwise("range")
    return found.withColumn("lookback_return", change).select("instrument_key", "start_time", "start_price", "lookback_return", label.alias("regime"))
