"""Structured Streaming twins of the windowed queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from plumbline.functions import times
from plumbline.operators.pit import weight_of

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Event files of a folder as they arrive, with the session's zone for the watermark."""
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return stream.withColumn("at", F.col("ts").cast("timestamp"))


def tumbling_bars(events: DataFrame, length: str = "1 day", late: str = "2 days") -> DataFrame:
    """Bars of tumbling windows; rows behind the watermark are dropped by Spark and counted in its metrics."""
    w = F.window("at", length)
    return (
        events.withWatermark("at", late)
        .groupBy(w.alias("w"), F.col("event_type").alias("instrument_key"))
        .agg(F.min_by("value", "at").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "at").alias("close"), F.count("*").alias("volume"))
        .select("instrument_key", F.col("w.start").cast("timestamp_ntz").alias("open_time"), "open", "high", "low", "close", "volume")
    )


def nested_windows(events: DataFrame, hours: int, late: str = "2 days") -> DataFrame:
    """Sliding windows that end every day and look ``hours`` back."""
    w = F.window("at", f"{hours} hours", "24 hours")
    return events.withWatermark("at", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("event_type", F.col("w.end").cast("timestamp_ntz").alias("as_of"), "n", "total")


def weighted_directions(events: DataFrame, weights: dict[str, int], length: str = "1 day", late: str = "2 days") -> DataFrame:
    """Weighted sign of amounts by window."""
    signal = F.signum(F.col("value") - 245).cast("long") * weight_of(F.col("event_type"), weights)
    return events.withWatermark("at", late).groupBy(F.window("at", length).alias("w")).agg(F.sum(signal).alias("score"), F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("day"), "score", "n")


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "2 days") -> DataFrame:
    """Clusters of a user's events with less than ``gap`` between them."""
    return (
        events.withWatermark("at", late)
        .groupBy(F.session_window("at", gap).alias("w"), "user_id")
        .agg(F.count("*").alias("n"), F.approx_count_distinct("event_type").alias("kinds"))
        .select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n", "kinds")
    )


def forecast_join(forecasts: DataFrame, prices: DataFrame, hours: int, late: str = "2 days") -> DataFrame:
    """Forecasts with the first-hand prices of their settlement interval; unsettled ones come out null once the watermark passes.

    forecasts: key, made_at, forecast; prices: price_key, price_at, price; both instants are timestamps.
    """
    f, p = forecasts.withWatermark("made_at", late), prices.withWatermark("price_at", late)
    on = F.expr(f"key = price_key AND price_at >= made_at AND price_at <= made_at + INTERVAL {hours} HOURS")
    return f.join(p, on, "left_outer").select("key", "made_at", "forecast", "price_at", "price")


STATE = "anchor double, way int, extreme double, extreme_at timestamp, start_at timestamp"
LEGS = "instrument_key string, direction string, start_time timestamp, end_time timestamp, end_price double"


def zigzag(bars: DataFrame, threshold: float) -> DataFrame:
    """Confirmed ZigZag legs of a stream of bars (instrument_key, at, close), one state a series.

    Rows of a batch are taken in order of time; rows older than the state's
    newest are not applied, nor are rows without a positive close.
    """

    def walk(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        anchor, way, extreme, extreme_at, start_at = state.get if state.exists else (None, 0, None, None, None)
        out = []
        for at, price in zip(rows["at"], rows["close"], strict=True):
            if anchor is None:
                anchor, extreme, extreme_at, start_at = price, price, at, at
            elif extreme_at is not None and at < extreme_at:
                continue
            elif way == 0:
                if abs(price / anchor - 1) * 100 > threshold:
                    way, extreme, extreme_at = (1 if price > anchor else -1), price, at
            elif (price - extreme) * way > 0:
                extreme, extreme_at = price, at
            elif (extreme - price) * way / extreme * 100 >= threshold:
                out.append((key[0], "up" if way > 0 else "down", start_at, extreme_at, extreme))
                start_at, extreme, extreme_at, way = extreme_at, price, at, -way
        state.update((anchor, way, extreme, extreme_at, start_at))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in LEGS.split(", ")])

    return bars.where("close > 0").groupBy("instrument_key").applyInPandasWithState(walk, LEGS, STATE, "append", "NoTimeout")


def late_counts(events: DataFrame, path: str, checkpoint: str, hours: int = 24) -> DataStreamWriter:
    """Writes, batch by batch, how many rows came after the end of their day plus ``hours``, by kind: late rows are counted, not lost."""

    def write(batch: DataFrame, number: int) -> None:
        end = times.floor_day(F.col("ts")) + times.hours(24)
        arrived = F.col("ts") + times.hours((F.col("event_id") % 48).cast("int"))
        status = F.when(arrived > end + times.hours(hours - 24), "late").otherwise("counted")
        batch.groupBy(F.col("event_type").alias("kind"), status.alias("status")).agg(F.count("*").alias("n")).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def run_once(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a streaming query over what is there and return its memory table; for tests and small checks."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
