"""Evidence before rises and falls against evidence before ordinary points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import times
from plumbline.operators import pit, signals
from plumbline.operators.joins import within


def comparison(points: DataFrame, legs: DataFrame, observations: DataFrame, hours: int, stride: int) -> DataFrame:
    """One row each for pump, dump and control: episodes, those with evidence known before their start, its mean direction score and its records.

    points: instrument_key, open_time; legs: instrument_key, start_time, end_time,
    direction (up, down, others are left out). Controls are every ``stride``-th of
    a series' points outside all legs and outside the ``hours`` before them.
    """
    label = F.when(F.col("direction") == "up", "pump").when(F.col("direction") == "down", "dump")
    episodes = legs.where(F.col("direction").isin("up", "down")).select(label.alias("label"), "instrument_key", "start_time", "end_time")
    spans = episodes.select("instrument_key", (F.col("start_time") - times.hours(hours)).alias("lower"), F.col("end_time").alias("upper"))
    blocked = within(spans, points.select("instrument_key", "open_time"), "lower", "upper", "open_time", max(hours, 1) * 3600, keys=["instrument_key"], how="left_semi")
    free = points.select("instrument_key", "open_time").join(blocked.distinct(), ["instrument_key", "open_time"], "left_anti")
    controls = signals.strided(free, ["instrument_key"], "open_time", stride).select(F.lit("control").alias("label"), "instrument_key", F.col("open_time").alias("start_time"))
    every = episodes.select("label", "instrument_key", "start_time").union(controls)
    found = pit.nested_horizons(every.select("instrument_key", "start_time").distinct(), observations, (hours,)).select("instrument_key", "start_time", "known", "score")
    both = every.join(found, ["instrument_key", "start_time"], "left")
    some = F.col("known") > 0
    return both.groupBy("label").agg(
        F.count("*").alias("episodes"), F.count_if(F.coalesce(some, F.lit(False))).alias("with_evidence"), F.avg(F.when(some, F.col("score"))).alias("mean_score"), F.coalesce(F.sum("known"), F.lit(0)).alias("records")
    )
