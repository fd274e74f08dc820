"""Naive forecasts, their scores, and selection on an earlier part of the series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.series import order, unbroken, with_gaps

METHODS = ("persistence", "linear", "mean3")


def forecasts(series: DataFrame, tolerance: float) -> DataFrame:
    """Each bar with three bars unbroken before it: one row a method, with its error and hits."""
    made = with_gaps(series)
    p1, p2, p3 = (F.lag("close", k).over(order()) for k in (1, 2, 3))
    whole = F.coalesce(unbroken(3), F.lit(False))
    wide = (
        made.withColumn("whole", whole)
        .withColumn("previous", p1)
        .withColumn("persistence", p1)
        .withColumn("linear", 2 * p1 - p2)
        .withColumn("mean3", (p1 + p2 + p3) / 3)
        .where("whole")
    )
    long = wide.unpivot(["instrument_key", "open_time", "n", "close", "previous"], list(METHODS), "method", "forecast")
    error = F.abs(F.col("forecast") - F.col("close"))
    return (
        long.withColumn("error", error)
        .withColumn("hit", F.when(F.col("previous") != 0, error / F.abs("previous") * 100 <= tolerance).otherwise(False))
        .withColumn("direction_hit", F.signum(F.col("forecast") - F.col("previous")) == F.signum(F.col("close") - F.col("previous")))
    )


def split(made: DataFrame, train_percent: int) -> DataFrame:
    """Marks the first part of each series' forecasts as train, the rest as test."""
    per = Window.partitionBy("instrument_key", "method")
    rank = F.row_number().over(per.orderBy("open_time"))
    return made.withColumn("part", F.when(rank <= F.floor(F.count("*").over(per) * train_percent / 100), "train").otherwise("test"))


def select_method(parted: DataFrame) -> DataFrame:
    """The method of most hits, then least error, then order of METHODS, on the train part; scored on the test part."""
    scored = parted.groupBy("instrument_key", "method", "part").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.avg("error").alias("mae"))
    place = F.array_position(F.array(*[F.lit(m) for m in METHODS]), F.col("method"))
    best = Window.partitionBy("instrument_key").orderBy(F.desc("hits"), "mae", place)
    chosen = scored.where("part = 'train'").withColumn("r", F.row_number().over(best)).where("r = 1").select("instrument_key", "method")
    return chosen.join(scored.where("part = 'test'"), ["instrument_key", "method"]).select("instrument_key", "method", "n", "hits", "mae")


def rollup(made: DataFrame) -> DataFrame:
    """Scores overall (instrument_key null) and by instrument."""
    return (
        made.groupingSets([["method"], ["method", "instrument_key"]], "method", "instrument_key")
        .agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.count_if("direction_hit").alias("direction_hits"), F.avg("error").alias("mae"))
        .select("method", "instrument_key", "n", "hits", "direction_hits", "mae")
    )
