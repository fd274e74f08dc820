"""Ordered series: cadence, gaps, returns and trailing baselines.

Series are partitioned by instrument. The cadence is measured; a window that
crosses a step of more than 1.5 times the cadence is refused, never computed.
Baselines end before the value they judge. Not enough baseline is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import times

KEY, TIME = "instrument_key", "open_time"


def order() -> Window:
    return Window.partitionBy(KEY).orderBy(TIME)


def trailing(bars: int) -> Window:
    """The ``bars`` rows before the current one."""
    return order().rowsBetween(-bars, -1)


def last(bars: int) -> Window:
    """The current row and those before it, ``bars`` in all."""
    return order().rowsBetween(-(bars - 1), 0)


def cadence(series: DataFrame) -> DataFrame:
    """The most frequent step of each series in seconds; the smallest wins a tie."""
    step = times.seconds_between(F.lag(TIME).over(order()), F.col(TIME))
    counted = series.select(KEY, step.alias("step")).where("step IS NOT NULL").groupBy(KEY, "step").agg(F.count("*").alias("n"))
    return counted.groupBy(KEY).agg(F.min_by("step", F.struct(-F.col("n"), F.col("step"))).alias("cadence"))


def with_gaps(series: DataFrame) -> DataFrame:
    """Adds step, cadence, n (place from 1) and gaps: how many gaps lie at or before a bar."""
    stepped = series.withColumn("step", times.seconds_between(F.lag(TIME).over(order()), F.col(TIME)))
    # one row a series
    known = stepped.join(F.broadcast(cadence(series)), KEY)
    flag = F.when(F.col("step") > 1.5 * F.col("cadence"), 1).otherwise(0)
    return known.withColumn("gaps", F.sum(flag).over(order().rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.row_number().over(order()))


def unbroken(bars: int) -> Column:
    """Whether the window of ``bars`` steps that ends here exists and crosses no gap."""
    return (F.col("gaps") - F.lag("gaps", bars).over(order())) == 0


def returns(series: DataFrame, bars: int = 1) -> DataFrame:
    """Adds change: percent from the close ``bars`` earlier; null across gaps or from zero."""
    before = F.lag("close", bars).over(order())
    return series.withColumn("change", F.when(unbroken(bars) & (before != 0), (F.col("close") - before) / before * 100))


def baseline(series: DataFrame, bars: int = 1, length: int = 90, least: int = 5) -> DataFrame:
    """Adds base_n, base_mean, base_sd (population) of the changes that end where the judged change starts or before, and z."""
    frame = order().rowsBetween(-(length + bars - 1), -bars)
    n, mean, sd = F.count("change").over(frame), F.avg("change").over(frame), F.stddev_pop("change").over(frame)
    enough = (F.col("base_n") >= least) & (F.col("base_sd") > 1e-12)
    return (
        series.withColumn("base_n", n)
        .withColumn("base_mean", mean)
        .withColumn("base_sd", sd)
        .withColumn("z", F.when(enough, (F.col("change") - F.col("base_mean")) / F.col("base_sd")))
    )


def abs_percentile(value: Column, history: Column) -> Column:
    """Percent of the history whose magnitude does not exceed the value's; null without history."""
    return F.when(F.size(history) > 0, F.size(F.filter(history, lambda h: F.abs(h) <= F.abs(value))) / F.size(history) * 100)


def median(values: Column) -> Column:
    return F.percentile(values, F.lit(0.5))


def newest(rows: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """The ``k`` newest rows of each key, and truncated: whether the key had more."""
    per = Window.partitionBy(*keys)
    ranked = rows.withColumn("_i", F.row_number().over(per.orderBy(*[F.desc(c) for c in order])))
    many = rows.groupBy(*keys).agg((F.count("*") > k).alias("truncated"))
    return ranked.where(F.col("_i") <= k).drop("_i").join(many, keys)
