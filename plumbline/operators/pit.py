"""Point-in-time evidence: a row counts at an instant only if it had happened and was known by then."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import times
from plumbline.functions.text import sign_label
from plumbline.operators.joins import within


def weight_of(kind: Column, weights: dict[str, int]) -> Column:
    table = F.create_map(*[F.lit(v) for pair in weights.items() for v in pair])
    return F.coalesce(F.try_element_at(table, kind), F.lit(0))


def evidence(boundaries: DataFrame, observations: DataFrame, window_seconds: int) -> DataFrame:
    """Boundaries (as_of) with the observations of the closed window before them that were available."""
    spans = boundaries.withColumn("lower", F.col("as_of") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(window_seconds)))
    return within(spans, observations, "lower", "as_of", "occurred_at", window_seconds).where("available_at <= as_of")


def features(found: DataFrame) -> DataFrame:
    """One row a boundary: records, amount, positive and negative counts, sources and actors."""
    return found.groupBy("as_of").agg(
        F.count("*").alias("records"),
        F.countDistinct("kind").alias("kinds"),
        F.sum("amount").alias("total"),
        F.count_if(F.col("amount") > 0).alias("positive"),
        F.count_if(F.col("amount") < 0).alias("negative"),
        F.slice(F.array_sort(F.collect_set("source")), 1, 100).alias("sources"),
    )


def weighted_direction(found: DataFrame, weights: dict[str, int], window_seconds: int, buckets: int = 3) -> DataFrame:
    """Signs of amounts, weighted by kind and by recency in ``buckets`` equal parts of the window."""
    age = times.seconds_between(F.col("occurred_at"), F.col("as_of"))
    part = F.least(F.lit(buckets - 1), F.floor(age * buckets / window_seconds))
    score = F.signum("amount").cast("long") * weight_of(F.col("kind"), weights) * (buckets - part)
    scored = found.withColumn("weight", weight_of(F.col("kind"), weights)).where((F.col("weight") > 0) & (F.col("amount") != 0))
    total = scored.groupBy("as_of").agg(F.count("*").alias("scored"), F.sum(score).alias("score"))
    return total.withColumn("direction", sign_label(F.col("score"), "up", "down", "flat"))


def late(observations: DataFrame, start: Column, end: Column) -> DataFrame:
    """Observations of [start, end) by kind: counted, or known only after the window's end."""
    inside = observations.where((F.col("occurred_at") >= start) & (F.col("occurred_at") < end))
    status = F.when(F.col("available_at") > end, "late").otherwise("counted")
    return inside.groupBy("kind", status.alias("status")).agg(F.count("*").alias("n"))


def coverage(observations: DataFrame, start: Column, end: Column, scope: str | None = None) -> DataFrame:
    """Per kind in [start, end): count, distinct sources, first, last and how many arrived late."""
    inside = observations.where((F.col("occurred_at") >= start) & (F.col("occurred_at") < end))
    if scope is not None:
        inside = inside.where(F.col("scope").isin(scope, ""))
    return inside.groupBy("kind").agg(
        F.count("*").alias("n"),
        F.countDistinct("source").alias("sources"),
        F.min("occurred_at").alias("first_at"),
        F.max("occurred_at").alias("last_at"),
        F.count_if(F.col("available_at") > end).alias("late"),
    )


def nested_horizons(points: DataFrame, observations: DataFrame, hours: tuple[int, ...] = (24, 48, 72)) -> DataFrame:
    """Per point (start_time) and horizon: records known before the start, and records that came too late."""
    spans = points.select("instrument_key", "start_time", F.explode(F.array(*[F.lit(h) for h in hours])).alias("hours"))
    spans = spans.withColumn("lower", F.col("start_time") - F.make_dt_interval(F.lit(0), F.col("hours")))
    found = within(spans, observations, "lower", "start_time", "occurred_at", 86_400)
    known = F.col("available_at") < F.col("start_time")
    return found.groupBy("instrument_key", "start_time", "hours").agg(F.count_if(known).alias("known"), F.count_if(~known).alias("late"), F.sum(F.when(known, F.signum("amount"))).cast("long").alias("score"))


def tiles(series: DataFrame, hours: int = 24) -> DataFrame:
    """Tumbling windows of a series: bars, return, highest, lowest and mean volume."""
    start = F.expr(times.EPOCH) + F.make_dt_interval(F.lit(0), (F.floor(times.epoch_seconds(F.col("open_time")) / (hours * 3600)) * hours).cast("int"))
    return series.groupBy("instrument_key", start.alias("tile_start")).agg(
        F.count("*").alias("bars"),
        F.min_by("open", "open_time").alias("first_open"),
        F.max_by("close", "open_time").alias("last_close"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.avg("volume").alias("mean_volume"),
    )
