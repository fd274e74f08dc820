"""The event graph and events against volatility legs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import times
from plumbline.operators.joins import within


def graph(events: DataFrame, hours: int) -> DataFrame:
    """Pairs of events of one actor, the earlier id first, within the horizon; strength by kind and distance."""
    a = events.select(F.col("event_id").alias("a"), "actor", F.col("kind").alias("a_kind"), F.col("occurred_at").alias("a_at"))
    spans = a.withColumn("lower", F.col("a_at") - times.hours(hours)).withColumn("upper", F.col("a_at") + times.hours(hours))
    b = events.select(F.col("event_id").alias("b"), "actor", F.col("kind").alias("b_kind"), F.col("occurred_at").alias("b_at"))
    pairs = within(spans, b, "lower", "upper", "b_at", 2 * hours * 3600, keys=["actor"]).where("a < b")
    away = F.abs(times.micros_between(F.col("a_at"), F.col("b_at"))) / 3.6e9
    strength = F.when(F.col("a_kind") == F.col("b_kind"), 0.9).when(away <= hours / 2, 0.5).otherwise(0.2)
    relation = F.when(F.col("a_kind").contains("error") | F.col("b_kind").contains("error"), "caused_by").when(F.col("a_kind") == F.col("b_kind"), "same_kind").otherwise("related_to")
    return pairs.select("a", "b", strength.alias("strength"), relation.alias("relation"), away.alias("hours"))


def leg_links(legs: DataFrame, events: DataFrame, hours: int) -> DataFrame:
    """Events of a leg's instrument between ``hours`` before its start and after its end, scored by time, kind and actor."""
    spans = legs.select("instrument_key", "start_time", "end_time", (F.col("start_time") - times.hours(hours)).alias("lower"), (F.col("end_time") + times.hours(hours)).alias("upper"))
    found = within(spans, events, "lower", "upper", "occurred_at", 86_400, keys=["instrument_key"])
    away = F.abs(times.micros_between(F.col("start_time"), F.col("occurred_at"))) / 3.6e9
    near = F.when(away <= 24, 1.0 - away / 24).otherwise(0.0)
    actor = F.when(F.col("actor").isNotNull(), 0.5).otherwise(0.0)
    return found.select("instrument_key", "start_time", "event_id", away.alias("hours"), ((near + 1.0 + actor) / 3).alias("score"))
