"""What is recorded about instruments in a window: every channel at once, and measured series over it.

Events of all channels are pooled as (instrument_key, channel, item, at, known_at,
value); an instrument_key of '' is market-wide and stands for all instruments. One
aggregation gives coverage, unknowns and changes of all of them. No record is not
the same as nothing happened, so channels that were expected and have no rows say so.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import times

EVENT = ("instrument_key", "channel", "item", "at", "known_at", "value")


def channel(rows: DataFrame, name: str, at: str, item: Column | None = None, known_at: str | None = None, value: Column | None = None, instrument: Column | None = None) -> DataFrame:
    """Rows as events of one channel; without ``known_at`` they were known when they happened."""
    own = F.col("instrument_key") if instrument is None else instrument
    return rows.select(
        F.coalesce(own, F.lit("")).alias("instrument_key"),
        F.lit(name).alias("channel"),
        (F.lit("") if item is None else F.coalesce(item.cast("string"), F.lit(""))).alias("item"),
        F.col(at).alias("at"),
        F.coalesce(F.col(known_at or at), F.col(at)).alias("known_at"),
        (F.lit(None) if value is None else value).cast("double").alias("value"),
    )


def pooled(*channels: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, channels)


def explain(events: DataFrame, start: Column, end: Column, pre_hours: int, expected: DataFrame | None = None) -> DataFrame:
    """One row for each (instrument, channel, item): records inside [start, end), in the hours before, and known too late; coverage and change.

    ``first_at`` to ``change`` are of the records inside, ``value`` at equal instants
    being the smaller first and the larger last. ``covered_hours`` is the part of
    the window between the first and the last record ever. ``expected`` (instrument_key, channel) adds a
    row with status never_recorded for every channel of an instrument without any event.
    Events without an instant are left out.
    """
    before = start - F.make_dt_interval(F.lit(0), F.lit(pre_hours))
    known = F.col("known_at") <= end
    inside, prior = (F.col("at") >= start) & (F.col("at") < end), (F.col("at") >= before) & (F.col("at") < start)
    when = lambda c: F.when(inside & known, c)
    place = F.struct("at", "value")
    out = events.where("at IS NOT NULL").groupBy("instrument_key", "channel", "item").agg(
        F.count_if(inside & known).alias("records"),
        F.count_if(prior & known).alias("before"),
        F.count_if((inside | prior) & ~known).alias("late"),
        F.count("*").alias("ever"),
        F.min("at").alias("since"),
        F.max("at").alias("until"),
        F.min(when(F.col("at"))).alias("first_at"),
        F.max(when(F.col("at"))).alias("last_at"),
        F.min(F.when(inside & known & F.col("value").isNotNull(), place)).alias("a"),
        F.max(F.when(inside & known & F.col("value").isNotNull(), place)).alias("b"),
        F.max(when(F.abs("value"))).alias("largest"),
    )
    if expected is not None:
        missing = expected.select("instrument_key", "channel").distinct().join(events.select("instrument_key", "channel").distinct(), ["instrument_key", "channel"], "left_anti")
        out = out.unionByName(missing.withColumn("item", F.lit("")).withColumns({c: F.lit(0).cast("long") for c in ("records", "before", "late", "ever")}), allowMissingColumns=True)
    status = F.when(F.col("records") > 0, "present").when(F.col("before") > 0, "before_only").when(F.col("late") > 0, "late_only").when(F.col("ever") > 0, "outside_window").otherwise("never_recorded")
    covered = F.greatest(times.micros_between(F.greatest(start, F.col("since")), F.least(end, F.col("until"))) / 3_600_000_000, F.lit(0.0))
    return out.select(
        "instrument_key", "channel", "item", status.alias("status"), "records", "before", "late", "ever", "first_at", "last_at",
        F.col("a.value").alias("first_value"), F.col("b.value").alias("last_value"), (F.col("b.value") - F.col("a.value")).alias("change"), "largest", F.coalesce(covered, F.lit(0.0)).alias("covered_hours"),
    )


def channel_lines(explained: DataFrame) -> DataFrame:
    """One line a channel of an instrument: items, records, and whether anything is there."""
    out = explained.groupBy("instrument_key", "channel").agg(F.count_if(F.col("item") != "").alias("items"), F.sum(F.col("records") + F.col("before")).alias("records"), F.sum("late").alias("late"), F.max("covered_hours").alias("covered_hours"), F.sum("ever").alias("ever"))
    status = F.when(F.col("records") > 0, "present").when(F.col("ever") > 0, "no_coverage").otherwise("never_recorded")
    return out.select("instrument_key", "channel", "items", "records", "late", "covered_hours", status.alias("status"))


def capital(measured: DataFrame, start: Column, end: Column, deltas: tuple[str, ...] = (), bounded: tuple[str, ...] = ()) -> DataFrame:
    """Per instrument and kind in [start, end), of records known by the end: first, last, change, and what may be said of it.

    Columns instrument_key ('' or null is market-wide), kind, unit, occurred_at,
    available_at, amount. ``deltas`` are kinds that are changes already: their sum over the window counts and no
    percent change is given. Units in ``bounded`` are scales without percent change. One reading has
    no change. A kind of several units is not compared.
    """
    rows = measured.where((F.col("occurred_at") >= start) & (F.col("occurred_at") < end) & (F.coalesce("available_at", "occurred_at") <= end) & F.col("amount").isNotNull())
    place = F.struct("occurred_at", "amount")
    out = rows.groupBy(F.coalesce("instrument_key", F.lit("")).alias("instrument_key"), "kind").agg(F.count("*").alias("points"), F.min(place).alias("a"), F.max(place).alias("b"), F.sum("amount").alias("sum"), F.countDistinct(F.coalesce("unit", F.lit(""))).alias("units"), F.min("unit").alias("unit"))
    delta, scale = F.col("kind").isin(*deltas), F.coalesce(F.col("unit").isin(*bounded), F.lit(False))
    note = F.when(F.col("units") > 1, "units_differ").when(F.col("points") < 2, "single_reading").when(delta, "change_over_interval").when(scale, "bounded_unit").when(F.col("a.amount") == 0, "zero_base").otherwise("level")
    compared = note.isin("change_over_interval", "bounded_unit", "zero_base", "level")
    change = F.col("b.amount") - F.col("a.amount")
    return out.select(
        "instrument_key", "kind", F.when(F.col("instrument_key") == "", "market_wide").otherwise("instrument").alias("scope"), "points",
        F.when(compared, F.col("a.amount")).alias("first"), F.when(compared, F.col("b.amount")).alias("last"), F.when(compared, change).alias("absolute_change"),
        F.when(note == "level", change / F.abs("a.amount") * 100).alias("percent_change"), F.when(note == "change_over_interval", F.col("sum")).alias("net"), note.alias("note"),
    )
