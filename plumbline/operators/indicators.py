"""The six frozen indicators over observations, their projection to evidence, and the composite of events, flows and anomalies.

Observations have entity, kind, source, actor, occurred_at, amount and evidence, a
struct or map with shares, code, form, series_id, value and on_ground. Each
indicator reads the hours before ``now`` and is one aggregation; an entity
without observations in them has no row. Long results are (entity, indicator,
value, direction), entity null for indicators of the whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import times

#: Hours of each indicator's window and the owners that make a cluster.
WINDOWS = {"insider_net_buy": 72, "insider_cluster": 72, "filing_event_momentum": 72, "macro_release_momentum": 168, "labor_stress": 720, "flight_activity": 24}
CLUSTER_OWNERS = 3
#: Series of which a rise is stress, and of which a fall is.
RISE_IS_STRESS, FALL_IS_STRESS = "LNS14000000", "JTS00000000JOL"
#: Weights by severity in the composite.
EVENT_WEIGHT = {"critical": 3.0, "high": 2.0, "moderate": 1.0, "low": 0.5}
ANOMALY_WEIGHT = {"critical": 3.0, "high": 2.0, "moderate": 1.0}


def sign(x: Column, up: str = "positive", down: str = "negative") -> Column:
    return F.when(x > 0, up).when(x < 0, down).otherwise("neutral")


def recent(observations: DataFrame, kind: str, now: Column, hours: int) -> DataFrame:
    return observations.where((F.col("kind") == kind) & (F.col("occurred_at") >= now - times.hours(hours)))


def insider_net_buy(observations: DataFrame, now: Column, hours: int) -> DataFrame:
    """Shares bought less shares disposed of (code D)."""
    shares = F.col("evidence.shares").cast("long")
    net = F.coalesce(F.sum(F.when(F.col("evidence.code") == "D", -shares).otherwise(shares)), F.lit(0)).cast("double")
    return recent(observations, "insider_trade", now, hours).groupBy("entity").agg(net.alias("value")).withColumn("direction", sign(F.col("value")))


def insider_cluster(observations: DataFrame, now: Column, hours: int, least: int = CLUSTER_OWNERS) -> DataFrame:
    """The larger number of distinct owners on one side; neutral below ``least``."""
    owners = lambda code: F.countDistinct(F.when(F.col("evidence.code") == code, F.col("actor")))
    made = recent(observations, "insider_trade", now, hours).groupBy("entity").agg(owners("A").alias("buy"), owners("D").alias("sell"))
    most = F.greatest("buy", "sell")
    side = F.when(F.col("buy") >= F.col("sell"), "positive").otherwise("negative")
    return made.select("entity", most.cast("double").alias("value"), F.when(most >= least, side).otherwise("neutral").alias("direction"))


def filing_event_momentum(observations: DataFrame, now: Column, hours: int) -> DataFrame:
    """Material filings; any is positive."""
    return recent(observations, "filing_event", now, hours).groupBy("entity").agg(F.count("*").cast("double").alias("value")).withColumn("direction", F.lit("positive"))


def macro_release_momentum(observations: DataFrame, now: Column, hours: int, source: str = "treasury-fiscal-data") -> DataFrame:
    """Last less first balance; fewer than two points are neutral with change 0."""
    rows = recent(observations, "macro_release", now, hours).where((F.col("source") == source) & F.col("amount").isNotNull())
    made = rows.agg(F.count("*").alias("n"), F.min_by("amount", "occurred_at").alias("first"), F.max_by("amount", "occurred_at").alias("last"))
    change = F.when(F.col("n") >= 2, F.col("last") - F.col("first")).otherwise(0.0)
    return made.select(F.lit(None).cast("string").alias("entity"), change.cast("double").alias("value")).withColumn("direction", sign(F.col("value")))


def labor_stress(observations: DataFrame, now: Column, hours: int) -> DataFrame:
    """Series that show stress less those that show relief; a series needs two points, and series without a known sense are neutral."""
    rows = recent(observations, "labor_metric", now, hours).where("evidence.series_id <> '' AND evidence.value IS NOT NULL")
    value = F.col("evidence.value").cast("double")
    series = rows.groupBy(F.col("evidence.series_id").alias("series")).agg(F.count("*").alias("n"), F.min_by(value, "occurred_at").alias("first"), F.max_by(value, "occurred_at").alias("last")).where("n >= 2")
    rises = F.col("last") > F.col("first")
    vote = F.when(F.col("series") == RISE_IS_STRESS, F.when(rises, 1).otherwise(-1)).when(F.col("series") == FALL_IS_STRESS, F.when(rises, -1).otherwise(1)).otherwise(0)
    made = series.agg(F.coalesce(F.sum(vote), F.lit(0)).cast("double").alias("value"))
    return made.select(F.lit(None).cast("string").alias("entity"), "value", sign(F.col("value")).alias("direction"))


def flight_activity(observations: DataFrame, now: Column, hours: int) -> DataFrame:
    """Flights in the air; any is positive."""
    made = recent(observations, "flight_event", now, hours).agg(F.count_if(~F.col("evidence.on_ground")).cast("double").alias("value"))
    return made.select(F.lit(None).cast("string").alias("entity"), "value", sign(F.col("value")).alias("direction"))


COMPUTERS: dict[str, Callable[[DataFrame, Column, int], DataFrame]] = {
    "insider_net_buy": insider_net_buy,
    "insider_cluster": insider_cluster,
    "filing_event_momentum": filing_event_momentum,
    "macro_release_momentum": macro_release_momentum,
    "labor_stress": labor_stress,
    "flight_activity": flight_activity,
}


def compute(observations: DataFrame, now: Column) -> DataFrame:
    """All six, (entity, indicator, value, direction)."""
    out = None
    for name, computer in COMPUTERS.items():
        made = computer(observations, now, WINDOWS[name]).select("entity", F.lit(name).alias("indicator"), "value", "direction")
        out = made if out is None else out.unionByName(made)
    return out


def evidence(indicators: DataFrame) -> DataFrame:
    """Observation rows of the indicators that point somewhere."""
    shown = indicators.where("direction <> 'neutral'")
    return shown.select(
        F.lit("constructed_indicator").alias("source"),
        F.concat_ws("-", "indicator", F.coalesce("entity", F.lit("all"))).alias("external_id"),
        F.lit("decision").alias("kind"),
        F.concat(F.lit("Constructed indicator "), "indicator", F.lit(": "), "direction").alias("description"),
        F.concat(F.lit("indicator:"), "indicator").alias("actor"),
        F.lit("indicator_signal").alias("action"),
        F.lit("analyst_hypothesis").alias("reason_basis"),
        F.lit("1").alias("amount"),
        F.lit("signal").alias("unit"),
        F.lit("estimated").alias("basis"),
    )


def weighted(severity: Column, weights: dict[str, float], other: float) -> Column:
    out = F
    for name, w in weights.items():
        out = out.when(severity == name, w)
    return out.otherwise(other)


def composite(events: DataFrame, flows: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Per instrument: mean weight of events, attributed flows and anomalies, halved and clipped at 10, with counts and parts.

    events: instrument_key, severity, confidence; flows: instrument_key, flows,
    amount (totals of attributed flows, large ones already weighted); anomalies:
    instrument_key, score, severity.
    """
    e = events.groupBy("instrument_key").agg(F.count("*").alias("event_count"), F.sum(weighted(F.col("severity"), EVENT_WEIGHT, 0.2) * F.coalesce(F.nullif(F.col("confidence"), F.lit(0.0)), F.lit(0.5))).alias("event_score"))
    f = flows.groupBy("instrument_key").agg(F.sum("flows").alias("flow_count"), F.sum("amount").cast("double").alias("flow_score"))
    a = anomalies.groupBy("instrument_key").agg(F.count("*").alias("anomaly_count"), F.sum(F.col("score") * weighted(F.col("severity"), ANOMALY_WEIGHT, 0.5)).alias("anomaly_score"))
    both = e.join(f, "instrument_key", "full").join(a, "instrument_key", "full").na.fill(0)
    counts, total = F.col("event_count") + F.col("flow_count") + F.col("anomaly_count"), F.col("event_score") + F.col("flow_score") + F.col("anomaly_score")
    return both.withColumn("score", F.least(F.lit(10.0), total / F.greatest(F.lit(1), counts * 2)))
