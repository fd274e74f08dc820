"""Pooled signals, forecast ledgers, links and window reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import times
from plumbline.functions.text import sign_label


def lookback_buckets(signals: DataFrame, now: Column, horizons: Sequence[int]) -> DataFrame:
    """Nested look-backs: for each horizon the signals (channel, at, sign) of its hours, by channel, with the hours that they cover."""
    spread = signals.withColumn("hours", F.explode(F.array(*[F.lit(h) for h in horizons])))
    inside = spread.where((F.col("at") > now - F.make_dt_interval(F.lit(0), F.col("hours"))) & (F.col("at") <= now))
    out = inside.groupBy("hours", "channel").agg(F.count("*").alias("n"), F.sum("sign").alias("score"), F.min("at").alias("first_at"))
    covers = F.least(F.col("hours").cast("double"), times.seconds_between(F.col("first_at"), now) / 3600)
    return out.withColumn("covers_hours", covers).withColumn("direction", sign_label(F.col("score"))).drop("first_at")


def settle(forecasts: DataFrame, settlements: DataFrame) -> DataFrame:
    """Forecasts with their settlement, if there is one: status, error and hits."""
    both = forecasts.join(settlements, "forecast_id", "left")
    error = F.abs(F.col("forecast") - F.col("actual"))
    return both.withColumn("status", F.when(F.col("actual").isNull(), "pending").otherwise("settled")).withColumn("error", error)


def ledger_scores(settled: DataFrame, tolerance: Column) -> DataFrame:
    """Overall (class null) and by class: settled, pending, hits, rate, and the mean error if all have one unit."""
    done = F.col("status") == "settled"
    out = settled.groupingSets([[], ["asset_class"]], "asset_class").agg(
        F.count_if(done).alias("settled"),
        F.count_if(~done).alias("pending"),
        F.count_if(done & (F.col("error") <= tolerance)).alias("hits"),
        F.when(F.countDistinct(F.when(done, F.col("unit"))) == 1, F.avg(F.when(done, F.col("error")))).alias("mae"),
    )
    return out.withColumn("rate", F.when(F.col("settled") > 0, F.col("hits") / F.col("settled")))


def required_classes(scores: DataFrame, required: DataFrame, least: int) -> DataFrame:
    """Each required class with whether enough of it is settled; classes without forecasts count as none."""
    own = scores.where("asset_class IS NOT NULL").select("asset_class", "settled")
    return required.join(own, "asset_class", "left").select("asset_class", F.coalesce("settled", F.lit(0)).alias("settled"), (F.coalesce("settled", F.lit(0)) >= least).alias("enough"))


def retract(edges: DataFrame, current: DataFrame) -> DataFrame:
    """Edges with status: active if the current snapshot has them, else retracted."""
    seen = current.select("src", "rel", "dst", F.lit(True).alias("_seen")).distinct()
    return edges.join(seen, ["src", "rel", "dst"], "left").withColumn("status", F.when(F.col("_seen"), "active").otherwise("retracted")).drop("_seen")


def failure_counters(attempts: DataFrame) -> DataFrame:
    """Failures of each edge since its last success; edges whose last attempt succeeded are cleared. Columns src, rel, at, ok."""
    last_ok = attempts.where("ok").groupBy("src", "rel").agg(F.max("at").alias("ok_at"))
    failed = attempts.where("NOT ok").join(last_ok, ["src", "rel"], "left").where("ok_at IS NULL OR at > ok_at")
    return failed.groupBy("src", "rel").agg(F.count("*").alias("failures"), F.max("at").alias("last_failure"))


def linked_status(links: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (source, entity) stay while a link of that source to the entity remains."""
    return edges.join(links.select("source", "entity").distinct(), ["source", "entity"], "left_semi")


def nth(rows: DataFrame, column: str, place: int) -> int | None:
    """The value of an integer column at a place, from 0, in order; counts of 1,024 ranges a pass, so no sort."""
    known = rows.where(F.col(column).isNotNull()).select(F.col(column).cast("long").alias("v"))
    low, high = known.agg(F.min("v"), F.max("v")).first()
    while low is not None and low < high:
        width = (high - low) // 1024 + 1
        held = known.where(F.col("v").between(low, high)).groupBy(F.expr(f"(v - {low}L) DIV {width}L").alias("r")).count().orderBy("r").collect()
        for r, n in held:
            if place < n:
                low, high = low + r * width, min(high, low + (r + 1) * width - 1)
                break
            place -= n
        else:
            return None
    return low


def category_places(rows: DataFrame) -> DataFrame:
    """Categories now, in history, or both, of all rows at once. Columns now (boolean) and category."""
    seen = rows.groupBy("category").agg(F.max("now").alias("now"), F.max(~F.col("now")).alias("before"))
    return seen.select("category", F.when(~F.col("before"), "new").when(~F.col("now"), "absent").otherwise("both").alias("place"))


def strided(rows: DataFrame, keys: Sequence[str], order: str, stride: int) -> DataFrame:
    """Every stride-th row of each key, the first included."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("_i", place).where((F.col("_i") - 1) % stride == 0).drop("_i")


def spread_report(series: DataFrame, keys: Sequence[str], at: str, value: str) -> DataFrame:
    """First, last, least, greatest and population spread of each series; spread null for one value."""
    return series.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.min_by(value, at).alias("first"),
        F.max_by(value, at).alias("last"),
        F.min(value).alias("least"),
        F.max(value).alias("greatest"),
        F.when(F.count(value) > 1, F.stddev_pop(value)).alias("spread"),
    )


def attribution_status(scans: DataFrame) -> DataFrame:
    """Of windows (reachable, truncated, articles): why a move has causes or none."""
    status = F.when(~F.col("reachable"), "unavailable").when(F.col("articles") == 0, "no_articles").when(F.col("truncated"), "truncated").otherwise("attributed")
    return scans.withColumn("status", status)
