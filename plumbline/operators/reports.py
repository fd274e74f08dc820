"""Composite reports: metrics and ratios, providers, retention, indicators, windows and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline import vocabulary as V


def ratios(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Long metrics (keys, k, v) to one row for each ratio: value or the reason it has none."""
    names = sorted({n for _, a, b in V.RATIOS for n in (a, b)})
    wide = metrics.groupBy(*keys).pivot("k", names).agg(F.max("v"))
    rows = [F.struct(F.lit(name).alias("ratio"), F.col(a).alias("num"), F.col(b).alias("den")) for name, a, b in V.RATIOS]
    long = wide.select(*keys, F.explode(F.array(*rows)).alias("r")).select(*keys, "r.*")
    status = F.when(F.col("num").isNull() | F.col("den").isNull(), "missing_metric").when(F.col("den") <= 0, "denominator_not_positive").otherwise("ok")
    return long.select(*keys, "ratio", F.when(status == "ok", F.round(F.col("num") / F.col("den"), 6)).alias("value"), status.alias("status"))


def alignment(metrics: DataFrame, keys: list[str], meta: list[str]) -> DataFrame:
    """Whether all metrics of a key agree in each metadata column."""
    sets = [F.countDistinct(m).alias(f"{m}_values") for m in meta]
    out = metrics.groupBy(*keys).agg(*sets, F.count("*").alias("metrics"))
    agree = F.greatest(*[F.col(f"{m}_values") for m in meta]) if len(meta) > 1 else F.col(f"{meta[0]}_values")
    return out.withColumn("aligned", agree <= 1)


def select_facts(facts: DataFrame, keys: list[str]) -> DataFrame:
    """One fact a key: latest end, then latest filing, then earliest start, then first tag, then greatest value; ambiguous if the tie before the value has several values."""
    tie = Window.partitionBy(*keys).orderBy(F.desc("end"), F.desc("filed"), F.asc("start"), F.asc("priority"))
    ranked = facts.withColumn("_r", F.rank().over(tie)).where("_r = 1")
    return ranked.groupBy(*keys).agg(F.max("v").alias("v"), (F.countDistinct("v") > 1).alias("ambiguous"), F.max("end").alias("end"), F.max("filed").alias("filed"))


def best_alias(rows: DataFrame, key: str, strong: Column, preferred: Column, name: str) -> DataFrame:
    """The best name of each listing: strong aliases first, then the preferred language, then by name."""
    rank = F.struct(F.when(strong, 0).otherwise(1), F.when(preferred, 0).otherwise(1), F.col(name))
    return rows.groupBy(key).agg(F.min_by(name, rank).alias(name), F.count("*").alias("aliases"))


def provider_flags(runs: DataFrame, stale_hours: float) -> DataFrame:
    """Per provider: runs, last status, first and last, totals and flags. Columns source, started_at, status, fetched, stored, skipped, age_hours."""
    out = runs.groupBy("source").agg(
        F.count("*").alias("runs"),
        F.max_by("status", "started_at").alias("last_status"),
        F.min("started_at").alias("first_run"),
        F.max("started_at").alias("last_run"),
        F.sum("fetched").alias("fetched"),
        F.sum("stored").alias("stored"),
        F.sum("skipped").alias("skipped"),
        F.count_if(F.col("status") == "failed").alias("failures"),
        F.min("age_hours").alias("age_hours"),
        F.min("fetched").alias("least"),
        F.max("fetched").alias("most"),
    )
    flags = F.array_compact(
        F.array(
            F.when(F.col("last_status") == "failed", "last_run_failed"),
            F.when(F.col("failures") * 2 > F.col("runs"), "mostly_failing"),
            F.when(F.col("skipped") > F.col("stored"), "mostly_skipped"),
            F.when(F.col("fetched") == 0, "empty"),
            F.when(F.col("age_hours") > stale_hours, "stale"),
            F.when(F.col("runs") == 1, "single_run"),
            F.when(F.col("most") >= 10 * F.greatest(F.col("least"), F.lit(1)), "uneven"),
        )
    )
    return out.withColumn("flags", F.array_join(flags, ",")).drop("least", "most", "age_hours")


def retention(rows: DataFrame, cut: Column, keep: int) -> DataFrame:
    """Per series: rows before the cut that go, what stays, and refusal if fewer than ``keep`` would stay. Columns series, at, until."""
    gone = F.col("at") < cut
    straddle = gone & (F.col("until") >= cut)
    out = rows.groupBy("series").agg(
        F.count("*").alias("n"), F.count_if(gone & ~straddle).alias("removed"), F.count_if(straddle).alias("straddles"), F.count_if(~gone | straddle).alias("stays")
    )
    return out.withColumn("refused", F.when(F.col("stays") < keep, "below_floor"))


def signed_sum_indicator(observations: DataFrame, start: Column, end: Column) -> DataFrame:
    """Per kind: net amount, transactions and direction inside [start, end)."""
    inside = observations.where((F.col("occurred_at") >= start) & (F.col("occurred_at") < end))
    out = inside.groupBy("kind").agg(F.count("*").alias("transactions"), F.sum("amount").alias("net"))
    return out.withColumn("direction", F.when(F.col("net") > 0, "positive").when(F.col("net") < 0, "negative").otherwise("neutral"))


def cluster_indicator(observations: DataFrame, start: Column, end: Column, least: int = 3) -> DataFrame:
    """Per kind: distinct actors on either side and whether one side reaches ``least``."""
    inside = observations.where((F.col("occurred_at") >= start) & (F.col("occurred_at") < end))
    out = inside.groupBy("kind").agg(
        F.countDistinct(F.when(F.col("amount") > 0, F.col("actor"))).alias("buyers"), F.countDistinct(F.when(F.col("amount") < 0, F.col("actor"))).alias("sellers")
    )
    most = F.greatest("buyers", "sellers")
    side = F.when(F.col("buyers") >= F.col("sellers"), "positive").otherwise("negative")
    return out.withColumn("cluster", most >= least).withColumn("direction", F.when(most >= least, side).otherwise("neutral"))


def momentum_indicator(observations: DataFrame, start: Column, end: Column) -> DataFrame:
    """Per kind: first and last value in [start, end), their change and direction; fewer than two points are neutral, no change is neutral."""
    inside = observations.where((F.col("occurred_at") >= start) & (F.col("occurred_at") < end))
    out = inside.groupBy("kind").agg(F.count("*").alias("points"), F.min_by("amount", "occurred_at").alias("first"), F.max_by("amount", "occurred_at").alias("last"))
    change = F.when(F.col("points") >= 2, F.col("last") - F.col("first"))
    return out.withColumn("change", change).withColumn("direction", F.when(F.col("change") > 0, "positive").when(F.col("change") < 0, "negative").otherwise("neutral"))


def window_behaviour(series: DataFrame, start: Column, end: Column) -> DataFrame:
    """Per instrument inside [start, end): return, extremes, volume against the mean and the largest bar move and when. Needs ``change``."""
    inside = series.where((F.col("open_time") >= start) & (F.col("open_time") < end))
    out = inside.groupBy("instrument_key").agg(
        F.count("*").alias("bars"),
        F.min_by("open", "open_time").alias("first_open"),
        F.max_by("close", "open_time").alias("last_close"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.sum("volume").alias("volume"),
        F.max_by(F.struct("change", "open_time"), F.struct(F.coalesce(F.abs("change"), F.lit(-1.0)), "open_time")).alias("top"),
    )
    percent = F.when(F.col("first_open") != 0, (F.col("last_close") - F.col("first_open")) / F.col("first_open") * 100)
    return out.select("instrument_key", "bars", percent.alias("return_percent"), "high", "low", "volume", F.col("top.change").alias("largest_move"), F.col("top.open_time").alias("largest_at"))


def schema_difference(df: DataFrame, declared: dict[str, str]) -> list[str]:
    """Columns missing, unexpected or of another type than declared."""
    have = dict(df.dtypes)
    return sorted(
        [f"missing {c}" for c in declared if c not in have]
        + [f"unexpected {c}" for c in have if c not in declared]
        + [f"type of {c}: {have[c]} instead of {t}" for c, t in declared.items() if c in have and have[c] != t]
    )
