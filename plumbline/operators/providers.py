"""What recorded ingest runs say about each source-query series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import times

#: Why a series is flagged, in the order of the report.
FLAGS = ("recorded_failure", "request_changed", "count_collapse", "stored_nothing_once", "stored_zero_while_fetched", "returned_nothing", "never_stored", "always_truncated", "no_payload_fingerprint", "stale")
#: A newest count at or below this share of the peak is a collapse.
COLLAPSE = 0.5


def series_report(runs: DataFrame, keys: list[str], now: Column, stale_hours: float = 168) -> DataFrame:
    """One row a series: extremes of its counts, identities, failures and an array of flags, in one aggregation.

    Columns besides keys: run_id, started_at, status, fetched, stored, truncated,
    request_sha256, payload_sha256. Runs are in order of start and id; null counts
    are 0, an empty or null hash is none. The request is stable if at most one
    identity was recorded; only then does a smaller count say something of the provider.
    A status other than completed, null or empty is a failure. ``stale_hours`` of 0 flags none.
    """
    at = F.struct(F.coalesce("started_at", F.lit("1970-01-01").cast("timestamp_ntz")).alias("t"), "run_id")
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    failed = ~F.coalesce(F.col("status"), F.lit("")).isin("", "completed")
    out = runs.groupBy(*keys).agg(
        F.count("*").alias("runs"),
        F.min("started_at").alias("first_run"),
        F.max("started_at").alias("last_run"),
        F.max(number("fetched")).alias("fetched_peak"),
        F.max_by(number("fetched"), at).alias("fetched_last"),
        F.min(number("stored")).alias("stored_least"),
        F.max(number("stored")).alias("stored_peak"),
        F.max_by(number("stored"), at).alias("stored_last"),
        F.countDistinct(F.when(F.col("request_sha256") != "", F.col("request_sha256"))).alias("identities"),
        F.count_if(F.col("payload_sha256") != "").alias("payload_hashed"),
        F.count_if("truncated").alias("truncated_runs"),
        F.count_if(failed).alias("failed_runs"),
        F.max(F.when(failed, F.col("started_at"))).alias("newest_failure"),
    )
    age = times.micros_between(F.col("last_run"), now) / 3_600_000_000
    stable = F.col("identities") <= 1
    rules = {
        "recorded_failure": F.col("failed_runs") > 0,
        "request_changed": ~stable,
        "count_collapse": stable & (F.col("fetched_last") < F.col("fetched_peak")) & (F.col("fetched_last") <= COLLAPSE * F.col("fetched_peak")),
        "stored_nothing_once": (F.col("stored_peak") > 0) & (F.col("stored_least") == 0),
        "stored_zero_while_fetched": (F.col("fetched_last") > 0) & (F.col("stored_last") == 0),
        "returned_nothing": (F.col("fetched_last") == 0) & (F.col("fetched_peak") > 0),
        "never_stored": F.col("stored_peak") == 0,
        "always_truncated": F.col("truncated_runs") == F.col("runs"),
        "no_payload_fingerprint": F.col("payload_hashed") < F.col("runs"),
        "stale": (F.lit(stale_hours) > 0) & F.coalesce(age > stale_hours, F.lit(False)),
    }
    flags = F.array_compact(F.array(*[F.when(rules[name], F.lit(name)) for name in FLAGS]))
    return out.withColumn("age_hours", age).withColumn("stable", stable).withColumn("flags", flags)


def flag_counts(report: DataFrame) -> DataFrame:
    """How many series raise each flag; every flag has a row."""
    every = report.sparkSession.createDataFrame([(i, f) for i, f in enumerate(FLAGS)], "place int, flag string")
    raised = report.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))
    return every.join(raised, "flag", "left").select("flag", F.coalesce("n", F.lit(0)).alias("series"))
