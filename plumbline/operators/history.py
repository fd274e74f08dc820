"""History of categories by day, kept as mergeable states, and what it says of windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import times
from plumbline.operators.joins import within

KEYS = ("day", "category")


def history(found: DataFrame, at: str = "at") -> DataFrame:
    """States of (at, category) rows: by day and category their number, first and last. Rows without an instant or category are left out."""
    rows = found.where(F.col(at).isNotNull() & F.col("category").isNotNull())
    return rows.groupBy(times.floor_day(F.col(at)).alias("day"), "category").agg(F.count("*").alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))


def merged(held: DataFrame, delta: DataFrame) -> DataFrame:
    """The states of both; a history that took its rows in parts equals one that took them at once."""
    return held.unionByName(delta).groupBy(*KEYS).agg(F.sum("n").alias("n"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))


def attribute(windows: DataFrame, held: DataFrame) -> DataFrame:
    """Windows (role, instrument_key, start_time, end_time) with ``categories``, those of all days that begin inside, and ``status``.

    A window that ends before the first day of the history or begins after the last
    is unavailable, which is not the same as quiet.
    """
    span = held.agg(F.min("day").alias("since"), F.max("day").alias("until")).first()
    keys = ["role", "instrument_key", "start_time", "end_time"]
    found = within(windows.select(*keys).distinct(), held.select("day", "category"), "start_time", "end_time", "day", 7 * 86_400).where("day < end_time")
    own = found.groupBy(*keys).agg(F.array_sort(F.collect_set("category")).alias("categories"))
    out = windows.select(*keys).distinct().join(own, keys, "left")
    reach = F.lit(False) if span.since is None else (F.col("end_time") > F.lit(span.since)) & (F.col("start_time") <= F.lit(span.until))
    status = F.when(~reach, "unavailable").when(F.col("categories").isNull(), "no_articles").otherwise("attributed")
    return out.withColumn("status", status).withColumn("categories", F.coalesce("categories", F.array().cast("array<string>")))


def presence(attributed: DataFrame) -> DataFrame:
    """Per category: windows of either role that the history reaches, those with the category, shares and enrichment.

    The numbers of windows, one of each role, are taken to the driver.
    """
    reached = attributed.where("status <> 'unavailable'")
    n = {r.role: r.n for r in reached.groupBy("role").agg(F.count("*").alias("n")).collect()}
    moves, controls = n.get("move", 0), n.get("control", 0)
    hits = lambda role: F.count_if(F.col("role") == role)
    out = reached.select("role", F.explode("categories").alias("category")).groupBy("category").agg(hits("move").alias("move_hits"), hits("control").alias("control_hits"))
    share = lambda c, total: (F.col(c) / F.lit(total)) if total else F.lit(None).cast("double")
    out = out.withColumns({"moves": F.lit(moves).cast("long"), "controls": F.lit(controls).cast("long"), "move_share": share("move_hits", moves), "control_share": share("control_hits", controls)})
    return out.withColumn("enrichment", F.when(F.col("control_share") > 0, F.col("move_share") / F.col("control_share")))


def scan(held: DataFrame, now: Column) -> DataFrame:
    """Per category: records of the days from ``now`` on and before, and whether it is new, absent, rarer or more frequent by day than it was."""
    current = F.col("day") >= now
    out = held.groupBy("category").agg(
        F.coalesce(F.sum(F.when(current, F.col("n"))), F.lit(0)).alias("now"), F.coalesce(F.sum(F.when(~current, F.col("n"))), F.lit(0)).alias("before"), F.count_if(current).alias("days_now"), F.count_if(~current).alias("days_before"),
    )
    a, b = F.col("now") * F.col("days_before"), F.col("before") * F.col("days_now")
    return out.withColumn("place", F.when(F.col("before") == 0, "new").when(F.col("now") == 0, "absent").when(a > b, "more").when(a < b, "rarer").otherwise("same"))
