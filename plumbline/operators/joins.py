"""Range and as-of joins with an equality key, so that they shuffle instead of comparing all pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import times
from plumbline.session import staged


#: Buckets that one interval may meet; wider ones want a larger bucket.
BUCKETS = 100_000


def within(left: DataFrame, right: DataFrame, start: str, end: str, instant: str, bucket_seconds: int, keys: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """Rows of ``right`` whose ``instant`` lies in [start, end] of a row of ``left``.

    Left rows are listed under each time bucket their interval meets, right rows
    under their own; the join is on keys and bucket, the bounds are a residual.
    Columns of both sides must differ but for ``keys``. ``how`` is inner or
    left_semi (rows of ``right`` that lie in some interval). An interval of more than
    ``BUCKETS`` buckets is an error: its bucket is too small.
    """
    bucket = lambda ts: F.floor(times.epoch_seconds(ts) / bucket_seconds)
    first, last = bucket(F.col(start)), bucket(F.col(end))
    refused = F.raise_error(F.lit(f"an interval meets more than {BUCKETS} buckets")).cast("array<bigint>")
    lhs = left.withColumn("_bucket", F.explode(F.when(last - first < BUCKETS, F.sequence(first, last)).when(first.isNotNull() & last.isNotNull(), refused)))
    rhs = right.withColumn("_bucket", bucket(F.col(instant)))
    inside = F.col(instant).between(F.col(start), F.col(end))
    if how == "left_semi":
        names = [*keys, "_bucket"]
        l_, r_ = lhs.select(*[F.col(c).alias(f"_l{c}") for c in names], start, end), rhs
        on = inside
        for c in names:
            on = (F.col(f"_l{c}") == F.col(c)) & on
        return r_.join(l_, on, "left_semi").drop("_bucket")
    return lhs.join(rhs, [*keys, "_bucket"]).where(inside).drop("_bucket")


#: Rows of one key that meet one copy of its known row, about.
SHARE = 100_000


def marked(rows: DataFrame, known: DataFrame, key: str, name: str) -> DataFrame:
    """Adds ``name``: true for rows whose ``key`` is a ``key`` of ``known``, else null; both are columns of that name.

    Blank and null keys are not looked up. A key of more than ``SHARE`` rows is dealt to as
    many shares as it fills, with a copy of its known row for each, so no task
    gets all rows of a frequent key. What is known only lists keys that rows ask for.
    """
    asked = F.when(F.trim(key) != "", F.col(key))
    many = rows.select(asked.alias("_key")).where("_key IS NOT NULL").groupBy("_key").agg(F.floor(F.count("*") / SHARE).cast("int").alias("_more"))
    held = staged(many.join(known.select(F.col(key).alias("_key")).distinct(), "_key"), "known")
    # a frequent key fills a share, so there are rows / SHARE of them at most
    often = F.broadcast(held.where("_more > 0").withColumnRenamed("_more", "_most"))
    dealt = held.select("_key", F.explode(F.sequence(F.lit(0), F.col("_more"))).alias("_share"), F.lit(True).alias(name))
    spread = F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("_most") + 1).cast("int"), F.lit(0))
    keyed = rows.withColumn("_key", asked).join(often, "_key", "left").withColumn("_share", spread).drop("_most")
    # rows without a key are spread over all tasks; they match nothing
    alone = F.coalesce("_key", F.concat(F.lit(" "), F.pmod(F.xxhash64(*rows.columns), F.lit(100_003)).cast("string")))
    return keyed.withColumn("_key", alone).join(dealt, ["_key", "_share"], "left").drop("_key", "_share")


def as_of(left: DataFrame, right: DataFrame, at: str, instant: str, value: str, keys: Sequence[str]) -> DataFrame:
    """Adds to each left row the ``value`` and ``instant`` of the latest right row with instant <= at; one sort, no pairs."""
    blank = right.select(*keys, F.col(instant).alias("_t"), F.struct(F.col(instant).alias("t"), F.col(value).alias("v")).alias("_hit"), F.lit(0).alias("_side"))
    rows = left.withColumn("_row", F.struct(*left.columns))
    asked = rows.select(*keys, F.col(at).alias("_t"), F.lit(None).cast(blank.schema["_hit"].dataType).alias("_hit"), F.lit(1).alias("_side"), "_row")
    both = asked.unionByName(blank, allowMissingColumns=True)
    upto = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_hit", F.last("_hit", ignorenulls=True).over(upto)).where("_side = 1")
    return found.select("_row.*", F.col("_hit.t").alias(f"as_of_{instant}"), F.col("_hit.v").alias(f"as_of_{value}"))
