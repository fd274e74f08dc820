"""Filters over keys: prefixes and any of several roles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_prefix(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose text begins with ``prefix``, which is no pattern; the filter reaches the scan. Null does not begin with anything."""
    return rows.where(F.col(column).startswith(prefix))


def any_role(rows: DataFrame, roles: Sequence[str], keys: DataFrame) -> DataFrame:
    """Rows that have one of the keys (column key) in any of the columns ``roles``, once for each key, with the roles it has.

    Roles are listed by key, so the join is on equal keys instead of alternatives.
    """
    held = F.filter(F.array(*[F.struct(F.col(r).cast("string").alias("key"), F.lit(r).alias("role")) for r in roles]), lambda x: x["key"].isNotNull())
    names = F.array_distinct(F.transform("_held", lambda x: x["key"]))
    of = F.transform(F.filter("_held", lambda x: x["key"] == F.col("key")), lambda x: x["role"])
    listed = rows.withColumn("_held", held).withColumn("key", F.explode(names)).withColumn("roles", of).drop("_held")
    return listed.join(keys.select(F.col("key").cast("string").alias("key")).distinct(), "key")
