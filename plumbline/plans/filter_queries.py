"""Filters over keys and exact decimal texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import decimals
from plumbline.operators import filters
from plumbline.views import entities, money_flows, table, with_views


def flows_in_any_role(spark: SparkSession, d: str) -> DataFrame:
    """Flows of every entity of the first five countries by name, whichever end it is."""
    first = table(spark, d, "nation").orderBy("n_name").limit(5).select(F.col("n_name").alias("country"))
    keys = entities(spark, d).join(first, "country", "left_semi")
    out = filters.any_role(money_flows(spark, d), ["src", "dst"], keys)
    return out.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.array_contains("roles", "src")).alias("as_source"), F.sum("amount").cast("double").alias("amount"))


def keys_with_prefix(spark: SparkSession, d: str) -> DataFrame:
    return filters.with_prefix(entities(spark, d), "key", "c1").groupBy("country").agg(F.count("*").alias("n"))


def storable_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Prices shifted by powers of a thousand as stored quantities; the smallest would be erased."""
    text = F.concat(F.floor(F.col("l_extendedprice") * 100).cast("string"), F.lit("e-"), (2 + 3 * F.col("l_linenumber")).cast("string"))
    out = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", decimals.storable(text).alias("s"))
    return out.select("l_orderkey", "l_linenumber", F.col("s.text").alias("text"), F.col("s.reason").alias("reason"))


QUERIES = {
    "flows_in_any_role": (flows_in_any_role, with_views("entities", "flows", "k AS (SELECT DISTINCT key FROM entities WHERE country IN (SELECT n_name FROM nation ORDER BY n_name LIMIT 5))",
        body="SELECT key, count(*) AS n, count(*) FILTER (WHERE src = key) AS as_source, sum(amount)::DOUBLE AS amount FROM flows JOIN k ON src = key OR dst = key GROUP BY 1")),
    "keys_with_prefix": (keys_with_prefix, with_views("entities", body="SELECT country, count(*) AS n FROM entities WHERE starts_with(key, 'c1') GROUP BY 1")),
    "storable_amounts": (storable_amounts, """WITH v AS (SELECT l_orderkey, l_linenumber, floor(l_extendedprice * 100)::HUGEINT AS c, 2 + 3 * l_linenumber AS e FROM lineitem),
        p AS (SELECT *, (10::HUGEINT ** greatest(e - 8, 0))::HUGEINT AS cut, (10::HUGEINT ** greatest(8 - e, 0))::HUGEINT AS up FROM v),
        q AS (SELECT *, c * up // cut AS whole, c * up % cut AS rest FROM p), r AS (SELECT *, whole + CASE WHEN 2 * rest > cut OR (2 * rest = cut AND whole % 2 = 1) THEN 1 ELSE 0 END AS w FROM q)
        SELECT l_orderkey, l_linenumber, CASE WHEN w > 0 OR c = 0 THEN (w // 100000000)::VARCHAR || '.' || lpad((w % 100000000)::VARCHAR, 8, '0') END AS text, CASE WHEN w = 0 AND c > 0 THEN 'erased' END AS reason FROM r"""),
}
