"""The domain tables as views over the supplied ones, in DataFrames and, for checks, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import times


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str, unit: str = "hour") -> DataFrame:
    """Open, high, low, close and volume of each event type and hour or day; hours without events are holes."""
    floor = {"hour": times.floor_hour, "day": times.floor_day}[unit]
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("instrument_key"), floor(F.col("ts")).alias("open_time"))
        .agg(
            F.min_by("value", "ts").alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", "ts").alias("close"),
            F.count("*").alias("volume"),
        )
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations: known 0 to 47 hours after they happen, in the scope of a user group."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.col("event_type").alias("kind"),
        F.col("user_id").alias("actor"),
        F.when(F.col("user_id") % 4 == 0, "").otherwise(F.concat(F.lit("k"), (F.col("user_id") % 4).cast("string"))).alias("scope"),
        F.concat(F.lit("s"), (F.col("event_id") % 3).cast("string")).alias("source"),
        (F.col("value") - 245).alias("amount"),
        F.col("ts").alias("occurred_at"),
        (F.col("ts") + times.hours((F.col("event_id") % 48).cast("int"))).alias("available_at"),
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nk"), F.col("n_name").alias("country"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("key"), F.lit("company").alias("kind"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nk"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("key"), F.lit("bank").alias("kind"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nk"))
    return c.union(s).join(F.broadcast(nation), "nk").select("key", "kind", "name", "country")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ownership: companies and banks to nations to regions."""
    key = lambda letter, col: F.concat(F.lit(letter), F.col(col))
    parts = [
        table(spark, sf_dir, "customer").select(key("c", "c_custkey").alias("src"), key("n", "c_nationkey").alias("dst")),
        table(spark, sf_dir, "supplier").select(key("s", "s_suppkey").alias("src"), key("n", "s_nationkey").alias("dst")),
        table(spark, sf_dir, "nation").select(key("n", "n_nationkey").alias("src"), key("r", "n_regionkey").alias("dst")),
    ]
    return parts[0].union(parts[1]).union(parts[2]).select("src", F.lit("subsidiary_of").alias("rel"), "dst")


def money_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments of customers to suppliers, one a line item."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    # whole cents, so that no engine's rounding of binary fractions matters
    cents = F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("decimal(16,0)")
    amount = (cents * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(18,2)")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_shipdate", amount.alias("amount"))
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line"),
        F.concat(F.lit("c"), "o_custkey").alias("src"),
        F.concat(F.lit("s"), "l_suppkey").alias("dst"),
        F.col("l_returnflag").alias("currency"),
        "amount",
        F.col("l_shipdate").alias("occurred_at"),
    )


SQL = {
    "bars_hour": """bars AS (SELECT event_type AS instrument_key, date_trunc('hour', ts) AS open_time,
        arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*) AS volume
        FROM events GROUP BY 1, 2)""",
    "bars_day": """bars AS (SELECT event_type AS instrument_key, date_trunc('day', ts)::TIMESTAMP AS open_time,
        arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*) AS volume
        FROM events GROUP BY 1, 2)""",
    "cadence": """steps AS (SELECT *, epoch(open_time)::BIGINT - lag(epoch(open_time)::BIGINT) OVER (PARTITION BY instrument_key ORDER BY open_time) AS step FROM bars),
        cadences AS (SELECT instrument_key, step AS cadence FROM (SELECT instrument_key, step, row_number() OVER (PARTITION BY instrument_key ORDER BY count(*) DESC, step) AS r
            FROM steps WHERE step IS NOT NULL GROUP BY 1, 2) WHERE r = 1),
        series AS (SELECT s.*, c.cadence, sum(CASE WHEN step > 1.5 * cadence THEN 1 ELSE 0 END) OVER (PARTITION BY instrument_key ORDER BY open_time) AS gaps,
            row_number() OVER (PARTITION BY instrument_key ORDER BY open_time) AS n FROM steps s JOIN cadences c USING (instrument_key))""",
    "observations": """obs AS (SELECT event_id, event_type AS kind, user_id AS actor, CASE WHEN user_id % 4 = 0 THEN '' ELSE 'k' || (user_id % 4) END AS scope,
        's' || (event_id % 3) AS source, value - 245 AS amount, ts AS occurred_at, ts + to_hours((event_id % 48)::INTEGER) AS available_at FROM events)""",
    "entities": """entities AS (SELECT 'c' || c_custkey AS key, 'company' AS kind, c_name AS name, n_name AS country FROM customer JOIN nation ON c_nationkey = n_nationkey
        UNION ALL SELECT 's' || s_suppkey, 'bank', s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)""",
    "edges": """edges AS (SELECT 'c' || c_custkey AS src, 'subsidiary_of' AS rel, 'n' || c_nationkey AS dst FROM customer
        UNION ALL SELECT 's' || s_suppkey, 'subsidiary_of', 'n' || s_nationkey FROM supplier
        UNION ALL SELECT 'n' || n_nationkey, 'subsidiary_of', 'r' || n_regionkey FROM nation)""",
    "flows": """flows AS (SELECT l_orderkey AS order_id, l_linenumber AS line, 'c' || o_custkey AS src, 's' || l_suppkey AS dst, l_returnflag AS currency,
        (floor(l_extendedprice * (1 - l_discount) * 100)::DECIMAL(16,0) * 0.01::DECIMAL(3,2))::DECIMAL(18,2) AS amount, l_shipdate AS occurred_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
}


def with_views(*names: str, body: str) -> str:
    return "WITH " + ",\n".join(SQL.get(n, n) for n in names) + "\n" + body
