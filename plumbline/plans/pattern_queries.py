"""Searches over sparse feature maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import times
from plumbline.operators import patterns, pit, vectors
from plumbline.plans.registry_queries import OBS_PIT, WEEK, boundaries
from plumbline.session import staged
from plumbline.views import bars, observations, table, with_views


def day_vectors(spark: SparkSession, d: str) -> DataFrame:
    made = vectors.feature_vectors(pit.evidence(boundaries(spark, d), observations(spark, d), WEEK))
    return made.select(times.epoch_seconds(F.col("as_of")).cast("long").alias("id"), "vector")


def baskets(spark: SparkSession, d: str) -> DataFrame:
    """Customers by what they bought: quantities by type of part."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("id"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws(" ", "p_brand", "p_type").alias("feature"))
    sums = li.join(o, "l_orderkey").join(p, "l_partkey").groupBy("id", "feature").agg(F.sum("l_quantity").cast("double").alias("w"))
    return sums.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("feature", "w"))).alias("vector"))


def basket_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five customers most like each customer whose key 50 divides."""
    made = staged(baskets(spark, d), "baskets")
    return patterns.top_k(made, made.where("id % 50 = 0"), k=5, least=0.05).select("query_id", "id", "similarity", "rank")


def pattern_topk(spark: SparkSession, d: str) -> DataFrame:
    made = staged(day_vectors(spark, d), "days")
    return patterns.top_k(made, made, k=3).select("query_id", "id", "similarity", "rank")


def day_directions(spark: SparkSession, d: str) -> DataFrame:
    """Which way purchases went on each day."""
    b = bars(spark, d, "day").where("instrument_key = 'purchase'")
    return b.select(times.epoch_seconds(F.col("open_time")).cast("long").alias("id"), F.when(F.col("close") > F.col("open"), "up").otherwise("down").alias("direction"))


def pattern_scores(spark: SparkSession, d: str) -> DataFrame:
    made = staged(day_vectors(spark, d), "days")
    return patterns.pattern_score(patterns.top_k(made, made, k=10), day_directions(spark, d))


def pairs_sql(least: float, k: int, every: int) -> str:
    """All pairs of ``e`` (id, name, v) by their common features."""
    return f"""u AS (SELECT id, name, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS v FROM e WHERE v <> 0),
    s AS (SELECT a.id AS query_id, b.id AS id, round(sum(a.v * b.v), 6) AS similarity FROM u a JOIN u b USING (name) WHERE a.id <> b.id AND a.id % {every} = 0 GROUP BY 1, 2),
    top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id)::INTEGER AS rank FROM s WHERE similarity >= {least} QUALIFY rank <= {k})"""


DAYS = ("observations", OBS_PIT.format(s=WEEK), """k AS (SELECT epoch(as_of)::BIGINT AS id, kind, count(*) AS n, sum(amount) AS t, sum(sign(amount)) AS g FROM found GROUP BY 1, 2),
    e AS (SELECT id, 'kind_' || kind AS name, n::DOUBLE AS v FROM k UNION ALL SELECT id, 'measured_' || kind || '_total', t FROM k UNION ALL SELECT id, 'event_records', sum(n) FROM k GROUP BY 1 UNION ALL SELECT id, 'direction_score', sum(g) FROM k GROUP BY 1)""")  # fmt: skip
BASKETS = """e AS (SELECT o_custkey AS id, p_brand || ' ' || p_type AS name, sum(l_quantity) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""

QUERIES = {
    "basket_topk": (basket_topk, with_views(BASKETS, pairs_sql(0.05, 5, 50), body="SELECT query_id, id, similarity, rank FROM top")),
    "pattern_topk": (pattern_topk, with_views(*DAYS, pairs_sql(0.5, 3, 1), body="SELECT query_id, id, similarity, rank FROM top")),
    "pattern_scores": (pattern_scores, with_views("bars_day", *DAYS, pairs_sql(0.5, 10, 1), "d AS (SELECT epoch(open_time)::BIGINT AS id, CASE WHEN close > open THEN 'up' ELSE 'down' END AS direction FROM bars WHERE instrument_key = 'purchase')",
        body="""SELECT a.id AS query_id, t.id AS matched_id, similarity, CASE WHEN b.direction IS NULL THEN 0 ELSE round(similarity * (CASE WHEN a.direction = b.direction THEN 1 ELSE -0.5 END) * 10, 4) END AS score,
        CASE WHEN t.id IS NULL THEN 'no_match' WHEN b.direction IS NULL THEN 'no_direction' ELSE 'ok' END AS status FROM d a LEFT JOIN (SELECT * FROM top WHERE rank = 1) t ON t.query_id = a.id LEFT JOIN d b ON b.id = t.id""")),
}
