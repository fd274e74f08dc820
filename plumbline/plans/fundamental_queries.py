"""Financial positions of entities and their alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import fundamentals
from plumbline.views import table

#: k: label, tags, period type.
VOCABULARY = {
    "net_income": ("flows", ("NetIncomeLoss",), "duration"),
    "operating_cash_flow": ("cash_flows", ("NetCashProvidedByUsedInOperatingActivities",), "duration"),
    "revenue": ("flows", ("Revenues",), "duration"),
    "total_assets": ("stocks", ("Assets",), "instant"),
    "total_liabilities": ("stocks", ("Liabilities",), "instant"),
    "total_equity": ("stocks", ("StockholdersEquity",), "instant"),
}
LABELS = ("stocks", "flows", "cash_flows")


def envelopes(spark: SparkSession, d: str) -> DataFrame:
    """Yearly order totals of customers as reported metrics, some of them late, foreign, of another filing or given twice."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("y"), "o_totalprice", "o_orderstatus", "o_orderpriority")
    some = lambda c: F.sum(F.when(c, F.col("o_totalprice")))
    sums = o.groupBy("entity", "y").agg(
        F.sum("o_totalprice").alias("total_assets"), some(F.col("o_orderstatus") == "F").alias("total_liabilities"), some(F.col("o_orderpriority") == "1-URGENT").alias("revenue"),
        some(F.col("o_orderpriority") == "2-HIGH").alias("net_income"), some(F.col("o_orderpriority") == "5-LOW").alias("operating_cash_flow"), some(F.col("o_orderstatus") == "O").alias("total_equity"),
    )
    long = sums.unpivot(["entity", "y"], list(VOCABULARY), "k", "v").where("v IS NOT NULL")
    twice = long.where("k = 'total_assets' AND entity % 19 = 0").withColumn("v", F.col("v") + 1)
    m = long.union(twice)
    e, k = F.col("entity"), F.col("k")
    tag = F.create_map(*[F.lit(x) for name, (_, tags, _) in VOCABULARY.items() for x in (name, tags[0])])[k]
    kind = F.create_map(*[F.lit(x) for name, (_, _, kind) in VOCABULARY.items() for x in (name, kind)])[k]
    year = F.col("y").cast("string")
    filing = F.when((e % 5 == 0) & (k == "total_liabilities"), "2").otherwise("1")
    accession = F.when((e % 17 == 0) & (k == "net_income"), "bad").otherwise(F.concat(F.lpad(e.cast("string"), 10, "0"), F.lit("-"), F.substring(year, 3, 2), F.lit("-"), F.lpad(filing, 6, "0")))
    start = F.when(kind == "duration", F.concat(year, F.when((e % 7 == 0) & (k == "revenue"), "-10-01").otherwise("-01-01"))).when((e % 23 == 0) & (k == "total_assets"), F.concat(year, F.lit("-01-01")))
    seen = F.struct(
        F.lit("sec_fact_v1").alias("schema"), F.lit("us-gaap").alias("taxonomy"), tag.alias("tag"), accession.alias("accession"), F.lit("10-K").alias("form"), F.concat((F.col("y") + 1).cast("string"), F.lit("-02-20")).alias("filed"),
        start.alias("start"), F.concat(year, F.lit("-12-31")).alias("end"), kind.alias("period_type"), F.lit("https://example.com/facts").alias("source_url"), F.lit("2002-01-01T00:00:00Z").alias("retrieved_at"),
        F.lit(False).alias("ambiguous"), F.lit(False).alias("invalid"),
    )
    return m.select(
        "entity", F.concat(year, F.when(e % 29 == 0, "-12-30").otherwise("-12-31")).alias("period"), F.concat(F.lit("s"), (e % 3).cast("string")).alias("source"), "k", F.col("v").alias("value"),
        F.when(e % 11 == 0, "EUR").otherwise("USD").alias("currency"), F.lit("currency").alias("unit"), F.lit(1.0).alias("scale"), F.when(~((e % 13 == 0) & (k == "revenue")), seen).alias("observation"),
    )


def financial_positions(spark: SparkSession, d: str) -> DataFrame:
    out = fundamentals.positions(fundamentals.grouped(envelopes(spark, d), VOCABULARY))
    return out.withColumn("value", F.round("value", 2))


def finmap(spark: SparkSession, d: str) -> DataFrame:
    out = fundamentals.finmap(fundamentals.grouped(envelopes(spark, d), VOCABULARY), LABELS)
    return out.select("entity", "period", "source", "label", "status", *[F.array_join(c, ",").alias(c) for c in ("consistent", "unusable", "errors")])


K = "(SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{label}', '{kind}')" for k, (label, _, kind) in VOCABULARY.items()) + ") t(metric, label, kind))"
FINMAP = f"""o AS (SELECT o_custkey AS entity, year(o_orderdate) AS y, o_totalprice AS v, o_orderstatus AS s, o_orderpriority AS p FROM orders),
    m AS (SELECT entity, y, x.k AS k, x.v AS v FROM (SELECT entity, y, unnest([{{'k': 'total_assets', 'v': sum(v)}}, {{'k': 'total_liabilities', 'v': sum(v) FILTER (WHERE s = 'F')}}, {{'k': 'revenue', 'v': sum(v) FILTER (WHERE p = '1-URGENT')}},
        {{'k': 'net_income', 'v': sum(v) FILTER (WHERE p = '2-HIGH')}}, {{'k': 'operating_cash_flow', 'v': sum(v) FILTER (WHERE p = '5-LOW')}}, {{'k': 'total_equity', 'v': sum(v) FILTER (WHERE s = 'O')}}]) AS x FROM o GROUP BY 1, 2) WHERE x.v IS NOT NULL),
    g AS (SELECT DISTINCT entity, y, y || CASE WHEN entity % 29 = 0 THEN '-12-30' ELSE '-12-31' END AS period, 's' || (entity % 3) AS source FROM m),
    every AS (SELECT g.*, k.* FROM g CROSS JOIN {K} k),
    full_pos AS (SELECT e.entity, e.y, e.period, e.source, e.metric, e.label, e.kind, m.v, CASE WHEN m.v IS NULL THEN 'missing' WHEN e.metric = 'total_assets' AND e.entity % 19 = 0 THEN 'conflicting' WHEN e.entity % 11 = 0 THEN 'currency_unit_scale' WHEN e.metric = 'revenue' AND e.entity % 13 = 0 THEN 'no_observation'
        WHEN e.metric = 'net_income' AND e.entity % 17 = 0 THEN 'accession' WHEN e.entity % 29 = 0 THEN 'period_is_not_end' WHEN e.metric = 'total_assets' AND e.entity % 23 = 0 THEN 'instant_with_start' END AS reason,
        CASE WHEN e.entity % 5 = 0 AND e.metric = 'total_liabilities' THEN 2 ELSE 1 END AS filing, CASE WHEN e.entity % 7 = 0 AND e.metric = 'revenue' THEN 10 ELSE 1 END AS start FROM every e LEFT JOIN m ON m.entity = e.entity AND m.y = e.y AND m.k = e.metric)"""  # fmt: skip

QUERIES = {
    "financial_positions": (financial_positions, f"WITH {FINMAP} SELECT entity, period, source, metric, label, CASE WHEN reason IS NULL THEN round(v, 2) END AS value, CASE WHEN reason IS NULL THEN 'ok' ELSE 'unknown' END AS status, reason FROM full_pos"),
    "finmap": (finmap, f"""WITH {FINMAP}, u AS (SELECT * FROM full_pos WHERE reason IS NULL),
        sets AS (SELECT c.entity, c.y, c.label, c.metric, list(x.metric ORDER BY x.metric) AS names, any_value(c.filing) AS filing, any_value(c.start) AS start FROM u c JOIN u x ON c.entity = x.entity AND c.y = x.y AND c.label = x.label AND c.filing = x.filing AND (c.kind = 'instant' OR c.start = x.start) GROUP BY 1, 2, 3, 4),
        best AS (SELECT entity, y, label, arg_min(names, (-len(names), names)) AS names, arg_min(filing, (-len(names), names)) AS filing FROM sets GROUP BY 1, 2, 3)
        SELECT p.entity, period, source, p.label, CASE WHEN count(*) FILTER (WHERE reason IS NOT NULL) = 0 AND count(*) FILTER (WHERE reason IS NULL AND NOT list_contains(names, metric)) = 0 THEN 'ok' ELSE 'unknown' END AS status,
        coalesce(array_to_string(any_value(names), ','), '') AS consistent, coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (WHERE reason IS NOT NULL), '') AS unusable,
        coalesce(string_agg(metric || CASE WHEN p.filing <> b.filing THEN ': end_accession_or_form' ELSE ': duration_start' END, ',' ORDER BY metric) FILTER (WHERE reason IS NULL AND NOT list_contains(names, metric)), '') AS errors
        FROM full_pos p LEFT JOIN best b ON p.entity = b.entity AND p.y = b.y AND p.label = b.label GROUP BY 1, 2, 3, 4"""),
}
