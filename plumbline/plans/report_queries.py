"""Signals, ledgers, link status and window reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import times
from plumbline.operators import moves, pit, series, signals, text
from plumbline.plans.registry_queries import CAT, HOUR_MOVES, LEXICON, documents
from plumbline.plans.series_queries import RETURNS, SPAN
from plumbline.views import bars, edges, entities, money_flows, observations, table, with_views

NOW = "2024-01-15 00:00:00"


def r4(c: str) -> F.Column:
    return F.round(c, 4).alias(c)


def signal_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Four channels pooled: evidence, hourly moves, volume and order of events, over 24, 48 and 72 hours."""
    o = observations(spark, d)
    evidence = o.where("available_at <= TIMESTAMP_NTZ '2024-01-15 00:00:00'").select(F.lit("evidence").alias("channel"), F.col("occurred_at").alias("at"), F.signum("amount").cast("long").alias("sign"))
    b = series.returns(series.with_gaps(bars(spark, d)), 1)
    price = b.where("change IS NOT NULL").select(F.lit("price"), "open_time", F.signum("change").cast("long"))
    volume = b.select(F.lit("volume"), "open_time", F.signum(F.col("volume") - 5).cast("long"))
    return signals.lookback_buckets(evidence.union(price).union(volume), times.at(NOW), (24, 48, 72)).select("hours", "channel", "n", "score", r4("covers_hours"), "direction")


def ledger(spark: SparkSession, d: str) -> DataFrame:
    """Orders as forecasts of their price by rounding; finished ones are settled."""
    o = table(spark, d, "orders")
    f = o.select(F.col("o_orderkey").alias("forecast_id"), F.col("o_orderpriority").alias("asset_class"), F.when(F.col("o_custkey") % 97 == 0, "eur").otherwise("usd").alias("unit"), (F.floor(F.col("o_totalprice") / 1000) * 1000).cast("double").alias("forecast"))
    s = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("forecast_id"), F.col("o_totalprice").alias("actual"))
    return signals.settle(f, s)


LEDGER = """ledger AS (SELECT o_orderkey, o_orderpriority AS asset_class, CASE WHEN o_custkey % 97 = 0 THEN 'eur' ELSE 'usd' END AS unit, o_orderstatus = 'F' AS done, abs(floor(o_totalprice / 1000) * 1000 - o_totalprice) AS error FROM orders)"""


def ledger_scores(spark: SparkSession, d: str) -> DataFrame:
    made = signals.ledger_scores(ledger(spark, d), F.lit(500.0))
    return made.select(F.coalesce("asset_class", F.lit("(all)")).alias("asset_class"), "settled", "pending", "hits", r4("mae"), r4("rate"))


def ledger_pending(spark: SparkSession, d: str) -> DataFrame:
    return ledger(spark, d).where("status = 'pending'").groupBy("asset_class").agg(F.count("*").alias("n"))


def ledger_required(spark: SparkSession, d: str) -> DataFrame:
    required = spark.createDataFrame([("1-URGENT",), ("5-LOW",), ("missing",)], "asset_class string")
    return signals.required_classes(signals.ledger_scores(ledger(spark, d), F.lit(500.0)), required, 100)


def category_by_window(spark: SparkSession, d: str) -> DataFrame:
    """Documents dealt to days by their id: categories by day, joined to that day's bars."""
    day = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'") + F.make_dt_interval((F.col("doc_id") % 30).cast("int"))
    found = documents(spark, d).select(day.alias("open_time"), F.explode(text.categories(F.col("text"), LEXICON)).alias("category"))
    b = bars(spark, d, "day").select("instrument_key", "open_time")
    return b.join(found, "open_time").groupBy("instrument_key", "open_time").agg(F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"), F.count("*").alias("n"))


def episode_precursors(spark: SparkSession, d: str) -> DataFrame:
    """Mean direction score and records before large moves, up against down."""
    points = moves.candidates(bars(spark, d), 3, 300.0)
    o = observations(spark, d).select("event_id", "amount", "occurred_at", "available_at")
    found = pit.nested_horizons(points, o, (24,))
    return points.join(found, ["instrument_key", "start_time"]).groupBy("direction").agg(F.count("*").alias("with_evidence"), F.round(F.avg("score"), 4).alias("mean_score"), F.sum("known").alias("known"))


def strided_controls(spark: SparkSession, d: str) -> DataFrame:
    return signals.strided(bars(spark, d), ["instrument_key"], "open_time", 25).select("instrument_key", "open_time")


def retracted_edges(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    current = e.where("substr(src, 2) % 5 <> 0")
    return signals.retract(e, current).groupBy("rel", "status").agg(F.count("*").alias("n"))


def failure_counters(spark: SparkSession, d: str) -> DataFrame:
    attempts = table(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.lit("parent").alias("rel"), F.struct("o_orderdate", "o_orderkey").alias("at"), (F.col("o_orderstatus") == "F").alias("ok"))
    return signals.failure_counters(attempts).select("src", "failures", F.col("last_failure.o_orderdate").alias("last_failure"))


def linked_edges(spark: SparkSession, d: str) -> DataFrame:
    f = money_flows(spark, d)
    links = f.where("currency = 'R'").select(F.col("dst").alias("source"), F.col("src").alias("entity"))
    every = f.select(F.col("dst").alias("source"), F.col("src").alias("entity")).distinct()
    return signals.linked_status(links, every).groupBy("source").agg(F.count("*").alias("n"))


def category_scan(spark: SparkSession, d: str) -> DataFrame:
    """Categories of the last tenth of all documents, in order of id, against those before, by language."""
    rows = documents(spark, d).where("doc_id IS NOT NULL")
    first = signals.nth(rows, "doc_id", rows.count() * 9 // 10)
    found = rows.select((F.col("doc_id") >= F.lit(first)).alias("now"), "lang", F.explode(text.categories(F.col("text"), LEXICON)).alias("c"))
    return signals.category_places(found.select("now", F.concat_ws(":", "lang", "c").alias("category")))


def spread_report(spark: SparkSession, d: str) -> DataFrame:
    out = signals.spread_report(observations(spark, d), ["kind", "source", "scope"], "occurred_at", "amount")
    return out.select("kind", "source", "scope", "n", *[r4(c) for c in ("first", "last", "least", "greatest", "spread")])


def explained_window(spark: SparkSession, d: str) -> DataFrame:
    """What a week holds, one row a measure: bars, moves, observations, late ones and documented flows."""
    inside = lambda c: (F.col(c) >= times.at(SPAN[0])) & (F.col(c) < times.at(SPAN[1]))
    o = observations(spark, d).where(inside("occurred_at"))
    count = lambda df, name: df.agg(F.lit(name).alias("measure"), F.count("*").alias("n"))
    parts = [
        count(bars(spark, d).where(inside("open_time")), "bars"),
        count(moves.candidates(bars(spark, d), 3, 300.0).where(inside("start_time")), "moves"),
        count(o, "observations"),
        count(o.where(F.col("available_at") > times.at(SPAN[1])), "late"),
        count(money_flows(spark, d).where(inside("occurred_at")), "flows"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def attribution_status(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select((F.col("o_orderkey") % 9 != 0).alias("reachable"), (F.col("o_orderkey") % 4 == 0).alias("truncated"), (F.col("o_custkey") % 3).alias("articles"))
    return signals.attribution_status(o).groupBy("status").agg(F.count("*").alias("n"))


def candidate_names(spark: SparkSession, d: str) -> DataFrame:
    """Entities by first letters of country: counts for a country list."""
    return entities(spark, d).groupBy(F.coalesce("country", F.lit("?")).alias("country")).agg(F.count("*").alias("n"))


QUERIES = {
    "signal_buckets": (signal_buckets, with_views("observations", "bars_hour", "cadence", RETURNS, f"""s AS (SELECT 'evidence' AS channel, occurred_at AS t, sign(amount)::BIGINT AS x FROM obs WHERE available_at <= '{NOW}' UNION ALL SELECT 'price', open_time, sign(change)::BIGINT FROM changes WHERE change IS NOT NULL UNION ALL SELECT 'volume', open_time, sign(volume - 5)::BIGINT FROM changes)""",
        body=f"""SELECT hours, channel, count(*) AS n, sum(x)::BIGINT AS score, round(least(hours, floor(epoch(TIMESTAMP '{NOW}' - min(t))) / 3600), 4) AS covers_hours, CASE WHEN sum(x) > 0 THEN 'up' WHEN sum(x) < 0 THEN 'down' ELSE 'flat' END AS direction
        FROM s, (SELECT unnest([24, 48, 72])::INTEGER AS hours) WHERE t > TIMESTAMP '{NOW}' - to_hours(hours) AND t <= '{NOW}' GROUP BY 1, 2""")),
    "ledger_scores": (ledger_scores, "WITH " + LEDGER + """ SELECT asset_class, settled, pending, hits, round(mae, 4) AS mae, round(CASE WHEN settled > 0 THEN hits / settled END, 4) AS rate FROM (SELECT coalesce(asset_class, '(all)') AS asset_class, count(*) FILTER (WHERE done) AS settled, count(*) FILTER (WHERE NOT done) AS pending,
        count(*) FILTER (WHERE done AND error <= 500) AS hits, CASE WHEN count(DISTINCT unit) FILTER (WHERE done) = 1 THEN avg(error) FILTER (WHERE done) END AS mae FROM ledger GROUP BY GROUPING SETS ((), (asset_class)))"""),
    "ledger_pending": (ledger_pending, "SELECT o_orderpriority AS asset_class, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1"),
    "ledger_required": (ledger_required, "SELECT c AS asset_class, count(o_orderkey) AS settled, count(o_orderkey) >= 100 AS enough FROM (SELECT unnest(['1-URGENT', '5-LOW', 'missing']) AS c) LEFT JOIN orders ON o_orderpriority = c AND o_orderstatus = 'F' GROUP BY 1"),
    "category_by_window": (category_by_window, with_views("bars_day", "x AS (SELECT TIMESTAMP '2024-01-01' + to_days((doc_id % 30)::INTEGER) AS open_time, unnest([" + ", ".join(f"CASE WHEN regexp_matches(text, '{CAT[k]}') THEN '{k}' END" for k in sorted(CAT)) + "]) AS c FROM documents)",
        body="SELECT instrument_key, open_time, string_agg(DISTINCT c, ',' ORDER BY c) AS categories, count(*) AS n FROM bars JOIN x USING (open_time) WHERE c IS NOT NULL GROUP BY 1, 2")),
    "episode_precursors": (episode_precursors, with_views(*HOUR_MOVES, "observations", """p AS (SELECT f.instrument_key, f.start_time, f.direction, count(*) FILTER (WHERE available_at < start_time) AS known, sum(sign(amount)) FILTER (WHERE available_at < start_time) AS score FROM found f JOIN obs ON occurred_at BETWEEN start_time - INTERVAL 24 HOUR AND start_time WHERE abs(change) >= 300 GROUP BY 1, 2, 3)""",
        body="SELECT direction, count(*) AS with_evidence, round(avg(score), 4) AS mean_score, sum(known)::BIGINT AS known FROM p GROUP BY 1")),
    "strided_controls": (strided_controls, with_views("bars_hour", body="SELECT instrument_key, open_time FROM (SELECT *, row_number() OVER (PARTITION BY instrument_key ORDER BY open_time) AS i FROM bars) WHERE (i - 1) % 25 = 0")),
    "retracted_edges": (retracted_edges, with_views("edges", body="SELECT rel, CASE WHEN substr(src, 2)::INT % 5 <> 0 THEN 'active' ELSE 'retracted' END AS status, count(*) AS n FROM edges GROUP BY 1, 2")),
    "failure_counters": (failure_counters, """WITH k AS (SELECT o_custkey, max((o_orderdate, o_orderkey)) AS ok_at FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT 'c' || o_custkey AS src, count(*) AS failures, max(o_orderdate) AS last_failure FROM orders LEFT JOIN k USING (o_custkey) WHERE o_orderstatus <> 'F' AND (ok_at IS NULL OR (o_orderdate, o_orderkey) > ok_at) GROUP BY 1"""),
    "linked_edges": (linked_edges, with_views("flows", body="SELECT dst AS source, count(DISTINCT src) AS n FROM flows WHERE currency = 'R' GROUP BY 1")),
    "category_scan": (category_scan, "WITH placed AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i, count(*) OVER () AS n FROM documents WHERE doc_id IS NOT NULL), cut AS (SELECT doc_id AS first FROM placed WHERE i = n * 9 // 10 + 1), x AS (SELECT doc_id >= first AS now, lang, unnest([" + ", ".join(f"CASE WHEN regexp_matches(text, '{CAT[k]}') THEN '{k}' END" for k in sorted(CAT)) + """]) AS c FROM documents, cut)
        SELECT lang || ':' || c AS category, CASE WHEN bool_and(now) THEN 'new' WHEN bool_or(now) THEN 'both' ELSE 'absent' END AS place FROM x WHERE c IS NOT NULL AND now IS NOT NULL GROUP BY 1"""),
    "spread_report": (spread_report, with_views("observations", body="SELECT kind, source, scope, count(*) AS n, round(arg_min(amount, occurred_at), 4) AS first, round(arg_max(amount, occurred_at), 4) AS last, round(min(amount), 4) AS least, round(max(amount), 4) AS greatest, round(CASE WHEN count(*) > 1 THEN stddev_pop(amount) END, 4) AS spread FROM obs GROUP BY 1, 2, 3")),
    "explained_window": (explained_window, with_views(*HOUR_MOVES, "observations", "flows", f"w AS (SELECT TIMESTAMP '{SPAN[0]}' AS s, TIMESTAMP '{SPAN[1]}' AS e)", body="""SELECT 'bars' AS measure, count(*) AS n FROM bars, w WHERE open_time >= s AND open_time < e UNION ALL SELECT 'moves', count(*) FROM found, w WHERE abs(change) >= 300 AND start_time >= s AND start_time < e
        UNION ALL SELECT 'observations', count(*) FROM obs, w WHERE occurred_at >= s AND occurred_at < e UNION ALL SELECT 'late', count(*) FROM obs, w WHERE occurred_at >= s AND occurred_at < e AND available_at > e UNION ALL SELECT 'flows', count(*) FROM flows, w WHERE occurred_at >= s AND occurred_at < e""")),
    "attribution_status": (attribution_status, "SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'unavailable' WHEN o_custkey % 3 = 0 THEN 'no_articles' WHEN o_orderkey % 4 = 0 THEN 'truncated' ELSE 'attributed' END AS status, count(*) AS n FROM orders GROUP BY 1"),
    "country_list": (candidate_names, with_views("entities", body="SELECT coalesce(country, '?') AS country, count(*) AS n FROM entities GROUP BY 1")),
}
