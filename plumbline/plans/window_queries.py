"""Providers' runs and what a window holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import times
from plumbline.operators import moves, providers, series, timeline
from plumbline.plans.registry_queries import HOUR_MOVES
from plumbline.plans.series_queries import SPAN
from plumbline.sources import observations as imports
from plumbline.views import bars, entities, money_flows, observations, table, with_views

NOW = "2001-09-01 00:00:00"
DELTAS, BOUNDED = ("purchase", "signup"), ("index",)


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Orders as ingest runs of fifty sources and their queries."""
    source = F.col("o_custkey") % 50
    hash_of = lambda c: F.sha2(c.cast("string"), 256)
    return table(spark, d, "orders").select(
        F.concat(F.lit("p"), source.cast("string")).alias("source"),
        F.col("o_orderpriority").alias("query"),
        F.col("o_orderkey").alias("run_id"),
        F.col("o_orderdate").alias("started_at"),
        F.when(F.col("o_orderstatus") == "P", "failed").otherwise("completed").alias("status"),
        F.when(F.col("o_orderkey") % 7 == 0, 0).otherwise(F.col("o_orderkey") % 100).alias("fetched"),
        F.when(source < 5, 0).when(source < 30, 1 + F.col("o_orderkey") % 60).otherwise(F.col("o_orderkey") % 60).alias("stored"),
        ((source % 10 == 3) | (F.col("o_orderkey") % 3 == 0)).alias("truncated"),
        hash_of(F.when(source % 4 == 0, F.year("o_orderdate")).otherwise(source)).alias("request_sha256"),
        F.when((source % 6 > 0) & (F.col("o_orderkey") % 5 == 0), "").otherwise(hash_of(F.col("o_orderkey"))).alias("payload_sha256"),
    )


RUNS = """runs AS (SELECT 'p' || (o_custkey % 50) AS source, o_orderpriority AS query, o_orderkey AS run_id, o_orderdate AS t, o_orderstatus = 'P' AS failed, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_orderkey % 100 END AS f,
    CASE WHEN o_custkey % 50 < 5 THEN 0 WHEN o_custkey % 50 < 30 THEN 1 + o_orderkey % 60 ELSE o_orderkey % 60 END AS s, o_custkey % 50 % 10 = 3 OR o_orderkey % 3 = 0 AS truncated,
    CASE WHEN o_custkey % 50 % 4 = 0 THEN year(o_orderdate) ELSE o_custkey % 50 END AS identity, NOT (o_custkey % 50 % 6 > 0 AND o_orderkey % 5 = 0) AS hashed FROM orders),
    g AS (SELECT source, query, count(*) AS runs, max(t) AS last_run, max(f) AS fetched_peak, arg_max(f, (t, run_id)) AS fetched_last, min(s) AS least, max(s) AS stored_peak, arg_max(s, (t, run_id)) AS stored_last, count(DISTINCT identity) AS identities,
        count(*) FILTER (WHERE hashed) AS hashed, count(*) FILTER (WHERE truncated) AS truncated_runs, count(*) FILTER (WHERE failed) AS failed_runs FROM runs GROUP BY 1, 2),
    r AS (SELECT *, list_filter([CASE WHEN failed_runs > 0 THEN 'recorded_failure' END, CASE WHEN identities > 1 THEN 'request_changed' END, CASE WHEN identities <= 1 AND fetched_last < fetched_peak AND 2 * fetched_last <= fetched_peak THEN 'count_collapse' END,
        CASE WHEN stored_peak > 0 AND least = 0 THEN 'stored_nothing_once' END, CASE WHEN fetched_last > 0 AND stored_last = 0 THEN 'stored_zero_while_fetched' END, CASE WHEN fetched_last = 0 AND fetched_peak > 0 THEN 'returned_nothing' END,
        CASE WHEN stored_peak = 0 THEN 'never_stored' END, CASE WHEN truncated_runs = runs THEN 'always_truncated' END, CASE WHEN hashed < runs THEN 'no_payload_fingerprint' END, CASE WHEN last_run < TIMESTAMP '2001-09-01' - INTERVAL 1440 HOUR THEN 'stale' END], lambda x: x IS NOT NULL) AS flags FROM g)"""  # fmt: skip


def provider_report(spark: SparkSession, d: str) -> DataFrame:
    out = providers.series_report(runs(spark, d), ["source", "query"], times.at(NOW), 1440)
    return out.select("source", "query", "runs", "last_run", "fetched_peak", "fetched_last", "stored_peak", "stored_last", "identities", "truncated_runs", "failed_runs", F.array_join("flags", ",").alias("flags"))


def provider_flag_counts(spark: SparkSession, d: str) -> DataFrame:
    return providers.flag_counts(providers.series_report(runs(spark, d), ["source", "query"], times.at(NOW), 1440))


KINDS = ("click", "error", "purchase", "signup", "view")


def shifted_flows(spark: SparkSession, d: str) -> DataFrame:
    """Money flows dealt to instruments by line and to January by day of month."""
    at = times.at("2024-01-01 00:00:00") + F.make_dt_interval((F.dayofmonth("occurred_at") - 1).cast("int"), (F.col("order_id") % 24).cast("int"))
    return money_flows(spark, d).where("line <= 3").select(F.get(F.array(*[F.lit(k) for k in KINDS]), F.col("line").cast("int")).alias("instrument_key"), "currency", at.alias("occurred_at"), F.col("amount").cast("double").alias("amount"))


def window_events(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d)
    o = observations(spark, d)
    tiers = moves.tiers(moves.candidates(b, 3, 100.0), (100, 200, 400, 800))
    changes = series.returns(series.with_gaps(b), 1)
    return timeline.pooled(
        timeline.channel(changes, "stored_bars", "open_time", value=F.col("close")),
        timeline.channel(tiers, "detected_moves", "end_time", F.col("tier"), value=F.col("change")),
        timeline.channel(o, "stored_observations", "occurred_at", F.col("kind"), "available_at", F.col("amount"), F.when(F.col("scope") == "", "").otherwise(F.col("kind"))),
        timeline.channel(shifted_flows(spark, d), "documented_money_flows", "occurred_at", F.col("currency"), value=F.col("amount")),
    )


def timeline_explained(spark: SparkSession, d: str) -> DataFrame:
    """A week of every instrument and three days before it; headlines are expected and never stored."""
    every = bars(spark, d).select("instrument_key").distinct().select("instrument_key", F.explode(F.array(*[F.lit(c) for c in ("stored_bars", "detected_moves", "stored_observations", "documented_money_flows", "headlines")])).alias("channel"))
    out = timeline.explain(window_events(spark, d), times.at(SPAN[0]), times.at(SPAN[1]), 72, every)
    r = lambda c: F.round(c, 4).alias(c)
    return out.select("instrument_key", "channel", "item", "status", "records", "before", "late", "ever", "first_at", "last_at", r("first_value"), r("last_value"), r("change"), r("largest"), r("covered_hours"))


def timeline_channels(spark: SparkSession, d: str) -> DataFrame:
    every = bars(spark, d).select("instrument_key").distinct().withColumn("channel", F.lit("headlines"))
    out = timeline.channel_lines(timeline.explain(window_events(spark, d), times.at(SPAN[0]), times.at(SPAN[1]), 72, every))
    return out.withColumn("covered_hours", F.round("covered_hours", 4))


def capital_changes(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d)
    unit = F.when(F.col("kind") == "error", "index").when((F.col("kind") == "view") & (F.col("actor") % 2 == 0), "count").otherwise("usd")
    rows = o.select(F.when(F.col("scope") == "", "").otherwise(F.concat_ws(":", "kind", "scope")).alias("instrument_key"), "kind", unit.alias("unit"), "occurred_at", "available_at", "amount")
    out = timeline.capital(rows, times.at(SPAN[0]), times.at(SPAN[1]), DELTAS, BOUNDED)
    r = lambda c: F.round(c, 4).alias(c)
    return out.select("instrument_key", "kind", "scope", "points", r("first"), r("last"), r("absolute_change"), r("percent_change"), r("net"), "note")


KINDS_TAKEN = ("decision", "fund_flow", "macro_release", "holding")


def records(spark: SparkSession, d: str) -> DataFrame:
    """Orders as imported observations of four kinds, some against every rule."""
    k = F.col("o_orderkey")
    kind = F.when(k % 47 == 0, "rumour").otherwise(F.get(F.array(*[F.lit(x) for x in KINDS_TAKEN]), (k % 4).cast("int")))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    iso = lambda h: F.concat(day, F.lit(f"T{h}:00:00Z"))
    routed, decision = kind == "fund_flow", kind == "decision"
    return table(spark, d, "orders").select(
        F.when(k % 53 != 0, F.concat(F.lit("s"), (k % 5).cast("string"))).alias("source"), k.cast("string").alias("external_id"), kind.alias("kind"), iso("08").alias("observed_at"),
        F.when(k % 43 == 0, iso("07")).when(k % 41 == 0, day).otherwise(iso("09")).alias("available_at"), F.when(k % 37 == 0, "http://x").otherwise("https://example.com/x").alias("source_url"),
        F.when(k % 31 == 0, F.repeat(F.lit("x"), 600)).when(routed, F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("actor"), F.when(routed & (k % 3 != 0), "s1").alias("counterparty"),
        F.when(k % 29 == 0, "nobody").when(k % 2 == 0, F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).otherwise("").alias("instrument"), F.when(decision & (k % 5 != 0), "hold").when((kind == "holding") & (k % 7 == 0), "hold").alias("action"),
        F.when(routed & (k % 11 == 0), "because").alias("reason"), F.round("o_totalprice", 2).cast("string").alias("amount"), F.when(k % 23 != 0, "usd").alias("unit"), F.when(k % 19 == 0, "guessed").alias("basis"), F.when(k % 17 == 0, "yesterday").alias("occurred_at"),
    )


def observation_import(spark: SparkSession, d: str) -> DataFrame:
    out = imports.checked(records(spark, d), entities(spark, d), KINDS_TAKEN)
    return out.groupBy(F.coalesce("refused", F.lit("stored")).alias("reason")).agg(F.count("*").alias("n"))


def observation_merge(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot of two thirds of the orders meets a load of three quarters, some changed, older or of another kind."""
    o = table(spark, d, "orders").select(F.lit("s").alias("source"), F.col("o_orderkey").cast("string").alias("external_id"), "o_orderkey", F.col("o_orderpriority").alias("kind"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("available_at"), F.round("o_totalprice", 2).cast("string").alias("amount"))
    k = F.col("o_orderkey")
    new = o.where(k % 4 != 1).withColumns({
        "kind": F.when(k % 13 == 0, "other").otherwise(F.col("kind")), "amount": F.when(k % 5 == 0, "1").otherwise(F.col("amount")), "available_at": F.when(k % 10 == 0, "1990-01-01").otherwise(F.col("available_at")),
    })
    return imports.merged(o.where(k % 3 != 0).drop("o_orderkey"), new.drop("o_orderkey")).groupBy("change").agg(F.count("*").alias("n"), F.count_if(F.col("amount") == "1").alias("ones"))


S, E = (f"TIMESTAMP '{x}'" for x in SPAN)
EXPLAINED = f"""flow AS (SELECT ['click', 'error', 'purchase', 'signup', 'view'][line + 1] AS instrument_key, currency, TIMESTAMP '2024-01-01' + to_days((day(occurred_at) - 1)::INTEGER) + to_hours((order_id % 24)::INTEGER) AS t, amount::DOUBLE AS amount FROM flows WHERE line <= 3),
    pool AS (SELECT instrument_key, 'stored_bars' AS channel, '' AS item, open_time AS t, open_time AS known, close AS value FROM bars
        UNION ALL SELECT instrument_key, 'detected_moves', 'p' || tier, end_time, end_time, change FROM found, (SELECT unnest([100, 200, 400, 800]) AS tier) WHERE abs(change) >= tier
        UNION ALL SELECT CASE WHEN scope = '' THEN '' ELSE kind END, 'stored_observations', kind, occurred_at, available_at, amount FROM obs
        UNION ALL SELECT instrument_key, 'documented_money_flows', currency, t, t, amount FROM flow),
    marked AS (SELECT *, t >= {S} AND t < {E} AS inside, t >= {S} - INTERVAL 72 HOUR AND t < {S} AS prior, known <= {E} AS known_by FROM pool),
    sums AS (SELECT instrument_key, channel, item, count(*) FILTER (WHERE inside AND known_by) AS records, count(*) FILTER (WHERE prior AND known_by) AS before, count(*) FILTER (WHERE (inside OR prior) AND NOT known_by) AS late, count(*) AS ever, min(t) AS since, max(t) AS until,
        min(t) FILTER (WHERE inside AND known_by) AS first_at, max(t) FILTER (WHERE inside AND known_by) AS last_at, arg_min(value, (t, value)) FILTER (WHERE inside AND known_by) AS first_value, arg_max(value, (t, value)) FILTER (WHERE inside AND known_by) AS last_value,
        max(abs(value)) FILTER (WHERE inside AND known_by) AS largest FROM marked GROUP BY 1, 2, 3),
    lines AS (SELECT * FROM sums UNION ALL BY NAME SELECT DISTINCT instrument_key, 'headlines' AS channel, '' AS item, 0 AS records, 0 AS before, 0 AS late, 0 AS ever FROM bars
        UNION ALL BY NAME SELECT instrument_key, channel, '' AS item, 0 AS records, 0 AS before, 0 AS late, 0 AS ever FROM (SELECT DISTINCT instrument_key FROM bars), (SELECT unnest(['detected_moves', 'stored_observations', 'documented_money_flows']) AS channel) WHERE (instrument_key, channel) NOT IN (SELECT (instrument_key, channel) FROM pool)),
    explained AS (SELECT *, coalesce(greatest(epoch_us(least({E}, until)) - epoch_us(greatest({S}, since)), 0) / 3.6e9, 0) AS hours FROM lines)"""  # fmt: skip

QUERIES = {
    "observation_import": (observation_import, """WITH r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 47 = 0 THEN 'rumour' ELSE ['decision', 'fund_flow', 'macro_release', 'holding'][o_orderkey % 4 + 1] END AS kind FROM orders)
        SELECT CASE WHEN k % 53 = 0 THEN 'missing_field' WHEN k % 31 = 0 THEN 'too_long' WHEN kind = 'rumour' THEN 'kind' WHEN k % 29 = 0 THEN 'unknown_instrument' WHEN k % 37 = 0 THEN 'source_url' WHEN k % 17 = 0 THEN 'occurred_at' WHEN k % 43 <> 0 AND k % 41 = 0 THEN 'instant'
        WHEN k % 43 = 0 THEN 'known_before_observed' WHEN k % 23 = 0 THEN 'unit' WHEN k % 19 = 0 THEN 'basis' WHEN kind = 'decision' AND k % 5 = 0 THEN 'decision_without_action' WHEN kind = 'fund_flow' AND k % 3 = 0 THEN 'half_route' WHEN kind = 'fund_flow' AND k % 11 = 0 THEN 'claims_on_route'
        WHEN kind = 'holding' AND k % 7 = 0 THEN 'claim_outside_decision' ELSE 'stored' END AS reason, count(*) AS n FROM r GROUP BY 1"""),
    "observation_merge": (observation_merge, """WITH r AS (SELECT o_orderkey AS k, round(o_totalprice, 2) = 1 AS was_one FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 4 <> 1)
        SELECT CASE WHEN k % 4 = 1 THEN 'kept' WHEN k % 3 = 0 THEN 'inserted' WHEN k % 13 = 0 THEN 'quarantined' WHEN k % 5 <> 0 THEN 'unchanged' WHEN k % 10 = 0 THEN 'stale' ELSE 'updated' END AS change, count(*) AS n,
        count(*) FILTER (WHERE was_one OR (k % 4 <> 1 AND k % 5 = 0 AND (k % 3 = 0 OR (k % 13 <> 0 AND k % 10 <> 0)))) AS ones FROM r GROUP BY 1"""),
    "provider_report": (provider_report, f"WITH {RUNS} SELECT source, query, runs, last_run, fetched_peak, fetched_last, stored_peak, stored_last, identities, truncated_runs, failed_runs, array_to_string(flags, ',') AS flags FROM r"),
    "provider_flag_counts": (provider_flag_counts, f"WITH {RUNS} SELECT flag, count(*) FILTER (WHERE list_contains(flags, flag)) AS series FROM r, (SELECT unnest({list(providers.FLAGS)}) AS flag) GROUP BY 1"),
    "timeline_explained": (timeline_explained, with_views(*HOUR_MOVES, "observations", "flows", EXPLAINED, body="""SELECT instrument_key, channel, item, CASE WHEN records > 0 THEN 'present' WHEN before > 0 THEN 'before_only' WHEN late > 0 THEN 'late_only' WHEN ever > 0 THEN 'outside_window' ELSE 'never_recorded' END AS status,
        records, before, late, ever, first_at, last_at, round(first_value, 4) AS first_value, round(last_value, 4) AS last_value, round(last_value - first_value, 4) AS change, round(largest, 4) AS largest, round(hours, 4) AS covered_hours FROM explained""")),
    "timeline_channels": (timeline_channels, with_views(*HOUR_MOVES, "observations", "flows", EXPLAINED, body="""SELECT instrument_key, channel, count(*) FILTER (WHERE item <> '') AS items, sum(records + before)::BIGINT AS records, sum(late)::BIGINT AS late, round(max(hours), 4) AS covered_hours,
        CASE WHEN sum(records + before) > 0 THEN 'present' WHEN sum(ever) > 0 THEN 'no_coverage' ELSE 'never_recorded' END AS status FROM explained WHERE ever > 0 OR channel = 'headlines' GROUP BY 1, 2""")),
    "capital_changes": (capital_changes, with_views("observations", f"""m AS (SELECT CASE WHEN scope = '' THEN '' ELSE kind || ':' || scope END AS instrument_key, kind, CASE WHEN kind = 'error' THEN 'index' WHEN kind = 'view' AND actor % 2 = 0 THEN 'count' ELSE 'usd' END AS unit, occurred_at AS t, amount FROM obs WHERE occurred_at >= {S} AND occurred_at < {E} AND available_at <= {E}),
        g AS (SELECT instrument_key, kind, count(*) AS points, arg_min(amount, (t, amount)) AS a, arg_max(amount, (t, amount)) AS b, sum(amount) AS total, count(DISTINCT unit) AS units, min(unit) AS unit FROM m GROUP BY 1, 2),
        n AS (SELECT *, CASE WHEN units > 1 THEN 'units_differ' WHEN points < 2 THEN 'single_reading' WHEN kind IN ('purchase', 'signup') THEN 'change_over_interval' WHEN unit = 'index' THEN 'bounded_unit' WHEN a = 0 THEN 'zero_base' ELSE 'level' END AS note FROM g)""",
        body="""SELECT instrument_key, kind, CASE WHEN instrument_key = '' THEN 'market_wide' ELSE 'instrument' END AS scope, points, CASE WHEN note NOT IN ('units_differ', 'single_reading') THEN round(a, 4) END AS first, CASE WHEN note NOT IN ('units_differ', 'single_reading') THEN round(b, 4) END AS last,
        CASE WHEN note NOT IN ('units_differ', 'single_reading') THEN round(b - a, 4) END AS absolute_change, CASE WHEN note = 'level' THEN round((b - a) / abs(a) * 100, 4) END AS percent_change, CASE WHEN note = 'change_over_interval' THEN round(total, 4) END AS net, note FROM n""")),
}
