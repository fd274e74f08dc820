"""Frozen indicators, the composite, headline classification, newest rows and tree coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import times
from plumbline.operators import episodes, flows, graph, indicators, moves, pit, series, text, vectors, volatility
from plumbline.plans.registry_queries import HOUR_MOVES, OBS_PIT, WEEK, boundaries
from plumbline.plans.series_queries import anomalies_sql
from plumbline.views import bars, edges, money_flows, observations, table, with_views

NOW = "2024-01-31 00:00:00"
#: Days that bring the payments of 1995 to the month of the events.
SHIFT = 10_592
KINDS = {"click": "insider_trade", "signup": "filing_event", "purchase": "macro_release", "error": "labor_metric", "view": "flight_event"}
SERIES = ("LNS14000000", "JTS00000000JOL", "other")


def evidence_observations(spark: SparkSession, d: str) -> DataFrame:
    """Events as observations of each kind that an indicator reads, with the evidence it reads."""
    e = table(spark, d, "events")
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("event_type")]
    found = F.struct(
        F.floor("value").alias("shares"),
        F.when(F.col("event_id") % 2 == 0, "A").otherwise("D").alias("code"),
        F.concat(F.lit("form"), (F.col("event_id") % 4).cast("string")).alias("form"),
        F.element_at(F.array(*[F.lit(s) for s in SERIES]), (F.col("event_id") % 3 + 1).cast("int")).alias("series_id"),
        F.col("value").alias("value"),
        (F.col("event_id") % 5 == 0).alias("on_ground"),
    )
    source = F.when((F.col("event_type") == "purchase") & (F.col("event_id") % 2 == 0), "treasury-fiscal-data").otherwise("other")
    return e.select(F.concat(F.lit("e"), (F.col("user_id") % 40).cast("string")).alias("entity"), kind.alias("kind"), source.alias("source"), F.col("user_id").alias("actor"), F.col("ts").alias("occurred_at"), F.col("value").alias("amount"), found.alias("evidence"))


EVIDENCE_SQL = (
    "eo AS (SELECT 'e' || (user_id % 40) AS entity, CASE event_type "
    + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KINDS.items())
    + f""" END AS kind, CASE WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN 'treasury-fiscal-data' ELSE 'other' END AS source, user_id AS actor, ts AS t, value AS amount,
    floor(value)::BIGINT AS shares, event_id % 2 = 0 AS buys, list_extract({list(SERIES)}, event_id % 3 + 1) AS sid, event_id % 5 = 0 AS on_ground FROM events)"""
)


def since(name: str) -> str:
    return f"t >= TIMESTAMP '{NOW}' - to_hours({indicators.WINDOWS[name]})"


def signed(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN 'positive' WHEN {x} < 0 THEN 'negative' ELSE 'neutral' END"


INDICATORS_SQL = f"""ind AS (
    SELECT entity, 'insider_net_buy' AS indicator, v AS value, {signed('v')} AS direction FROM (SELECT entity, sum(CASE WHEN buys THEN shares ELSE -shares END)::DOUBLE AS v FROM eo WHERE kind = 'insider_trade' AND {since('insider_net_buy')} GROUP BY 1)
    UNION ALL SELECT entity, 'insider_cluster', greatest(b, s)::DOUBLE, CASE WHEN greatest(b, s) >= 3 THEN CASE WHEN b >= s THEN 'positive' ELSE 'negative' END ELSE 'neutral' END
        FROM (SELECT entity, count(DISTINCT actor) FILTER (WHERE buys) AS b, count(DISTINCT actor) FILTER (WHERE NOT buys) AS s FROM eo WHERE kind = 'insider_trade' AND {since('insider_cluster')} GROUP BY 1)
    UNION ALL SELECT entity, 'filing_event_momentum', count(*)::DOUBLE, 'positive' FROM eo WHERE kind = 'filing_event' AND {since('filing_event_momentum')} GROUP BY 1
    UNION ALL SELECT NULL, 'macro_release_momentum', v, {signed('v')} FROM (SELECT CASE WHEN count(*) >= 2 THEN arg_max(amount, t) - arg_min(amount, t) ELSE 0 END AS v FROM eo WHERE kind = 'macro_release' AND source = 'treasury-fiscal-data' AND {since('macro_release_momentum')})
    UNION ALL SELECT NULL, 'labor_stress', v, {signed('v')} FROM (SELECT coalesce(sum(CASE sid WHEN '{SERIES[0]}' THEN CASE WHEN up THEN 1 ELSE -1 END WHEN '{SERIES[1]}' THEN CASE WHEN up THEN -1 ELSE 1 END ELSE 0 END), 0)::DOUBLE AS v
        FROM (SELECT sid, arg_max(amount, t) > arg_min(amount, t) AS up FROM eo WHERE kind = 'labor_metric' AND {since('labor_stress')} GROUP BY 1 HAVING count(*) >= 2))
    UNION ALL SELECT NULL, 'flight_activity', v, {signed('v')} FROM (SELECT count(*) FILTER (WHERE NOT on_ground)::DOUBLE AS v FROM eo WHERE kind = 'flight_event' AND {since('flight_activity')}))"""


def indicators_frozen(spark: SparkSession, d: str) -> DataFrame:
    return indicators.compute(evidence_observations(spark, d), times.at(NOW)).withColumn("value", F.round("value", 4))


def indicator_evidence(spark: SparkSession, d: str) -> DataFrame:
    return indicators.evidence(indicators.compute(evidence_observations(spark, d), times.at(NOW)))


def severity(value: F.Column) -> F.Column:
    return F.when(value > 400, "critical").when(value > 300, "high").when(value > 200, "moderate").when(value > 50, "low").otherwise("unknown")


def event_indicator(spark: SparkSession, d: str) -> DataFrame:
    """The composite of each event type: its events, the payments attributed to them and the anomalies of its bars."""
    e = table(spark, d, "events").withColumnRenamed("event_type", "instrument_key")
    weighed = e.select("instrument_key", severity(F.col("value")).alias("severity"), (F.col("event_id") % 5 / 4).alias("confidence"))
    large = F.col("amount") * F.when(F.col("amount") > 50_000, 3).otherwise(1)
    paid = money_flows(spark, d).select((F.col("occurred_at") + F.make_dt_interval(F.lit(SHIFT))).alias("occurred_at"), large.alias("amount"))
    found = flows.attribution_totals(e.select("event_id", F.col("ts").alias("at")), paid).join(e.select("event_id", "instrument_key"), "event_id")
    odd = volatility.anomalies(series.returns(series.with_gaps(bars(spark, d)), 1), "percentile").where("breach").select("instrument_key", F.round("measure", 4).alias("score"), "severity")
    made = indicators.composite(weighed, found, odd)
    r = lambda c: F.round(c, 4).alias(c)
    return made.select("instrument_key", "event_count", "flow_count", "anomaly_count", r("event_score"), F.round("flow_score", 2).alias("flow_score"), r("anomaly_score"), r("score"))


EVENT_INDICATOR_SQL = with_views(
    "flows",
    """e AS (SELECT event_type AS k, count(*) AS n, sum(CASE WHEN value > 400 THEN 3 WHEN value > 300 THEN 2 WHEN value > 200 THEN 1 WHEN value > 50 THEN 0.5 ELSE 0.2 END * CASE WHEN event_id % 5 = 0 THEN 0.5 ELSE (event_id % 5) / 4 END)::DOUBLE AS s FROM events GROUP BY 1)""",
    f"""f AS (SELECT event_type AS k, count(*) AS n, sum(amount * CASE WHEN amount > 50000 THEN 3 ELSE 1 END)::DOUBLE AS s FROM events JOIN flows ON occurred_at + to_days({SHIFT}) BETWEEN ts AND ts + INTERVAL 24 HOUR GROUP BY 1)""",
    f"""a AS (SELECT instrument_key AS k, count(*) AS n, sum(measure * CASE severity WHEN 'high' THEN 2 ELSE 0.5 END)::DOUBLE AS s FROM ({anomalies_sql("percentile")}) WHERE breach GROUP BY 1)""",
    body="""SELECT k AS instrument_key, n1 AS event_count, n2 AS flow_count, n3 AS anomaly_count, round(s1, 4) AS event_score, round(s2, 2) AS flow_score, round(s3, 4) AS anomaly_score, round(least(10, (s1 + s2 + s3) / greatest(1, (n1 + n2 + n3) * 2)), 4) AS score
    FROM (SELECT e.k, e.n AS n1, coalesce(f.n, 0) AS n2, coalesce(a.n, 0) AS n3, e.s AS s1, coalesce(f.s, 0) AS s2, coalesce(a.s, 0) AS s3 FROM e LEFT JOIN f USING (k) LEFT JOIN a USING (k))""",
)

#: Terms that the invented prose has, under names of headline categories.
HEADLINES = {"corporate_earnings": ["license", "licensed under"], "macro_rates": ["the", "der"], "market_sentiment": ["and", "und"], "geopolitics": ["les", "la"]}


def headline_matches(spark: SparkSession, d: str) -> DataFrame:
    """Every category and term of every document."""
    made = table(spark, d, "documents").select("doc_id", F.explode(text.classify(F.col("text"), HEADLINES)["matches"]).alias("category", "terms"))
    return made.select("doc_id", "category", F.array_join("terms", ",").alias("terms"))


def headline_family(spark: SparkSession, d: str) -> DataFrame:
    made = table(spark, d, "documents").select("doc_id", text.classify(F.col("text"), HEADLINES)["categories"].alias("c"))
    primary, family = text.primary_family(F.col("c"))
    return made.select("doc_id", primary.alias("category"), family.alias("family"))


def headline_emotion(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", text.headline_emotion(F.col("text")).alias("s")).select("conv_id", "turn", "s.*")


def term_sql(term: str) -> str:
    other = r"[^\p{L}\p{M}\p{N}\p{Pc}]"
    return rf"regexp_matches(text, '(?i)(?:^|{other}){term}(?:$|{other})')"


HEADLINE_SQL = "h AS (SELECT doc_id, unnest([" + ", ".join(f"{{'category': '{c}', 'term': CASE WHEN {term_sql(t)} THEN '{t}' END}}" for c, terms in HEADLINES.items() for t in terms) + "]) AS x FROM documents), m AS (SELECT doc_id, x.category AS category, x.term AS term FROM h WHERE x.term IS NOT NULL)"


def newest_observations(spark: SparkSession, d: str) -> DataFrame:
    """The 50 newest observations of each kind and whether there were more: the limit is the feature."""
    return series.newest(observations(spark, d).select("kind", "event_id", "occurred_at"), ["kind"], ["occurred_at", "event_id"], 50)


def tree_coverage(spark: SparkSession, d: str) -> DataFrame:
    roots = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("key"))
    e = edges(spark, d)
    return graph.coverage(graph.tree(e, roots, 3), e, 3)


def episode_comparison(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d)
    legs = moves.candidates(b, 3, 800.0).select("instrument_key", "start_time", "end_time", "direction")
    o = observations(spark, d).select("event_id", "amount", "occurred_at", "available_at")
    return episodes.comparison(b, legs, o, 6, 25).withColumn("mean_score", F.round("mean_score", 4))


EPISODES_SQL = with_views(
    *HOUR_MOVES, "observations",
    "legs AS (SELECT instrument_key, start_time, end_time, direction FROM found WHERE abs(change) >= 800 AND direction IN ('up', 'down'))",
    """pts AS (SELECT CASE direction WHEN 'up' THEN 'pump' ELSE 'dump' END AS label, instrument_key, start_time FROM legs UNION ALL SELECT 'control', instrument_key, open_time FROM
        (SELECT *, row_number() OVER (PARTITION BY instrument_key ORDER BY open_time) - 1 AS i FROM bars b WHERE NOT EXISTS (SELECT 1 FROM legs f WHERE f.instrument_key = b.instrument_key AND b.open_time BETWEEN f.start_time - INTERVAL 6 HOUR AND f.end_time)) WHERE i % 25 = 0)""",
    """ev AS (SELECT label, p.instrument_key, p.start_time, count(*) FILTER (WHERE available_at < start_time) AS known, sum(sign(amount)) FILTER (WHERE available_at < start_time) AS score FROM pts p JOIN obs ON occurred_at BETWEEN start_time - INTERVAL 6 HOUR AND start_time GROUP BY 1, 2, 3)""",
    body="SELECT label, count(*) AS episodes, count(*) FILTER (WHERE known > 0) AS with_evidence, round(avg(score) FILTER (WHERE known > 0), 4) AS mean_score, coalesce(sum(known), 0)::BIGINT AS records FROM pts LEFT JOIN ev USING (label, instrument_key, start_time) GROUP BY 1",
)


def feature_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of each day's point-in-time evidence, stored once by their hash."""
    made = vectors.feature_vectors(pit.evidence(boundaries(spark, d), observations(spark, d), WEEK))
    return made.groupBy("hash").agg(F.min("as_of").alias("as_of"), F.min(F.size("vector")).cast("long").alias("features"))


FEATURES_SQL = with_views(
    "observations", OBS_PIT.format(s=WEEK), "k AS (SELECT as_of, kind, count(*) AS n, sum(amount) AS t FROM found GROUP BY 1, 2)",
    """e AS (SELECT as_of, 'kind_' || kind AS name, n::DOUBLE AS v FROM k UNION ALL SELECT as_of, 'measured_' || kind || '_total', t FROM k UNION ALL SELECT as_of, 'event_records', count(*) FROM found GROUP BY 1
        UNION ALL SELECT as_of, 'direction_score', sum(sign(amount)) FROM found GROUP BY 1)""",
    """h AS (SELECT as_of, count(*) AS features, substr(sha256(string_agg(name || '=' || round(v * 1e6)::BIGINT, ',' ORDER BY name)), 1, 32) AS hash FROM e GROUP BY 1)""",
    body="SELECT hash, min(as_of) AS as_of, min(features)::BIGINT AS features FROM h GROUP BY 1",
)

QUERIES = {
    "episode_comparison": (episode_comparison, EPISODES_SQL),
    "feature_vectors": (feature_vectors, FEATURES_SQL),
    "indicators_frozen": (indicators_frozen, f"WITH {EVIDENCE_SQL}, {INDICATORS_SQL} SELECT entity, indicator, round(value, 4) AS value, direction FROM ind"),
    "indicator_evidence": (indicator_evidence, f"""WITH {EVIDENCE_SQL}, {INDICATORS_SQL} SELECT 'constructed_indicator' AS source, indicator || '-' || coalesce(entity, 'all') AS external_id, 'decision' AS kind, 'Constructed indicator ' || indicator || ': ' || direction AS description,
        'indicator:' || indicator AS actor, 'indicator_signal' AS action, 'analyst_hypothesis' AS reason_basis, '1' AS amount, 'signal' AS unit, 'estimated' AS basis FROM ind WHERE direction <> 'neutral'"""),
    "event_indicator": (event_indicator, EVENT_INDICATOR_SQL),
    "headline_matches": (headline_matches, f"WITH {HEADLINE_SQL} SELECT doc_id, category, string_agg(term, ',' ORDER BY term) AS terms FROM m GROUP BY 1, 2"),
    "headline_family": (headline_family, f"""WITH {HEADLINE_SQL}, p AS (SELECT doc_id, min(category) AS category, bool_or(category = 'market_sentiment') AS felt FROM m GROUP BY 1)
        SELECT doc_id, coalesce(category, 'uncategorized') AS category, CASE WHEN felt THEN 'sentiment_emotion' ELSE CASE category WHEN 'corporate_earnings' THEN 'corporate_fundamental' WHEN 'macro_rates' THEN 'macro_environment' WHEN 'geopolitics' THEN 'macro_environment' ELSE 'sentiment_emotion' END END AS family FROM documents LEFT JOIN p USING (doc_id)"""),
    "headline_emotion": (headline_emotion, None),
    "newest_observations": (newest_observations, with_views("observations", body="SELECT kind, event_id, occurred_at, n > 50 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY occurred_at DESC, event_id DESC) AS i, count(*) OVER (PARTITION BY kind) AS n FROM obs) WHERE i <= 50")),
    "tree_coverage": (tree_coverage, "WITH " + "n AS (SELECT 'r' || n_regionkey AS root, n_nationkey FROM nation), m AS (SELECT c_nationkey AS n FROM customer UNION ALL SELECT s_nationkey FROM supplier) SELECT 'r' || r_regionkey AS root, 1 + (SELECT count(*) FROM n WHERE root = 'r' || r_regionkey) + (SELECT count(*) FROM n JOIN m ON m.n = n_nationkey WHERE root = 'r' || r_regionkey) AS nodes, 0 AS cycle_edges, 1 AS without_parent FROM region"),
}
