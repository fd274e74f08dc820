"""Category history and what it says of moves and controls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import times
from plumbline.operators import history, inference, moves, profiles, text
from plumbline.plans.registry_queries import CAT, HOUR_MOVES, LEXICON, documents
from plumbline.session import staged
from plumbline.views import bars, with_views


def found(spark: SparkSession, d: str) -> DataFrame:
    """Categories of documents, dealt to the first twenty days by id; a category is of its language."""
    at = times.at("2024-01-03 00:00:00") + F.make_dt_interval((F.col("doc_id") % 20).cast("int"), (F.col("doc_id") % 24).cast("int"))
    rows = documents(spark, d).select("doc_id", at.alias("at"), "lang", F.explode(text.categories(F.col("text"), LEXICON)).alias("c"))
    return rows.select("doc_id", "at", F.concat_ws(":", "lang", "c").alias("category"))


def held(spark: SparkSession, d: str) -> DataFrame:
    """The history of two thirds of the documents, brought up to date by the rest."""
    rows = staged(found(spark, d), "found")
    return staged(history.merged(history.history(rows.where("doc_id % 3 <> 0")), history.history(rows.where("doc_id % 3 = 0"))), "history")


def category_history(spark: SparkSession, d: str) -> DataFrame:
    return held(spark, d)


def attributed(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d)
    large = moves.candidates(b, 3, 800.0)
    return staged(history.attribute(profiles.windows_before(large, inference.control_windows(b, large, 6, 40), 24), held(spark, d)), "attributed")


def headline_attribution(spark: SparkSession, d: str) -> DataFrame:
    return attributed(spark, d).select("role", "instrument_key", "start_time", "status", F.array_join("categories", ",").alias("categories"))


def headline_profile(spark: SparkSession, d: str) -> DataFrame:
    out = history.presence(attributed(spark, d))
    return out.select("category", "moves", "controls", "move_hits", "control_hits", *[F.round(c, 4).alias(c) for c in ("move_share", "control_share", "enrichment")])


def history_scan(spark: SparkSession, d: str) -> DataFrame:
    return history.scan(held(spark, d), times.at("2024-01-17 00:00:00"))


FOUND = "f AS (SELECT TIMESTAMP '2024-01-03' + to_days((doc_id % 20)::INTEGER) + to_hours((doc_id % 24)::INTEGER) AS t, concat_ws(':', lang, c) AS category FROM (SELECT doc_id, lang, unnest([" + ", ".join(f"CASE WHEN regexp_matches(text, '{CAT[k]}') THEN '{k}' END" for k in sorted(CAT)) + "]) AS c FROM documents) WHERE c IS NOT NULL AND doc_id IS NOT NULL)"
HELD = (FOUND, "held AS (SELECT date_trunc('day', t)::TIMESTAMP AS day, category, count(*) AS n, min(t) AS first_at, max(t) AS last_at FROM f GROUP BY 1, 2)")
WINDOWS = (*HOUR_MOVES, *HELD, """large AS (SELECT * FROM found WHERE abs(change) >= 800),
    free AS (SELECT instrument_key, open_time FROM bars b WHERE NOT EXISTS (SELECT 1 FROM large f WHERE f.instrument_key = b.instrument_key AND b.open_time BETWEEN f.start_time - INTERVAL 6 HOUR AND f.end_time + INTERVAL 6 HOUR)),
    placed AS (SELECT *, count(*) OVER (PARTITION BY instrument_key) AS n, row_number() OVER (PARTITION BY instrument_key ORDER BY open_time) - 1 AS i FROM free),
    w AS (SELECT DISTINCT 'move' AS role, instrument_key, start_time - INTERVAL 24 HOUR AS s, start_time AS e FROM large UNION ALL SELECT 'control', instrument_key, open_time - INTERVAL 24 HOUR, open_time FROM placed WHERE n <= 40 OR i IN (SELECT floor(k * n / 40)::BIGINT FROM range(40) r(k))),
    own AS (SELECT role, instrument_key, s, e, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM w JOIN held ON day >= s AND day < e GROUP BY 1, 2, 3, 4),
    att AS (SELECT w.*, coalesce(categories, '') AS categories, CASE WHEN NOT (w.e > (SELECT min(day) FROM held) AND w.s <= (SELECT max(day) FROM held)) THEN 'unavailable' WHEN categories IS NULL THEN 'no_articles' ELSE 'attributed' END AS status FROM w LEFT JOIN own USING (role, instrument_key, s, e))""")  # fmt: skip

QUERIES = {
    "category_history": (category_history, with_views(*HELD, body="SELECT * FROM held")),
    "headline_attribution": (headline_attribution, with_views(*WINDOWS, body="SELECT role, instrument_key, s AS start_time, status, categories FROM att")),
    "headline_profile": (headline_profile, with_views(*WINDOWS, """n AS (SELECT count(*) FILTER (WHERE role = 'move') AS moves, count(*) FILTER (WHERE role = 'control') AS controls FROM att WHERE status <> 'unavailable'),
        h AS (SELECT category, count(*) FILTER (WHERE role = 'move') AS move_hits, count(*) FILTER (WHERE role = 'control') AS control_hits FROM (SELECT role, unnest(string_split(categories, ',')) AS category FROM att WHERE status = 'attributed') GROUP BY 1)""",
        body="SELECT category, moves, controls, move_hits, control_hits, round(move_hits / moves, 4) AS move_share, round(control_hits / controls, 4) AS control_share, round(CASE WHEN control_hits > 0 THEN (move_hits / moves) / (control_hits / controls) END, 4) AS enrichment FROM h, n")),
    "history_scan": (history_scan, with_views(*HELD, "g AS (SELECT category, coalesce(sum(n) FILTER (WHERE day >= '2024-01-17'), 0)::BIGINT AS now, coalesce(sum(n) FILTER (WHERE day < '2024-01-17'), 0)::BIGINT AS before, count(*) FILTER (WHERE day >= '2024-01-17') AS days_now, count(*) FILTER (WHERE day < '2024-01-17') AS days_before FROM held GROUP BY 1)",
        body="SELECT *, CASE WHEN before = 0 THEN 'new' WHEN now = 0 THEN 'absent' WHEN now * days_before > before * days_now THEN 'more' WHEN now * days_before < before * days_now THEN 'rarer' ELSE 'same' END AS place FROM g")),
}
