"""Profiles of moves against controls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import inference, moves, profiles
from plumbline.plans.registry_queries import HOUR_MOVES
from plumbline.views import bars, observations, table, with_views

HOURS = 3
SHARES = ("move_share", "control_share", "enrichment", "move_mean", "control_mean", "mean_difference", "relative_difference")
COUNTS = ("moves", "controls", "moves_with", "controls_with", "moves_measured", "controls_measured")


def profile_input(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Three hours before large moves and before control bars; observations by kind and scope."""
    b = bars(spark, d)
    large = moves.candidates(b, 3, 800.0)
    windows = profiles.windows_before(large, inference.control_windows(b, large, 6, 40), HOURS)
    return windows, observations(spark, d).withColumn("kind", F.concat_ws(":", "kind", "scope"))


def move_profile(spark: SparkSession, d: str) -> DataFrame:
    out = profiles.contrast(*profile_input(spark, d), HOURS)
    return out.select("kind", *[F.col(c).cast("long").alias(c) for c in COUNTS], *[F.round(c, 6).alias(c) for c in SHARES], "tested", "drifts", "test", "status")


def move_profile_tests(spark: SparkSession, d: str) -> DataFrame:
    out = profiles.move_profile(*profile_input(spark, d), HOURS)
    return out.select("kind", "presence_p", "presence_q", "magnitude_p", "magnitude_q", "stands_out")


def permutation_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Order totals, finished orders against the others, by priority: values that hardly repeat."""
    o = table(spark, d, "orders")
    return inference.permutation_means(o.select(F.col("o_orderpriority").alias("category"), F.when(F.col("o_orderstatus") == "F", "move").otherwise("control").alias("role"), F.col("o_totalprice").alias("value")))


PROFILE = with_views(
    *HOUR_MOVES, "observations",
    """large AS (SELECT * FROM found WHERE abs(change) >= 800)""",
    """free AS (SELECT instrument_key, open_time FROM bars b WHERE NOT EXISTS (SELECT 1 FROM large f WHERE f.instrument_key = b.instrument_key AND b.open_time BETWEEN f.start_time - INTERVAL 6 HOUR AND f.end_time + INTERVAL 6 HOUR)),
    placed AS (SELECT *, count(*) OVER (PARTITION BY instrument_key) AS n, row_number() OVER (PARTITION BY instrument_key ORDER BY open_time) - 1 AS i FROM free),
    w AS (SELECT DISTINCT 'move' AS role, instrument_key, start_time - INTERVAL 3 HOUR AS s, start_time AS e FROM large
        UNION ALL SELECT 'control', instrument_key, open_time - INTERVAL 3 HOUR, open_time FROM placed WHERE n <= 40 OR i IN (SELECT floor(k * n / 40)::BIGINT FROM range(40) r(k))),
    o AS (SELECT concat_ws(':', kind, scope) AS kind, occurred_at, available_at, amount FROM obs),
    cov AS (SELECT kind, min(occurred_at) - INTERVAL 3 HOUR AS since, max(available_at) AS until FROM o GROUP BY 1),
    vals AS (SELECT role, instrument_key, s, e, kind, avg(amount) AS v FROM w JOIN o ON occurred_at >= s AND occurred_at < e AND available_at <= e GROUP BY ALL),
    kept AS (SELECT DISTINCT role, instrument_key, s, e FROM vals),
    sizes AS (SELECT kind, count(*) FILTER (WHERE role = 'move') AS moves, count(*) FILTER (WHERE role = 'control') AS controls FROM kept JOIN cov ON s >= since AND e <= until GROUP BY 1),
    own AS (SELECT vals.* FROM vals JOIN cov USING (kind) WHERE s >= since AND e <= until),
    counts AS (SELECT kind, count(*) FILTER (WHERE role = 'move') AS moves_with, count(*) FILTER (WHERE role = 'control') AS controls_with, avg(v) FILTER (WHERE role = 'move') AS mm, avg(v) FILTER (WHERE role = 'control') AS cm FROM own GROUP BY 1),
    ranked AS (SELECT kind, v, row_number() OVER (PARTITION BY kind ORDER BY s, v) AS i, count(*) OVER (PARTITION BY kind) AS n FROM own),
    trend AS (SELECT kind, n, abs(avg(v) FILTER (WHERE i > n - n // 3) - avg(v) FILTER (WHERE i <= n // 3)) >= stddev_pop(v) AND stddev_pop(v) > 0 AS drift FROM ranked GROUP BY 1, 2),
    r AS (SELECT kind, coalesce(moves, 0) AS moves, coalesce(controls, 0) AS controls, coalesce(moves_with, 0) AS moves_with, coalesce(controls_with, 0) AS controls_with, least(moves, controls) > 0 AND moves IS NOT NULL AS tested,
        CASE WHEN least(moves_with, controls_with) >= 2 THEN mm END AS mm, CASE WHEN least(moves_with, controls_with) >= 2 THEN cm END AS cm, drift, trend.n FROM (SELECT DISTINCT kind FROM vals) LEFT JOIN sizes USING (kind) LEFT JOIN counts USING (kind) LEFT JOIN trend USING (kind))""",
    body="""SELECT kind, moves, controls, moves_with, controls_with, moves_with AS moves_measured, controls_with AS controls_measured, round(moves_with / moves, 6) AS move_share, round(controls_with / controls, 6) AS control_share,
    round(CASE WHEN controls_with > 0 THEN (moves_with / moves) / (controls_with / controls) END, 6) AS enrichment, round(mm, 6) AS move_mean, round(cm, 6) AS control_mean, round(mm - cm, 6) AS mean_difference,
    round(CASE WHEN cm <> 0 THEN (mm - cm) / abs(cm) END, 6) AS relative_difference, tested, mm IS NOT NULL AND n >= 6 AND coalesce(drift, false) AS drifts,
    CASE WHEN NOT tested THEN 'none' WHEN mm IS NOT NULL THEN 'difference_in_measured_mean' ELSE 'presence' END AS test, CASE WHEN NOT tested THEN 'no_comparable_windows' WHEN least(moves, controls) < 8 THEN 'too_few_windows' ELSE 'ok' END AS status FROM r""",
)

QUERIES = {
    "move_profile": (move_profile, PROFILE),
    "move_profile_tests": (move_profile_tests, None),
    "permutation_amounts": (permutation_amounts, None),
}
