"""Series, moves, volatility and forecasts over event bars."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import times
from plumbline.operators import forecasts, moves, pit, reports, series, volatility
from plumbline.views import SQL, bars, observations, with_views

KEYS = ["instrument_key", "open_time"]


def r4(c: str, name: str | None = None) -> F.Column:
    return F.round(c, 4).alias(name or c)


def bars_hourly(spark: SparkSession, d: str) -> DataFrame:
    return bars(spark, d, "hour")


def bars_daily(spark: SparkSession, d: str) -> DataFrame:
    return bars(spark, d, "day")


def series_cadence_gaps(spark: SparkSession, d: str) -> DataFrame:
    return series.with_gaps(bars(spark, d)).groupBy("instrument_key").agg(
        F.count("*").alias("bars"), F.max("cadence").alias("cadence"), F.max("gaps").alias("gaps"), F.max("step").alias("longest_step"), F.min("open_time").alias("first_bar"), F.max("open_time").alias("last_bar")
    )


def bar_returns(spark: SparkSession, d: str) -> DataFrame:
    return series.returns(series.with_gaps(bars(spark, d)), 1).where("change IS NOT NULL").select(*KEYS, r4("change"))


RETURNS = """changes AS (SELECT *, CASE WHEN gaps = lag(gaps) OVER w AND lag(close) OVER w <> 0 THEN (close - lag(close) OVER w) / lag(close) OVER w * 100 END AS change
    FROM series WINDOW w AS (PARTITION BY instrument_key ORDER BY open_time))"""
RETURNS_K = """changes AS (SELECT *, CASE WHEN gaps = lag(gaps, 3) OVER w AND lag(close, 3) OVER w <> 0 THEN (close - lag(close, 3) OVER w) / lag(close, 3) OVER w * 100 END AS change,
    lag(open_time, 3) OVER w AS start_time, lag(close, 3) OVER w AS start_price, max(high) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS hi, min(low) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS lo
    FROM series WINDOW w AS (PARTITION BY instrument_key ORDER BY open_time))"""


def baseline_sql(length: int, bars_: int = 1) -> str:
    return f"""judged AS (SELECT *, count(change) OVER b AS base_n, avg(change) OVER b AS base_mean, stddev_pop(change) OVER b AS base_sd
    FROM changes WINDOW b AS (PARTITION BY instrument_key ORDER BY open_time ROWS BETWEEN {length + bars_ - 1} PRECEDING AND {bars_} PRECEDING))"""


def trailing_zscore(spark: SparkSession, d: str, unit: str = "hour", length: int = 90) -> DataFrame:
    made = series.baseline(series.returns(series.with_gaps(bars(spark, d, unit)), 1), 1, length)
    return made.where("change IS NOT NULL").select(*KEYS, r4("change"), "base_n", r4("z"))


def trailing_zscore_daily(spark: SparkSession, d: str) -> DataFrame:
    return trailing_zscore(spark, d, "day", 20)


def zscore_sql(unit: str, length: int) -> str:
    return with_views(
        f"bars_{unit}", "cadence", RETURNS, baseline_sql(length),
        body="""SELECT instrument_key, open_time, round(change, 4) AS change, base_n, round(CASE WHEN base_n >= 5 AND base_sd > 1e-12 THEN (change - base_mean) / base_sd END, 4) AS z
        FROM judged WHERE change IS NOT NULL""",
    )


def abs_percentile_baseline(spark: SparkSession, d: str) -> DataFrame:
    made = series.returns(series.with_gaps(bars(spark, d)), 1)
    made = made.withColumn("p", series.abs_percentile(F.col("change"), F.collect_list("change").over(series.trailing(50))))
    return made.where("change IS NOT NULL").select(*KEYS, r4("p", "percentile"))


def move_candidates(spark: SparkSession, d: str) -> DataFrame:
    return moves.candidates(bars(spark, d), 3, 100.0).select("instrument_key", "start_time", "end_time", r4("start_price"), r4("end_price"), r4("change"), "direction", r4("range_percent"), "base_n", r4("z"))


CANDIDATES = """found AS (SELECT instrument_key, start_time, open_time AS end_time, start_price, close AS end_price, change, CASE WHEN change > 0 THEN 'up' WHEN change < 0 THEN 'down' ELSE 'flat' END AS direction,
    CASE WHEN lo > 0 THEN (hi - lo) / lo * 100 END AS range_percent, base_n, CASE WHEN base_n >= 5 AND base_sd > 1e-12 THEN (change - base_mean) / base_sd END AS z FROM judged WHERE abs(change) >= 100)"""


def move_tiers(spark: SparkSession, d: str) -> DataFrame:
    found = moves.tiers(moves.candidates(bars(spark, d), 3, 100.0), (100, 200, 400, 800))
    return found.groupBy("instrument_key", "tier", "direction").agg(F.count("*").alias("n"), F.round(F.avg("change"), 4).alias("mean_change"), F.round(series.median("change"), 4).alias("median_change"))


def moves_nonoverlapping(spark: SparkSession, d: str) -> DataFrame:
    return moves.select_largest(moves.candidates(bars(spark, d), 3, 100.0), cooldown_bars=2)


def current_move(spark: SparkSession, d: str) -> DataFrame:
    return moves.current(bars(spark, d), 3, 100.0).select("instrument_key", "as_of", r4("change"), "status")


def move_pre_windows(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d)
    return moves.pre_windows(moves.candidates(b, 3, 100.0), 24, b)


def moves_verified(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d)
    found = moves.candidates(b, 3, 100.0)
    # every seventh stored price was altered, and every eleventh bar is gone
    stored = found.withColumn("start_price", F.when(F.col("end_n") % 7 == 0, F.col("start_price") + 1).otherwise(F.col("start_price")))
    thinner = series.with_gaps(b).where("n % 11 <> 0").select(b.columns)
    return moves.verify(stored, thinner).groupBy("instrument_key", "status").agg(F.count("*").alias("n"))


W = "WINDOW w AS (PARTITION BY instrument_key ORDER BY open_time), r AS (PARTITION BY instrument_key ORDER BY open_time ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), i AS (PARTITION BY instrument_key ORDER BY open_time ROWS BETWEEN 18 PRECEDING AND CURRENT ROW)"
VOLATILITY = f"""logs AS (SELECT *, CASE WHEN open > 0 THEN ln(open) END AS lo, CASE WHEN high > 0 THEN ln(high) END AS lh, CASE WHEN low > 0 THEN ln(low) END AS ll, CASE WHEN close > 0 THEN ln(close) END AS lc FROM series),
    t AS (SELECT *, lc - lag(lc) OVER w AS r, lo - lag(lc) OVER w AS o, lc - lo AS c, power(lh - ll, 2) / (4 * ln(2)) AS pk,
    0.5 * power(lh - ll, 2) - (2 * ln(2) - 1) * power(lc - lo, 2) AS gk, (lh - lc) * (lh - lo) + (ll - lc) * (ll - lo) AS rs,
    greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM logs WINDOW w AS (PARTITION BY instrument_key ORDER BY open_time)),
    e AS (SELECT *, gaps = lag(gaps, 19) OVER w AS whole, bool_and(least(open, high, low, close) > 0) OVER r AS ok, avg(r * r) OVER i AS v1, var_samp(r) OVER i AS v2, avg(pk) OVER r AS v3, avg(gk) OVER i AS v4, avg(rs) OVER i AS v5,
    var_samp(o) OVER i + (0.34 / (1.34 + 20.0 / 18)) * var_samp(c) OVER i + (1 - 0.34 / (1.34 + 20.0 / 18)) * avg(rs) OVER i AS v6 FROM t {W}),
    v AS (SELECT instrument_key, open_time, coalesce(whole, false) AS whole, n, close, CASE WHEN whole AND ok AND v1 > 0 THEN v1 END AS close_to_close, CASE WHEN whole AND ok AND v2 > 0 THEN v2 END AS demeaned,
    CASE WHEN whole AND ok AND v3 > 0 THEN v3 END AS parkinson, CASE WHEN whole AND ok AND v4 > 0 THEN v4 END AS garman_klass, CASE WHEN whole AND ok AND v5 > 0 THEN v5 END AS rogers_satchell, CASE WHEN whole AND ok AND v6 > 0 THEN v6 END AS yang_zhang FROM e)"""
SHOWN = ("close_to_close", "demeaned", "parkinson", "garman_klass", "rogers_satchell", "yang_zhang")


def one_estimator(name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        made = volatility.estimates(series.with_gaps(bars(spark, d)), 20)
        return made.where("whole").select(*KEYS, F.round(name, 6).alias("variance"))

    return query


def estimator_sql(name: str) -> str:
    what = name if name != "lpv" else "list_avg(list_filter([parkinson, garman_klass, rogers_satchell], lambda x: x IS NOT NULL))"
    return with_views("bars_hour", "cadence", VOLATILITY, body=f"SELECT instrument_key, open_time, round({what}, 6) AS variance FROM v WHERE whole")


def vol_atr(spark: SparkSession, d: str) -> DataFrame:
    return volatility.wilder_atr(series.with_gaps(bars(spark, d)), 30).where("atr IS NOT NULL").select(*KEYS, r4("atr"))


ATR_SQL = with_views(
    "bars_hour", "cadence", VOLATILITY,
    """a AS (SELECT instrument_key, open_time, gaps = lag(gaps, 29) OVER (PARTITION BY instrument_key ORDER BY open_time) AS ok,
    array_agg(tr) OVER (PARTITION BY instrument_key ORDER BY open_time ROWS BETWEEN 28 PRECEDING AND CURRENT ROW) AS x FROM t)""",
    body="""SELECT instrument_key, open_time, round(list_reduce(list_concat([list_sum(x[1:14]) / 14], x[15:]), lambda a, b: (a * 13 + b) / 14), 4) AS atr FROM a WHERE ok""",
)


def volatility_latest(spark: SparkSession, d: str) -> DataFrame:
    made = volatility.long_latest(series.with_gaps(bars(spark, d)), 20, 3600)
    return made.select("instrument_key", "open_time", "estimator", F.round("variance", 6).alias("variance"), F.round("annual_percent", 2).alias("annual_percent"), "status")


LATEST_SQL = with_views(
    "bars_hour", "cadence", VOLATILITY,
    """a AS (SELECT instrument_key, open_time, array_agg(tr) OVER (PARTITION BY instrument_key ORDER BY open_time ROWS BETWEEN 18 PRECEDING AND CURRENT ROW) AS x FROM t)""",
    """b AS (SELECT instrument_key, open_time, CASE WHEN len(x) >= 14 THEN list_reduce(list_concat([list_sum(x[1:14]) / 14], x[15:]), lambda a, b: (a * 13 + b) / 14) END AS atr FROM a)""",
    """w AS (SELECT v.*, list_avg(list_filter([parkinson, garman_klass, rogers_satchell], lambda x: x IS NOT NULL)) AS lpv, CASE WHEN whole AND close > 0 AND atr > 0 THEN power(atr / close, 2) END AS natr,
        row_number() OVER (PARTITION BY instrument_key ORDER BY open_time DESC) AS newest FROM v JOIN b USING (instrument_key, open_time))""",
    body="SELECT instrument_key, open_time, e.name AS estimator, round(e.v, 6) AS variance, round(sqrt(e.v * 8760) * 100, 2) AS annual_percent, CASE WHEN n < 20 THEN 'insufficient_bars' WHEN NOT whole THEN 'gap' WHEN e.v IS NULL THEN 'not_computable' ELSE 'ok' END AS status FROM w, unnest(["
    + ", ".join(f"{{'name': '{n}', 'v': {n}}}" for n in volatility.ESTIMATORS)
    + "]) AS u(e) WHERE newest = 1",
)


def drawdown_ulcer(spark: SparkSession, d: str) -> DataFrame:
    return volatility.drawdowns(bars(spark, d)).select(*KEYS, r4("drawdown"), r4("max_drawdown"), r4("ulcer"))


def anomalies(mode: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        made = volatility.anomalies(series.returns(series.with_gaps(bars(spark, d)), 1), mode)
        return made.select(*KEYS, "base_n", r4("measure"), "breach", "severity", "reason")

    return query


def anomalies_sql(mode: str) -> str:
    least, threshold = volatility.MODES[mode]
    measure = {
        "percentile": "CASE WHEN base_n > 0 THEN len(list_filter(h, lambda x: abs(x) <= abs(change))) / base_n * 100 END",
        "z": "CASE WHEN sd > 0 THEN (change - mean) / sd END",
        "absolute": "abs(change)",
    }[mode]
    severity = "CASE WHEN measure >= 99 THEN 'extreme' WHEN measure >= 97.5 THEN 'high' WHEN measure >= 95 THEN 'elevated' END" if mode == "percentile" else "'breach'"
    return with_views(
        "bars_hour", "cadence", RETURNS,
        """h0 AS (SELECT *, count(change) OVER b AS base_n, avg(change) OVER b AS mean, stddev_samp(change) OVER b AS sd, list_filter(array_agg(change) OVER b, lambda x: x IS NOT NULL) AS h
        FROM changes WINDOW b AS (PARTITION BY instrument_key ORDER BY open_time ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING))""",
        f"h1 AS (SELECT *, {measure} AS measure FROM h0 WHERE change IS NOT NULL)",
        f"h2 AS (SELECT *, CASE WHEN base_n >= {least} THEN abs(measure) >= {threshold} END AS breach FROM h1)",
        body=f"""SELECT instrument_key, open_time, base_n, round(measure, 4) AS measure, breach, CASE WHEN breach THEN {severity} END AS severity,
        CASE WHEN base_n < {least} THEN 'short_baseline' WHEN measure IS NULL THEN 'no_variation' END AS reason FROM h2""",
    )


def context_change(spark: SparkSession, d: str) -> DataFrame:
    """First difference of hourly volume, refused across holes."""
    made = series.with_gaps(bars(spark, d))
    diff = F.when(series.unbroken(1), F.col("volume") - F.lag("volume").over(series.order()))
    return made.withColumn("difference", diff).where("difference IS NOT NULL").select(*KEYS, "difference")


def context_zscore(spark: SparkSession, d: str) -> DataFrame:
    """Volume against exactly the 10 bars before it."""
    frame = series.trailing(10)
    n, mean, sd = F.count("volume").over(frame), F.avg("volume").over(frame), F.stddev_samp("volume").over(frame)
    made = series.with_gaps(bars(spark, d)).withColumn("ok", F.coalesce(series.unbroken(10), F.lit(False)) & (n == 10)).withColumn("z", F.when(F.col("ok") & (sd > 0), (F.col("volume") - mean) / sd))
    return made.where("z IS NOT NULL").select(*KEYS, r4("z"))


def context_refusals(spark: SparkSession, d: str) -> DataFrame:
    made = series.with_gaps(bars(spark, d)).withColumn("value", (F.col("close") - F.col("open")) / 1e9).withColumn("ok", series.unbroken(10))
    reason = (
        F.when(F.col("n") <= 10, "short_baseline")
        .when(~F.col("ok"), "hole_in_baseline")
        .when(F.col("value") == 0, "no_variation")
        .when((F.round("value", 8) == 0) & (F.col("value") != 0), "value_not_representable")
        .otherwise("stored")
    )
    return made.groupBy("instrument_key", reason.alias("reason")).agg(F.count("*").alias("n"))


SPAN = ("2024-01-08 00:00:00", "2024-01-15 00:00:00")


def window_behaviour(spark: SparkSession, d: str) -> DataFrame:
    made = series.returns(series.with_gaps(bars(spark, d)), 1)
    out = reports.window_behaviour(made, times.at(SPAN[0]), times.at(SPAN[1]))
    return out.select("instrument_key", "bars", r4("return_percent"), "high", "low", "volume", r4("largest_move"), "largest_at")


def window_change(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d).where((F.col("occurred_at") >= times.at(SPAN[0])) & (F.col("occurred_at") < times.at(SPAN[1])))
    out = o.groupBy("kind").agg(F.count("*").alias("points"), F.min_by("amount", "occurred_at").alias("first"), F.max_by("amount", "occurred_at").alias("last"))
    return out.select("kind", "points", r4("first"), r4("last"), F.when(F.col("points") > 1, F.round(F.col("last") - F.col("first"), 4)).alias("change"))


def market_signals(spark: SparkSession, d: str) -> DataFrame:
    """Mean size of bar moves of the last 24 bars and volume against the 24 bars before them."""
    recent, before = series.last(24), series.order().rowsBetween(-47, -24)
    made = series.returns(series.with_gaps(bars(spark, d)), 1)
    z = F.when(F.stddev_pop("volume").over(before) > 0, (F.avg("volume").over(recent) - F.avg("volume").over(before)) / F.stddev_pop("volume").over(before))
    return made.withColumn("mean_move", F.avg(F.abs("change")).over(recent)).withColumn("z", z).where("n >= 48").select(*KEYS, r4("mean_move"), r4("z", "volume_z"))


def daily_tiles(spark: SparkSession, d: str) -> DataFrame:
    return pit.tiles(bars(spark, d), 24).select("instrument_key", "tile_start", "bars", "first_open", "last_close", "high", "low", r4("mean_volume"))


def zigzag_legs(spark: SparkSession, d: str) -> DataFrame:
    return moves.zigzag(bars(spark, d, "day"), 60.0)


def episode_regime(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d)
    points = moves.candidates(b, 3, 100.0).select("instrument_key", "start_time", "start_price")
    return moves.regimes(b, points, 48, 50.0).select("instrument_key", "start_time", r4("lookback_return"), "regime")


def forecast_methods(spark: SparkSession, d: str) -> DataFrame:
    return forecasts.forecasts(bars(spark, d), 25.0).groupBy("instrument_key", "method").agg(
        F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.count_if("direction_hit").alias("direction_hits"), F.round(F.avg("error"), 4).alias("mae")
    )


FORECASTS = """p AS (SELECT *, lag(close) OVER w AS p1, lag(close, 2) OVER w AS p2, lag(close, 3) OVER w AS p3, gaps = lag(gaps, 3) OVER w AS ok FROM series WINDOW w AS (PARTITION BY instrument_key ORDER BY open_time)),
    f AS (SELECT instrument_key, open_time, close, p1 AS previous, m.method, m.forecast FROM p, unnest([{'method': 'persistence', 'forecast': p1}, {'method': 'linear', 'forecast': 2 * p1 - p2}, {'method': 'mean3', 'forecast': (p1 + p2 + p3) / 3}]) AS u(m) WHERE ok),
    s AS (SELECT *, abs(forecast - close) AS error, CASE WHEN previous <> 0 THEN abs(forecast - close) / abs(previous) * 100 <= 25 ELSE false END AS hit, sign(forecast - previous) = sign(close - previous) AS direction_hit FROM f)"""


def forecast_split_selection(spark: SparkSession, d: str) -> DataFrame:
    return forecasts.select_method(forecasts.split(forecasts.forecasts(bars(spark, d), 25.0), 70)).select("instrument_key", "method", "n", "hits", r4("mae"))


def rollup_scores(spark: SparkSession, d: str) -> DataFrame:
    return forecasts.rollup(forecasts.forecasts(bars(spark, d), 25.0)).select("method", F.coalesce("instrument_key", F.lit("(all)")).alias("instrument_key"), "n", "hits", "direction_hits", r4("mae"))


def endpoint_moves_precursors(spark: SparkSession, d: str) -> DataFrame:
    points = moves.candidates(bars(spark, d), 3, 300.0)
    known = observations(spark, d).select("event_id", "amount", "occurred_at", "available_at")
    return pit.nested_horizons(points, known)


def h(body: str, *more: str) -> str:
    return with_views("bars_hour", "cadence", *more, body=body)


#: The same series without every eleventh bar, with its own cadence and gaps.
THINNED = "thin AS (SELECT * FROM series WHERE n % 11 <> 0), " + re.sub(r"\b(steps|cadences|series)\b", r"thin_\1", SQL["cadence"]).replace("FROM bars", "FROM (SELECT instrument_key, open_time, close FROM thin)")
VERIFIED_SQL = with_views(
    "bars_hour", "cadence", RETURNS_K, baseline_sql(90, 3), CANDIDATES, THINNED,
    """kept AS (SELECT f.instrument_key, f.start_time, f.end_time, CASE WHEN s.n % 7 = 0 THEN f.start_price + 1 ELSE f.start_price END AS start_price, f.end_price FROM found f JOIN series s ON s.instrument_key = f.instrument_key AND s.open_time = f.end_time)""",
    body="""SELECT k.instrument_key, CASE WHEN a.close IS NULL THEN 'start_missing' WHEN b.close IS NULL THEN 'end_missing' WHEN a.gaps <> b.gaps THEN 'gap' WHEN a.close <> k.start_price OR b.close <> k.end_price THEN 'changed' ELSE 'verified' END AS status, count(*) AS n
    FROM kept k LEFT JOIN thin_series a ON a.instrument_key = k.instrument_key AND a.open_time = k.start_time LEFT JOIN thin_series b ON b.instrument_key = k.instrument_key AND b.open_time = k.end_time GROUP BY 1, 2""",
)

QUERIES = {
    "bars_hourly": (bars_hourly, with_views("bars_hour", body="SELECT * FROM bars")),
    "bars_daily": (bars_daily, with_views("bars_day", body="SELECT * FROM bars")),
    "series_cadence_gaps": (series_cadence_gaps, h("SELECT instrument_key, count(*) AS bars, max(cadence) AS cadence, max(gaps)::BIGINT AS gaps, max(step) AS longest_step, min(open_time) AS first_bar, max(open_time) AS last_bar FROM series GROUP BY 1")),
    "bar_returns": (bar_returns, h("SELECT instrument_key, open_time, round(change, 4) AS change FROM changes WHERE change IS NOT NULL", RETURNS)),
    "trailing_zscore": (trailing_zscore, zscore_sql("hour", 90)),
    "trailing_zscore_daily": (trailing_zscore_daily, zscore_sql("day", 20)),
    "abs_percentile_baseline": (abs_percentile_baseline, h("""SELECT instrument_key, open_time, round(CASE WHEN len(h) > 0 THEN len(list_filter(h, lambda x: abs(x) <= abs(change))) / len(h) * 100 END, 4) AS percentile FROM
        (SELECT *, list_filter(array_agg(change) OVER (PARTITION BY instrument_key ORDER BY open_time ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING), lambda x: x IS NOT NULL) AS h FROM changes) WHERE change IS NOT NULL""", RETURNS)),
    "move_candidates": (move_candidates, h("SELECT instrument_key, start_time, end_time, round(start_price, 4) AS start_price, round(end_price, 4) AS end_price, round(change, 4) AS change, direction, round(range_percent, 4) AS range_percent, base_n, round(z, 4) AS z FROM found", RETURNS_K, baseline_sql(90, 3), CANDIDATES)),
    "move_tiers": (move_tiers, h("""SELECT instrument_key, 'p' || t AS tier, direction, count(*) AS n, round(avg(change), 4) AS mean_change, round(median(change), 4) AS median_change
        FROM found, unnest([100, 200, 400, 800]) AS u(t) WHERE abs(change) >= t GROUP BY 1, 2, 3""", RETURNS_K, baseline_sql(90, 3), CANDIDATES)),
    "moves_nonoverlapping": (moves_nonoverlapping, None),
    "current_move": (current_move, h("""SELECT instrument_key, open_time AS as_of, round(change, 4) AS change, CASE WHEN n <= 3 THEN 'insufficient_bars' WHEN gaps <> g3 THEN 'gap' WHEN abs(change) >= 100 THEN 'move' ELSE 'calm' END AS status
        FROM (SELECT *, lag(gaps, 3) OVER (PARTITION BY instrument_key ORDER BY open_time) AS g3, row_number() OVER (PARTITION BY instrument_key ORDER BY open_time DESC) AS newest FROM changes) WHERE newest = 1""", RETURNS_K)),
    "move_pre_windows": (move_pre_windows, h("SELECT instrument_key, start_time, greatest(start_time - INTERVAL 24 HOUR, first_bar) AS pre_start, start_time AS pre_end FROM found JOIN (SELECT instrument_key, min(open_time) AS first_bar FROM bars GROUP BY 1) USING (instrument_key)", RETURNS_K, baseline_sql(90, 3), CANDIDATES)),
    "moves_verified": (moves_verified, VERIFIED_SQL),
    **{f"vol_{n}": (one_estimator(n), estimator_sql(n)) for n in (*SHOWN, "lpv")},
    "vol_atr": (vol_atr, ATR_SQL),
    "volatility_latest": (volatility_latest, LATEST_SQL),
    "drawdown_ulcer": (drawdown_ulcer, with_views("bars_hour", """dd AS (SELECT *, (close / CASE WHEN max(close) OVER w > 0 THEN max(close) OVER w END - 1) * 100 AS drawdown FROM bars WINDOW w AS (PARTITION BY instrument_key ORDER BY open_time))""",
        body="""SELECT instrument_key, open_time, round(drawdown, 4) AS drawdown, round(min(drawdown) OVER w, 4) AS max_drawdown, round(sqrt(avg(drawdown * drawdown) OVER (w ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)), 4) AS ulcer
        FROM dd WINDOW w AS (PARTITION BY instrument_key ORDER BY open_time)""")),
    **{f"price_anomalies_{m}": (anomalies(m), anomalies_sql(m)) for m in volatility.MODES},
    "context_change": (context_change, h("SELECT instrument_key, open_time, volume - v1 AS difference FROM (SELECT *, lag(volume) OVER w AS v1, lag(gaps) OVER w AS g1 FROM series WINDOW w AS (PARTITION BY instrument_key ORDER BY open_time)) WHERE gaps = g1")),
    "context_zscore": (context_zscore, h("""SELECT instrument_key, open_time, round((volume - m) / sd, 4) AS z FROM (SELECT *, avg(volume) OVER b AS m, stddev_samp(volume) OVER b AS sd, count(volume) OVER b AS k, lag(gaps, 10) OVER (PARTITION BY instrument_key ORDER BY open_time) AS g
        FROM series WINDOW b AS (PARTITION BY instrument_key ORDER BY open_time ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) WHERE gaps = g AND k = 10 AND sd > 0""")),
    "context_refusals": (context_refusals, h("""SELECT instrument_key, CASE WHEN n <= 10 THEN 'short_baseline' WHEN gaps <> g THEN 'hole_in_baseline' WHEN v = 0 THEN 'no_variation' WHEN round(v, 8) = 0 AND v <> 0 THEN 'value_not_representable' ELSE 'stored' END AS reason, count(*) AS n
        FROM (SELECT *, (close - open) / 1e9 AS v, lag(gaps, 10) OVER (PARTITION BY instrument_key ORDER BY open_time) AS g FROM series) GROUP BY 1, 2""")),
    "window_behaviour": (window_behaviour, h(f"""SELECT instrument_key, count(*) AS bars, round((arg_max(close, open_time) - arg_min(open, open_time)) / nullif(arg_min(open, open_time), 0) * 100, 4) AS return_percent, max(high) AS high, min(low) AS low, sum(volume)::BIGINT AS volume,
        round(arg_max(change, (coalesce(abs(change), -1), open_time)), 4) AS largest_move, arg_max(open_time, (coalesce(abs(change), -1), open_time)) AS largest_at FROM changes WHERE open_time >= '{SPAN[0]}' AND open_time < '{SPAN[1]}' GROUP BY 1""", RETURNS)),
    "window_change": (window_change, with_views("observations", body=f"""SELECT kind, count(*) AS points, round(arg_min(amount, occurred_at), 4) AS first, round(arg_max(amount, occurred_at), 4) AS last,
        CASE WHEN count(*) > 1 THEN round(arg_max(amount, occurred_at) - arg_min(amount, occurred_at), 4) END AS change FROM obs WHERE occurred_at >= '{SPAN[0]}' AND occurred_at < '{SPAN[1]}' GROUP BY 1""")),
    "market_signals": (market_signals, h("""SELECT instrument_key, open_time, round(mm, 4) AS mean_move, round(CASE WHEN sd > 0 THEN (v - m) / sd END, 4) AS volume_z FROM (SELECT *, avg(abs(change)) OVER r AS mm, avg(volume) OVER r AS v, avg(volume) OVER b AS m, stddev_pop(volume) OVER b AS sd
        FROM changes WINDOW r AS (PARTITION BY instrument_key ORDER BY open_time ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), b AS (PARTITION BY instrument_key ORDER BY open_time ROWS BETWEEN 47 PRECEDING AND 24 PRECEDING)) WHERE n >= 48""", RETURNS)),
    "daily_tiles": (daily_tiles, with_views("bars_hour", body="""SELECT instrument_key, date_trunc('day', open_time)::TIMESTAMP AS tile_start, count(*) AS bars, arg_min(open, open_time) AS first_open, arg_max(close, open_time) AS last_close, max(high) AS high, min(low) AS low, round(avg(volume), 4) AS mean_volume FROM bars GROUP BY 1, 2""")),
    "zigzag_legs": (zigzag_legs, None),
    "episode_regime": (episode_regime, h("""SELECT f.instrument_key, f.start_time, round((f.start_price - b.close) / nullif(b.close, 0) * 100, 4) AS lookback_return,
        CASE WHEN b.close IS NULL OR b.close = 0 THEN 'unknown' WHEN (f.start_price - b.close) / nullif(b.close, 0) * 100 > 50 THEN 'bull' WHEN (f.start_price - b.close) / nullif(b.close, 0) * 100 < -50 THEN 'bear' ELSE 'range' END AS regime
        FROM (SELECT *, start_time - INTERVAL 48 HOUR AS target FROM found) f ASOF LEFT JOIN bars b ON f.instrument_key = b.instrument_key AND f.target >= b.open_time""", RETURNS_K, baseline_sql(90, 3), CANDIDATES)),
    "forecast_methods": (forecast_methods, h("SELECT instrument_key, method, count(*) AS n, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE direction_hit) AS direction_hits, round(avg(error), 4) AS mae FROM s GROUP BY 1, 2", FORECASTS)),
    "forecast_split_selection": (forecast_split_selection, h("""SELECT instrument_key, method, n, hits, mae FROM (SELECT *, first_value(method) OVER (PARTITION BY instrument_key ORDER BY part <> 'train', hits DESC, raw, list_position(['persistence', 'linear', 'mean3'], method)) AS best, min(part <> 'train') OVER (PARTITION BY instrument_key) AS untrained FROM
        (SELECT instrument_key, method, part, count(*) AS n, count(*) FILTER (WHERE hit) AS hits, avg(error) AS raw, round(avg(error), 4) AS mae FROM
        (SELECT *, CASE WHEN row_number() OVER (PARTITION BY instrument_key, method ORDER BY open_time) <= floor(count(*) OVER (PARTITION BY instrument_key, method) * 70 / 100) THEN 'train' ELSE 'test' END AS part FROM s) GROUP BY 1, 2, 3)) WHERE part = 'test' AND method = best AND NOT untrained""", FORECASTS)),
    "rollup_scores": (rollup_scores, h("SELECT method, coalesce(instrument_key, '(all)') AS instrument_key, count(*) AS n, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE direction_hit) AS direction_hits, round(avg(error), 4) AS mae FROM s GROUP BY GROUPING SETS ((method), (method, instrument_key))", FORECASTS)),
    "endpoint_moves_precursors": (endpoint_moves_precursors, h("""SELECT f.instrument_key, f.start_time, hours, count(*) FILTER (WHERE available_at < start_time) AS known, count(*) FILTER (WHERE NOT available_at < start_time) AS late, sum(sign(amount)) FILTER (WHERE available_at < start_time)::BIGINT AS score
        FROM (SELECT *, unnest([24, 48, 72])::INTEGER AS hours FROM found WHERE abs(change) >= 300) f JOIN obs ON occurred_at BETWEEN start_time - to_hours(hours) AND start_time GROUP BY 1, 2, 3""", RETURNS_K, baseline_sql(90, 3), CANDIDATES, "observations")),
}
