"""Realised volatility of windows of bars, drawdowns and threshold anomalies.

Variances are per bar; a variance that is not positive is null. Estimators that
need no earlier close still leave out the window's first bar. Windows that cross
a gap, are too short or hold a price that is not positive get a status instead of
a number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.series import abs_percentile, last, order, trailing, unbroken

#: Days a year by asset class.
YEAR_DAYS = {"crypto": 365, "equity": 252, "other": 252}
ALPHA = 1.34
ESTIMATORS = ("close_to_close", "demeaned", "parkinson", "garman_klass", "rogers_satchell", "yang_zhang", "lpv", "natr")


def annual_basis(cadence: int, asset_class: str) -> int | None:
    """Bars in a year; none unless it is a whole number and the class is known."""
    seconds = YEAR_DAYS.get(asset_class, 0) * 86_400
    return seconds // cadence if cadence > 0 and seconds >= cadence and seconds % cadence == 0 else None


def positive(x: Column) -> Column:
    return F.when(x > 0, x)


def terms(series: DataFrame) -> DataFrame:
    """Adds priced (all four prices positive) and per-bar terms; logs of ratios are null where a price is not positive."""
    prior = F.lag("close").over(order())
    ratio = lambda a, b: F.when((a > 0) & (b > 0), F.ln(a / b))
    ln = lambda a, b: ratio(F.col(a), F.col(b))
    hl, co = ln("high", "low"), ln("close", "open")
    return (
        series.withColumn("priced", F.coalesce(F.least("open", "high", "low", "close") > 0, F.lit(False)))
        .withColumn("r", ratio(F.col("close"), prior))
        .withColumn("overnight", ratio(F.col("open"), prior))
        .withColumn("body", co)
        .withColumn("pk", hl * hl / (4 * F.ln(F.lit(2.0))))
        .withColumn("gk", 0.5 * hl * hl - (2 * F.ln(F.lit(2.0)) - 1) * co * co)
        .withColumn("rs", ln("high", "close") * ln("high", "open") + ln("low", "close") * ln("low", "open"))
        .withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prior), F.abs(F.col("low") - prior)))
    )


def estimates(series: DataFrame, window: int = 20) -> DataFrame:
    """Adds a variance column for each estimator over the last ``window`` bars, where they are unbroken."""
    rows, inner = last(window), last(window - 1)
    whole = unbroken(window - 1)
    t = float(window)
    k = (ALPHA - 1) / (ALPHA + t / (t - 2))
    out = terms(series).withColumn("whole", F.coalesce(whole, F.lit(False))).withColumn("priced", F.every("priced").over(rows))
    only = lambda x: F.when(F.col("whole") & F.col("priced"), positive(x))
    out = (
        out.withColumn("close_to_close", only(F.avg(F.col("r") * F.col("r")).over(inner)))
        .withColumn("demeaned", only(F.var_samp("r").over(inner)))
        .withColumn("parkinson", only(F.avg("pk").over(rows)))
        .withColumn("garman_klass", only(F.avg("gk").over(inner)))
        .withColumn("rogers_satchell", only(F.avg("rs").over(inner)))
        .withColumn("yang_zhang", only(F.var_samp("overnight").over(inner) + k * F.var_samp("body").over(inner) + (1 - k) * F.avg("rs").over(inner)))
    )
    ranges = F.array("parkinson", "garman_klass", "rogers_satchell")
    usable = F.filter(ranges, lambda v: v.isNotNull())
    mean = F.aggregate(usable, F.lit(0.0), lambda a, v: a + v) / F.size(usable)
    return out.withColumn("lpv", F.when(F.size(usable) > 0, mean))


def wilder_atr(series: DataFrame, window: int = 40, period: int = 14) -> DataFrame:
    """Adds atr: Wilder's average of true ranges, seeded at the start of the last ``window`` bars, in price units."""
    ranges = F.collect_list("tr").over(last(window - 1))
    seed = F.aggregate(F.slice(ranges, 1, period), F.lit(0.0), lambda a, v: a + v) / period
    rest = F.slice(ranges, period + 1, window)
    atr = F.aggregate(rest, seed, lambda a, v: (a * (period - 1) + v) / period)
    whole = F.coalesce(unbroken(window - 1), F.lit(False))
    return terms(series).withColumn("atr", F.when(whole & (F.size(ranges) >= period), atr))


def long_latest(series: DataFrame, window: int, cadence: int, asset_class: str = "crypto") -> DataFrame:
    """The newest estimate of each series and estimator: variance, annual percent (null without a whole number of bars a year) and status."""
    made = wilder_atr(series, window).select("instrument_key", "open_time", "atr")
    wide = estimates(series, window).join(made, ["instrument_key", "open_time"])
    wide = wide.withColumn("natr", positive(F.when(F.col("close") > 0, F.col("atr") / F.col("close")) ** 2))
    newest = wide.withColumn("newest", F.row_number().over(Window.partitionBy("instrument_key").orderBy(F.desc("open_time")))).where("newest = 1")
    per_year = annual_basis(cadence, asset_class)
    long = newest.unpivot(["instrument_key", "open_time", "n", "whole"], list(ESTIMATORS), "estimator", "variance")
    annual = F.sqrt(F.col("variance") * F.lit(per_year).cast("double")) * 100
    status = F.when(F.col("n") < window, "insufficient_bars").when(~F.col("whole"), "gap").when(F.col("variance").isNull(), "not_computable").otherwise("ok")
    return long.select("instrument_key", "open_time", "estimator", "variance", annual.alias("annual_percent"), status.alias("status"))


def drawdowns(series: DataFrame, window: int = 14) -> DataFrame:
    """Adds drawdown from the running high (null until one is positive), the worst so far, and the ulcer index of the last bars."""
    sofar = order().rowsBetween(Window.unboundedPreceding, 0)
    high = F.max("close").over(sofar)
    out = series.withColumn("drawdown", F.when(high > 0, (F.col("close") / high - 1) * 100))
    return out.withColumn("max_drawdown", F.min("drawdown").over(sofar)).withColumn("ulcer", F.sqrt(F.avg(F.col("drawdown") * F.col("drawdown")).over(last(window))))


#: Least baseline and threshold by mode.
MODES = {"percentile": (100, 95.0), "z": (60, 2.0), "absolute": (20, 150.0)}


def anomalies(series: DataFrame, mode: str, length: int = 250) -> DataFrame:
    """Changes judged against their own trailing distribution: measure, three-valued breach and severity.

    ``series`` has ``change``; the judged change and those of the baseline have the same span.
    """
    least, threshold = MODES[mode]
    frame = trailing(length)
    n = F.count("change").over(frame)
    measure = {
        "percentile": lambda: abs_percentile(F.col("change"), F.collect_list("change").over(frame)),
        "z": lambda: F.when(F.stddev_samp("change").over(frame) > 0, (F.col("change") - F.avg("change").over(frame)) / F.stddev_samp("change").over(frame)),
        "absolute": lambda: F.abs("change"),
    }[mode]()
    enough = F.col("base_n") >= least
    breach = F.abs("measure") >= threshold
    severity = F.when(F.col("measure") >= 99, "extreme").when(F.col("measure") >= 97.5, "high").when(F.col("measure") >= 95, "elevated")
    return (
        series.withColumn("base_n", n)
        .withColumn("measure", measure)
        .where("change IS NOT NULL")
        .withColumn("breach", F.when(enough, breach))
        .withColumn("severity", F.when(F.col("breach"), severity if mode == "percentile" else F.lit("breach")))
        .withColumn("reason", F.when(~enough, "short_baseline").when(F.col("measure").isNull(), "no_variation"))
    )
