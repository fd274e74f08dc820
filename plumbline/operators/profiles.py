"""Move profiles: what stored conditions precede moves, against control windows of the same time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import times
from plumbline.operators import inference
from plumbline.operators.joins import within
from plumbline.session import staged

WINDOW = ("role", "instrument_key", "start_time", "end_time")
#: Kinds that a profile takes; each is an aggregate of its own in one pass over the windows.
KINDS = 1000
LEAST, ALPHA = 8, 0.05


def windows_before(moves: DataFrame, controls: DataFrame, hours: int) -> DataFrame:
    """(role, instrument_key, start_time, end_time): the hours before each move's start and before each control's."""
    one = lambda df, role: df.select(F.lit(role).alias("role"), "instrument_key", (F.col("start_time") - times.hours(hours)).alias("start_time"), F.col("start_time").alias("end_time"))
    return one(moves, "move").unionByName(one(controls, "control")).distinct()


def coverage(observations: DataFrame, hours: int) -> DataFrame:
    """Per kind: the time over which a whole window could hold it, ``since`` and ``until``."""
    return observations.groupBy("kind").agg((F.min("occurred_at") - times.hours(hours)).alias("since"), F.max("available_at").alias("until"))


def window_values(windows: DataFrame, observations: DataFrame, hours: int) -> DataFrame:
    """Windows by kind with at least one observation of it that happened inside and was known by the end: records and mean amount."""
    o = observations.select("kind", "occurred_at", "available_at", F.when(F.abs("amount") < float("inf"), F.col("amount").cast("double")).alias("amount"))
    found = within(windows, o, "start_time", "end_time", "occurred_at", hours * 3600).where("occurred_at < end_time AND available_at <= end_time")
    return found.groupBy(*WINDOW, "kind").agg(F.count("*").alias("records"), F.avg("amount").alias("value"))


def _reached(spans: list, start: Column, end: Column) -> Column:
    return F.array(*[F.when((start >= F.lit(s["since"])) & (end <= F.lit(s["until"])), F.lit(s["kind"])) for s in spans])


def contrast(windows: DataFrame, observations: DataFrame, hours: int) -> DataFrame:
    """One row a kind, see ``contrasted``."""
    return contrasted(observations, staged(window_values(windows, observations, hours), "window_values"), hours)


def contrasted(observations: DataFrame, values: DataFrame, hours: int) -> DataFrame:
    """One row a kind: windows of both roles inside the kind's own coverage, those with it, shares, enrichment, means and drift.

    A window counts only if some kind was observed in it, moves and controls
    alike. ``tested`` is false, with a reason, where no pair of windows can be
    compared. At most ``KINDS`` kinds: kinds are a closed vocabulary.
    """
    spans = coverage(observations, hours)
    held = spans.orderBy("kind").limit(KINDS + 1).collect()
    if len(held) > KINDS:
        raise ValueError(f"more than {KINDS} kinds")
    spans = observations.sparkSession.createDataFrame(held, spans.schema) if held else spans
    kept = values.select(*WINDOW).distinct()
    reached = kept.select("role", F.explode(_reached(held, F.col("start_time"), F.col("end_time")) if held else F.array().cast("array<string>")).alias("kind")).where("kind IS NOT NULL")
    number = lambda role: F.count_if(F.col("role") == role)
    sizes = reached.groupBy("kind").agg(number("move").alias("moves"), number("control").alias("controls"))
    own = values.join(F.broadcast(spans), "kind").where("start_time >= since AND end_time <= until")
    measured = lambda role: F.count_if((F.col("role") == role) & F.col("value").isNotNull())
    mean = lambda role: F.avg(F.when(F.col("role") == role, F.col("value")))
    counts = own.groupBy("kind").agg(
        number("move").alias("moves_with"), number("control").alias("controls_with"), measured("move").alias("moves_measured"), measured("control").alias("controls_measured"), mean("move").alias("move_mean"), mean("control").alias("control_mean")
    )
    rows = values.select("kind").distinct().join(sizes, "kind", "left").join(counts, "kind", "left").fillna(0, ["moves", "controls", "moves_with", "controls_with", "moves_measured", "controls_measured"])
    trend = inference.time_trend(own.where("value IS NOT NULL"), "kind", "start_time", "value", ["value"])
    enough = F.least("moves_measured", "controls_measured") >= 2
    tested = F.least("moves", "controls") > 0
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    rows = rows.join(trend.select("kind", "drift"), "kind", "left").withColumns({"move_share": share("moves_with", "moves"), "control_share": share("controls_with", "controls"), "tested": tested})
    rows = rows.withColumns({c: F.when(tested & enough, F.col(c)) for c in ("move_mean", "control_mean")})
    return rows.withColumns({
        "enrichment": F.when(F.col("control_share") > 0, F.col("move_share") / F.col("control_share")),
        "mean_difference": F.col("move_mean") - F.col("control_mean"),
        "relative_difference": F.when(F.col("control_mean") != 0, (F.col("move_mean") - F.col("control_mean")) / F.abs("control_mean")),
        "drifts": tested & enough & (F.col("moves_measured") + F.col("controls_measured") >= 6) & F.coalesce("drift", F.lit(False)),
        "test": F.when(~tested, "none").when(enough, "difference_in_measured_mean").otherwise("presence"),
        "status": F.when(~tested, "no_comparable_windows").when(F.least("moves", "controls") < LEAST, "too_few_windows").otherwise("ok"),
    }).drop("drift")


def move_profile(windows: DataFrame, observations: DataFrame, hours: int, rounds: int = 2000, alpha: float = ALPHA) -> DataFrame:
    """``contrast`` with permutation p of presence and of magnitude, their adjusted q, and which kinds stand out.

    A kind stands out if its magnitude's q is at most ``alpha``, there are windows
    enough and its level does not drift with the calendar.
    """
    values = staged(window_values(windows, observations, hours), "window_values")
    rows = staged(contrasted(observations, values, hours), "contrast")
    flags = rows.withColumnsRenamed({"moves_with": "move_hits", "controls_with": "control_hits"}).select(F.col("kind").alias("category"), "moves", "controls", "move_hits", "control_hits")
    presence = inference.permutation(flags, rounds).select(F.col("category").alias("kind"), F.col("p_permuted").alias("presence_p"))
    own = values.join(F.broadcast(coverage(observations, hours)), "kind").where("start_time >= since AND end_time <= until")
    means = inference.permutation_means(own.select(F.col("kind").alias("category"), "role", "value"), rounds).select(F.col("category").alias("kind"), F.col("p").alias("magnitude_p"))
    out = rows.join(presence, "kind", "left").join(means, "kind", "left").withColumn("category", F.col("kind"))
    for p, q in (("presence_p", "presence_q"), ("magnitude_p", "magnitude_q")):
        out = inference.benjamini_hochberg(out, p).withColumnRenamed("q", q)
    return out.drop("category").withColumn("stands_out", (F.col("status") == "ok") & ~F.col("drifts") & F.coalesce(F.col("magnitude_q") <= alpha, F.lit(False)))
