"""Control windows, presence contrasts, exact and permutation tests, multiple testing and drift."""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import times


def thin(rows: DataFrame, keys: list[str], order: str, count: int) -> DataFrame:
    """``count`` rows of each key, evenly spread in order: places floor(i * n / count)."""
    per = Window.partitionBy(*keys)
    placed = rows.withColumn("_n", F.count("*").over(per)).withColumn("_i", F.row_number().over(per.orderBy(order)) - 1)
    # place i is taken when it is the floor of some multiple of n / count
    k = F.ceil(F.col("_i") * count / F.col("_n"))
    taken = (F.col("_n") <= count) | ((k < count) & (F.floor(k * F.col("_n") / count) == F.col("_i")))
    return placed.where(taken).drop("_n", "_i")


def control_windows(bars: DataFrame, moves: DataFrame, hours: int, count: int) -> DataFrame:
    """Bars further than ``hours`` from every move of their series, thinned evenly.

    Blocked hours are listed by the hour, so the exclusion is an anti-join on
    equal keys.
    """
    hour = F.floor(times.epoch_seconds(F.col("start_time")) / 3600)
    end = F.floor(times.epoch_seconds(F.col("end_time")) / 3600)
    blocked = moves.select("instrument_key", F.explode(F.sequence(hour - hours, end + hours)).alias("hour")).distinct()
    starts = bars.select("instrument_key", F.col("open_time").alias("start_time")).withColumn("hour", F.floor(times.epoch_seconds(F.col("start_time")) / 3600))
    free = starts.join(blocked, ["instrument_key", "hour"], "left_anti").drop("hour")
    return thin(free, ["instrument_key"], "start_time", count)


def presence(windows: DataFrame) -> DataFrame:
    """Per category (columns role move/control, category, present 0/1): shares, their ratio and counts."""
    share = lambda role: F.avg(F.when(F.col("role") == role, F.col("present")))
    number = lambda role, what: F.sum(F.when(F.col("role") == role, what).otherwise(0)).cast("long")
    out = windows.groupBy("category").agg(
        number("move", F.lit(1)).alias("moves"),
        number("control", F.lit(1)).alias("controls"),
        number("move", F.col("present")).alias("move_hits"),
        number("control", F.col("present")).alias("control_hits"),
        share("move").alias("move_share"),
        share("control").alias("control_share"),
    )
    status = F.when(F.least("moves", "controls") < 8, "too_few_windows").otherwise("ok")
    return out.withColumn("enrichment", F.when(F.col("control_share") > 0, F.col("move_share") / F.col("control_share"))).withColumn("status", status)


def upper_tail(moves: int, controls: int, move_hits: int, control_hits: int) -> float:
    """P(X >= move_hits) for X hypergeometric, from ratios of neighbouring chances around the mode.

    Chances further than 40 standard deviations from the mode are below the
    smallest double and stand as zero, so the work grows with the root of the rows.
    """
    n, hits = moves + controls, move_hits + control_hits
    low, high = max(0, moves - (n - hits)), min(moves, hits)
    mode = min(high, max(low, (moves + 1) * (hits + 1) // (n + 2)))
    reach = 50 + math.ceil(40 * math.sqrt(moves / max(n, 1) * hits * (1 - hits / max(n, 1)) + 1))
    first, last = max(low, mode - reach), min(high, mode + reach)
    i = np.arange(first, last, dtype=np.float64)
    ratio = np.log((hits - i) * (moves - i)) - np.log((i + 1) * (n - hits - moves + i + 1))
    weight = np.concatenate([[0.0], np.cumsum(ratio)])
    weight = np.exp(weight - weight.max())
    return float(min(1.0, weight[max(0, move_hits - first) :].sum() / weight.sum()))


def hypergeometric(contrast: DataFrame) -> DataFrame:
    """Adds p: the chance of at least as many move windows with the category, all labellings alike."""

    def each(col: pd.DataFrame) -> pd.Series:
        return pd.Series([upper_tail(int(a), int(b), int(x), int(y)) for a, b, x, y in zip(col["moves"], col["controls"], col["move_hits"], col["control_hits"], strict=True)], dtype="float64")

    p = F.pandas_udf(each, "double")
    return contrast.withColumn("p", p(F.struct("moves", "controls", "move_hits", "control_hits")))


def permutation(contrast: DataFrame, rounds: int = 2000, seed: int = 20260927) -> DataFrame:
    """Adds p_permuted: share of random labellings with at least as many hits, (hits + 1) / (rounds + 1)."""

    def each(col: pd.DataFrame) -> pd.Series:
        out = []
        for a, b, x, y in zip(col["moves"], col["controls"], col["move_hits"], col["control_hits"], strict=True):
            if a < 2 or b < 2:
                out.append(None)
                continue
            draws = np.random.default_rng(seed).hypergeometric(int(x + y), int(a + b - x - y), int(a), rounds)
            out.append((int((draws >= x).sum()) + 1) / (rounds + 1))
        return pd.Series(out, dtype="float64")

    return contrast.withColumn("p_permuted", F.pandas_udf(each, "double")(F.struct("moves", "controls", "move_hits", "control_hits")))


SHARDS, VALUES = 4096, 1 << 14


def drawn(count: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each kind are among ``take`` of ``count.sum()`` items, all choices alike.

    Every item is taken by itself with the chance that gives ``take`` in the mean;
    then as many as are too many are put back, or too few added, all alike. Numbers
    may exceed what hypergeometric generators take.
    """
    total = int(count.sum())
    chance = take / total if total else 0.0
    got = (rng.random(len(count)) < chance).astype(np.int64) if len(count) and count.max() == 1 else rng.binomial(count, chance)
    over = int(got.sum()) - take
    if not over:
        return got
    pool = got if over > 0 else count - got
    size, wanted = int(pool.sum()), abs(over)
    if 3 * wanted >= size:
        places = rng.permutation(size)[:wanted]
    else:
        places = np.unique(rng.integers(0, size, wanted))
        while len(places) < wanted:
            places = np.unique(np.concatenate([places, rng.integers(0, size, wanted - len(places))]))
    change = np.bincount(np.searchsorted(np.cumsum(pool), places, "right"), minlength=len(count))
    return got - change if over > 0 else got + change


def permutation_means(values: DataFrame, rounds: int = 2000, seed: int = 20260927, shards: int = SHARDS) -> DataFrame:
    """Per category (columns role, value): two-sided permutation test of the difference of means.

    Rows are counted by role and value, and a category's distinct values are dealt
    by hash to shards of about ``VALUES``, ``shards`` at most. The number of moves of
    every shard in each round is drawn once from the shards' sizes, and a shard
    gets its own numbers; inside it the moves are drawn from its counts: together a
    permutation of all rows. A task returns a sum for each round, so neither values
    nor rows of a category meet. p counts rounds whose difference
    is as large as the observed one, within 1e-9, and the observed one itself.
    Null and non-finite values are left out; fewer than two rows of either role
    give a null difference and p.
    """
    many = lambda role: F.sum(F.when(F.col("role") == role, 1).otherwise(0))
    known = values.withColumn("value", F.col("value").cast("double")).where("value IS NOT NULL AND NOT isnan(value) AND abs(value) < double('Infinity') AND role IN ('move', 'control')")
    counted = known.groupBy("category", "value").agg(many("move").alias("a"), many("control").alias("b"))
    size = counted.groupBy("category").agg(F.least(F.lit(shards), F.ceil(F.count("*") / VALUES)).cast("int").alias("shards"), F.sum("a").alias("n"), F.sum("b").alias("m"), F.sum(F.col("a") * F.col("value")).alias("moves"), F.sum(F.col("b") * F.col("value")).alias("controls"))
    difference = F.when((F.col("n") >= 2) & (F.col("m") >= 2), F.col("moves") / F.col("n") - F.col("controls") / F.col("m"))
    size = size.select("category", "shards", "n", "m", (F.col("moves") + F.col("controls")).alias("total"), difference.alias("difference"))
    dealt = counted.join(size.select(F.col("category").alias("_c"), "shards", "n", "difference").where("difference IS NOT NULL"), F.col("category").eqNullSafe(F.col("_c")))
    dealt = dealt.select("category", F.pmod(F.xxhash64("value"), F.col("shards")).cast("int").alias("shard"), "n", "value", (F.col("a") + F.col("b")).alias("many"))
    kind = values.schema["category"].dataType.simpleString()

    def seeds(category: object) -> list[int]:
        return [seed, zlib.crc32(str(category).encode())]

    def share(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("shard")
        category, take, of = group["category"].iloc[0], int(group["n"].iloc[0]), group["s"].to_numpy(dtype=np.int64)
        alike = np.random.default_rng(seeds(category))
        takes = np.stack([drawn(of, take, alike) for _ in range(rounds)], axis=1)
        return pd.DataFrame({"category": category, "shard": group["shard"].to_numpy(), "takes": list(takes)})

    # a category's group: one row a shard, ``shards`` at most
    takes = dealt.groupBy("category", "shard").agg(F.first("n").alias("n"), F.sum("many").alias("s")).groupBy("category").applyInPandas(share, f"category {kind}, shard int, takes array<long>")

    def each(group: pd.DataFrame, taken: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("value")
        category, shard = taken["category"].iloc[0], int(taken["shard"].iloc[0])
        value, count = group["value"].to_numpy(), group["many"].to_numpy(dtype=np.int64)
        inside = np.random.default_rng([*seeds(category), shard + 1])
        sums = [float(drawn(count, int(take), inside) @ value) for take in taken["takes"].iloc[0]]
        return pd.DataFrame({"category": category, "round": np.arange(rounds, dtype=np.int32), "part": sums})

    parts = dealt.drop("n").groupBy("category", "shard").cogroup(takes.groupBy("category", "shard")).applyInPandas(each, f"category {kind}, round int, part double")
    moves = parts.groupBy(F.col("category").alias("_c"), "round").agg(F.sum("part").alias("s"))
    met = moves.join(size, F.col("category").eqNullSafe(F.col("_c")))
    gap = F.abs(F.col("s") / F.col("n") - (F.col("total") - F.col("s")) / F.col("m"))
    hits = met.groupBy("_c").agg(F.count_if(gap >= F.abs("difference") - 1e-9).alias("hits"))
    return size.join(hits, F.col("category").eqNullSafe(F.col("_c")), "left").select("category", "difference", ((F.col("hits") + 1) / (rounds + 1)).alias("p"))


def benjamini_hochberg(tested: DataFrame, p: str = "p") -> DataFrame:
    """Adds q, the step-up adjusted p; rows are tests, a few for each category, so one window orders them."""
    ranked = tested.withColumn("_r", F.row_number().over(Window.orderBy(F.asc_nulls_last(p), *[c for c in tested.columns if c == "category"])))
    m = tested.where(F.col(p).isNotNull()).agg(F.count("*").alias("_m"))
    raw = F.when(F.col(p).isNotNull(), F.col(p) * F.col("_m") / F.col("_r"))
    down = Window.orderBy("_r").rowsBetween(0, Window.unboundedFollowing)
    return ranked.join(F.broadcast(m)).withColumn("q", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min(raw).over(down)))).drop("_r", "_m")


def time_trend(rows: DataFrame, key: str, order: str, value: str, ties: Sequence[str] = ()) -> DataFrame:
    """Means of the earliest and latest third and whether they drift by a standard deviation or more.

    ``order`` is a timestamp; rows of one instant are ordered by ``ties``. Minutes are counted first, so whole minutes fall into
    a third by their counts, and only rows of the two minutes of a key that a
    third's end cuts are ordered.
    """
    minute = F.floor(times.epoch_seconds(F.col(order)) / 60)
    counted = rows.groupBy(key, minute.alias("_m")).agg(F.count("*").alias("_c"))
    per = Window.partitionBy(key)
    placed = counted.withColumn("_before", F.sum("_c").over(per.orderBy("_m")) - F.col("_c")).withColumn("_n", F.sum("_c").over(per))
    third = F.floor(F.col("_n") / 3)
    cut = lambda at: (F.col("_before") < at) & (at < F.col("_before") + F.col("_c"))
    placed = placed.select(key, "_m", "_before", "_n", third.alias("_t"), (cut(third) | cut(F.col("_n") - third)).alias("_cut"))
    dated = rows.withColumn("_m", minute).join(placed, [key, "_m"])
    inside = dated.where("_cut").withColumn("_i", F.col("_before") + F.row_number().over(Window.partitionBy(key, "_m").orderBy(order, *ties)))
    dated = dated.where("NOT _cut").withColumn("_i", F.col("_before") + 1).unionByName(inside)
    early, late = F.col("_i") <= F.col("_t"), F.col("_i") > F.col("_n") - F.col("_t")
    out = dated.groupBy(key).agg(F.avg(F.when(early, F.col(value))).alias("early"), F.avg(F.when(late, F.col(value))).alias("late"), F.stddev_pop(value).alias("spread"))
    return out.withColumn("drift", F.when(F.col("spread") > 0, F.abs(F.col("late") - F.col("early")) >= F.col("spread")))
