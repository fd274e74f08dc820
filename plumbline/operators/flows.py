"""Money flows: summaries, counterparties and attribution to events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import times
from plumbline.operators.joins import within
from plumbline.session import staged


def sided(flows: DataFrame) -> DataFrame:
    """Each flow once for either side: entity, partner, inflow or outflow."""
    side = lambda own, other, way: F.struct(F.col(own).alias("entity"), F.col(other).alias("partner"), F.lit(way).alias("way"))
    both = F.explode(F.array(side("dst", "src", "in"), side("src", "dst", "out"))).alias("s")
    return flows.select("currency", "amount", "occurred_at", both).select("s.*", "currency", "amount", "occurred_at")


def summary(flows: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Exact inflow, outflow, net and count by entity and currency."""
    rows = sided(flows)
    rows = rows.join(entities.select(F.col("key").alias("entity")), "entity", "left_semi") if entities is not None else rows
    total = lambda way: F.coalesce(F.sum(F.when(F.col("way") == way, F.col("amount"))), F.lit(0).cast("decimal(28,2)")).cast("decimal(28,2)")
    out = rows.groupBy("entity", "currency").agg(total("in").alias("inflow"), total("out").alias("outflow"), F.count("*").alias("n"))
    return out.withColumn("net", (F.col("inflow") - F.col("outflow")).cast("decimal(28,2)"))


def top_counterparties(flows: DataFrame, k: int) -> DataFrame:
    """The k partners of largest total by entity and currency; ties by partner, descending.

    Flows are added up by pair, whichever way they go, before either end gets its row.
    """
    src, dst = F.col("src"), F.col("dst")
    turned = F.coalesce(src > dst, dst.isNull() & src.isNotNull())
    ends = flows.select(F.when(turned, dst).otherwise(src).alias("a"), F.when(turned, src).otherwise(dst).alias("b"), "currency", "amount")
    pairs = ends.groupBy("a", "b", "currency").agg(F.sum("amount").alias("total"))
    end = lambda own, other: F.struct(F.col(own).alias("entity"), F.col(other).alias("partner"))
    # a flow to itself counts for either side, in one row
    itself = F.col("a").eqNullSafe(F.col("b"))
    rows = pairs.select(F.explode(F.when(itself, F.array(end("a", "b"))).otherwise(F.array(end("a", "b"), end("b", "a")))).alias("s"), "currency", (F.col("total") * F.when(itself, 2).otherwise(1)).cast("decimal(28,2)").alias("total"))
    totals = rows.select("s.entity", "currency", "s.partner", "total")
    best = Window.partitionBy("entity", "currency").orderBy(F.desc("total"), F.desc("partner"))
    return totals.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def attribution_score(hours: Column) -> Column:
    return F.when(hours <= 1, 0.9).when(hours <= 6, 0.6).when(hours <= 24, 0.3).otherwise(0.1)


def attribute(events: DataFrame, flows: DataFrame, hours: int) -> DataFrame:
    """Flows within the hours after an event (event_id, at), their score and distance."""
    spans = events.select("event_id", "at", (F.col("at") + times.hours(hours)).alias("until"))
    found = within(spans, flows.select("order_id", "line", "amount", F.col("occurred_at").alias("flow_at")), "at", "until", "flow_at", hours * 3600)
    away = times.micros_between(F.col("at"), F.col("flow_at")) / 3.6e9
    return found.select("event_id", "order_id", "line", "amount", away.alias("hours")).withColumn("score", attribution_score(F.col("hours")))


#: Hours after an event and the score of a flow up to there.
LADDER = ((1, 0.9), (6, 0.6), (24, 0.3))


def attribution_totals(events: DataFrame, flows: DataFrame) -> DataFrame:
    """event_id, flows, amount, score of all flows in the 24 hours from each event (event_id, at); events without any have no row.

    The totals of ``attribute``, without its pairs: cumulative counts and amounts
    of flows are read at an event's instant and at each step of the ladder, and
    the differences are the flows between. Sums run inside hours; hours of the day
    before, and days before, are added from a table with a row for each hour that
    has a flow or a question. Only the days are one window: one row a day. Flows are
    read once, into a stored table with a row for each instant.
    """
    hour = F.floor(times.epoch_seconds(F.col("t")) / 3600)
    money = staged(flows.groupBy(F.col("occurred_at").alias("t")).agg(F.count("*").alias("n"), F.sum("amount").alias("sum")), "money")
    money = money.select(F.lit(None).cast(events.schema["event_id"].dataType).alias("event_id"), "t", F.lit(1).alias("side"), F.lit(None).cast("int").alias("step"), "n", "sum")
    steps = [(0, 0, F.col("at")), *[(i + 1, 2, F.col("at") + times.hours(h)) for i, (h, _) in enumerate(LADDER)]]
    asked = events.select("event_id", F.explode(F.array(*[F.struct(t.alias("t"), F.lit(side).alias("side"), F.lit(i).alias("step")) for i, side, t in steps])).alias("s")).select("event_id", "s.*")
    both = money.unionByName(asked, allowMissingColumns=True).withColumn("hour", hour)
    within_hour = Window.partitionBy("hour").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    read = both.withColumn("n", F.sum("n").over(within_hour)).withColumn("sum", F.sum("sum").over(within_hour)).where("side <> 1")
    zero = lambda c: F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(0))
    hours = both.groupBy("hour").agg(zero(F.sum("n")).alias("n"), zero(F.sum("sum")).alias("sum")).withColumn("day", F.floor(F.col("hour") / 24))
    days = hours.groupBy("day").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"))
    earlier = lambda c, w: zero(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    by_day, by_hour = Window.orderBy("day"), Window.partitionBy("day").orderBy("hour")
    days = days.select("day", earlier("n", by_day).alias("day_n"), earlier("sum", by_day).alias("day_sum"))
    hours = hours.select("hour", "day", earlier("n", by_hour).alias("hour_n"), earlier("sum", by_hour).alias("hour_sum")).join(days, "day")
    total = read.join(hours.select("hour", (F.col("hour_n") + F.col("day_n")).alias("before_n"), (F.col("hour_sum") + F.col("day_sum")).alias("before_sum")), "hour")
    total = total.select("event_id", "step", (zero("n") + F.col("before_n")).alias("n"), (zero("sum") + F.col("before_sum")).alias("sum"))
    at = lambda c, i: F.max(F.when(F.col("step") == i, F.col(c)))
    wide = total.groupBy("event_id").agg(*[at("n", i).alias(f"n{i}") for i in range(len(LADDER) + 1)], (at("sum", len(LADDER)) - at("sum", 0)).alias("amount"))
    score = sum(((F.col(f"n{i + 1}") - F.col(f"n{i}")) * w for i, (_, w) in enumerate(LADDER)), F.lit(0.0))
    return wide.select("event_id", (F.col(f"n{len(LADDER)}") - F.col("n0")).alias("flows"), "amount", score.alias("score")).where("flows > 0")
