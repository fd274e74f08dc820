"""Documents that must hold to rules, row by row: each row with the reason that refuses it, null if it stands.

A refused document is never stored in part: ``stands`` leaves out documents of
which any row has a reason. Rules are columns, references are anti-joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import public_url
from plumbline.operators.joins import marked

#: Minutes of the price grid, decimal exponents of a price, points of a document.
GRID_MINUTES, EXPONENT, POINTS = 5, 12, (2, 10_000)
#: Bases of a reason, and kinds that may have a route.
REASON_BASES = ["unknown", "stated_reason", "documented_mandate", "analyst_hypothesis"]
ROUTED_KINDS = ["fund_flow", "exchange_transfer", "onchain_transfer", "liquidation"]
MAPPING = "struct<`from`:string,`to`:string,actor:string,action:string,reason:string,reason_basis:string,related_ids:array<string>,source_locator:string>"


def on_grid(at: Column, minutes: int = GRID_MINUTES) -> Column:
    """Whether a text instant with a zone and whole seconds lies on the grid of minutes."""
    whole = at.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(Z|[+-]\d{2}:\d{2})$")
    return F.when(whole, F.unix_timestamp(F.try_to_timestamp(at)) % (minutes * 60) == 0)


def in_exponents(text: Column, exponent: int = EXPONENT) -> Column:
    """Whether a decimal text is positive and its leading digit's place is from -exponent to exponent."""
    value = F.when(text.rlike(r"^[0-9]+(\.[0-9]+)?$"), text.try_cast("decimal(38,18)"))
    low, high = F.lit(f"1E-{exponent}").cast("decimal(38,18)"), F.lit(f"1E{exponent + 1}").cast("decimal(38,18)")
    return F.coalesce((value >= low) & (value < high), F.lit(False))


def first_of(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that is broken."""
    out = F
    for name, broken in rules:
        out = out.when(F.coalesce(broken, F.lit(True)), name)
    return out.otherwise(F.lit(None).cast("string"))


def price_documents(raw: DataFrame, key: str) -> DataFrame:
    """(key, place, timestamp, price, reason) of documents of prices: grid, exponents, increasing instants, number of points."""
    shape = "struct<prices:array<struct<timestamp:string,price:string>>>"
    rows = raw.select(key, F.posexplode(F.from_json("payload", shape).getField("prices")).alias("place", "p")).select(key, "place", "p.*")
    order = Window.partitionBy(key).orderBy("place")
    at = F.try_to_timestamp("timestamp")
    n = F.count("*").over(Window.partitionBy(key))
    reason = first_of(
        ("points", (n < POINTS[0]) | (n > POINTS[1])),
        ("grid", ~on_grid(F.col("timestamp"))),
        ("price", ~in_exponents(F.col("price"))),
        ("not_increasing", (F.col("place") > 0) & (F.coalesce(at > F.lag(at).over(order), F.lit(False)) == F.lit(False))),
    )
    return rows.withColumn("reason", reason)


def flow_records(records: DataFrame, entities: DataFrame) -> DataFrame:
    """Records (src, dst, type, amount, currency, source_url, texts) with the reason that refuses them; ends must be known entities."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    both = records
    for name in ("src", "dst"):
        both = marked(both, entities.select(F.col("key").alias(name)), name, f"known_{name}")
    amount = F.col("amount").try_cast("decimal(38,18)")
    missing = [blank(c) for c in ("src", "dst", "type", "amount", "currency", "source_url")]
    any_missing = missing[0]
    for m in missing[1:]:
        any_missing = any_missing | m
    reason = first_of(
        ("missing_field", any_missing),
        ("same_ends", F.col("src") == F.col("dst")),
        ("unknown_source", F.col("known_src").isNull()),
        ("unknown_destination", F.col("known_dst").isNull()),
        ("source_url", ~public_url(F.col("source_url"))),
        ("amount", F.coalesce(amount <= 0, F.lit(True))),
    )
    return both.withColumn("reason", reason).select(*records.columns, "reason")


def mapping_reason(id_: Column, kind: Column, mapping: Column, amount: Column, currency: Column) -> Column:
    """Why the mapping of a piece of evidence is refused: reasons, decisions and routes; a row without a mapping stands."""
    m = lambda f: mapping[f]
    related = F.coalesce(m("related_ids"), F.array().cast("array<string>"))
    basis = F.coalesce(m("reason_basis"), F.lit("unknown"))
    decision, attributed = kind == "decision", m("reason_basis").isin("stated_reason", "documented_mandate")
    routed = m("from").isNotNull() | m("to").isNotNull()
    value = amount.try_cast("decimal(38,18)")
    found = first_of(
        ("related_ids", (F.size(F.array_distinct(related)) != F.size(related)) | F.coalesce(F.array_contains(related, id_), F.lit(False))),
        ("reason_basis", ~basis.isin(REASON_BASES)),
        ("reason_without_basis", (F.coalesce(m("reason_basis") == "unknown", F.lit(False)) & m("reason").isNotNull()) | (F.coalesce(m("reason_basis").isin(REASON_BASES[1:]), F.lit(False)) & m("reason").isNull())),
        ("decision_with_route", decision & routed),
        ("decision_without_action", decision & m("action").isNull()),
        ("unattributed_reason", decision & F.coalesce(attributed, F.lit(False)) & (m("actor").isNull() | m("source_locator").isNull())),
        ("claim_outside_decision", ~decision & (m("actor").isNotNull() | m("action").isNotNull() | m("reason").isNotNull() | (basis != "unknown"))),
        ("route_kind", routed & ~kind.isin(ROUTED_KINDS)),
        ("half_route", routed & (m("from").isNull() | m("to").isNull())),
        ("route_amount", routed & F.coalesce(value <= 0, F.lit(True))),
        ("route_currency", routed & (F.coalesce(currency, F.lit("")) == "")),
    )
    return F.when(mapping.isNotNull(), found)


def stands(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of documents without a refused row."""
    refused = rows.where("reason IS NOT NULL").select(*keys).distinct()
    return rows.join(refused, list(keys), "left_anti").drop("reason")
