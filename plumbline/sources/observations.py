"""Imported observations: every field by its rule, and snapshots that a load changes once at most.

A record has source, external_id, kind, observed_at, available_at, source_url and
may have the other ``FIELDS``; all are text. ``checked`` names the first rule that
a record breaks, ``merged`` brings the rest into a snapshot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import public_url
from plumbline.operators.joins import marked
from plumbline.sources.validation import ROUTED_KINDS, first_of

REQUIRED = ("source", "external_id", "kind", "observed_at", "available_at", "source_url")
#: Fields of text and their largest numbers of characters.
LENGTHS = {"source": 256, "external_id": 512, "kind": 128, "instrument": 512, "description": 4096, "actor": 512, "counterparty": 512, "action": 1024, "reason": 1024, "amount": 64, "unit": 128, "currency": 128}
FIELDS = (*REQUIRED, "description", "actor", "counterparty", "instrument", "action", "reason", "reason_basis", "amount", "unit", "currency", "basis", "occurred_at", "evidence")
KEY = ("source", "external_id")
DATE = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})?)?$"
INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})$"


def instant(text: Column) -> Column:
    """A text with a zone as an instant, else null."""
    return F.when(text.rlike(INSTANT), text.try_cast("timestamp"))


def checked(records: DataFrame, instruments: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """The records (fields that are not there are null) with ``reason``: the first rule that is broken, else null.

    ``instruments`` has a column key. Blank and null are alike. Instants need a zone
    and a record may not be known before it was observed; an amount needs a unit and
    a basis of observed or estimated. Only decisions carry an action, a reason or its
    basis, and routed kinds have both ends.
    """
    own = records.select(*[F.col(c).cast("string").alias(c) if c in records.columns else F.lit(None).cast("string").alias(c) for c in FIELDS])
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    some = lambda test, names: F.exists(F.array(*[test(n) for n in names]), lambda x: F.coalesce(x, F.lit(False)))
    basis = F.coalesce("reason_basis", F.lit("unknown"))
    decision, routed = F.col("kind") == "decision", F.col("kind").isin(ROUTED_KINDS)
    claims = ~blank("action") | ~blank("reason") | (basis != "unknown")
    observed, available = instant(F.col("observed_at")), instant(F.col("available_at"))
    reason = first_of(
        ("missing_field", some(blank, REQUIRED)),
        ("too_long", some(lambda c: F.length(c) > LENGTHS[c], LENGTHS)),
        ("kind", ~F.col("kind").isin(*kinds)),
        ("unknown_instrument", ~blank("instrument") & F.col("known").isNull()),
        ("source_url", ~public_url(F.col("source_url"))),
        ("occurred_at", ~blank("occurred_at") & (~F.col("occurred_at").rlike(DATE) | F.substring("occurred_at", 1, 10).try_cast("date").isNull())),
        ("instant", observed.isNull() | available.isNull()),
        ("known_before_observed", available < observed),
        ("unit", ~blank("amount") & blank("unit")),
        ("basis", ~blank("amount") & ~F.coalesce("basis", F.lit("observed")).isin("observed", "estimated")),
        ("decision_without_action", decision & blank("action")),
        ("half_route", routed & (blank("actor") | blank("counterparty"))),
        ("claims_on_route", routed & claims),
        ("claim_outside_decision", ~decision & claims),
    )
    return marked(own, instruments.select(F.col("key").alias("instrument")), "instrument", "known").withColumn("reason_refused", reason).select(*FIELDS, F.col("reason_refused").alias("refused"))


def digest(columns: Sequence[str]) -> Column:
    """A hash of values that tells null from blank and one column from the next."""
    return F.sha2(F.to_json(F.array(*[F.col(c).cast("string") for c in columns])), 256)


def merged(current: DataFrame, incoming: DataFrame, keys: Sequence[str] = KEY, fixed: Sequence[str] = ("kind",), version: str = "available_at") -> DataFrame:
    """The next snapshot and what happened to each key: column ``change``.

    Of incoming rows of one key the one of latest ``version`` (then greatest digest) counts. A key
    whose ``fixed`` columns differ is refused: the held row stays and the change is
    quarantined. An incoming row older than the held one is stale. Loading the same
    rows again leaves every row unchanged. Both sides have the columns of ``current``.
    """
    columns = current.columns
    rest = [c for c in columns if c not in keys]
    newest = incoming.select(*columns).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.coalesce(version, F.lit("")), digest(columns))).alias("new"))
    held = current.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.coalesce(version, F.lit("")), digest(columns))).alias("old"))
    both = held.join(newest, list(keys), "full_outer")
    differs = lambda names: F.exists(F.array(*[~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")) for c in names]), lambda x: x)
    older = F.coalesce(F.col(f"new.{version}"), F.lit("")) < F.coalesce(F.col(f"old.{version}"), F.lit(""))
    change = F.when(F.col("new").isNull(), "kept").when(F.col("old").isNull(), "inserted").when(differs(fixed), "quarantined").when(~differs(rest), "unchanged").when(older, "stale").otherwise("updated")
    row = F.when(change.isin("inserted", "updated"), F.col("new")).otherwise(F.col("old"))
    return both.select(*keys, row.alias("r"), change.alias("change")).select(*[F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in columns], "change")
