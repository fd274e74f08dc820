"""Financial positions from metric envelopes: validity by reason, and which positions are of one scope.

A metric row has entity, period, source, k, value, currency, unit, scale and
``observation``, a struct of schema, taxonomy, tag, accession, form, filed, start,
end, period_type, source_url, retrieved_at, ambiguous and invalid. ``vocabulary``
maps k to (label, tags, period type); other k are left out. Unknown values stay null, never zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import public_url

SCHEMA, TAXONOMY = "sec_fact_v1", "us-gaap"
#: Forms that facts are taken from, each also as amended.
BASE_FORMS = ("10-K", "10-Q", "10-KT", "10-QT", "20-F", "40-F", "6-K", "8-K", "S-1", "S-4", "S-11", "F-1", "F-4")
FORMS = tuple(form + suffix for form in BASE_FORMS for suffix in ("", "/A"))
REQUIRED = ("schema", "taxonomy", "tag", "filed", "end", "period_type", "source_url", "retrieved_at")
INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
META = ("currency", "unit", "scale")
Vocabulary = dict[str, tuple[str, tuple[str, ...], str]]


def _date(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))


def envelope_reason(period: Column, value: Column, currency: Column, unit: Column, scale: Column, o: Column, vocabulary: Vocabulary) -> Column:
    """Why an envelope is not valid, the first reason that holds; null if it is."""
    kinds = F.create_map(*[F.lit(x) for _, tags, kind in vocabulary.values() for tag in tags for x in (tag, kind)])
    expected = F.try_element_at(kinds, o["tag"])
    untidy = [(o[c] != F.trim(o[c])) | (o[c] == "") | o[c].rlike(r"[\x00-\x1f\x7f]") for c in (*REQUIRED, "accession", "form", "start")]
    bad = untidy[0]
    for u in untidy[1:]:
        bad = F.coalesce(bad, F.lit(False)) | F.coalesce(u, F.lit(False))
    missing = o[REQUIRED[0]].isNull()
    for c in REQUIRED[1:]:
        missing = missing | o[c].isNull()
    rules = (
        ("value_not_finite", value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))),
        ("currency_unit_scale", ~(currency.eqNullSafe(F.lit("USD")) & unit.eqNullSafe(F.lit("currency")) & scale.eqNullSafe(F.lit(1.0)))),
        ("no_observation", o.isNull()),
        ("partial_observation", missing),
        ("untidy_text", bad),
        ("schema_or_taxonomy", (o["schema"] != SCHEMA) | (o["taxonomy"] != TAXONOMY)),
        ("unsupported_tag", expected.isNull()),
        ("period_type", o["period_type"] != expected),
        ("accession", o["accession"].isNotNull() & ~o["accession"].rlike(r"^[0-9]{10}-[0-9]{2}-[0-9]{6}$")),
        ("form", o["form"].isNotNull() & ~o["form"].isin(*FORMS)),
        ("date", _date(o["end"]).isNull() | _date(o["filed"]).isNull() | (o["start"].isNotNull() & _date(o["start"]).isNull())),
        ("period_is_not_end", ~period.eqNullSafe(o["end"])),
        ("start_after_end", o["start"] > o["end"]),
        ("instant_with_start", o["start"].isNotNull() & (expected == "instant") & ~F.coalesce(o["invalid"], F.lit(False))),
        ("source_url", ~F.coalesce(public_url(o["source_url"]), F.lit(False))),
        ("retrieved_at", ~o["retrieved_at"].rlike(INSTANT) | o["retrieved_at"].try_cast("timestamp").isNull()),
        ("marked", F.coalesce(o["invalid"], F.lit(False)) | F.coalesce(o["ambiguous"], F.lit(False))),
    )
    out = F.lit(None).cast("string")
    for name, holds in reversed(rules):
        out = F.when(F.coalesce(holds, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def grouped(metrics: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """One row a group (entity, period, source): ``positions``, one for each k of the vocabulary with value, reason and scope.

    An envelope is judged before it is shuffled: what moves is its reason, value and
    scope, and a digest that tells variants apart. Of variants that conflict, that of
    the least digest lends its scope.
    """
    o = F.col("observation")
    why = envelope_reason(F.col("period"), F.col("value"), F.col("currency"), F.col("unit"), F.col("scale"), o, vocabulary)
    why = F.coalesce(why, F.when((F.trim(F.coalesce("period", F.lit(""))) == "") | (F.trim(F.coalesce("source", F.lit(""))) == ""), "blank_period_or_source"))
    scope = [F.col(m) for m in META] + [o[c].alias(c) for c in ("end", "accession", "form", "start", "period_type")]
    digest = F.unhex(F.sha2(F.to_json(F.struct("value", *META, "observation")), 256))
    held = F.struct(digest.alias("digest"), why.alias("reason"), F.col("value"), *scope)
    own = metrics.where(F.col("k").isin(*vocabulary)).select("entity", "period", "source", "k", held.alias("p")).repartition("entity", "period", "source")
    names = sorted(vocabulary)
    of = lambda k, c: F.when(F.col("k") == k, F.col(c))
    rows = own.groupBy("entity", "period", "source").agg(*[F.min(of(k, "p")).alias(f"least{i}") for i, k in enumerate(names)], *[F.max(of(k, "p.digest")).alias(f"most{i}") for i, k in enumerate(names)])

    def position(i: int, k: str) -> Column:
        p = F.col(f"least{i}")
        why = F.when(p.isNull(), "missing").when(p["digest"] != F.col(f"most{i}"), "conflicting").otherwise(p["reason"])
        kept = [p[c].alias(c) for c in (*META, "end", "accession", "form", "start", "period_type")]
        return F.struct(F.lit(k).alias("metric"), F.lit(vocabulary[k][0]).alias("label"), F.when(why.isNull(), p["value"]).alias("value"), why.alias("reason"), *kept)

    return rows.select("entity", "period", "source", F.array(*[position(i, k) for i, k in enumerate(names)]).alias("positions"))


def positions(groups: DataFrame) -> DataFrame:
    p = groups.select("entity", "period", "source", F.explode("positions").alias("p"))
    return p.select("entity", "period", "source", "p.metric", "p.label", "p.value", F.when(F.col("p.reason").isNull(), "ok").otherwise("unknown").alias("status"), F.col("p.reason").alias("reason"))


def _same_filing(a: Column, b: Column) -> Column:
    return a["end"].eqNullSafe(b["end"]) & a["accession"].eqNullSafe(b["accession"]) & a["form"].eqNullSafe(b["form"])


def _beside(c: Column, x: Column) -> Column:
    """Whether x belongs to the set that c stands for: of its filing, and an instant or of the same start."""
    instant = x["period_type"] == "instant"
    return _same_filing(c, x) & F.when(c["period_type"] == "instant", instant).otherwise(instant | c["start"].eqNullSafe(x["start"]))


def finmap(groups: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """One row for each group and label: the largest set of positions of one filing and duration, and why each other position is not in it.

    Of sets of one size that with the first names stands. ``status`` is ok only if
    every position of the label is usable, in the set, and of one currency, unit and scale.
    """
    of = groups.select("entity", "period", "source", F.explode(F.array(*[F.lit(x) for x in labels])).alias("label"), "positions")
    own = of.withColumn("own", F.filter("positions", lambda p: p["label"] == F.col("label"))).drop("positions").where(F.size("own") > 0)
    own = own.withColumn("usable", F.filter("own", lambda p: p["reason"].isNull())).withColumn("unusable", F.transform(F.filter("own", lambda p: p["reason"].isNotNull()), lambda p: p["metric"]))
    sets = F.transform("usable", lambda c: F.filter("usable", lambda x: _beside(c, x)))
    names = lambda s: F.transform(s, lambda x: x["metric"])
    own = own.withColumn("best", F.array_min(F.transform(sets, lambda s: F.struct((-F.size(s)).alias("n"), names(s).alias("names"))))["names"])
    own = own.withColumn("inside", F.filter("usable", lambda x: F.array_contains("best", x["metric"])))
    first = F.get("inside", F.lit(0))
    duration = F.coalesce(F.get(F.filter("inside", lambda x: x["period_type"] == "duration"), F.lit(0)), first)
    differs = lambda x: F.concat(x["metric"], F.when(~_same_filing(first, x), ": end_accession_or_form").otherwise(": duration_start"))
    meta = lambda x: ~(x["currency"].eqNullSafe(first["currency"]) & x["unit"].eqNullSafe(first["unit"]) & x["scale"].eqNullSafe(first["scale"]))
    outside = F.filter("usable", lambda x: ~F.array_contains("best", x["metric"]) | ~_beside(duration, x))
    errors = F.concat(F.transform(outside, differs), F.transform(F.filter("usable", meta), lambda x: F.concat(x["metric"], F.lit(": currency_unit_scale"))))
    status = F.when((F.size("unusable") == 0) & (F.size("errors") == 0), "ok").otherwise("unknown")
    return own.withColumn("errors", errors).select("entity", "period", "source", "label", status.alias("status"), F.coalesce("best", F.array().cast("array<string>")).alias("consistent"), "unusable", "errors")
