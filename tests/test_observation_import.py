"""Imported observations field by field, and loads into snapshots."""

from plumbline.sources import observations
from pyspark.sql import functions as F

GOOD = {"source": "s", "external_id": "1", "kind": "macro_release", "observed_at": "2024-01-01T08:00:00Z", "available_at": "2024-01-01T10:00:00+01:00", "source_url": "https://example.com/x", "amount": "1", "unit": "usd"}
KINDS = ("decision", "fund_flow", "macro_release")


def test_each_rule_by_a_record_of_its_own(spark):
    cases = {
        None: {}, "missing_field": {"source": " "}, "too_long": {"description": "x" * 5000}, "kind": {"kind": "rumour"}, "unknown_instrument": {"instrument": "nobody"}, "source_url": {"source_url": "http://10.0.0.1/"}, "occurred_at": {"occurred_at": "2024-02-31"},
        "instant": {"observed_at": "2024-01-01 08:00:00"}, "known_before_observed": {"available_at": "2024-01-01T08:30:00+01:00"}, "unit": {"unit": None}, "basis": {"basis": "guessed"}, "decision_without_action": {"kind": "decision"},
        "half_route": {"kind": "fund_flow", "actor": "a"}, "claims_on_route": {"kind": "fund_flow", "actor": "a", "counterparty": "b", "reason": "x"}, "claim_outside_decision": {"reason_basis": "stated_reason"},
    }
    fine = [{"kind": "decision", "action": "x"}, {"kind": "fund_flow", "actor": "a", "counterparty": "b"}, {"instrument": "known", "occurred_at": "2024-02-29"}, {"amount": None, "unit": None}, {"available_at": GOOD["observed_at"]}]
    rows = [GOOD | {"evidence": str(i)} | c for i, c in enumerate([*cases.values(), *fine])]
    kind = ", ".join(f"{c} string" for c in observations.FIELDS)
    frame = spark.createDataFrame([tuple(r.get(c) for c in observations.FIELDS) for r in rows], kind)
    known = spark.createDataFrame([("known",), ("known",), (None,)], "key string")
    got = {int(r.evidence): r.refused for r in observations.checked(frame, known, KINDS).collect()}
    assert got == dict(enumerate([*cases, *[None] * len(fine)]))
    assert observations.checked(frame.limit(0), known, KINDS).collect() == []
    assert observations.checked(frame.select("source", "kind"), known, KINDS).where("refused = 'missing_field'").count() == len(rows)


def test_loads_change_a_snapshot_once(spark):
    kind = "source string, external_id string, kind string, available_at string, amount string"
    current = spark.createDataFrame([("s", "1", "a", "2024-01-02", "1"), ("s", "2", "a", "2024-01-02", "1"), ("s", "3", "a", "2024-01-02", None), ("s", "4", "a", "2024-01-02", "1"), ("s", "5", "a", None, "1"), ("s", "9", "a", "2024", "1")], kind)
    load = spark.createDataFrame([("s", "1", "a", "2024-01-03", "2"), ("s", "1", "a", "2024-01-01", "7"), ("s", "2", "b", "2024-01-03", "2"), ("s", "3", "a", "2024-01-02", None), ("s", "3", "a", "2024-01-02", None), ("s", "4", "a", "2024-01-01", "5"), ("s", "5", "a", "2024", "3"), ("s", "6", "a", "2024", "1")], kind)
    out = observations.merged(current, load)
    found = {r.external_id: (r.change, r.kind, r.amount) for r in out.collect()}
    assert found == {"1": ("updated", "a", "2"), "2": ("quarantined", "a", "1"), "3": ("unchanged", "a", None), "4": ("stale", "a", "1"), "5": ("updated", "a", "3"), "6": ("inserted", "a", "1"), "9": ("kept", "a", "1")}
    again = observations.merged(out.drop("change"), load)
    assert {r.change for r in again.collect()} == {"unchanged", "quarantined", "stale", "kept"}
    assert again.drop("change").exceptAll(out.drop("change")).count() == 0
    assert {r.change for r in observations.merged(current.limit(0), load).select(F.col("change")).collect()} == {"inserted"}
