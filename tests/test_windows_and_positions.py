"""Provider runs, window inventories and financial positions on planted rows."""

import datetime as dt
import itertools
import random

from plumbline.operators import fundamentals, providers, timeline
from pyspark.sql import functions as F

T = dt.datetime(2024, 1, 1)


def at(h):
    return T + dt.timedelta(hours=h)


def test_every_flag_can_be_raised_and_stays_down(spark):
    kind = "source string, run_id long, started_at timestamp_ntz, status string, fetched long, stored long, truncated boolean, request_sha256 string, payload_sha256 string"
    runs = [
        ("fine", 1, at(0), "completed", 10, 10, False, "r", "p"), ("fine", 2, at(1), "completed", 9, 9, None, "r", "p"),
        ("failed", 1, at(1), "failed", 5, 5, False, "r", "p"), ("failed", 2, at(2), None, 5, 5, False, "r", "p"),
        ("changed", 1, at(1), "", 100, 5, False, "r", "p"), ("changed", 2, at(2), "", 1, 5, False, "s", "p"),
        ("collapse", 1, at(2), "", 5, 5, False, "r", "p"), ("collapse", 2, at(1), "", 10, 5, False, "", "p"),
        ("once", 1, at(1), "", 5, 0, False, "r", "p"), ("once", 2, at(2), "", 5, 4, False, "r", "p"),
        ("zero", 1, at(1), "", 5, 4, False, "r", "p"), ("zero", 2, at(2), "", 5, 0, False, "r", "p"),
        ("nothing", 1, at(1), "", 5, 4, False, "r", "p"), ("nothing", 2, at(2), "", None, 4, False, "r", "p"),
        ("never", 1, at(2), "", 0, None, False, "r", "p"), ("cut", 1, at(2), "", 5, 5, True, "r", "p"),
        ("bare", 1, at(2), "", 5, 5, False, None, ""), ("old", 1, at(-500), "", 5, 5, False, "r", "p"), (None, 1, None, None, None, None, None, None, None),
    ]
    out = providers.series_report(spark.createDataFrame(runs, kind), ["source"], F.lit(at(3)), 168)
    flags = {r.source: set(r.flags) for r in out.collect()}
    assert flags == {
        "fine": set(), "failed": {"recorded_failure"}, "changed": {"request_changed"}, "collapse": {"count_collapse"}, "once": {"stored_nothing_once"}, "zero": {"stored_nothing_once", "stored_zero_while_fetched"},
        "nothing": {"count_collapse", "returned_nothing"}, "never": {"never_stored"}, "cut": {"always_truncated"}, "bare": {"no_payload_fingerprint"}, "old": {"stale"}, None: {"never_stored", "no_payload_fingerprint"},
    }
    counts = {r.flag: r.series for r in providers.flag_counts(out).collect()}
    assert set(counts) == set(providers.FLAGS) and all(counts.values())
    assert all(r.series == 0 for r in providers.flag_counts(out.limit(0)).collect())


def test_window_inventory(spark):
    kind = "instrument_key string, at timestamp_ntz, known timestamp_ntz, what string, value double"
    rows = [("a", at(10), at(10), "x", 1.0), ("a", at(12), None, "x", 4.0), ("a", at(12), at(99), "x", 50.0), ("a", at(5), at(5), "y", 9.0), ("a", at(15), at(99), "z", None), ("a", at(90), at(90), "w", 1.0), (None, at(11), at(11), "x", None), ("a", None, None, "x", 1.0)]
    events = timeline.channel(spark.createDataFrame(rows, kind), "records", "at", F.col("what"), "known", F.col("value"))
    expected = spark.createDataFrame([("a", "records"), ("a", "headlines"), ("b", "records")], "instrument_key string, channel string")
    out = {(r.instrument_key, r.channel, r.item): r for r in timeline.explain(events, F.lit(at(9)), F.lit(at(20)), 6, expected).collect()}
    x = out["a", "records", "x"]
    assert (x.status, x.records, x.before, x.late, x.ever, x.first_value, x.last_value, x.change, x.largest, x.covered_hours) == ("present", 2, 0, 1, 3, 1.0, 4.0, 3.0, 4.0, 2.0)
    assert {k: r.status for k, r in out.items()} == {
        ("a", "records", "x"): "present", ("a", "records", "y"): "before_only", ("a", "records", "z"): "late_only", ("a", "records", "w"): "outside_window", ("", "records", "x"): "present",
        ("a", "headlines", ""): "never_recorded", ("b", "records", ""): "never_recorded",
    }
    lines = {(r.instrument_key, r.channel): (r.status, r.records) for r in timeline.channel_lines(timeline.explain(events, F.lit(at(9)), F.lit(at(20)), 6, expected)).collect()}
    assert lines == {("a", "records"): ("present", 3), ("", "records"): ("present", 1), ("a", "headlines"): ("never_recorded", 0), ("b", "records"): ("never_recorded", 0)}


def test_capital_says_what_each_number_is(spark):
    kind = "instrument_key string, kind string, unit string, occurred_at timestamp_ntz, available_at timestamp_ntz, amount double"
    rows = [("a", "level", "usd", at(1), at(1), 50.0), ("a", "level", "usd", at(3), None, 75.0), ("a", "level", "usd", at(4), at(99), 1.0), ("a", "flow", "usd", at(1), at(1), 5.0), ("a", "flow", "usd", at(2), at(2), -2.0)]
    rows += [(None, "index", "points", at(1), at(1), 74.0), ("", "index", "points", at(2), at(2), 75.0), ("a", "one", None, at(2), at(2), 3.0), ("a", "mixed", "usd", at(1), at(1), 1.0), ("a", "mixed", "eur", at(2), at(2), 1.0), ("a", "zero", "usd", at(1), at(1), 0.0), ("a", "zero", "usd", at(2), at(2), 2.0), ("a", "none", "usd", at(1), at(1), None)]
    out = {r.kind: r for r in timeline.capital(spark.createDataFrame(rows, kind), F.lit(at(0)), F.lit(at(10)), ("flow",), ("points",)).collect()}
    shown = {k: (r.scope, r.points, r["first"], r["last"], r.absolute_change, r.percent_change, r.net, r.note) for k, r in out.items()}
    assert shown == {
        "level": ("instrument", 2, 50.0, 75.0, 25.0, 50.0, None, "level"), "flow": ("instrument", 2, 5.0, -2.0, -7.0, None, 3.0, "change_over_interval"), "index": ("market_wide", 2, 74.0, 75.0, 1.0, None, None, "bounded_unit"),
        "one": ("instrument", 1, None, None, None, None, None, "single_reading"), "mixed": ("instrument", 2, None, None, None, None, None, "units_differ"), "zero": ("instrument", 2, 0.0, 2.0, 2.0, None, None, "zero_base"),
    }


VOCABULARY = {"assets": ("stocks", ("Assets",), "instant"), "debt": ("stocks", ("Debt",), "instant"), "income": ("flows", ("Income",), "duration"), "revenue": ("flows", ("Revenue",), "duration"), "tax": ("flows", ("Tax",), "duration"), "cash": ("flows", ("Cash",), "instant")}
OBSERVATION = "struct<schema:string,taxonomy:string,tag:string,accession:string,form:string,filed:string,start:string,end:string,period_type:string,source_url:string,retrieved_at:string,ambiguous:boolean,invalid:boolean>"
METRIC = f"entity long, period string, source string, k string, value double, currency string, unit string, scale double, observation {OBSERVATION}"
GOOD = {"schema": "sec_fact_v1", "taxonomy": "us-gaap", "tag": "Income", "accession": "0000000001-24-000001", "form": "10-K", "filed": "2025-02-01", "start": "2024-01-01", "end": "2024-12-31", "period_type": "duration", "source_url": "https://example.com/x", "retrieved_at": "2025-03-01T00:00:00Z", "ambiguous": None, "invalid": None}


def metric(entity, k="income", value=1.0, period="2024-12-31", source="s", currency="USD", scale=1.0, seen=True, **changes):
    tag, kind = VOCABULARY.get(k, (None, ("Other",), "instant"))[1][0], VOCABULARY.get(k, (None, None, "instant"))[2]
    o = GOOD | {"tag": tag, "period_type": kind} | ({} if kind == "duration" else {"start": None}) | changes
    return (entity, period, source, k, value, currency, "currency", scale, tuple(o[c] for c in GOOD) if seen else None)


def test_reasons_of_envelopes(spark):
    cases = {
        None: metric(0), "value_not_finite": metric(0, value=float("nan")), "currency_unit_scale": metric(0, currency="EUR"), "no_observation": metric(0, seen=False), "partial_observation": metric(0, filed=None), "untidy_text": metric(0, tag=" Income"),
        "schema_or_taxonomy": metric(0, taxonomy="ifrs"), "unsupported_tag": metric(0, tag="Nothing"), "period_type": metric(0, period_type="instant"), "accession": metric(0, accession="1-2-3"), "form": metric(0, form="13F-HR"), "date": metric(0, filed="2025-02-30"),
        "period_is_not_end": metric(0, period="2024-12-30"), "start_after_end": metric(0, start="2025-01-01"), "instant_with_start": metric(0, "assets", start="2024-01-01"), "source_url": metric(0, source_url="ftp://x"), "retrieved_at": metric(0, retrieved_at="yesterday"),
        "marked": metric(0, ambiguous=True), "blank_period_or_source": metric(0, source=" "),
    }
    rows = [(i, *m[1:]) for i, m in enumerate(cases.values())]
    out = fundamentals.positions(fundamentals.grouped(spark.createDataFrame(rows, METRIC), VOCABULARY)).where("status = 'ok' OR reason <> 'missing'").collect()
    assert {r.entity: r.reason for r in out} == dict(enumerate(cases))
    assert all((r.value is None) == (r.status == "unknown") for r in out)


def test_repeated_and_conflicting_metrics(spark):
    rows = [metric(1), metric(1), metric(2), metric(2, value=2.0), metric(3, "unheard"), metric(None)]
    out = {(r.entity, r.metric): r.reason for r in fundamentals.positions(fundamentals.grouped(spark.createDataFrame(rows, METRIC), VOCABULARY)).collect()}
    assert out[1, "income"] is None and out[2, "income"] == "conflicting" and out[None, "income"] is None and not any(e == 3 for e, _ in out)


def test_largest_consistent_sets_by_enumeration(spark):
    rng = random.Random(1)
    rows, want = [], {}
    flows = ("cash", "income", "revenue", "tax")
    for entity in range(60):
        own = {}
        for k in flows:
            if rng.random() < 0.9:
                changes = {"accession": f"0000000001-24-00000{rng.randrange(1, 3)}"} | ({"start": f"2024-0{rng.choice([1, 1, 7])}-01"} if VOCABULARY[k][2] == "duration" else {})
                rows.append(metric(entity, k, **changes))
                own[k] = changes
        fits = lambda a, b: own[a]["accession"] == own[b]["accession"] and ("start" not in own[a] or "start" not in own[b] or own[a]["start"] == own[b]["start"])  # noqa: B023, E731
        sets = [s for n in range(len(own), 0, -1) for s in itertools.combinations(sorted(own), n) if all(fits(a, b) for a, b in itertools.combinations(s, 2))]
        best = min((s for s in sets if len(s) == len(sets[0])), default=())
        want[entity] = (list(best), sorted(set(flows) - set(own)), len(own) - len(best))
    out = fundamentals.finmap(fundamentals.grouped(spark.createDataFrame(rows, METRIC), VOCABULARY), ("flows",))
    for r in out.collect():
        assert (r.consistent, sorted(r.unusable), len(r.errors)) == want[r.entity], r
        assert r.status == ("ok" if not r.unusable and not r.errors else "unknown")
    assert fundamentals.finmap(fundamentals.grouped(spark.createDataFrame([], METRIC), VOCABULARY), ("flows",)).collect() == []
