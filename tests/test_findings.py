"""Cases of the reviewer's findings, by planted rows and brute force."""

import itertools
import random

import pytest
from plumbline.operators import inference, registry, signals
from plumbline.plans import registry_queries, report_queries

SF = "/root/testdata/sf0.001"

DOCS = "doc_id long, lang string, source string, text string"


def test_category_scan_reads_every_document(spark, tmp_path):
    # residues 7 and 8 modulo 200 hold nothing
    rows = [(i, "en", "s", "nothing") for i in range(10, 110)]
    rows[3] = (13, "en", "s", "a licensed under b")
    rows[5] = (15, "de", "s", "x und y")
    rows[95] = (105, "de", "s", "x und y")
    rows[99] = (109, "fr", "s", "x et y")
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in report_queries.category_scan(spark, str(tmp_path)).collect()}
    assert got == {("en:license", "absent"), ("de:connective", "both"), ("fr:connective", "new")}


def test_nth_equals_sorting(spark):
    for own in ([5], [3, 3, 3, 9], [-(2**40), 0, 1, 2, 7, 2**50, 2**50], list(range(3000))):
        rows = spark.createDataFrame([(v,) for v in own] + [(None,)], "v long")
        for place in {0, len(own) // 2, len(own) * 9 // 10}:
            assert signals.nth(rows, "v", place) == sorted(own)[place]
    assert signals.nth(rows.limit(0), "v", 0) is None


def test_permutation_means_reads_every_order(spark):
    made = {r.category: r for r in registry_queries.permutation_means(spark, SF).collect()}
    full = {r.category: r for r in inference.presence(registry_queries.roles(spark, SF)).collect()}
    assert made.keys() == full.keys()
    for k, r in made.items():
        assert r.difference == pytest.approx(full[k].move_share - full[k].control_share)
        # 2,000 rounds
        assert r.p * 2001 == pytest.approx(round(r.p * 2001))


def test_permutation_means_agrees_with_all_labellings(spark):
    a, b = [1.0, 5.0, 2.5, 9.0], [0.5, 1.0, 3.0, 2.5, 2.5, 4.0]
    rows = [("x", "move", v) for v in a] + [("x", "control", v) for v in b] + [("x", "move", None), ("y", "move", 1.0), ("y", "control", 2.0)]
    values = spark.createDataFrame(rows, "category string, role string, value double")
    made = {r.category: r for r in inference.permutation_means(values).collect()}
    gap = lambda own: sum(own) / 4 - (sum(a + b) - sum(own)) / 6
    every = [abs(gap(own)) >= abs(gap(a)) - 1e-12 for own in itertools.combinations(a + b, 4)]
    exact = sum(every) / len(every)
    assert made["x"].difference == pytest.approx(gap(a)) and abs(made["x"].p - exact) < 4 * (exact * (1 - exact) / 2000) ** 0.5 + 1e-3
    assert made["y"].difference is None and made["y"].p is None


def test_top_counterparties_of_every_entity(spark):
    rows = [(r.src, r.dst, r.currency, r.amount) for r in registry_queries.money_flows(spark, SF).collect()]
    totals = {}
    for src, dst, currency, amount in rows:
        for own in ((dst, currency, src), (src, currency, dst)):
            totals[own] = totals.get(own, 0) + amount
    ranked = {}
    for (entity, currency, partner), total in totals.items():
        ranked.setdefault((entity, currency), []).append((total, partner))
    want = {(*k, i + 1, partner) for k, own in ranked.items() for i, (_, partner) in enumerate(sorted(own, reverse=True)[:3])}
    made = registry_queries.flow_top_counterparties(spark, SF).collect()
    assert {(r.entity, r.currency, r.rank, r.partner) for r in made} == want and len(made) == len(want)


def test_fuzzy_links_cover_all_pairs(spark):
    rng = random.Random(6)
    names = [" ".join(rng.choices("abcdefghij", k=rng.randrange(1, 7))) + (" common" if i % 2 else "") for i in range(90)] + ["", None]
    frame = spark.createDataFrame([(f"k{i:03d}", n) for i, n in enumerate(names)], "key string, name string")
    made = [tuple(r) for r in registry.fuzzy_links(frame).collect()]
    own = {f"k{i:03d}": frozenset((n or "").split()) for i, n in enumerate(names)}
    head = {}
    for k in sorted(own):
        head.setdefault(own[k], k)
    want = {(head[s], k, 1.0) for k, s in own.items() if s and head[s] != k}
    for x, y in itertools.combinations(sorted(k for s, k in head.items() if s), 2):
        score = len(own[x] & own[y]) / min(len(own[x]), len(own[y]))
        want |= {(x, y, score)} if score >= 0.6 else set()
    assert len(made) == len(set(made)) and set(made) == want


def test_duplicate_links_keep_every_strong_link(spark):
    rows = [("a", "Acme", "X", ""), ("b", "ACME", "Y", "L1"), ("c", "acme ", "Y", None), ("d", "Other", "Z", "l1 "), ("e", "Bare", "", ""), ("f", "bare", "", ""), ("g", None, "X", None)]
    frame = spark.createDataFrame(rows, "key string, name string, country string, lei string")
    made = sorted(tuple(r) for r in registry.duplicate_links(frame).collect())
    assert made == [("a", "b", "name"), ("a", "c", "name"), ("b", "c", "name_country"), ("b", "d", "lei"), ("e", "f", "name")]
