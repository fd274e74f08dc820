import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from plumbline.operators import patterns, vectors
from plumbline.plans import registry_queries
from plumbline.sources import validation
from pyspark.sql import functions as F


def test_worthless_events_are_no_planted_faults(spark, tmp_path):
    at = [datetime(2024, 1, 1, h, 5 * i) for h in (1, 3, 5) for i in range(3)]
    rows = [(i, t, 1, "click", v, "{}") for i, (t, v) in enumerate(zip(at, [0.0, 2.0, -3.5] * 3, strict=True))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    found = {r.reason: r.n for r in registry_queries.quarantine_ohlc(spark, str(tmp_path)).collect()}
    assert found == {"valid": 1, "high_below_low": 1, "not_positive": 1}


def test_hash_of_features_does_not_depend_on_order(spark):
    amounts = [1e9 / 7, -1e9 / 7 + 0.01, 1e-3, 3e8 / 11, -3e8 / 11] * 400
    hashes = set()
    for seed in range(4):
        random.Random(seed).shuffle(amounts)
        rows = [(datetime(2024, 1, 2), "a", x) for x in amounts] + [(datetime(2024, 1, 3), "a", float("inf")), (datetime(2024, 1, 4), "a", None)]
        found = spark.createDataFrame(rows, "as_of timestamp_ntz, kind string, amount double").coalesce(1 + seed)
        made = {r.as_of.day: r for r in vectors.feature_vectors(found.where("as_of < '2024-01-03' OR amount IS NULL")).collect()}
        hashes.add(made[2].hash)
        assert abs(made[2].vector["measured_a_total"] - 4.4) < 1e-4 and made[4].vector["measured_a_total"] == 0
    assert len(hashes) == 1


def test_search_shuffles_no_pairs_with_vectors(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, {f"f{rng.randrange(30)}": rng.random() for _ in range(6)}) for i in range(300)]
    made = spark.createDataFrame(rows, "id long, vector map<string,double>")
    whole = patterns.top_k(made, made, 4, 0.1)
    assert "Join" not in whole._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(patterns, "ROWS", 70, raising=False)
    key = lambda r: (r.query_id, r["rank"], r.id, round(r.similarity, 5))
    assert sorted(map(key, patterns.top_k(made, made, 4, 0.1).collect())) == sorted(map(key, whole.collect()))


def test_postings_give_the_scores_of_the_matrix(monkeypatch):
    rng = np.random.default_rng(5)
    some = lambda n: pd.DataFrame([{"id": i, "f": np.unique(rng.integers(0, 40, 9)), "w": None} for i in range(n)])
    data, asked = (rows.assign(w=[rng.standard_normal(len(f)) for f in rows["f"]]) for rows in (some(50), some(20)))
    dense = patterns.Index(data).scores(asked)
    monkeypatch.setattr(patterns, "PLACES", 0)
    assert np.allclose(patterns.Index(data).scores(asked), dense) and (dense != 0).any()


def test_rows_of_a_frequent_key_meet_in_many_tasks(spark, monkeypatch):
    from plumbline.operators import joins
    from pyspark.sql import functions as F

    monkeypatch.setattr(joins, "SHARE", 50, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        records = [(f"c{i % 3}", ["s1", "s1", "s1", "nobody", None, " ", "s2"][i % 7], "payment", str(i + 1), "USD", "https://sec.gov/x") for i in range(2100)]
        rows = spark.createDataFrame(records, "src string, dst string, type string, amount string, currency string, source_url string")
        known = spark.createDataFrame([("c0",), ("c1",), ("s1",), ("s1",), ("s2",)], "key string")
        found = validation.flow_records(rows, known).withColumn("task", F.spark_partition_id()).collect()
        assert len(found) == 2100
        for r in found:
            want = "missing_field" if not (r.dst or "").strip() else "unknown_source" if r.src == "c2" else "unknown_destination" if r.dst == "nobody" else None
            assert r.reason == want
        assert len({r.task for r in found if r.dst == "s1"}) > 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_blank_instruments_meet_in_many_tasks(spark):
    from plumbline.sources import observations
    from pyspark.sql import functions as F

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        at = "2024-01-01T08:00:00Z"
        rows = spark.createDataFrame([("s", str(i), "news", at, at, "https://example.com/x", ["", "k", "nobody"][i % 3]) for i in range(300)], "source string, external_id string, kind string, observed_at string, available_at string, source_url string, instrument string")
        found = observations.checked(rows, spark.createDataFrame([("k",)], "key string"), ["news"]).withColumn("task", F.spark_partition_id()).collect()
        assert len(found) == 300 and all(r.refused == ("unknown_instrument" if r.instrument == "nobody" else None) for r in found)
        assert len({r.task for r in found if r.instrument == ""}) > 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_sizes_of_shards_reach_a_shard_once(spark, monkeypatch):
    from plumbline.operators import inference

    monkeypatch.setattr(inference, "VALUES", 8)
    rng = random.Random(7)
    rows = [(c, "move" if rng.random() < 0.4 else "control", rng.gauss(0, 1) + (i % 5)) for i in range(900) for c in ("a", None)]
    made = inference.permutation_means(spark.createDataFrame(rows, "category string, role string, value double"), 200)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "sizes" not in plan
    found = {r.category: r for r in made.collect()}
    monkeypatch.setattr(inference, "VALUES", 1 << 14)
    whole = {r.category: r for r in inference.permutation_means(spark.createDataFrame(rows, "category string, role string, value double"), 200).collect()}
    assert set(found) == {"a", None}
    for k, r in found.items():
        assert abs(r.difference - whole[k].difference) < 1e-9 and abs(r.p - whole[k].p) < 0.15


def test_envelopes_are_judged_before_they_are_shuffled(spark):
    from plumbline.operators import fundamentals
    from plumbline.plans.fundamental_queries import VOCABULARY, envelopes

    base = envelopes(spark, "/root/testdata/sf0.001").where("observation IS NOT NULL").limit(1).drop("entity", "k").collect()[0]
    rows = spark.createDataFrame([base], envelopes(spark, "/root/testdata/sf0.001").drop("entity", "k").schema)
    k, entity = F.array(*[F.lit(x) for x in ("revenue", "total_assets", "other")]), F.sequence(F.lit(1), F.lit(3))
    rows = rows.withColumn("k", F.explode(k)).withColumn("entity", F.explode(entity)).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(2))))
    # entity 1 repeats each envelope, 2 differs in its address, 3 in its value
    other = F.when((F.col("entity") == 2) & (F.col("n") == 2), "https://example.com/other").otherwise(F.col("observation.source_url"))
    rows = rows.withColumn("observation", F.col("observation").withField("source_url", other)).withColumn("value", F.col("value") + F.when(F.col("entity") == 3, F.col("n")).otherwise(0)).drop("n")
    groups = fundamentals.grouped(rows, VOCABULARY)
    found = {(r.entity, r.metric): r.reason for r in fundamentals.positions(groups).collect()}
    assert len(found) == 18 and all(found[e, m] == "missing" for e, m in found if m not in ("revenue", "total_assets"))
    assert all(found[e, m] == "conflicting" for e in (2, 3) for m in ("revenue", "total_assets"))
    assert "conflicting" not in {found[1, "revenue"], found[1, "total_assets"]}
    assert groups._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_attribution_reads_flows_once(spark, tmp_path):
    from plumbline.operators import flows

    at = datetime(2024, 1, 1)
    spark.createDataFrame([(at + timedelta(hours=h), h) for h in (0, 1, 5, 24, 25)], "occurred_at timestamp_ntz, amount long").write.parquet(str(tmp_path / "flows"))
    made = flows.attribution_totals(spark.createDataFrame([(1, at), (2, at + timedelta(days=9))], "event_id long, at timestamp_ntz"), spark.read.parquet(str(tmp_path / "flows")))
    assert not [f for f in made.inputFiles() if str(tmp_path) in f]
    assert [(r.event_id, r.flows, r.amount, round(r.score, 6)) for r in made.collect()] == [(1, 4, 30, 2.7)]


def test_pairs_are_added_up_whichever_way_they_go(spark):
    from decimal import Decimal

    from plumbline.operators import flows

    rng = random.Random(11)
    names = ["a", "b", "c", "d", None]
    rows = [(rng.choice(names), rng.choice(names), rng.choice(["x", None]), Decimal(rng.randrange(100)) / 4, datetime(2024, 1, 1)) for _ in range(400)]
    df = spark.createDataFrame(rows, "src string, dst string, currency string, amount decimal(18,2), occurred_at timestamp_ntz")
    want = {}
    for src, dst, currency, amount, _ in rows:
        for own, other in ((dst, src), (src, dst)):
            want[own, currency, other] = want.get((own, currency, other), 0) + amount
    made = flows.top_counterparties(df, 9)
    assert {(r.entity, r.currency, r.partner): r.total for r in made.collect()} == want
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Aggregate")  # printed from the top: pairs are aggregated below


def test_fund_reports_are_parsed_once(spark):
    from plumbline.plans import source_queries

    made = source_queries.source_fund_holdings(spark, "/root/testdata/sf0.001")
    assert made._jdf.queryExecution().optimizedPlan().toString().count("from_xml") == 1
