import math
import random
from datetime import datetime, timedelta

import duckdb
import pytest
from plumbline import catalog
from plumbline.operators import inference, moves, registry, series, text, vectors, volatility
from plumbline.plans import registry_queries
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
BARS = "instrument_key string, open_time timestamp_ntz, open double, high double, low double, close double, volume long"
START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return connection


def values(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    return sorted((tuple(round(float(x), 5) + 0.0 if isinstance(x, float) else str(x) for x in row) for row in frame.values.tolist()), key=str)


@pytest.mark.parametrize("name", [n for n, (_, sql) in catalog.ALL.items() if sql])
def test_query_equals_sql(spark, duck, name):
    query, sql = catalog.ALL[name]
    got, want = query(spark, SF).toPandas(), duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert values(got) == values(want)


def test_queries_without_sql_have_tests_of_their_own():
    tested = {"moves_nonoverlapping", "zigzag_legs", "lexicon_sentiment", "headline_emotion", "permutation_presence", "permutation_means", "permutation_amounts", "move_profile_tests"}
    assert {n for n, (_, sql) in catalog.ALL.items() if not sql} == tested


def test_permutation_presence_over_the_table(spark):
    made = {r.category: r.p_permuted for r in catalog.ALL["permutation_presence"][0](spark, SF).collect()}
    exact = {r.category: r.p for r in inference.hypergeometric(inference.presence(registry_queries.roles(spark, SF))).collect()}
    assert made.keys() == exact.keys() and len(made) == 3
    for k, p in exact.items():
        assert abs(made[k] - p) < 4 * math.sqrt(p * (1 - p) / 2000) + 1e-3


def frame(spark, closes, skip=(), step=3600):
    rows = [("a", START + timedelta(seconds=step * i), float(c), c * 1.01, c * 0.99, float(c), 10) for i, c in enumerate(closes) if i not in skip]
    return spark.createDataFrame(rows, BARS)


def test_windows_never_cross_a_gap(spark):
    made = series.returns(series.with_gaps(frame(spark, range(100, 140), skip=(20, 21))), 3)
    rows = {r.open_time: r.change for r in made.collect()}
    assert all(rows[START + timedelta(hours=h)] is None for h in (0, 1, 2, 22, 23, 24))
    assert rows[START + timedelta(hours=25)] == pytest.approx(300 / 122)


def test_baseline_excludes_the_judged_move(spark):
    closes = [100 + (i % 3) for i in range(60)] + [140]
    made = series.baseline(series.returns(series.with_gaps(frame(spark, closes)), 1), 1, 30).orderBy("open_time").collect()
    assert made[-1].base_n == 30 and made[-1].z > 10
    assert made[3].z is None  # fewer than five changes


def test_a_jump_is_reported_on_its_own_window(spark):
    closes = [100.0] * 20 + [150.0] * 20
    (move,) = moves.candidates(frame(spark, closes), 1, 20.0).collect()
    assert (move.start_price, move.end_price) == (100.0, 150.0) and move.end_time == START + timedelta(hours=20)


def test_greedy_selection_against_plain_python(spark):
    rng = random.Random(4)
    closes = [100.0]
    for _ in range(300):
        closes.append(max(5.0, closes[-1] * (1 + rng.gauss(0, 0.08))))
    found = moves.candidates(frame(spark, closes), 4, 10.0)
    kept = moves.select_largest(found).collect()
    spans = sorted((r.start_n, r.end_n) for r in kept)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    for r in found.collect():  # what was left out overlaps something at least as large
        if (r.start_n, r.end_n) not in spans:
            assert any(s.start_n < r.end_n and r.start_n < s.end_n and abs(s.change) >= abs(r.change) for s in kept)


def test_zigzag_against_plain_python(spark):
    closes = [100, 101, 120, 118, 90, 95, 130, 129, 128, 100, 99]
    legs = moves.zigzag(frame(spark, closes), 15.0).orderBy("start_time").collect()
    assert [(r.direction, r.start_price, r.end_price) for r in legs] == [("up", 100, 120), ("down", 120, 90), ("up", 90, 130), ("down", 130, 99)]


def test_wilder_average(spark):
    rng = random.Random(1)
    closes = [100 + rng.random() * 10 for _ in range(50)]
    got = volatility.wilder_atr(series.with_gaps(frame(spark, closes)), 20, 14).orderBy("open_time").collect()[-1].atr
    true = [max(c * 1.01 - c * 0.99, abs(c * 1.01 - p), abs(c * 0.99 - p)) for p, c in zip(closes[-20:], closes[-19:], strict=False)]
    atr = sum(true[:14]) / 14
    for t in true[14:]:
        atr = (atr * 13 + t) / 14
    assert got == pytest.approx(atr)


def test_estimators_against_floats(spark):
    rng = random.Random(2)
    closes = [100 + rng.random() * 10 for _ in range(20)]
    row = volatility.estimates(series.with_gaps(frame(spark, closes)), 20).orderBy("open_time").collect()[-1]
    r = [math.log(b / a) for a, b in zip(closes, closes[1:], strict=False)]
    assert row.close_to_close == pytest.approx(sum(x * x for x in r) / 19)
    mean = sum(r) / 19
    assert row.demeaned == pytest.approx(sum((x - mean) ** 2 for x in r) / 18)
    assert row.parkinson == pytest.approx(math.log(1.01 / 0.99) ** 2 / (4 * math.log(2)))


def test_permutation_agrees_with_the_exact_tail(spark):
    rows = [("x", 30, 70, 12, 10, "ok"), ("y", 30, 70, 9, 21, "ok"), ("z", 1, 70, 1, 2, "few")]
    contrast = spark.createDataFrame(rows, "category string, moves long, controls long, move_hits long, control_hits long, status string")
    made = inference.permutation(inference.hypergeometric(contrast)).collect()
    for r in made:
        if r.category == "z":
            assert r.p_permuted is None
        else:
            assert abs(r.p - r.p_permuted) < 4 * math.sqrt(r.p * (1 - r.p) / 2000) + 1e-3


def test_benjamini_hochberg_is_monotone(spark):
    rng = random.Random(9)
    rows = [(f"t{i}", rng.random() if i % 9 else None) for i in range(60)]
    made = inference.benjamini_hochberg(spark.createDataFrame(rows, "category string, p double")).collect()
    known = sorted((r.p, r.q) for r in made if r.p is not None)
    assert all(a[1] <= b[1] + 1e-12 for a, b in zip(known, known[1:], strict=False)) and all(p <= q + 1e-12 for p, q in known)
    assert all(r.q is None for r in made if r.p is None)


def test_lexicon_sentiment(spark):
    cases = {
        "the bank reported strong growth": (2, 0, "ok"),
        "the bank reported no growth": (0, 1, "ok"),
        "results were not weak, but risks are growing": (2, 1, "ok"),
        "das ist nicht gut": (None, None, "unsupported_or_uncertain_language"),
        "the company and the bank": (0, 0, "no_lexical_overlap"),
        "": (None, None, "empty_text"),
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.lexicon_sentiment(F.col("t")).alias("s")).collect()
    for r in rows:
        p, n, status = cases[r.t]
        assert r.s.status == status, r
        if status == "ok":
            assert (r.s.positive, r.s.negative) == (p, n), r


def test_merge_rules(spark):
    rows = spark.createDataFrame([(1, 1, "a", None), (1, 2, None, 5), (1, 3, "b", None), (2, 1, None, None)], "k int, at int, x string, y int")
    assert sorted(map(tuple, registry.upsert_fields(rows, ["k"], "at").collect())) == [(1, "b", 5, 3), (2, None, None, 1)]
    assert sorted(map(tuple, registry.latest(rows, ["k"], F.col("at")).collect())) == [(1, 3, "b", None), (2, 1, None, None)]
    aliases = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e")], "alias string, target string")
    assert [tuple(r) for r in registry.alias_chains(aliases).collect()] == [("a", "b")]


def test_sparse_cosine(spark):
    row = spark.sql("select map('a', 1D, 'b', 2D) x, map('b', 2D, 'c', 1D) y, map('z', 0D) z")
    got = row.select(vectors.sparse_cosine(F.col("x"), F.col("y")).alias("xy"), vectors.sparse_cosine(F.col("x"), F.col("z")).alias("xz")).first()
    assert got.xy == pytest.approx(4 / 5) and got.xz == 0


@pytest.mark.parametrize("name", ["event_graph", "event_volatility_links", "flow_attribution", "pit_features", "endpoint_moves_precursors", "fuzzy_candidates"])
def test_range_joins_have_a_key(spark, name):
    plan = catalog.ALL[name][0](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
