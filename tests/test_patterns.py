"""Sparse search against all pairs."""

import math
import random

from plumbline.operators import patterns

VECTOR = "id long, vector map<string,double>"


def brute(data, queries, k, least):
    out = {}
    clean = lambda v: {f: x for f, x in (v or {}).items() if x and math.isfinite(x)}
    length = lambda v: math.sqrt(sum(x * x for x in v.values()))
    data = {i: clean(v) for i, v in data}
    for q, v in queries:
        v, rows = clean(v), []
        for i, w in data.items():
            if i != q and v and w:
                s = round(sum(x * w.get(f, 0) for f, x in v.items()) / length(v) / length(w), 6)
                if s >= least:
                    rows.append((-s, i))
        for rank, (s, i) in enumerate(sorted(rows)[:k], 1):
            out[q, rank] = (i, -s)
    return out


def test_top_k_equals_all_pairs(spark):
    rng = random.Random(4)
    def vector(n):
        own = {f"f{min(int(rng.expovariate(0.15)), 60)}": rng.choice([1.0, -1.0, 0.2, 3.0]) * rng.random() for _ in range(n)}
        return own | ({"common": 0.4 * rng.random()} if rng.random() < 0.8 else {})
    data = [(i, vector(rng.randrange(1, 12))) for i in range(400)]
    data += [(400 + i, dict(data[7][1])) for i in range(15)] + [(500, {}), (501, None), (502, {"f1": 0.0, "f2": float("nan")}), (503, {"f1": None, "f3": 1.0}), (504, {"lone": 2.0})]
    queries = [d for d in data if d[0] % 5 == 0] + [(10_000, {"f1": 1.0, "unseen": 3.0}), (10_001, {"unseen": 1.0})]
    for k, least in ((3, 0.3), (10, 0.01), (1, 0.9)):
        found = patterns.top_k(spark.createDataFrame(data, VECTOR), spark.createDataFrame(queries, VECTOR), k, least).collect()
        got = {(r.query_id, r["rank"]): (r.id, r.similarity) for r in found}
        want = brute(data, queries, k, least)
        assert got.keys() == want.keys()
        wrong = {x for x in want if abs(got[x][1] - want[x][1]) > 2e-6 or (got[x][0] != want[x][0] and got[x][1] == want[x][1])}
        assert len(wrong) <= len(want) // 200  # halves of the sixth place may fall either way
    empty = spark.createDataFrame([], VECTOR)
    assert patterns.top_k(empty, empty).collect() == [] and patterns.top_k(spark.createDataFrame(data, VECTOR), empty).collect() == []


def test_scores_by_the_best_match(spark):
    found = spark.createDataFrame([(1, 2, 0.8, 1), (1, 3, 0.7, 2), (2, 1, 0.8, 1), (3, 9, 0.6, 1)], "query_id long, id long, similarity double, rank int")
    ways = spark.createDataFrame([(1, "up"), (2, "down"), (3, "up"), (4, "up")], "id long, direction string")
    got = {r.query_id: (r.matched_id, r.score, r.status) for r in patterns.pattern_score(found, ways).collect()}
    assert got == {1: (2, -4.0, "ok"), 2: (1, -4.0, "ok"), 3: (9, 0.0, "no_direction"), 4: (None, 0.0, "no_match")}
