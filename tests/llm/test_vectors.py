import math

import duckdb
import numpy as np
from plumbline.llm import ann_collision, queries, topk_pivot

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 0.0, 0) for i, v in rows], SCHEMA)


def awkward(rng, n, dim):
    rows = [(i, [float(x) for x in rng.standard_normal(dim)]) for i in range(n)]
    rows += [(n + i, rows[i][1]) for i in range(20)]  # ties
    rows += [rows[0], rows[3]]  # repeated rows
    rows += [(900, None), (920, [float("nan")] * dim), (940, [None] * dim), (None, rows[1][1]), (960, [float("inf")] + [0.0] * (dim - 1)), (980, [])]
    return rows


def clean(rows):
    return {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}


def test_top_k_is_exact(spark):
    rows = awkward(np.random.default_rng(1), 300, 8)
    data = {i: np.floor(64 * v).astype(int) for i, v in clean(rows).items()}
    want = set()
    for q in data:
        if q % 20 == 0:
            best = sorted((-int(data[q] @ v), i) for i, v in data.items() if i != q)[:7]
            want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    got = topk_pivot.top_k(frame(spark, rows), k=7, pivots=6, data_rows=64, query_rows=8)
    assert {tuple(r) for r in got.collect()} == want
    assert got.count() == len(want)


def test_fewer_candidates_and_empty(spark):
    few = frame(spark, [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (20, [0.0, 0.0])])
    got = {tuple(r) for r in topk_pivot.top_k(few).collect()}
    assert got == {(0, 1, 1, 64 * 32 + 128 * 32), (0, 2, 20, 0), (20, 1, 0, 0), (20, 2, 1, 0)}
    assert topk_pivot.top_k(frame(spark, [])).collect() == []
    assert ann_collision.nearest(frame(spark, [])).collect() == []
    only = ann_collision.nearest(frame(spark, [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 0.0])])).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in only] == [(0, 1, 1)]


def test_nearest_recall_and_scores(spark):
    rows = awkward(np.random.default_rng(2), 800, 64)
    data = clean(rows)
    got = {}
    for r in ann_collision.nearest(frame(spark, rows), data_rows=256, query_rows=8).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q in data:
        if q % 50 == 0:
            cos = lambda v: float(data[q] @ v / math.sqrt(data[q] @ data[q]) / math.sqrt(v @ v))
            best = {i for _, i in sorted((-cos(v), i) for i, v in data.items() if i != q)[:5]}
            mine = sorted(got[q])
            assert [r for r, _, _ in mine] == [1, 2, 3, 4, 5]
            assert all(abs(s - cos(data[i])) < 1e-12 for _, i, s in mine)
            hits, total = hits + len(best & {i for _, i, _ in mine}), total + 5
    assert hits / total >= 0.9


def test_rows_that_share_an_id_and_differ(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = awkward(rng, 130, 8) + [(i, [float(x) for x in rng.standard_normal(8)]) for i in (0, 20, 20, 21, 21, 33)]
    path = str(tmp_path / "embeddings.parquet")
    frame(spark, rows).coalesce(1).write.parquet(path)
    connection = duckdb.connect()
    connection.execute(f"create view embeddings as select * from '{path}/*.parquet'")
    want = sorted(connection.sql(queries.OP2_SQL).fetchall())
    columns = [c[0] for c in connection.sql(queries.OP2_SQL).description]
    got = topk_pivot.top_k(spark.read.parquet(path), data_rows=50, query_rows=4).select(*columns)
    assert sorted(map(tuple, got.collect())) == want
    near = ann_collision.nearest(spark.read.parquet(path), k=200, every=20, data_rows=50, query_rows=4).collect()
    mine = [r.vec_id for r in near if r.query_id == 0]
    assert mine.count(21) == 3 and mine.count(33) == 2 and 0 not in mine and len({r.query_id for r in near}) == 8


def test_windows_grow_to_the_same_neighbours_as_counting_all_ranks():
    rng = np.random.default_rng(6)
    vectors = rng.standard_normal((500, 16))
    vectors[:40] = vectors[0] + 0.1 * rng.standard_normal((40, 16))
    ids = np.arange(500)
    search = ann_collision.search_block(5, 24, 3, 0.15, 1.3, 0.8, 0.55)
    found = search(ids[:10], vectors[:10], ids, vectors)
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    place = unit @ ann_collision.projections(16, 24, 3)
    for q in range(10):
        gap = np.abs(place - place[q])
        distance, seen = 0.15, np.array([], dtype=int)
        while True:
            hits = (gap <= 0.8 * distance).sum(1) if distance < 2 * 1.3 else np.full(500, 24)
            seen = np.flatnonzero((hits >= math.ceil(0.55 * 24)) & (ids != q))
            cosine = unit[seen] @ unit[q]
            if len(seen) == 499 or (cosine >= 1 - distance**2 / 2).sum() >= 5:
                break
            distance *= 1.3
        assert found[q][0].tolist() == seen[np.lexsort((seen, -cosine))[:5]].tolist()


def test_pivots_eliminate_on_clustered_data(spark):
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((24, 12)) * 6
    vectors = np.vstack([c + 0.2 * rng.standard_normal((60, 12)) for c in centres]).astype(np.float32).astype(float)
    ints = np.floor(64 * vectors)
    top = (ints**2).sum(1).max()
    near = topk_pivot.lifted(ints, top)
    points = near[topk_pivot.pivot_rows(near, 24)]
    away = topk_pivot.distances(near, points)
    cell = away.argmin(1)
    low, high = (np.array([f(away[cell == c], 0) for c in range(24)]) for f in (np.min, np.max))
    scores = ints @ ints.T
    np.fill_diagonal(scores, -np.inf)
    least = np.array([np.sort(scores[q][cell == cell[q]])[-5] for q in range(len(ints))])
    reach = topk_pivot.reached(ints, least, points, low, high, top)
    best = np.sort(scores, axis=1)[:, -5]
    for q in range(0, len(ints), 7):  # no cell with one of the five best is left out
        assert reach[q, np.unique(cell[scores[q] >= best[q]])].all()
    assert reach.mean() < 0.35
    frame_ = frame(spark, [(i, [float(x) for x in v]) for i, v in enumerate(vectors)])
    got = {tuple(r) for r in topk_pivot.top_k(frame_, k=5, pivots=24, data_rows=40, query_rows=16).collect()}
    assert got == {(q, r + 1, int(i), int(scores[q, i])) for q in range(0, len(ints), 20) for r, i in enumerate(np.lexsort((np.arange(len(ints)), -scores[q]))[:5])}
