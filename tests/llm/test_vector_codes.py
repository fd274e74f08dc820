import numpy as np
import pytest

from plumbline.llm import vector_codes

VECTORS = "vec_id long, embedding array<float>, label int, n int, code string"


def plain(rows, parts, k, rounds):
    """Lloyd's rounds with every distance computed: code and error by place, entries."""
    kept = [(i, r) for i, r in enumerate(rows) if r[1] and all(v is not None and np.isfinite(v) for v in r[1])]
    x = np.array([[int(np.floor(256 * float(np.float32(v)))) for v in r[1]] for _, r in kept], dtype=np.int64).reshape(len(kept), parts, -1)
    least = {}
    for own, (_, r) in zip(x, kept, strict=True):
        least[r[0]] = min(least.get(r[0], own.tolist()), own.tolist())
    order = sorted(least, key=lambda i: (i is None, i or 0))[:k]
    books = np.array([least[i] for i in order]).transpose(1, 0, 2)
    for turn in range(rounds + 1):
        gap = ((x[:, :, None] - books[None]) ** 2).sum(3)
        code = gap.argmin(2)
        if turn < rounds:
            for p in range(parts):
                for j in set(code[:, p].tolist()):
                    books[p, j] = x[code[:, p] == j, p].sum(0) // int((code[:, p] == j).sum())
    return sorted((str(r[0]), bytes(c.tolist()), int(e)) for (_, r), c, e in zip(kept, code, gap.min(2).sum(1), strict=True)), books


def rows_of(seed, n, kinds=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(kinds, 8))
    rows = [(int(i), (centres[i % kinds] + 0.02 * rng.normal(size=8)).tolist(), int(i % 3) or None, 0, "x") for i in rng.permutation(n)]
    return rows + [(n, None, 1, 0, "x"), (n, [None] * 8, 1, 0, "x"), (n, [float("nan")] * 8, 1, 0, "x"), (n, [float("inf")] * 8, 1, 0, "x"), (n, [], 1, 0, "x"), (None, [0.5] * 8, None, 0, "x")]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_full_scans(spark, seed):
    rows = rows_of(seed, 700)
    rows += [rows[3]] * 9 + [(rows[3][0], [0.0] * 8, 2, 0, "x")]  # a repeated row, and its id with another vector
    rows += [(-i, [0.25] * 8, 2, 0, "x") for i in range(1, 6)]  # entries that are alike: ties
    frame = spark.createDataFrame(rows, VECTORS).repartition(5)
    codes, books = vector_codes.compress(frame, parts=4, entries=16)
    want, entries = plain(rows, 4, 16, 2)
    found = codes.collect()
    assert (books.entries == entries).all()
    assert sorted((str(r.vec_id), bytes(r.code), r.error) for r in found) == want
    assert books.scanned[0] == 4 * len(want) and max(books.scanned[1:]) < 0.6 * books.scanned[0]
    sums = {}
    for r in found:
        sums[r.label] = sums.get(r.label, 0) + r.error
    assert all(r.label_error == sums[r.label] for r in vector_codes.with_label_errors(codes).collect())
    shown = {r.vec_id: r.x for r in vector_codes.decode(codes, books).collect() if r.vec_id == 5}
    code = next(bytes(r.code) for r in found if r.vec_id == 5)
    assert shown[5] == [int(v) for p in range(4) for v in entries[p, code[p]]]


def test_bounds_keep_ties_at_the_lower_index():
    entries = np.array([[[0, 0], [10, 0], [0, 0]]])
    x = np.array([[[5, 0]], [[0, 0]], [[9, 0]]])
    code, exact, high, low, scanned = vector_codes.assign(x, entries)
    assert code.ravel().tolist() == [0, 0, 1] and scanned == 3
    after = np.array([[[0, 0], [10, 0], [-1, 0]]])
    moves = vector_codes.Moves.between(entries, after)
    again = vector_codes.assign(x, after, code.astype("u1"), high, low, moves)
    assert again[0].ravel().tolist() == [0, 0, 1] and again[1].ravel().tolist() == [25, 0, 1]
    assert again[4] == 1  # only the part halfway between two entries


def test_random_moves_against_scans():
    rng = np.random.default_rng(7)
    for _ in range(60):
        k = int(rng.integers(1, 9))
        x = rng.integers(-6, 7, size=(50, 2, 2))
        before, after = rng.integers(-6, 7, size=(2, 2, k, 2))
        code, _, high, low, _ = vector_codes.assign(x, before)
        got = vector_codes.assign(x, after, code.astype("u1"), high, low, vector_codes.Moves.between(before, after))
        want = vector_codes.assign(x, after)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_few_rows_none_and_large_components(spark):
    none = spark.createDataFrame([(1, None, 1, 0, "x")], VECTORS)
    codes, books = vector_codes.compress(none, parts=4)
    assert vector_codes.with_label_errors(codes).collect() == [] and books.sha256()
    codes, books = vector_codes.compress(spark.createDataFrame([(1, [0.5] * 8, None, 0, "x")] * 3, VECTORS), parts=4)
    assert [(bytes(r.code), r.error) for r in codes.collect()] == [(b"\0" * 4, 0)] * 3 and books.entries.shape == (4, 1, 2)
    with pytest.raises(Exception, match="beyond"):
        vector_codes.compress(spark.createDataFrame([(1, [1e9] * 8, None, 0, "x")], VECTORS), parts=4)
