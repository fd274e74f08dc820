"""Move profiles and permutations of continuous values, by plain Python and enumeration."""

import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest
from plumbline.operators import inference, profiles

T0 = dt.datetime(2024, 1, 1)
WINDOWS = "role string, instrument_key string, start_time timestamp_ntz, end_time timestamp_ntz"
OBSERVED = "kind string, occurred_at timestamp_ntz, available_at timestamp_ntz, amount double"


def hour(h):
    return T0 + dt.timedelta(hours=h)


def test_draws_are_alike_for_every_choice():
    rng = np.random.default_rng(1)
    count = np.array([1, 3, 0, 2])
    seen = {}
    for _ in range(20_000):
        got = tuple(inference.drawn(count, 3, rng).tolist())
        assert sum(got) == 3 and all(0 <= g <= c for g, c in zip(got, count, strict=True))
        seen[got] = seen.get(got, 0) + 1
    for got, n in seen.items():
        chance = math.prod(math.comb(c, g) for c, g in zip(count.tolist(), got, strict=True)) / math.comb(6, 3)
        assert abs(n / 20_000 - chance) < 5 * (chance / 20_000) ** 0.5
    big = np.array([10**11, 10**10, 7])
    assert inference.drawn(big, 10**10, rng).sum() == 10**10 and inference.drawn(big, 0, rng).sum() == 0 and (inference.drawn(big, int(big.sum()), rng) == big).all()


def test_permutation_of_continuous_values_by_enumeration(spark):
    rng = random.Random(3)
    cases = {k: ([rng.gauss(shift, 1) for _ in range(5)], [rng.gauss(0, 1) for _ in range(7)]) for k, shift in (("a", 0.2), ("b", 1.5), (None, 3))}
    rows = [(k, role, v) for k, both in cases.items() for role, own in zip(("move", "control"), both, strict=True) for v in own] + [("a", "move", float("nan")), ("a", "control", float("inf")), ("a", "other", 1.0), ("few", "move", 1.0)]
    values = spark.createDataFrame(rows, "category string, role string, value double")
    for shards in (1, 4096):
        old, inference.VALUES = inference.VALUES, inference.VALUES if shards == 1 else 2
        try:
            made = {r.category: r for r in inference.permutation_means(values, 4000, shards=shards).collect()}
        finally:
            inference.VALUES = old
        assert made["few"].p is None and made["few"].difference is None
        for k, (a, b) in cases.items():
            gap = lambda own: abs(sum(own) / 5 - (sum(a + b) - sum(own)) / 7)  # noqa: B023, E731
            every = [gap(own) >= gap(a) - 1e-9 for own in itertools.combinations(a + b, 5)]
            exact = sum(every) / len(every)
            assert abs(made[k].p - exact) < 5 * (exact * (1 - exact) / 4000) ** 0.5 + 1e-3, (k, shards)
            assert made[k].difference == pytest.approx(sum(a) / 5 - sum(b) / 7)


def plain(windows, observed, hours):
    cov = {}
    for k, at, known, _ in observed:
        lo, hi = cov.get(k, (at, known))
        cov[k] = (min(lo, at), max(hi, known))
    values = {}
    for w in windows:
        for k, at, known, amount in observed:
            if w[2] <= at < w[3] and known <= w[3]:
                values.setdefault((w, k), []).append(amount)
    kept = {w for w, _ in values}
    out = {}
    for k in {k for _, k in values}:
        lo, hi = cov[k][0] - dt.timedelta(hours=hours), cov[k][1]
        inside = lambda w: w[2] >= lo and w[3] <= hi  # noqa: B023, E731
        n = {r: sum(inside(w) and w[0] == r for w in kept) for r in ("move", "control")}
        own = {r: [v for (w, kk), v in values.items() if kk == k and w[0] == r and inside(w)] for r in ("move", "control")}
        mean = {r: [sum(x for x in v if x is not None) / len([x for x in v if x is not None]) for v in own[r] if any(x is not None for x in v)] for r in own}
        out[k] = (n["move"], n["control"], len(own["move"]), len(own["control"]), len(mean["move"]), len(mean["control"]), sorted(mean["move"]), sorted(mean["control"]))
    return out


def test_contrast_against_plain_python(spark):
    rng = random.Random(5)
    observed = [(rng.choice("xyz"), hour(h := rng.uniform(0, 200)), hour(h + rng.choice([0, 1, 9])), rng.choice([None, rng.gauss(0, 2)])) for _ in range(300)]
    observed += [("late", hour(190 + i / 9), hour(191 + i / 9), 1.0) for i in range(40)] + [("once", hour(20), hour(20), 5.0)]
    windows = [(rng.choice(["move", "control"]), rng.choice("ab"), hour(h), hour(h + 6)) for h in range(-20, 220, 3)]
    w, o = spark.createDataFrame(windows, WINDOWS), spark.createDataFrame(observed, OBSERVED)
    found = {r.kind: r for r in profiles.move_profile(w, o, 6, rounds=200).collect()}
    want = plain(windows, observed, 6)
    assert found.keys() == want.keys()
    for k, (moves, controls, a, b, ma, mb, va, vb) in want.items():
        r = found[k]
        assert (r.moves, r.controls, r.moves_with, r.controls_with, r.moves_measured, r.controls_measured) == (moves, controls, a, b, ma, mb)
        assert r.tested == (min(moves, controls) > 0) and r.status == ("no_comparable_windows" if not r.tested else "too_few_windows" if min(moves, controls) < 8 else "ok")
        if r.test == "difference_in_measured_mean":
            assert r.mean_difference == pytest.approx(sum(va) / ma - sum(vb) / mb) and 0 < r.magnitude_p <= r.magnitude_q <= 1
        else:
            assert r.move_mean is None
    assert profiles.move_profile(w, o.limit(0), 6, rounds=10).collect() == []
    assert profiles.contrast(w.limit(0), o, 6).collect() == []


def test_a_planted_condition_stands_out(spark):
    rng = random.Random(12)
    windows = [("move" if i % 3 == 0 else "control", "a", hour(6 * i), hour(6 * i + 6)) for i in range(90)]
    observed = [("level", w[2], w[2], (5.0 if w[0] == "move" else 0.0) + rng.gauss(0, 1)) for w in windows]
    observed += [("noise", w[2], w[2], rng.gauss(0, 1)) for w in windows] + [("drift", w[2], w[2], i / 3 + (5.0 if w[0] == "move" else 0.0)) for i, w in enumerate(windows)]
    found = {r.kind: r for r in profiles.move_profile(spark.createDataFrame(windows, WINDOWS), spark.createDataFrame(observed, OBSERVED), 6, rounds=500).collect()}
    assert found["level"].stands_out and not found["noise"].stands_out
    assert found["drift"].drifts and not found["drift"].stands_out


def test_share_of_the_role_that_has_windows(spark):
    windows = spark.createDataFrame([("control", "a", hour(3 * i), hour(3 * i + 3)) for i in range(1, 5)], WINDOWS)
    observed = spark.createDataFrame([("k", hour(4), hour(4), 1.0), ("other", hour(7), hour(7), 1.0), ("k", hour(14), hour(14), 1.0), ("other", hour(1), hour(15), 1.0)], OBSERVED)
    made = {r.kind: r for r in profiles.contrast(windows, observed, 3).collect()}
    assert (made["k"].moves, made["k"].controls, made["k"].controls_with, made["k"].tested) == (0, 2, 1, False)
    assert made["k"].control_share == 0.5 and made["k"].move_share is None and made["k"].enrichment is None
