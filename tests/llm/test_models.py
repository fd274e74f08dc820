"""The classifiers' parts against enumeration and brute force."""

import itertools

import numpy as np
import pytest
from plumbline.llm import quality_crf, toxicity_gbt


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    per_text = np.array([1, 4, 7, 2, 1])
    emission, transition = rng.normal(0, 2, per_text.sum()), rng.normal(0, 1, (2, 2))
    good, pairs, z = quality_crf.marginals(emission, transition, per_text)
    want, want_pairs, want_z, at = [], np.zeros((2, 2)), 0.0, 0
    for n in per_text:
        own = emission[at : at + n]
        at += n
        labels = list(itertools.product((0, 1), repeat=n))
        weight = np.exp([sum(e for e, y in zip(own, ys, strict=True) if y) + sum(transition[a, b] for a, b in itertools.pairwise(ys)) for ys in labels])
        share = weight / weight.sum()
        want += [sum(p for p, ys in zip(share, labels, strict=True) if ys[i]) for i in range(n)]
        for p, ys in zip(share, labels, strict=True):
            for a, b in itertools.pairwise(ys):
                want_pairs[a, b] += p
        want_z += np.log(weight.sum())
    assert good == pytest.approx(want) and pairs == pytest.approx(want_pairs) and z == pytest.approx(want_z)


def test_document_score_is_the_length_weighted_mean():
    field = quality_crf.Field(np.zeros(1), np.ones(1), np.ones(1), 0.0, np.zeros((2, 2)))
    x, length, per_text = np.array([[2.0], [-2.0], [0.5]]), np.array([9.0, 0.0, 3.0]), np.array([2, 1])
    p = 1 / (1 + np.exp(-x[:, 0]))
    mean = np.array([(10 * p[0] + p[1]) / 11, p[2]])
    assert 1 / (1 + np.exp(-field.raw(x, length, per_text))) == pytest.approx(mean)


def test_isotonic_equals_the_min_max_formula():
    rng = np.random.default_rng(5)
    margin = rng.permutation(60).astype(float)
    y = (rng.random(60) < 1 / (1 + np.exp(-(margin - 30) / 10))).astype(float)
    at, share = toxicity_gbt.isotonic(margin, y)
    s = y[np.argsort(margin)]
    fitted = np.array([max(min(s[j : k + 1].mean() for k in range(i, 60)) for j in range(i + 1)) for i in range(60)])
    assert (np.diff(share) >= 0).all()
    low, high = at[::2], at[1::2]
    for i in range(60):
        block = int(np.searchsorted(high, i))
        assert low[block] <= i <= high[block]
        members = np.arange(int(low[block]), int(high[block]) + 1)
        assert fitted[members] == pytest.approx(s[members].mean())


def test_a_stump_is_the_best_split():
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(0, 1, (200, 3)), 1)
    y = (x[:, 1] + rng.normal(0, 0.7, 200) > 0.4).astype(float)
    made = toxicity_gbt.grow(x, y, trees=1, depth=1, rate=0.1, bins=16)
    p = y.mean()
    g, h = p - y, np.full(200, p * (1 - p))

    def gain(j, c):
        left = x[:, j] <= c
        part = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1.0)
        return part(left) + part(~left) - part(np.ones(200, bool))

    cuts = [np.unique(np.append(np.quantile(x[:, j], np.linspace(0, 1, 17)[1:-1], method="lower"), 0.0)) for j in range(3)]
    best = max(gain(j, c) for j in range(3) for c in cuts[j])
    j, c = int(made.feature[0][0]), float(made.cut[0][0])
    assert gain(j, c) == pytest.approx(best)
    for side, m in enumerate((x[:, j] <= c, x[:, j] > c)):
        assert made.leaf[0][side] == pytest.approx(-0.1 * g[m].sum() / (h[m].sum() + 1))
        assert made.margin(x)[m] == pytest.approx(np.full(m.sum(), np.log(p / (1 - p)) + made.leaf[0][side]))


def test_boosting_lowers_the_loss():
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (400, 4))
    y = ((x[:, 0] * x[:, 1] > 0) | (x[:, 2] > 1.2)).astype(float)

    def loss(trees):
        m = toxicity_gbt.grow(x, y, trees=trees).margin(x)
        return float(np.mean(np.log1p(np.exp(-m * (2 * y - 1)))))

    losses = [loss(t) for t in (1, 5, 20, 60)]
    assert losses == sorted(losses, reverse=True) and losses[-1] < 0.3
