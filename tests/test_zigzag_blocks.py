"""ZigZag legs by blocks against one walk along the whole series."""

import datetime as dt
import random

import pytest
from plumbline.operators import moves


def prices(rng, n, step):
    out, p = [], 100.0
    for _ in range(n):
        p = max(0.5, p * (1 + rng.gauss(0, step))) if rng.random() < 0.8 else p
        out.append(round(p, rng.choice([0, 1, 3])) or 1.0)
    return out


@pytest.mark.parametrize("threshold", [1.0, 5.0, 20.0])
def test_swings_in_blocks_change_no_leg(threshold):
    rng = random.Random(int(threshold))
    for case in range(400):
        own = prices(rng, rng.randrange(1, 300), rng.choice([0.003, 0.02, 0.1]))
        cuts = sorted({0, len(own), *(rng.randrange(len(own)) for _ in range(rng.choice([0, 3, 50])))})
        kept = [a + i for a, b in zip(cuts[:-1], cuts[1:], strict=True) for i in moves.swings(own[a:b], threshold)]
        legs = moves.zigzag_points(kept, [own[i] for i in kept], threshold)
        assert [(kept[s], kept[e], d) for s, e, d in legs] == moves.zigzag_points(own, own, threshold), case


def test_a_series_in_fifty_blocks(spark):
    rng = random.Random(9)
    own = prices(rng, 1200, 0.02)
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0 + dt.timedelta(hours=i), p) for i, p in enumerate(own)] + [("a", t0, None), ("b", t0, 5.0), ("b", t0 + dt.timedelta(hours=1), 0.0)]
    frame = spark.createDataFrame(rows, "instrument_key string, open_time timestamp_ntz, close double").repartition(7)
    found = sorted((r.start_time, r.end_time, r.direction) for r in moves.zigzag(frame, 8.0, block_hours=24).collect())
    assert found == [(t0 + dt.timedelta(hours=s), t0 + dt.timedelta(hours=e), d) for s, e, d in moves.zigzag_points(own, own, 8.0)]
    assert len(moves.swings(own, 8.0)) < len(own) // 4
