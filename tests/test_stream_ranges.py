"""Average true ranges of a stream against the sorted series, out of order and over a restart."""

import datetime as dt
import random

import pytest
from plumbline.streaming import ranges

BARS = "instrument_key string, at timestamp, high double, low double, close double"
T = dt.datetime(2024, 1, 1)


def test_streamed_equals_sorted_after_restart_and_disorder(spark, tmp_path):
    rng = random.Random(6)
    rows, price = [], 100.0
    for i in range(300):
        price *= 1 + rng.gauss(0, 0.02)
        rows.append(("a" if i % 3 else "b", T + dt.timedelta(hours=i), price * 1.01, price * 0.98, price))
    shuffled = [r for k in range(0, 300, 20) for r in rng.sample(rows[k : k + 20], 20)]  # up to 20 hours late
    shuffled[40:40] = [rows[33], ("a", T + dt.timedelta(hours=50), None, 1.0, 1.0)]  # a repeated bar, and one with a null
    folder = tmp_path / "in"
    folder.mkdir()
    stream = ranges.atr(spark.readStream.schema(BARS).option("maxFilesPerTrigger", 1).parquet(str(folder)), period=5, late="30 hours")

    def run(parts):
        for k in parts:
            spark.createDataFrame(shuffled[k * 31 : k * 31 + 31], BARS).coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
            next((tmp_path / f"part{k}").glob("*.parquet")).rename(folder / f"{k:03}.parquet")
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()

    run(range(4))
    run(range(4, 10))  # a new query from the same checkpoint
    found = {(r.instrument_key, r.at): (r.true_range, r.atr) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(found) > 230
    for key in "ab":
        own = [r for r in rows if r[0] == key]
        made = list(ranges.wilder([(i, *r[2:]) for i, r in enumerate(own)], None, 0, 0.0, 5))
        got = [found[key, r[1]] for r in own if (key, r[1]) in found]
        assert all((key, r[1]) in found for r in own[: len(got)])  # without holes
        assert got == [(pytest.approx(m[1]), m[2] if m[2] is None else pytest.approx(m[2])) for m in made[: len(got)]]
    assert len(found) == spark.read.parquet(str(tmp_path / "out")).count()


def test_average_of_the_first_period_then_smoothing():
    bars = [(i, 10.0 + i, 9.0, 9.5) for i in range(4)]
    made = [m[2] for m in ranges.wilder(bars, None, 0, 0.0, 3)]
    assert made[:2] == [None, None] and made[2] == pytest.approx(2.0) and made[3] == pytest.approx((2.0 * 2 + 4.0) / 3)
