"""Category histories in parts, and windows that they reach."""

import datetime as dt
import random

from plumbline.operators import history
from pyspark.sql import functions as F

T = dt.datetime(2024, 1, 1)
ROWS = "id long, at timestamp_ntz, category string"


def at(h):
    return T + dt.timedelta(hours=h)


def test_parts_equal_the_whole_in_any_order(spark):
    rng = random.Random(3)
    rows = [(i, at(rng.uniform(0, 400)), rng.choice("abcd")) for i in range(500)] + [(900, None, "a"), (901, at(1), None)]
    frame = spark.createDataFrame(rows, ROWS)
    whole = {tuple(r) for r in history.history(frame).collect()}
    parts = [history.history(frame.where(F.col("id") % 3 == k)) for k in range(3)]
    for order in ((0, 1, 2), (2, 0, 1)):
        held = parts[order[0]]
        for k in order[1:]:
            held = history.merged(held, parts[k])
        assert {tuple(r) for r in held.collect()} == whole
    assert history.merged(history.history(frame.limit(0)), history.history(frame.limit(0))).collect() == []


def test_windows_and_scan(spark):
    held = history.history(spark.createDataFrame([(1, at(24), "x"), (2, at(30), "y"), (3, at(96), "x"), (4, at(97), "x"), (5, at(99), "z")], ROWS))
    windows = [("move", "i", at(20), at(25)), ("move", "i", at(48), at(72)), ("control", "i", at(-48), at(-24)), ("control", "i", at(24), at(97)), ("move", "i", at(200), at(224))]
    found = history.attribute(spark.createDataFrame(windows, "role string, instrument_key string, start_time timestamp_ntz, end_time timestamp_ntz"), held)
    got = {(r.role, r.start_time): (r.status, r.categories) for r in found.collect()}
    assert got == {("move", at(20)): ("attributed", ["x", "y"]), ("move", at(48)): ("no_articles", []), ("control", at(-48)): ("unavailable", []), ("control", at(24)): ("attributed", ["x", "y", "z"]), ("move", at(200)): ("unavailable", [])}
    shares = {r.category: (r.moves, r.controls, r.move_hits, r.control_hits, r.move_share, r.enrichment) for r in history.presence(found).collect()}
    assert shares == {"x": (2, 1, 1, 1, 0.5, 0.5), "y": (2, 1, 1, 1, 0.5, 0.5), "z": (2, 1, 0, 1, 0.0, 0.0)}
    places = {r.category: (r.now, r.before, r.place) for r in history.scan(held, F.lit(at(72))).collect()}
    assert places == {"x": (2, 1, "more"), "y": (0, 1, "absent"), "z": (1, 0, "new")}
    assert {r.status for r in history.attribute(found.select("role", "instrument_key", "start_time", "end_time"), held.limit(0)).collect()} == {"unavailable"}
