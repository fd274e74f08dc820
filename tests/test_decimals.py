"""Decimal texts against Python's decimal arithmetic."""

import random
from decimal import ROUND_HALF_EVEN, Context, Decimal, localcontext

from plumbline.functions import decimals
from pyspark.sql import functions as F


def texts():
    rng = random.Random(4)
    out = ["0", "-0", "0.000", "1", "-1.5", ".5", "5.", "0.000000005", "0.000000015", "0.0000000050000000000000000000000000000000001", "0.00000000499999", "1e-9", "1E18", "9999999999999999999", "9999999999999999999.999999995", "1e19", "1e-30", "999999999999999999995e-2", "99999999999999999999.5", "1e400", "1e-400", "0e500", "", "x", "1.2.3", "e5", ".", "+7", "1_0", " 1", "nan", "Infinity", None]
    for _ in range(700):
        digits = "".join(rng.choice("0123456789") for _ in range(rng.choice([1, 5, 18, 21, 40, 90])))
        if rng.random() < 0.3:
            digits = digits[: len(digits) // 2] + rng.choice(["5", "50", "500000", "4999", "9999999999999999999999"])
        at = rng.randrange(len(digits) + 1)
        out.append(rng.choice(["", "-", "+"]) + digits[:at] + "." * (at < len(digits) or rng.random() < 0.5) + digits[at:] + rng.choice(["", "", "e-12", "E3", "e-25"]))
    return out


def value(text):
    import re

    return Decimal(text) if text is not None and re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text) else None


def stored(v):
    if v is None:
        return None, "not_a_number"
    with localcontext(Context(prec=2000, rounding=ROUND_HALF_EVEN)):
        q = v.quantize(Decimal("1E-8"))
    if v and not -18 <= q.adjusted() <= 18:
        return None, "out_of_range"
    return (None, "erased") if v and not q else (format(q, "f"), None)


def test_stored_quantities(spark):
    rows = texts()
    frame = spark.createDataFrame(list(enumerate(rows)), "i int, t string").select("i", decimals.storable(F.col("t")).alias("s"))
    for r in frame.collect():
        v = value(rows[r.i])
        if v is not None and v and v.adjusted() > 300:
            assert r.s.reason == "out_of_range"
        else:
            assert (r.s.text, r.s.reason) == stored(v), rows[r.i]


def test_parameters_keep_twenty_digits(spark):
    rows = texts()
    frame = spark.createDataFrame(list(enumerate(rows)), "i int, t string").select("i", decimals.parameter(F.col("t")).alias("s"))
    for r in frame.collect():
        v = value(rows[r.i])
        if v is None:
            assert r.s.reason == "not_a_number"
            continue
        with localcontext(Context(prec=20, rounding=ROUND_HALF_EVEN)):
            want = +v
        if not want:
            assert Decimal(r.s.text) == 0
        elif not -18 <= want.adjusted() <= 18:
            assert r.s.reason == "out_of_range", rows[r.i]
        else:
            assert r.s.reason is None and Decimal(r.s.text) == want and "e" not in r.s.text.lower(), (rows[r.i], r.s, want)
