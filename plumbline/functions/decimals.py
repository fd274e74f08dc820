"""Decimal texts of any length, exactly: rounding to places or digits, half to even, without binary fractions.

A text is an optional sign, digits with an optional point, and an optional exponent.
Digits that stay fit a decimal of 38; digits that go are compared as text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import let

#: Places of a stored quantity, digits and characters of a parameter, largest power of ten of either.
PLACES, DIGITS, CHARACTERS, POWER = 8, 20, 64, 18
NUMBER = r"^([+-]?)(?=\d|\.\d)(\d*)(?:\.(\d*))?(?:[eE]([+-]?\d{1,9}))?$"


def _parts(text: Column) -> Column:
    """struct(sign, digits without leading zeros, point): the value is 0.digits times ten to the point; null if it is no number."""
    group = lambda i: F.regexp_extract(text, NUMBER, i)

    def of(whole: Column) -> Column:
        digits = F.ltrim(whole, F.lit("0"))
        point = F.length(group(2)) + F.coalesce(group(4).try_cast("int"), F.lit(0)) - (F.length(whole) - F.length(digits))
        return F.struct(F.when(group(1) == "-", "-").otherwise("").alias("sign"), digits.alias("digits"), point.alias("point"))

    return F.when(text.rlike(NUMBER), let(F.concat(group(2), group(3)), of))


def _rounded(digits: Column, kept: Column) -> Column:
    """The first ``kept`` digits as a whole number, the rest rounded half to even. kept may be 0 (the first digit may round up) or less."""
    head = F.when(kept > 0, F.rpad(F.substring(digits, F.lit(1), kept), kept, F.lit("0"))).otherwise("0")
    tail = F.when(kept >= 0, F.substring(digits, kept + 1, F.length(digits))).otherwise("0")
    whole = head.try_cast("decimal(38,0)")
    more = F.rtrim(F.substring(tail, F.lit(2), F.length(tail)), F.lit("0")) != ""
    first = F.substring(tail, 1, 1)
    up = (first > "5") | ((first == "5") & (more | (F.pmod(whole, F.lit(2)) == 1)))
    return whole + F.when(up, 1).otherwise(0)


def _plain(whole: Column, places: Column) -> Column:
    """A whole number of ``places`` places as plain text."""
    shown = whole.cast("string")
    padded = F.lpad(shown, F.greatest(F.length(shown), places + 1), F.lit("0"))
    point = F.length(padded) - places
    return F.when(places > 0, F.concat(F.substring(padded, F.lit(1), point), F.lit("."), F.substring(padded, point + 1, places))).otherwise(padded)


def _judged(text: Column, of) -> Column:
    reason = F.struct(F.lit(None).cast("string").alias("text"), F.lit("not_a_number").alias("reason"))
    return let(_parts(text), lambda p: F.when(p.isNull(), reason).otherwise(of(p)))


def _verdict(text: Column, *rules: tuple[str, Column]) -> Column:
    reason = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        reason = F.when(F.coalesce(broken, F.lit(True)), name).otherwise(reason)
    return let(reason, lambda r: F.struct(F.when(r.isNull(), text).alias("text"), r.alias("reason")))


def storable(text: Column, places: int = PLACES) -> Column:
    """struct(text, reason): the quantity with ``places`` places, or why it cannot be kept.

    Reasons: not_a_number, out_of_range (a power of ten over 18), erased (not zero,
    but all its places are).
    """

    def of(p: Column) -> Column:
        wide = p["point"] > POWER + 1
        whole = F.when(p["digits"] == "", F.lit(0).cast("decimal(38,0)")).when(~wide, _rounded(p["digits"], p["point"] + places))
        return let(whole, lambda w: _verdict(F.concat(p["sign"], _plain(w, F.lit(places))), ("out_of_range", (p["digits"] != "") & (wide | F.coalesce(w >= F.lit(f"1E{POWER + 1 + places}").cast("decimal(38,0)"), F.lit(False)))), ("erased", (p["digits"] != "") & (w == 0))))

    return _judged(text, of)


def parameter(text: Column, digits: int = DIGITS, characters: int = CHARACTERS) -> Column:
    """struct(text, reason): the number to ``digits`` significant digits as plain text, trailing zeros as given, or why not.

    Reasons: not_a_number, out_of_range (a power of ten over 18 or under -18), too_long.
    """

    def of(p: Column) -> Column:
        n = F.least(F.length(p["digits"]), F.lit(digits))
        whole = _rounded(p["digits"], n)

        def shown(w: Column) -> Column:
            # a carry adds a digit: 9.99 to 10.0
            carried = F.length(w.cast("string")) > n
            power = p["point"] - 1 + F.when(carried, 1).otherwise(0)
            number = F.when(carried & (n == digits), F.floor(w / 10).cast("decimal(38,0)")).otherwise(w)
            places = n - p["point"] - F.when(carried & (n == digits), 1).otherwise(0)
            plain = F.when(places > 0, _plain(number, places)).otherwise(F.concat(number.cast("string"), F.repeat(F.lit("0"), -places)))
            value = F.concat(p["sign"], plain)
            return _verdict(value, ("out_of_range", ~power.between(-POWER, POWER)), ("too_long", F.length(value) > characters))

        zero = F.struct(F.concat(p["sign"], F.lit("0")).alias("text"), F.lit(None).cast("string").alias("reason"))
        return F.when(p["digits"] == "", zero).when(~p["point"].between(-POWER - 1, POWER + 2), F.struct(F.lit(None).cast("string").alias("text"), F.lit("out_of_range").alias("reason"))).otherwise(let(whole, shown))

    return _judged(text, of)
