"""Names, tokens and labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Legal suffixes that names are compared without.
LEGAL_SUFFIXES = "inc incorporated corp corporation co company ltd limited llc plc ag sa nv bv gmbh lp llp holding holdings group".split()


def normalize_name(name: Column) -> Column:
    """White space collapsed, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


def name_tokens(name: Column) -> Column:
    """Distinct alphanumeric tokens without legal suffixes."""
    tokens = F.array_distinct(F.filter(F.split(F.lower(name), "[^0-9a-z]+"), lambda t: t != ""))
    return F.array_except(tokens, F.array(*[F.lit(s) for s in LEGAL_SUFFIXES]))


def overlap(a: Column, b: Column) -> Column:
    """Overlap coefficient of two token arrays, 0 where one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def csv_cell(text: Column) -> Column:
    """Cells that a spreadsheet would run as a formula get a leading apostrophe."""
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def tier_label(percent: Column) -> Column:
    return F.concat(F.lit("p"), percent.cast("string"))


def tier_percent(label: Column) -> Column:
    return F.regexp_extract(label, r"^p([1-9]\d{0,3})$", 1).try_cast("int")


def sign_label(value: Column, up: str = "up", down: str = "down", flat: str = "flat") -> Column:
    return F.when(value > 0, up).when(value < 0, down).otherwise(flat)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; expressions inside lambdas and conditions are not shared otherwise."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def headline_title(title: Column) -> Column:
    """A title without its trailing publisher."""
    return F.regexp_replace(F.trim(title), r"\s+-\s+[^-]{1,80}$", "")


def number(text: Column) -> Column:
    """A number with optional thousands separators, else null."""
    plain = text.rlike(r"^[+-]?((\d+|\d{1,3}(,\d{3})+)(\.\d*)?|\.\d+)([eE][+-]?\d+)?$")
    return F.when(plain, F.regexp_replace(text, ",", "").try_cast("double"))


def public_url(url: Column) -> Column:
    """Whether a provenance address is https with a dotted host, local: or file:///."""
    host = F.try_parse_url(url, F.lit("HOST"))
    private = host.rlike(r"^(localhost|127\.|10\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.|169\.254\.)")
    return F.coalesce((url.rlike("^https://") & host.contains(".") & ~private) | url.rlike(r"^local:\S+") | url.rlike("^file:///"), F.lit(False))
