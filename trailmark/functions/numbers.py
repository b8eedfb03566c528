"""Number rules as columns: lenient parsing, seeds, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def score(col: Column) -> Column:
    """A number in [0, 1]: text is parsed, values over 1 count in tenths, what does not parse is 0."""
    x = F.coalesce(col.try_cast("double"), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(x > 1, x / 10).otherwise(x)))


def round_even(col: Column, digits: int = 4) -> Column:
    """col rounded to so many digits by its exact binary value, ties to even, as decimal rounding of the double is defined.

    The product with a power of ten is taken with its rounding error (both factors split in halves), so what lies over or under
    a half is told apart where the product alone says a half. Numbers from 2**52 / 10**digits on are whole at that digit and stay.
    """
    power = float(10**digits)
    half = lambda x: x * 134217729.0 - (x * 134217729.0 - x)  # noqa: E731  the upper half of a double's digits
    high_p = power * 134217729.0 - (power * 134217729.0 - power)
    low_p = power - high_p
    x = col.cast("double")
    size = F.abs(x)
    product, high = size * power, half(size)
    low = size - high
    error = ((high * high_p - product) + high * low_p + low * high_p) + low * low_p
    whole = F.floor(product).cast("double")
    over = (product - whole - 0.5) + error
    up = (over > 0) | ((over == 0) & (whole % 2 == 1))
    made = F.when(up, whole + 1).otherwise(whole) / power
    return F.when(x.isNull() | F.isnan(x) | (product >= 2.0**52), x).otherwise(F.when(x < 0, -made).otherwise(made))


def boolish(col: Column) -> Column:
    return F.coalesce(F.lower(F.trim(col.cast("string"))).isin("1", "true", "yes", "y"), F.lit(False))


def seed(base: int, sample: Column, path: Column) -> Column:
    """1 + the first eight hex digits of a digest, modulo 2e9."""
    digest = F.sha2(F.concat_ws("|", F.lit(str(base)), sample, path), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 2_000_000_000 + 1


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def square_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
