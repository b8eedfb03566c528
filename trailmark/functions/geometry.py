"""Image coordinates and homographies as columns: points are structs or pairs of columns, a homography is an array of 9 numbers by rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_normalized(x: Column, y: Column, height: Column, width: Column) -> tuple[Column, Column]:
    """Pixels to shares of the image."""
    return x.cast("double") / width, y.cast("double") / height


def to_pixels(x: Column, y: Column, height: Column, width: Column) -> tuple[Column, Column]:
    return x * width, y * height


def projected(h: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """A point through a homography; a point at infinity becomes null."""
    at = lambda r: h[3 * r] * x + h[3 * r + 1] * y + h[3 * r + 2]
    w = F.nullif(at(2), F.lit(0.0))
    return at(0) / w, at(1) / w


def corner_error(h: Column, true: Column, width: Column, height: Column, width_to: Column, height_to: Column) -> Column:
    """Largest difference, in shares of the second image, between where h takes the first image's corners and where they truly lie.

    true: array of 8 numbers, x and y of the corners from the upper left one on, clockwise. Infinite without a homography or for a corner at infinity.
    """
    zero = F.lit(0.0)
    far = []
    for k, (x, y) in enumerate(((zero, zero), (width, zero), (width, height), (zero, height))):
        u, v = projected(h, x, y)
        far += [F.abs(true[2 * k] - u / width_to), F.abs(true[2 * k + 1] - v / height_to)]
    known = F.lit(True)
    for f in far:
        known = known & f.isNotNull()
    return F.when(h.isNotNull() & known, F.greatest(*far)).otherwise(F.lit(float("inf")))


def ratios(text: Column, defaults: dict[str, float]) -> Column:
    """Shares by name from a `name:number,...` text, the defaults overridden and scaled to 1; unknown names and what is no number are passed over.

    Negative numbers count as 0; of a repeated name the last counts. Without any usable entry, or where all would be 0, the defaults stay as they are.
    """
    parts = F.transform(F.split(F.trim(F.coalesce(text, F.lit(""))), ","), lambda p: F.struct(F.lower(F.trim(F.substring_index(p, ":", 1))).alias("k"), F.when(F.contains(p, F.lit(":")), F.trim(F.regexp_replace(p, r"(?s)^[^:]*:", "")).try_cast("double")).alias("v")))
    used = F.filter(parts, lambda p: p["k"].isin(*defaults) & p["v"].isNotNull())
    value = {k: F.try_element_at(F.filter(used, lambda p: p["k"] == k), F.lit(-1))["v"] for k in defaults}  # noqa: B023
    new = {k: F.when(v.isNotNull(), F.greatest(v, F.lit(0.0))).otherwise(float(defaults[k])) for k, v in value.items()}
    total = sum(list(new.values())[1:], list(new.values())[0])
    made = F.create_map(*(x for k, v in new.items() for x in (F.lit(k), v / F.nullif(total, F.lit(0.0)))))
    plain = F.create_map(*(F.lit(x) for k, v in defaults.items() for x in (k, float(v))))
    return F.when((F.size(used) > 0) & (total > 0), made).otherwise(plain)
