"""Rigid 4 x 4 transforms as columns: arrays of 16 numbers by rows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType


def pose(rotation: list[list[Column]], translation: list[Column]) -> Column:
    rows = [[*rotation[i], translation[i]] for i in range(3)]
    return F.array(*(c.cast("double") for row in rows for c in row), *(F.lit(float(x)) for x in (0, 0, 0, 1)))


@F.pandas_udf(StructType().add("cos", DoubleType()).add("sin", DoubleType()))
def turned(angle: pd.Series) -> pd.DataFrame:
    """Cosine and sine by the system's library: the JVM's own have another last digit for one angle in five hundred."""
    return pd.DataFrame({f.__name__: [f(a) if math.isfinite(a) else None for a in angle.tolist()] for f in (math.cos, math.sin)}, dtype="float64")


def yaw_pose(angle: Column, translation: list[Column], exact: Column | None = None) -> Column:
    """A turn about the y axis and a translation. exact: the angle's `turned`, where the last digits decide."""
    c, s = (F.cos(angle), F.sin(angle)) if exact is None else (exact["cos"], exact["sin"])
    one, none = F.lit(1.0), F.lit(0.0)
    return pose([[c, none, s], [none, one, none], [-s, none, c]], translation)


def cell(m: Column, row: int, col: int) -> Column:
    return m[4 * row + col]


def inverse(m: Column) -> Column:
    """The inverse of a rigid transform: its rotation transposed, its translation turned back."""
    back = [[cell(m, j, i) for j in range(3)] for i in range(3)]
    return pose(back, [-sum((back[i][j] * cell(m, j, 3) for j in range(1, 3)), back[i][0] * cell(m, 0, 3)) for i in range(3)])


def product(a: Column, b: Column) -> Column:
    return F.array(*(sum((cell(a, i, k) * cell(b, k, j) for k in range(1, 4)), cell(a, i, 0) * cell(b, 0, j)) for i in range(4) for j in range(4)))


def moved(m: Column, x: Column, y: Column, z: Column) -> list[Column]:
    """A point after a transform."""
    return [cell(m, i, 0) * x + cell(m, i, 1) * y + cell(m, i, 2) * z + cell(m, i, 3) for i in range(3)]


def along(m: Column, x: Column, y: Column, z: Column) -> list[Column]:
    """The point at depth z in the direction (x, y, 1) after a transform."""
    return [cell(m, i, 0) * x * z + cell(m, i, 1) * y * z + cell(m, i, 2) * z + cell(m, i, 3) for i in range(3)]


def seen_from(m: Column, x: Column, y: Column, z: Column) -> list[Column]:
    """A point before a rigid transform; the translation goes first, so a point near it loses no digits."""
    d = [p - cell(m, j, 3) for j, p in enumerate((x, y, z))]
    return [cell(m, 0, i) * d[0] + cell(m, 1, i) * d[1] + cell(m, 2, i) * d[2] for i in range(3)]


def _step(x: Column, limit: float) -> Column:
    return F.when(x > limit, 2).when(x < -limit, 0).otherwise(1)


def action(before: Column, now: Column, move: float, turn: float, turned: Column | None = None) -> Column:
    """Base-3 code of the change between two poses: forward, right, up and yaw, each 0 (back), 1 (none) or 2; 0 without a pose before.

    turned: the turn about the y axis, if known better than from the poses.
    """
    change = product(inverse(before), now)
    yaw = F.atan2(cell(change, 0, 2), cell(change, 2, 2)) if turned is None else F.atan2(F.sin(turned), F.cos(turned))
    code = _step(cell(change, 2, 3), move) * 27 + _step(cell(change, 0, 3), move) * 9 + _step(cell(change, 1, 3), move) * 3 + _step(yaw, turn)
    return F.when(before.isNull(), 0).otherwise(code)
