"""Order-dependent rules as folds: each row's decision depends on the decisions before it.

Rows are dealt by run and sorted inside tasks; a task streams through them batch by batch with only the counters of the run at hand in
memory, so a run may be of any length. Runs (cities, tracks) spread over tasks; the sequence of one run is serial by its meaning.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Fixed values.
LEAST_WEATHER, LEAST_OCCLUSION, TARGET, MOST, LEAST_SHARE, CAPABILITY = 0.55, 0.58, 0.25, 0.30, 0.20, 0.25
ORDER = ("global", "local", "dual")
WEATHER_ORDER, SAFE_WEATHERS, WEATHER_SHARE, MOST_WEATHER = ("overcast", "fog", "rain", "snow", "night"), ("overcast", "fog"), 0.20, 0.50


def fold_rows(df: DataFrame, key: str, order: str, start: Callable[[], Any], step: Callable[[Any, Any], tuple | None], schema: str) -> DataFrame:
    """The rows that step(state, row) makes of each key's rows in order; state is made anew by start() for each key (null is a key of its own)."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, at = None, None
        for batch in batches:
            out, row_of = [], namedtuple("Row", batch.schema.names)  # values as they are: pandas would turn long keys beside a null into doubles
            for row in map(row_of._make, zip(*(c.to_pylist() for c in batch.columns))):
                k = getattr(row, key)
                if state is None or k != at and (k == k or at == at):
                    state, at = start(), k
                got = step(state, row)
                if got is not None:
                    out.append(got)
            yield pa.record_batch([pa.array([r[k] for r in out], f.type) for k, f in enumerate(kinds)], names=kinds.names)

    return df.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, schema)


def _choice(n: dict[str, int], w: float, o: float) -> str:
    """The route with the highest score among those under the cap (all eligible ones if none is)."""
    total = float(sum(n.values()) + 1)
    worth = {"global": w, "local": o, "dual": min(w, o)}
    fit = {"global": w >= LEAST_WEATHER, "local": o >= LEAST_OCCLUSION}
    fit["dual"] = fit["global"] and fit["local"]
    rows = []
    for place, r in enumerate(ORDER):
        if fit[r]:
            share, lack = n[r] / total, TARGET * total - n[r]
            rows.append((share <= MOST, (2 * lack if share < LEAST_SHARE else lack) + CAPABILITY * worth[r], -place, r))
    return max(rows)[3] if rows else "skip"


def _weather(row, made: dict[str, int], passed: dict[str, int]) -> str:
    """The weather that lacks most passed images, among those that the scene allows and that are not over the cap; ties by the row's tie number."""
    pool = [x for x in WEATHER_ORDER if not row.restricted or x in SAFE_WEATHERS]
    pool = [x for x in pool if x in row.safe] or pool
    n = sum(made.values())
    pool = [x for x in pool if not n or made[x] / n <= MOST_WEATHER] or pool
    planned = sum(passed.values()) + 1
    lack = {x: WEATHER_SHARE * planned - passed[x] for x in pool}
    best = [x for x in pool if lack[x] == max(lack.values())]
    return best[int(row.tie) % len(best)]


def schedule(df: DataFrame, run: str = "run", order: str = "ord") -> DataFrame:
    """(run, ord, route, weather) of rows (run, ord, w, o, bad): bad rows are skipped unscored, null scores count as 0.

    Optional columns: after_global, after_local, after_dual (what the policies make of a row that is given this route; counters follow the
    route after them), and restricted, safe, tie, passed, with which every global row also gets its weather by quota
    (passed: whether the image passes once it is made, which the next rows' quota sees). Without them weather is null.
    """
    names = set(df.columns)
    kinds = df.schema
    after = {r: f"after_{r}" for r in ORDER if f"after_{r}" in names}
    weathers = {"restricted", "safe", "tie", "passed"} <= names
    clean = df.withColumns({"w": F.coalesce(F.col("w").cast("double"), F.lit(0.0)), "o": F.coalesce(F.col("o").cast("double"), F.lit(0.0)), "bad": F.coalesce("bad", F.lit(False))})
    if weathers:
        clean = clean.withColumns({"safe": F.coalesce("safe", F.array().cast("array<string>")), "restricted": F.coalesce("restricted", F.lit(False)), "passed": F.coalesce("passed", F.lit(False)), "tie": F.coalesce("tie", F.lit(0))})
    used = [run, order, "w", "o", "bad", *after.values(), *(("restricted", "safe", "tie", "passed") if weathers else ())]

    def start() -> tuple[dict, dict, dict]:
        return dict.fromkeys(("skip", *ORDER), 0), dict.fromkeys(WEATHER_ORDER, 0), dict.fromkeys(WEATHER_ORDER, 0)

    def step(state, row) -> tuple:
        n, made, passed = state
        route = "skip" if row.bad else _choice(n, row.w, row.o)
        route = getattr(row, after[route]) if route in after else route
        weather = None
        if weathers and route == "global":
            weather = _weather(row, made, passed)
            made[weather] += 1
            passed[weather] += bool(row.passed)
        n[route] += 1
        return getattr(row, run), getattr(row, order), route, weather

    kind = lambda c: kinds[c].dataType.simpleString()
    return fold_rows(clean.select(*used), run, order, start, step, f"{run} {kind(run)}, {order} {kind(order)}, route string, weather string")


def accumulate_select(df: DataFrame, key: str, order: str, amount: str, limit: float) -> DataFrame:
    """Rows at which the running amount since the last chosen row reaches the limit (the first row of a key is chosen); null amounts count as 0."""

    def step(state: list, row) -> tuple | None:
        state[0] = state[0] + getattr(row, amount)
        if state[0] < limit:
            return None
        state[0] = 0.0
        return getattr(row, key), getattr(row, order)

    kind = lambda c: df.schema[c].dataType.simpleString()
    rows = df.select(key, order, F.coalesce(F.col(amount).cast("double"), F.lit(0.0)).alias(amount))
    return fold_rows(rows, key, order, lambda: [float("inf")], step, f"{key} {kind(key)}, {order} {kind(order)}")


# Motion that counts as none, the least step, seconds after which a frame is due, and the likeness of a repeat.
STILL, LEAST_STEP, DUE_SECONDS, SAME = 1.0, 5.0, 4.0, 0.999


def _alike(hist: np.ndarray, others: list[np.ndarray]) -> bool:
    """Whether a histogram is nearly one of the others by correlation (1 where one of the two has no variance)."""
    a = hist - hist.mean()
    for other in others:
        b = other - other.mean()
        size = float((a * a).sum() * (b * b).sum())
        if (float((a * b).sum()) / size**0.5 if size > 2.0**-52 else 1.0) > SAME:
            return True
    return False


def motion_frames(samples: DataFrame, key: str, fps: float, most: int) -> DataFrame:
    """(key, idx) of the frames to keep of each track: (key, idx, motion: since the sample before, hist: array of numbers).

    A frame is due when the motion since the last kept one reaches its share of the track's motion (5 at least; motion under 1 counts as none), or four seconds
    have passed; it is kept unless its histogram repeats that of a kept one. The first frame is kept, and the last one if it is no repeat.
    """
    ends = samples.groupBy(key).agg(F.min("idx").alias("_first"), F.max("idx").alias("_last"), F.sum(F.coalesce("motion", F.lit(0.0))).alias("_all"), F.min_by("motion", "idx").alias("_own"))
    share = (F.col("_all") - F.coalesce("_own", F.lit(0.0))) / most if most > 0 else F.col("_all") - F.coalesce("_own", F.lit(0.0))
    ends = ends.select(F.col(key).alias("_key"), "_first", "_last", F.greatest(F.lit(STILL * LEAST_STEP), share).alias("_step"))
    rows = samples.join(ends, F.equal_null(F.col(key), F.col("_key"))).select(key, "idx", F.coalesce("motion", F.lit(0.0)).alias("motion"), F.col("hist").cast("array<double>").alias("hist"), F.col("_last").alias("last"), F.col("_step").alias("step"))

    def step(state: dict, row) -> tuple | None:
        hist = np.array(row.hist, float)
        if not state["hists"]:
            state.update(hists=[hist], at=row.idx)
            return getattr(row, key), row.idx
        state["moved"] += row.motion if row.motion >= STILL else 0.0
        due = state["moved"] >= row.step or row.idx - state["at"] > DUE_SECONDS * fps
        if (due or row.idx == row.last) and not _alike(hist, state["hists"]):
            state["hists"].append(hist)
            state.update(moved=0.0, at=row.idx)
            return getattr(row, key), row.idx
        return None

    kind = lambda c: samples.schema[c].dataType.simpleString()
    return fold_rows(rows, key, "idx", lambda: {"hists": [], "moved": 0.0, "at": 0}, step, f"{key} {kind(key)}, idx {kind('idx')}")
