"""Order-dependent operators on bounded groups (an image, a mask, a pair): suppression, components, homographies.

Rows are dealt by key and sorted inside tasks; a task walks through its groups batch by batch, so many small groups share
one Arrow batch and only the group at hand is in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def per_group(df: DataFrame, key: str, one: Callable[[dict[str, np.ndarray]], list[tuple]], schema: str) -> DataFrame:
    """Rows (key, ...) that `one` makes of each group's columns; null keys are one group. Keys stay Arrow values, whatever their type."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, {schema}"
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def made(t: pa.Table, cuts: list[int]) -> pa.RecordBatch:
        cols = {c: t.column(c).to_numpy() for c in t.column_names if c != key}
        rows, of = [], []
        for a, b in zip(cuts, cuts[1:]):
            got = one({c: v[a:b] for c, v in cols.items()})
            rows += got
            of += [a] * len(got)
        keys = t.column(key).take(pa.array(of, pa.int64())).combine_chunks()
        return pa.record_batch([keys, *(pa.array([r[k] for r in rows], f.type) for k, f in enumerate(list(kinds)[1:]))], names=kinds.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            t = pa.Table.from_batches([*rest, batch])
            codes = t.column(key).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist()]
            rest = t.slice(cuts[-1]).to_batches()
            if len(cuts) > 1:
                yield made(t, cuts)
        if rest:
            t = pa.Table.from_batches(rest)
            yield made(t, [0, t.num_rows])

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def suppress(boxes: DataFrame, key: str, limit: float = 0.5) -> DataFrame:
    """Greedy non-maximum suppression of boxes (id, x0, y0, x1, y1, score) inside a key (one image and class)."""

    def one(c: dict[str, np.ndarray]) -> list[tuple]:
        order = np.lexsort((c["id"], -c["score"]))
        x0, y0, x1, y1, ids = (c[n][order] for n in ("x0", "y0", "x1", "y1", "id"))
        area, alive, kept = (x1 - x0) * (y1 - y0), np.ones(len(ids), bool), []
        for i in range(len(ids)):
            if alive[i]:
                kept.append((ids[i],))
                shared = np.maximum(np.minimum(x1, x1[i]) - np.maximum(x0, x0[i]), 0) * np.maximum(np.minimum(y1, y1[i]) - np.maximum(y0, y0[i]), 0)
                alive &= shared <= limit * (area + area[i] - shared)
        return kept

    return per_group(boxes.select(key, "id", "x0", "y0", "x1", "y1", "score"), key, one, "id long")


def components(y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> list[tuple]:
    """(n, cx, cy) of the 8-connected components of one mask's runs: pixels and centroid of each."""
    rows = sorted(zip(y.tolist(), x0.tolist(), x1.tolist()))
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    above: list[int] = []  # runs of the row before, and of this one
    same: list[int] = []
    for i, (row, a, b) in enumerate(rows):
        if same and rows[same[0]][0] != row:
            above, same = (same if rows[same[0]][0] == row - 1 else []), []
        for j in above + same:
            if rows[j][1] <= b and a <= rows[j][2]:  # touching at a corner counts
                root[find(i)] = find(j)
        same.append(i)
    size: dict[int, list[int]] = {}
    for i, (row, a, b) in enumerate(rows):
        s = size.setdefault(find(i), [0, 0, 0])
        s[0] += b - a
        s[1] += (a + b - 1) * (b - a) // 2
        s[2] += row * (b - a)
    return [(n, sx / n + 0.5, sy / n + 0.5) for n, sx, sy in size.values()]


def component_rows(runs: DataFrame, key: str) -> DataFrame:
    """(key, n, cx, cy) of the 8-connected components of masks given as run-length rows (y, x0, x1): pixels and centroid of each."""
    return per_group(runs.select(key, "y", "x0", "x1"), key, lambda c: components(c["y"], c["x0"], c["x1"]), "n long, cx double, cy double")


def components8(runs: DataFrame, key: str) -> DataFrame:
    """The number of 8-connected components of each mask and the largest one's pixels."""
    return component_rows(runs, key).groupBy(key).agg(F.count("*").alias("components"), F.max("n").alias("largest"))


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """Homography through point pairs by the direct linear transform on normalised points."""

    def normal(p):
        c = p.mean(0)
        s = np.sqrt(2) / max(np.sqrt(((p - c) ** 2).sum(1)).mean(), 1e-12)
        return np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])

    ta, tb = normal(a), normal(b)
    pa, pb = (np.column_stack((p, np.ones(len(p)))) @ t.T for p, t in ((a, ta), (b, tb)))
    z = np.zeros_like(pa)
    m = np.vstack((np.hstack((pa, z, -pb[:, :1] * pa)), np.hstack((z, pa, -pb[:, 1:2] * pa))))
    h = np.linalg.inv(tb) @ np.linalg.svd(m)[2][-1].reshape(3, 3) @ ta
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else None


def homographies(matches: DataFrame, key: str, pixels: float = 3.0, rounds: int = 2000, confidence: float = 0.995) -> DataFrame:
    """RANSAC homography of each pair's matches (x0, y0, x1, y1): 9 numbers and the inliers; null with under 4 matches."""

    def one(c: dict[str, np.ndarray]) -> list[tuple]:
        order = np.lexsort((c["y1"], c["x1"], c["y0"], c["x0"]))
        a, b = np.column_stack((c["x0"], c["y0"])).astype(float)[order], np.column_stack((c["x1"], c["y1"])).astype(float)[order]
        rng, best, need, k = np.random.default_rng(0), np.zeros(len(a), bool), rounds, 0

        def inside(h):
            q = np.column_stack((a, np.ones(len(a)))) @ h.T
            with np.errstate(divide="ignore", invalid="ignore"):
                return np.hypot(*(q[:, :2] / q[:, 2:] - b).T) <= pixels

        while len(a) >= 4 and k < need:
            pick = rng.choice(len(a), 4, replace=False)
            h = _solve(a[pick], b[pick])
            if h is not None and (ok := inside(h)).sum() > best.sum():
                best = ok
                w = min(ok.mean() ** 4, 1 - 1e-9)
                need = min(rounds, int(np.ceil(np.log(1 - confidence) / np.log(1 - w))) if w > 0 else rounds)
            k += 1
        h = _solve(a[best], b[best]) if best.sum() >= 4 else None
        return [(None if h is None else h.ravel().tolist(), len(a), int(best.sum()))]

    return per_group(matches.select(key, "x0", "y0", "x1", "y1"), key, one, "h array<double>, matches long, inliers long")
