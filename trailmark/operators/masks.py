"""Masks as run-length rows (y, x0, x1): compact ellipses in their place, and candidate footprints with their coverage.

Parameters, template sizes, geometry and choices are columns; only what walks over pixels (overlap of a shape at many places, rasters,
dilation) is a helper that sees one mask's runs or some candidates' boxes, and gives runs or sums back. Pixels are never rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions import numbers as N

from .grouped import component_rows, components

# Fixed values.
ASPECTS = (1.0, 0.75, 4 / 3, 0.5, 2.0)
LEAST_RATIO, MOST_RATIO, CENTRES, BROADCAST_SIZES = 0.04, 0.08, 32, 2000
SHAPES = ("horizontal_compact", "vertical_rectangle", "facade_rectangle", "cone_triangle", "compact_irregular_blob")
GRID = 16

RUNS = "array<struct<y: int, x0: int, x1: int>>"


def _sums(spans: Column) -> Column:
    """Pixels, sums of their x and y, and of x * x + y * y, of runs."""
    zero = F.struct(*(F.lit(0).cast("long").alias(c) for c in ("n", "sx", "sy", "ss")))

    def add(s: Column, r: Column) -> Column:
        n, a, b, y = (r["x1"] - r["x0"]).cast("long"), r["x0"].cast("long"), r["x1"].cast("long"), r["y"].cast("long")
        to = lambda k: (k - 1) * k * (2 * k - 1) / 6  # noqa: E731  squares below k
        return F.struct((s["n"] + n).alias("n"), (s["sx"] + ((a + b - 1) * n / 2).cast("long")).alias("sx"), (s["sy"] + y * n).alias("sy"), (s["ss"] + y * y * n + (to(b) - to(a)).cast("long")).alias("ss"))

    return F.aggregate(spans, zero, add)


def _compactness(n: Column, sx: Column, sy: Column, ss: Column) -> Column:
    """Area squared over 2 pi times the polar second moment, in which every pixel is a unit square: 1 for a disk."""
    moment = ss - (sx * sx + sy * sy) / n + n / 6
    return F.when(n > 0, F.least(F.lit(1.0), n * n / (F.lit(2 * math.pi) * moment))).otherwise(0.0)


def ellipses(sizes: DataFrame) -> DataFrame:
    """(w, h, spans, area, cx, cy, compactness) of filled ellipses by the centres of their pixels, from (w, h)."""
    w, h = F.col("w"), F.col("h")

    def row(y: Column) -> Column:
        v = (y + 0.5 - h / 2) / (h / 2)
        half = w / 2 * F.sqrt(F.greatest(F.lit(0.0), 1 - v * v))
        return F.struct(y.cast("int").alias("y"), F.greatest(F.lit(0), F.ceil(w / 2 - half - 0.5)).cast("int").alias("x0"), F.least(w, F.floor(w / 2 + half - 0.5) + 1).cast("int").alias("x1"))

    spans = F.filter(F.transform(F.sequence(F.lit(0), h - 1), row), lambda r: r["x0"] < r["x1"])
    s = sizes.distinct().withColumn("spans", spans).withColumn("s", _sums(F.col("spans")))
    n = F.col("s.n")
    return s.select("w", "h", "spans", n.alias("area"), (F.col("s.sx") / n + 0.5).alias("cx"), (F.col("s.sy") / n + 0.5).alias("cy"), _compactness(n, *(F.col(f"s.{c}") for c in ("sx", "sy", "ss"))).alias("compactness"))


def _prefixes(of: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray, many: int, width: int, height: int) -> np.ndarray:
    """Row prefix sums (mask, y, x) of masks of one size; `of` tells which mask a run belongs to."""
    size = width + 2
    line = (of * height + y) * size + 1
    ends = (np.clip(x, 0, width) for x in (x0, x1))
    starts, stops = (np.bincount(line + e, minlength=many * height * size) for e in ends)
    covered = np.cumsum((starts - stops).reshape(many, height, size), axis=2, dtype=np.int32)
    return np.cumsum(covered, axis=2, dtype=np.int32)[:, :, : width + 1]


def _best_places(seen: np.ndarray, shape: tuple, mx: np.ndarray, my: np.ndarray) -> tuple:
    """Best place of one shape over each of many masks of one size, at every pixel: (x, y, overlap, away, places tried)."""
    dy, left, right, cx, cy = shape
    ny, nx = seen.shape[1] - int(dy.max()), seen.shape[2] - int(right.max())
    shared = np.zeros((len(seen), ny, nx), np.int32)
    for d, a, b in zip(dy, left, right):
        shared += seen[:, d : d + ny, b : b + nx] - seen[:, d : d + ny, a : a + nx]
    away = ((np.arange(nx) + cx - mx[:, None]) ** 2)[:, None, :] + ((np.arange(ny) + cy - my[:, None]) ** 2)[:, :, None]
    shared, away = shared.reshape(len(seen), -1), away.reshape(len(seen), -1)
    most = shared.max(axis=1)
    at = np.where(shared == most[:, None], away, np.inf).argmin(axis=1)  # the first of equals: least y, then x
    return at % nx, at // nx, most, away[np.arange(len(seen)), at], ny * nx


def _best_place(seen: np.ndarray, shape: tuple, centre: tuple, centres: list[tuple], stride: int, refine: int) -> tuple:
    """Best place of one shape over one mask, given by row prefix sums: on a grid and at the given centres, then pixel by pixel around the best of them."""
    dy, left, right, cx, cy = shape
    height, width = seen.shape[0], seen.shape[1] - 1
    tw, th = int(right.max()), int(dy.max()) + 1
    xmax, ymax = width - tw, height - th

    def ranked(places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        y, x = np.divmod(places, width + 1)
        shared = np.zeros(len(places), np.int64)
        for d, a, b in zip(dy, left, right):
            shared += seen[y + d, x + b] - seen[y + d, x + a]
        away = (x + cx - centre[0]) ** 2 + (y + cy - centre[1]) ** 2
        return shared, away, np.lexsort((x, y, away, -shared))

    grid = lambda most: np.unique(np.append(np.arange(0, most + 1, stride), most))
    places = (grid(ymax)[:, None] * (width + 1) + grid(xmax)).ravel()
    tried = [(min(max(np.rint(c[1] - cy), 0), ymax), min(max(np.rint(c[0] - cx), 0), xmax)) for c in [centre, *centres]]
    places = np.unique(np.append(places, [int(y) * (width + 1) + int(x) for y, x in tried]))
    shared, away, order = ranked(places)
    fine = [np.arange(max(0, y - stride), min(ymax, y + stride) + 1)[:, None] * (width + 1) + np.arange(max(0, x - stride), min(xmax, x + stride) + 1) for y, x in zip(*np.divmod(places[order[:refine]], width + 1))]
    places = np.unique(np.concatenate([places, *(f.ravel() for f in fine)]))
    shared, away, order = ranked(places)
    best = order[0]
    y, x = divmod(int(places[best]), width + 1)
    return x, y, shared[best], away[best], len(places)


_PLACES = "array<struct<x: int, y: int, overlap: bigint, away: double, evaluated: bigint>>"


def _search(stride: int | None, refine: int, keep: list[str]):
    """The best place of every chosen shape of every mask; masks of one size are searched together where every pixel is tried."""

    def places(batch: pa.RecordBatch) -> pa.Array:
        runs, chosen = batch.column("runs"), batch.column("chosen")
        number = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
        width, height, mx, my = (number(c) for c in ("width", "height", "mx", "my"))
        row_of = lambda lists: np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        flat, run_row, asked, asked_row = runs.flatten(), row_of(runs), chosen.flatten(), row_of(chosen)
        y, x0, x1 = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
        w, h, cx, cy = (asked.field(c).to_numpy(zero_copy_only=False) for c in ("w", "h", "cx", "cy"))
        spans = asked.field("spans")
        found = [np.zeros(len(asked), t) for t in (np.int32, np.int32, np.int64, np.float64, np.int64)]
        order = np.lexsort((h, w, asked_row, height[asked_row], width[asked_row]))
        start = 0
        while start < len(order):  # masks of one size, some million pixels at most at once
            first = asked_row[order[start]]
            wide, high = int(width[first]), int(height[first])
            part = order[start : start + max(1, 2_000_000 // (wide * high))]
            part = part[(width[asked_row[part]] == wide) & (height[asked_row[part]] == high)]
            start += len(part)
            rows, at = np.unique(asked_row[part], return_inverse=True)
            place = np.full(batch.num_rows, -1)
            place[rows] = np.arange(len(rows))
            mine = place[run_row] >= 0
            seen = _prefixes(place[run_row[mine]], y[mine], x0[mine], x1[mine], len(rows), wide, high)
            step = stride or max(1, min(wide, high) // 32)
            for size in np.unique(np.stack([w[part], h[part]]), axis=1).T:
                same = np.flatnonzero((w[part] == size[0]) & (h[part] == size[1]))
                one = part[same[0]]
                shape = (*(spans[int(one)].values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)), cx[one], cy[one])
                if step == 1:
                    got = _best_places(seen[at[same]], shape, mx[rows[at[same]]], my[rows[at[same]]])
                    for out, v in zip(found, got):
                        out[part[same]] = v
                    continue
                for k in same:
                    r, own = rows[at[k]], run_row == rows[at[k]]
                    parts = [p[1:] for p in sorted(components(y[own], x0[own], x1[own]), reverse=True)[:CENTRES]]
                    for out, v in zip(found, _best_place(seen[at[k]], shape, (mx[r], my[r]), parts, step, refine)):
                        out[part[k]] = v
        ends = np.append(0, np.cumsum(chosen.value_lengths().to_numpy(zero_copy_only=False)))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(f) for f in found], names=["x", "y", "overlap", "away", "evaluated"]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([*(batch.column(c) for c in keep), places(batch)], names=[*keep, "places"])

    return search


def adapt_masks(runs: DataFrame, images: DataFrame, ratio: float = 0.06, least_overlap: float = 0.7, tolerance: float = 0.05, aspects: tuple[float, ...] = ASPECTS, stride: int | None = None, refine: int = 8, least_gain: float = 0.0) -> DataFrame:
    """A filled ellipse in the place of every mask, with diagnostics; images: (mask, width, height), runs: (mask, y, x0, x1) without overlaps.

    The ellipse takes ratio of the image, within the tolerance and 4 to 8 percent, is no less compact than the mask, and lies where most of
    it is in the mask: ranked by overlap, distance of the centroids, area, compactness, y, x. A mask without runs, or where nothing fits,
    has its failure_reason; null keys are no masks. spans are the ellipse's runs, to be shifted by x and y (`adapted_runs`).
    """
    if not LEAST_RATIO <= ratio <= MOST_RATIO or not 0 < least_overlap <= 1 or not 0 <= tolerance <= 0.25 or not 0 <= least_gain <= 1:
        raise ValueError("ratio, overlap, tolerance or gain out of range")
    if refine < 1 or not aspects or any(not 0.5 <= a <= 2 for a in aspects) or (stride is not None and stride < 1):
        raise ValueError("refine, aspects or stride out of range")
    a, b, y = (F.col(c).cast("int").cast("long") for c in ("x0", "x1", "y"))
    below = lambda k: (k - 1) * k * (2 * k - 1) / 6  # noqa: E731  squares below k
    packed = runs.groupBy("mask").agg(  # one image's runs
        F.collect_list(F.struct(*(F.col(c).cast("int").alias(c) for c in ("y", "x0", "x1")))).alias("runs"), F.sum(b - a).alias("n"), F.sum(((a + b - 1) * (b - a) / 2).cast("long")).alias("sx"),
        F.sum(y * (b - a)).alias("sy"), F.sum(y * y * (b - a) + (below(b) - below(a)).cast("long")).alias("ss"),
    )
    sized = images.select("mask", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"))
    m = sized.join(packed, "mask", "left")
    pixels = F.col("width").cast("double") * F.col("height")
    m = m.withColumns({"runs": F.coalesce("runs", F.array().cast(RUNS)), "n": F.coalesce("n", F.lit(0)), "some": F.nullif(F.col("n"), F.lit(0)), "target": F.lit(ratio) * pixels})
    bounds = {
        "least": F.greatest(F.lit(1), F.ceil(F.greatest(LEAST_RATIO * pixels, F.col("target") * (1 - tolerance)))),
        "most": F.floor(F.least(MOST_RATIO * pixels, F.col("target") * (1 + tolerance))),
    }
    m = m.withColumns({**bounds, "mx": F.col("sx") / F.col("some") + 0.5, "my": F.col("sy") / F.col("some") + 0.5, "before": _compactness(F.col("some"), *map(F.col, ("sx", "sy", "ss")))})
    early = F.when(F.col("n") == 0, "empty_vulnerability_mask").when(F.col("most") < F.col("least"), "no_integer_area_in_requested_tolerance").when(F.col("n") < F.ceil(least_overlap * F.col("least")), "insufficient_vulnerability_area_for_required_overlap")
    m = m.withColumn("early", early)

    # What may be placed depends on the image's size alone; a mask takes the first of each aspect that is compact enough.
    order = sorted(set(aspects))
    wide, high = F.rint(F.sqrt(4 * F.col("target") * F.col("aspect") / math.pi)).cast("int"), F.rint(F.sqrt(4 * F.col("target") / (F.col("aspect") * math.pi))).cast("int")
    near = lambda c, most: F.explode(F.sequence(F.greatest(F.lit(1), c - 2), F.greatest(F.greatest(F.lit(1), c - 2), F.least(most, c + 2))))
    sizes = sized.select("width", "height").distinct().withColumn("target", F.lit(ratio) * pixels).withColumns(bounds)
    sizes = sizes.withColumn("aspect", F.explode(F.array(*map(F.lit, order)))).withColumn("w", near(wide, F.col("width"))).withColumn("h", near(high, F.col("height")))
    sizes = sizes.where((F.col("w") <= F.col("width")) & (F.col("h") <= F.col("height")) & (F.col("w") / F.col("h")).between(0.5, 2.0))
    fit = sizes.join(ellipses(sizes.select("w", "h")), ["w", "h"]).where((F.col("area") >= F.col("least")) & (F.col("area") <= F.col("most")))
    fit = fit.select("width", "height", F.struct("aspect", F.abs(F.col("area") - F.col("target")).alias("off"), F.abs(F.col("w") / F.col("h") - F.col("aspect")).alias("bent"), "w", "h", "area", "cx", "cy", "compactness", "spans").alias("f"))
    fit = fit.groupBy("width", "height").agg(F.array_sort(F.collect_list("f")).alias("f"))  # 25 an aspect at most
    fit = fit.select("width", "height", F.array(*(F.filter("f", lambda f: f["aspect"] == v) for v in order)).alias("by_aspect"))  # noqa: B023  called at once
    if fit.limit(BROADCAST_SIZES + 1).count() <= BROADCAST_SIZES:
        fit = F.broadcast(fit)
    compact = lambda f: f["compactness"] + 1e-12 >= F.col("before") + least_gain
    kind = "array<struct<w: int, h: int, area: bigint, cx: double, cy: double, compactness: double, spans: " + RUNS + ">>"
    chosen = F.transform(F.filter(F.transform("by_aspect", lambda fs: F.get(F.filter(fs, compact), F.lit(0))), lambda f: f.isNotNull()), lambda f: F.struct(*(f[c].alias(c) for c in ("w", "h", "area", "cx", "cy", "compactness", "spans"))))
    m = m.join(fit, ["width", "height"], "left").withColumn("chosen", F.coalesce(F.when(F.col("early").isNull(), chosen), F.array()).cast(kind))
    m = m.select("mask", "width", "height", "runs", "n", "mx", "my", "before", "least", "most", "target", "early", "chosen")
    keep = [f for f in m.schema if f.name not in ("runs", "mx", "my")]
    m = m.mapInArrow(_search(stride, refine, [f.name for f in keep]), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keep) + f", places {_PLACES}")
    # Six keys; what does not fit comes after all that does, so the least rank tells whether anything fits.
    def ranked(f: Column, p: Column) -> Column:
        share = p["overlap"] / f["area"]
        keys = {"no": share < least_overlap, "r": -share, "d": p["away"], "a": F.abs(f["area"] - F.col("target")), "c": -f["compactness"], "y": p["y"], "x": p["x"]}
        return F.struct(*(v.alias(k) for k, v in keys.items()), *(f[c].alias(c) for c in ("w", "h", "area", "compactness", "spans")), p["overlap"].alias("overlap"), p["away"].alias("away"))

    m = m.withColumn("b", F.array_min(F.zip_with("chosen", "places", ranked)))
    m = m.withColumns({"fits": ~F.col("b.no"), "best_overlap": -F.col("b.r"), "evaluated": F.aggregate("places", F.lit(0).cast("long"), lambda s, p: s + p["evaluated"])})
    parts = component_rows(runs, "mask").groupBy("mask").agg(F.count("*").alias("components"))  # not made where nobody asks for it
    out = m.join(parts, "mask", "left").withColumn("components", F.coalesce("components", F.lit(0)))
    failure = F.coalesce("early", F.when(F.col("b").isNull(), "no_template_meets_area_size_and_compactness_constraints").when(~F.col("fits"), "no_compact_candidate_meets_overlap_in_configured_search"))
    ok = lambda c: F.when(failure.isNull(), c)
    return out.select(
        "mask", F.when(failure.isNull(), "success").otherwise("failure").alias("status"), failure.alias("failure_reason"),
        F.col("n").alias("vulnerability_area"), F.col("components").alias("num_components_before"), F.col("before").alias("compactness_before"),
        F.col("least").alias("least_area"), F.col("most").alias("most_area"), F.coalesce("evaluated", F.lit(0)).alias("candidates_evaluated"), F.col("best_overlap").alias("best_candidate_overlap_ratio"),
        ok(F.col("b.x")).alias("x"), ok(F.col("b.y")).alias("y"), ok(F.col("b.w")).alias("w"), ok(F.col("b.h")).alias("h"),
        F.coalesce(ok(F.col("b.area")), F.lit(0)).alias("generation_area"), F.coalesce(ok(F.col("b.overlap")), F.lit(0)).alias("overlap_pixels"),
        F.coalesce(ok(F.col("b.overlap") / F.col("b.area")), F.lit(0.0)).alias("overlap_ratio"), ok(F.col("b.compactness")).alias("compactness_after"),
        ok(F.sqrt(F.col("b.away")) / F.hypot("width", "height")).alias("centroid_distance_normalized"), ok(F.abs(F.col("b.area") - F.col("target")) / F.col("target")).alias("target_area_relative_error"),
        ok(F.col("b.spans")).alias("spans"),
    )


def adapted_runs(adapted: DataFrame) -> DataFrame:
    """(mask, y, x0, x1) of the ellipses of adapt_masks."""
    s = adapted.select("mask", "x", "y", F.explode("spans").alias("s"))
    return s.select("mask", (F.col("y") + F.col("s.y")).alias("y"), (F.col("x") + F.col("s.x0")).alias("x0"), (F.col("x") + F.col("s.x1")).alias("x1"))


def spread_anchors(tokens: Column, most: int, apart: float) -> Column:
    """Tokens (weight, y, x) taken by falling weight, then y, x, each at least `apart` from those taken before, `most` at most."""
    ordered = F.transform(F.array_sort(F.transform(tokens, lambda t: F.struct((-t["weight"]).alias("w"), t["y"].alias("y"), t["x"].alias("x")))), lambda t: F.struct(t["y"].alias("y"), t["x"].alias("x")))
    far = lambda t, p: F.hypot(t["y"] - p["y"], t["x"] - p["x"]) >= apart
    return F.aggregate(ordered, F.slice(ordered, 1, 0), lambda taken, t: F.when((F.size(taken) < most) & F.forall(taken, lambda p: far(t, p)), F.concat(taken, F.array(t))).otherwise(taken))


def _token_edge(k: Column, size: Column) -> Column:
    """First pixel of a token: pixel p belongs to token floor(p * 16 / size)."""
    return F.ceil(k * size / GRID)


def candidate_centres(samples: DataFrame, offsets: tuple[float, ...], anchors: int, apart: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """(sample, height, width, x, y) and the columns to keep: centres to try for the region of interest of each sample.

    samples: (sample, height, width, roi: tokens y * 16 + x, weights: 256). Centres lie on a frame around the region's
    centroid, in the middle of its box, and in the middle of spread, heavy tokens; those outside the image go.
    """
    s = samples.where("size(roi) > 0").withColumn("cells", F.transform("roi", lambda t: F.struct(F.floor(t / GRID).cast("int").alias("y"), (t % GRID).cast("int").alias("x"), F.element_at("weights", (t + 1).cast("int")).alias("weight"))))
    edge = lambda k, size: _token_edge(k, F.col(size))
    box = F.transform("cells", lambda c: F.struct(edge(c["x"], "width").alias("a"), edge(c["x"] + 1, "width").alias("b"), edge(c["y"], "height").alias("t"), edge(c["y"] + 1, "height").alias("u")))
    s = s.withColumn("box", box)
    total = lambda f: F.aggregate("box", F.lit(0.0), lambda acc, b: acc + f(b))
    pixels = total(lambda b: ((b["b"] - b["a"]) * (b["u"] - b["t"])).cast("double"))
    s = s.withColumns({
        "cx": total(lambda b: (b["u"] - b["t"]) * (b["b"] - b["a"]) * (b["a"] + b["b"]) / 2.0) / pixels, "cy": total(lambda b: (b["b"] - b["a"]) * (b["u"] - b["t"]) * (b["t"] + b["u"]) / 2.0) / pixels,
        "x0": F.array_min(F.transform("box", lambda b: b["a"])), "x1": F.array_max(F.transform("box", lambda b: b["b"])), "y0": F.array_min(F.transform("box", lambda b: b["t"])), "y1": F.array_max(F.transform("box", lambda b: b["u"])),
    })
    steps = F.array(*map(F.lit, map(float, offsets)))
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    frame = F.flatten(F.transform(steps, lambda oy: F.transform(steps, lambda ox: point(N.round_even(F.col("cx") + ox * (F.col("x1") - F.col("x0")), 6), N.round_even(F.col("cy") + oy * (F.col("y1") - F.col("y0")), 6)))))
    middle = F.array(point((F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2))
    heavy = F.transform(spread_anchors(F.col("cells"), anchors, apart), lambda a: point((edge(a["x"], "width") + edge(a["x"] + 1, "width")) / 2, (edge(a["y"], "height") + edge(a["y"] + 1, "height")) / 2))
    out = s.select("sample", "height", "width", *keep, F.explode(F.array_distinct(F.concat(frame, middle, heavy))).alias("c")).select("sample", "height", "width", *keep, "c.x", "c.y")
    return out.where("x >= 0 AND x < width AND y >= 0 AND y < height")


def roi_coverage(runs: DataFrame, images: DataFrame) -> DataFrame:
    """(mask, area, target_precision, weighted_coverage, roi_weighted_coverage, binary_roi_coverage, centroid_distance_normalized) of masks as runs.

    images: (mask, height, width, roi: tokens, weights: 256 numbers), a row per mask. A pixel belongs to token floor(y * 16 / height) and floor(x * 16 / width), and
    each token keeps its weight whatever its pixels. Coverage is null where weights are all zero, what the region gives is null without one. Runs are cut at token borders.
    """
    i = images.select("mask", F.col("height").cast("long").alias("height"), F.col("width").cast("long").alias("width"), F.col("roi").cast("array<int>").alias("roi"), F.col("weights").cast("array<double>").alias("weights"))
    length = F.col("x1") - F.col("x0")
    packed = runs.where("x1 > x0").groupBy("mask").agg(  # one image's runs
        F.collect_list(F.struct("y", "x0", "x1")).alias("runs"), F.sum(length).alias("area"),
        (F.sum((F.col("x0") + F.col("x1")) * length / 2) / F.sum(length)).alias("cx"), (F.sum((F.col("y") + 0.5) * length) / F.sum(length)).alias("cy"),
    )
    box = F.transform("roi", lambda t: F.struct(F.floor(t / GRID).alias("y"), (t % GRID).alias("x")))
    edges = F.transform(box, lambda b: F.struct(_token_edge(b["x"], F.col("width")).alias("a"), _token_edge(b["x"] + 1, F.col("width")).alias("b"), _token_edge(b["y"], F.col("height")).alias("t"), _token_edge(b["y"] + 1, F.col("height")).alias("u")))
    add = lambda f: F.aggregate("edges", F.lit(0.0), lambda acc, e: acc + f(e))
    size = F.nullif(add(lambda e: ((e["b"] - e["a"]) * (e["u"] - e["t"])).cast("double")), F.lit(0.0))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, w: a + w)
    # Maps of weights are long, so they stream past hash maps of runs: they are never sorted, nor copied by run.
    known = i.join(packed.hint("shuffle_hash"), "mask").withColumn("edges", edges).select(
        "mask", "height", "width", "roi", "weights", "runs", "area", "cx", "cy", size.alias("roi_pixels"), F.nullif(total(F.col("weights")), F.lit(0.0)).alias("all_"), F.nullif(total(F.transform(F.array_distinct("roi"), lambda t: F.element_at("weights", t + 1))), F.lit(0.0)).alias("all_roi"),
        (add(lambda e: (e["u"] - e["t"]) * (e["b"] - e["a"]) * (e["a"] + e["b"]) / 2.0) / size).alias("rx"), (add(lambda e: (e["b"] - e["a"]) * (e["u"] - e["t"]) * (e["t"] + e["u"]) / 2.0) / size).alias("ry"),
    )
    at = lambda v, size: F.floor(v * GRID / F.col(size))
    own = ("height", "width", "area", "cx", "cy", "roi_pixels", "all_", "all_roi", "rx", "ry")
    cut = known.select("mask", "roi", "weights", *own, F.inline("runs")).withColumn("col", F.explode(F.sequence(at(F.col("x0"), "width"), at(F.col("x1") - 1, "width"))))
    n = F.least(F.col("x1"), _token_edge(F.col("col") + 1, F.col("width"))) - F.greatest(F.col("x0"), _token_edge(F.col("col"), F.col("width")))
    token = (at(F.col("y"), "height") * GRID + F.col("col")).cast("int")
    side = lambda k, size: _token_edge(k + 1, F.col(size)) - _token_edge(k, F.col(size))
    part = n / (side(at(F.col("y"), "height"), "height") * side(F.col("col"), "width")) * F.element_at("weights", token + 1)
    inside = F.array_contains("roi", token)
    sums = cut.groupBy("mask").agg(F.sum(part).alias("got"), F.sum(F.when(inside, part).otherwise(0.0)).alias("got_roi"), F.sum(F.when(inside, n).otherwise(0)).alias("shared"), *(F.first(c).alias(c) for c in own))
    return sums.select(
        "mask", "area", (F.col("shared") / F.col("area")).alias("target_precision"), (F.col("got") / F.col("all_")).alias("weighted_coverage"), (F.col("got_roi") / F.col("all_roi")).alias("roi_weighted_coverage"),
        (F.col("shared") / F.col("roi_pixels")).alias("binary_roi_coverage"), (F.hypot(F.col("cx") - F.col("rx"), F.col("cy") - F.col("ry")) / F.hypot(F.col("height").cast("double"), F.col("width").cast("double"))).alias("centroid_distance_normalized"),
    )


def _phase(seed: int, sample: Column, family: Column) -> Column:
    """An angle from 64 bits of a digest."""
    digest = F.sha2(F.concat(F.lit(f"blob:{seed}:"), sample.cast("string"), F.lit(":"), family), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64) * F.lit(2 * math.pi)


def _inside(shape: str, x: np.ndarray, y: np.ndarray, half_w: np.ndarray, half_h: np.ndarray, cos: np.ndarray, sin: np.ndarray, phase: np.ndarray) -> np.ndarray:
    """[shapes, rows, columns]: which pixel centres (x [shapes, 1, columns], y [shapes, rows, 1] from the middle) lie inside; without turns, u depends on columns and v on rows alone."""
    u, v = (cos * x + sin * y if sin.any() else cos * x) / half_w, (cos * y - sin * x if sin.any() else cos * y) / half_h
    if shape == "horizontal_compact":
        return u**4 + v**4 <= 1
    if shape == "cone_triangle":
        return (abs(v) <= 1) & (abs(u) <= (v + 1) / 2)
    if shape == "compact_irregular_blob":
        square = u**2 + v**2
        inside = square < 0.7  # its edge lies between 0.84 and 1.16
        near = np.nonzero(~inside & (square < 1.4))
        u, v, phase = np.broadcast_to(u, square.shape)[near], np.broadcast_to(v, square.shape)[near], phase[near[0], 0, 0]
        turn = np.arctan2(v, u)
        inside[near] = np.hypot(u, v) <= 1 + 0.1 * np.cos(3 * turn + phase) + 0.06 * np.sin(5 * turn - phase)
        return inside
    return (abs(u) <= 1) & (abs(v) <= 1)


def _frames(shape: str, height: np.ndarray, width: np.ndarray, cx: np.ndarray, cy: np.ndarray, fraction: np.ndarray, aspect: np.ndarray, angle: np.ndarray) -> tuple:
    """Half sides, cosines and sines of some footprints, and their boxes: first column, first row, columns, rows, not cut by the image."""
    fill = {"horizontal_compact": math.gamma(1.25) ** 2 / math.gamma(1.5), "cone_triangle": 0.5, "compact_irregular_blob": math.pi / 4 * (1 + (0.1**2 + 0.06**2) / 2)}.get(shape, 1.0)
    area = height * width * fraction / fill
    half_w, half_h = np.sqrt(area * aspect) / 2, np.sqrt(area / aspect) / 2
    angles, which = np.unique(np.radians(angle), return_inverse=True)
    cos, sin = (np.array([f(a) for a in angles.tolist()])[which] for f in (math.cos, math.sin))
    room = 1.17 if shape == "compact_irregular_blob" else 1.0
    reach_x, reach_y = room * (abs(cos) * half_w + abs(sin) * half_h), room * (abs(sin) * half_w + abs(cos) * half_h)
    left, top = np.floor(cx - reach_x).astype(np.int64) - 1, np.floor(cy - reach_y).astype(np.int64) - 1
    return half_w, half_h, cos, sin, left, top, np.ceil(cx + reach_x).astype(np.int64) + 1 - left, np.ceil(cy + reach_y).astype(np.int64) + 1 - top


def _rasters(shape: str, cx: np.ndarray, cy: np.ndarray, frames: tuple, phase: np.ndarray) -> np.ndarray:
    """[footprints, rows, columns]: pixels whose centres lie inside, from each one's first row and column on."""
    half_w, half_h, cos, sin, left, top, cols, rows = frames
    of = lambda v: v[:, None, None]
    x, y = of(left) + np.arange(cols.max(initial=0)) + 0.5 - of(cx), of(top) + np.arange(rows.max(initial=0))[:, None] + 0.5 - of(cy)
    return _inside(shape, x, y, of(half_w), of(half_h), of(cos), of(sin), of(phase))


def raster(shape: str, height: int, width: int, cx: float, cy: float, fraction: float, aspect: float, angle: float, phase: float) -> tuple[np.ndarray, int, int, int]:
    """Pixels of a footprint whose centres lie inside it: (part inside the image, its first row and column, pixels cut off by the image)."""
    one = lambda v: np.array([v])
    frames = _frames(shape, *map(one, (height, width, cx, cy, fraction, aspect, float(angle))))
    inside, left, top = _rasters(shape, one(cx), one(cy), frames, one(phase))[0], int(frames[4][0]), int(frames[5][0])
    kept = inside[max(0, -top) : max(0, height - top), max(0, -left) : max(0, width - left)]
    return kept, max(0, top), max(0, left), int(inside.sum()) - int(kept.sum())


def _widened(core: np.ndarray, radius: int) -> np.ndarray:
    """[masks, rows, columns] with the pixels at most radius from one of core (Euclidean), on frames wider by radius on every side: every row widened by what the circle leaves at its distance."""
    n, h, w = core.shape
    wide, row = (np.zeros((n, h + more, w + 2 * radius), bool) for more in (2 * radius, 0))
    row[:, :, radius : radius + w] = core
    reached = 0
    for d in range(radius, -1, -1):  # the nearer the row, the farther it reaches to the sides
        for reached in range(reached + 1, math.isqrt(radius * radius - d * d) + 1):
            for at in (radius - reached, radius + reached):
                row[:, :, at : at + w] |= core
        for at in {radius - d, radius + d}:
            wide[:, at : at + h] |= row
    return wide


def _pixels(masks: np.ndarray) -> np.ndarray:
    """How many pixels each mask has."""
    return np.bitwise_count(np.packbits(masks.reshape(len(masks), -1), axis=1)).sum(1, dtype=np.int64)


def dilate(core: np.ndarray, radius: int) -> np.ndarray:
    """One mask widened."""
    return _widened(core[None], radius)[0]


def _run_lists(masks: np.ndarray, top: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(of which mask, rows (y, x0, x1)) of the runs of masks, by mask, row and place."""
    edge = np.zeros((*masks.shape[:2], masks.shape[2] + 2), bool)
    edge[:, :, 1:-1] = masks
    of, y, x = np.nonzero(edge[:, :, 1:] != edge[:, :, :-1])  # by rows, every start before its end
    of = of[::2]
    return of, np.stack([y[::2] + top[of], x[::2] + left[of], x[1::2] + left[of]], axis=1)


def _drawn(shape: str, height: np.ndarray, width: np.ndarray, cx: np.ndarray, cy: np.ndarray, frames: tuple, phase: np.ndarray, settings: dict, runs: bool) -> dict:
    """Of some footprints of one shape: area, sums of x and y, pixels cut off, pixels by token, and of the widened form its pixels and the radius that the area bounds allow; runs of both on demand."""
    left, top = frames[4], frames[5]
    core = _rasters(shape, cx, cy, frames, phase)
    whole = _pixels(core)
    x, y = left[:, None] + np.arange(core.shape[2]), top[:, None] + np.arange(core.shape[1])
    core &= ((x >= 0) & (x < width[:, None]))[:, None] & ((y >= 0) & (y < height[:, None]))[:, :, None]
    # Pixels by token from sums over all pixels above and left of the tokens' corners.
    sums = np.zeros((len(core), core.shape[1] + 1, core.shape[2] + 1), np.int32)
    np.cumsum(core, axis=1, out=sums[:, 1:, 1:])
    np.cumsum(sums, axis=2, out=sums)
    by_col, by_row, area = np.diff(sums[:, -1]).astype(np.int64), np.diff(sums[:, :, -1]).astype(np.int64), sums[:, -1, -1].astype(np.int64)
    corner = np.arange(GRID + 1)
    at_x, at_y = (np.clip(-(-corner * size[:, None] // GRID) - first[:, None], 0, most) for size, first, most in ((width, left, core.shape[2]), (height, top, core.shape[1])))
    corners = sums[np.arange(len(core))[:, None, None], at_y[:, :, None], at_x[:, None, :]]
    tokens = np.diff(np.diff(corners, axis=1), axis=2).reshape(len(core), GRID * GRID)
    # The widest form within the bounds, tried from the asked radius down; radius 0 is the core itself.
    short = np.minimum(height, width)
    radius = np.minimum(settings["max_radius_pixels"], np.round(short * settings["radius_fraction_of_short_side"]).astype(np.int64))
    cap = np.floor(height * width * settings["max_image_area_fraction"]).astype(np.int64)
    status = np.select([area == 0, area > cap], ["empty_core", "core_exceeds_render_area_cap"], "expanded").astype(object)
    most = np.minimum(area + np.floor(area * settings["max_added_area_ratio"]).astype(np.int64), cap)
    open_ = np.flatnonzero(status == "expanded")
    radius[status != "expanded"] = 0
    added, lists = area.copy(), []
    said = lambda masks, of, r: lists.append((of, *_run_lists(masks, top[of] - r, left[of] - r)))
    if runs:
        said(core[rest := np.flatnonzero(status != "expanded")], rest, 0)
    while len(open_):
        r = int(radius[open_].max())
        now = open_[radius[open_] == r]
        wide = _widened(core[now], r)
        x, y = left[now, None] - r + np.arange(wide.shape[2]), top[now, None] - r + np.arange(wide.shape[1])
        wide &= ((x >= 0) & (x < width[now, None]))[:, None] & ((y >= 0) & (y < height[now, None]))[:, :, None]
        n = _pixels(wide)
        fits = (n <= most[now]) | (r == 0)
        added[now[fits]] = n[fits]
        if runs:
            said(wide[fits], now[fits], r)
        radius[now[~fits]] = r - 1
        status[now[~fits]] = "bounded"
        open_ = open_[radius[open_] < r]
    out = {"area": area, "sx": (by_col * np.arange(core.shape[2])).sum(1) + left * area, "sy": (by_row * np.arange(core.shape[1])).sum(1) + top * area, "clipped_pixels": whole - area, "render_area": added, "render_radius": radius, "render_status": status, "tokens": tokens}
    if runs:
        out["core"] = _run_lists(core, top, left)
        out["render"] = (np.concatenate([of[k] for of, k, _ in lists]), np.concatenate([rows for _, _, rows in lists]))
    return out


def _numbers(lists: pa.Array, size: int) -> np.ndarray:
    """Lists of `size` numbers as rows; what is absent is nan."""
    out = np.full((len(lists), size), np.nan)
    parts = lists.flatten()
    n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    held = at < size
    out[row[held], at[held]] = parts.to_numpy(zero_copy_only=False)[held]
    return out


def _as_lists(of: np.ndarray, rows: np.ndarray, many: int) -> pa.Array:
    """Runs (y, x0, x1) of `many` shapes as lists; each shape's lie together, in order."""
    order = np.argsort(of, kind="stable")
    ends = np.cumsum(np.bincount(of, minlength=many))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.StructArray.from_arrays([pa.array(rows[order, k], pa.int32()) for k in range(3)], names=["y", "x0", "x1"]))


_DRAWN = "area long, sx long, sy long, clipped_pixels long, render_area long, render_radius int, render_status string, inside long, got double, got_roi double"
_TRIED = "family string, shape string, area_fraction double, aspect double, angle double, candidate_id string"
_TRIES, _PIXELS = 4096, 1 << 18  # footprints whose tokens are held at once, and pixels of boxes that are drawn at once


def _draw(settings: dict, keep: list[str], runs: bool):
    """All tried footprints of rows of centres, with the sums of their coverage: pixels in the region, and shares of tokens times weights."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, _TRIES // max(1, len(whole.column("tried")[0]) if whole.num_rows else 1))  # every row tries the same families
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                tried, ids = batch.column("tried"), batch.column("ids").flatten()
                centre = np.repeat(np.arange(batch.num_rows), tried.value_lengths().to_numpy(zero_copy_only=False))
                tried = dict(zip((f.name for f in tried.type.value_type), tried.flatten().flatten(), strict=True))
                if len(centre):
                    yield pa.record_batch(*_covered(batch, centre, tried, ids))

    def _covered(batch: pa.RecordBatch, centre: np.ndarray, tried: dict, ids: pa.Array) -> tuple:
        number = lambda c: c.to_numpy(zero_copy_only=False)
        h, w = (number(batch.column(c)).astype(np.int64) for c in ("height", "width"))
        height, width, cx, cy = h[centre], w[centre], number(batch.column("x"))[centre], number(batch.column("y"))[centre]
        fraction, aspect, angle, phase = (number(tried[c]) for c in ("area_fraction", "aspect", "angle", "phase"))
        shapes, which = np.unique(number(tried["shape"]).astype(str), return_inverse=True)
        out, lists = {}, {"core": [], "render": []}
        for i, shape in enumerate(shapes.tolist()):
            mine = np.flatnonzero(which == i)
            size = lambda at, shape=shape: _frames(shape, height[at], width[at], cx[at], cy[at], fraction[at], aspect[at], angle[at])
            frames = size(mine)
            order = np.lexsort((frames[6], frames[7], frames[3] != 0))  # boxes of like sizes together, straight ones apart
            mine, frames = mine[order], tuple(f[order] for f in frames)
            lo = 0
            while lo < len(mine):
                # As many boxes as fit when all take the largest of them.
                pixels = np.maximum.accumulate(frames[6][lo:]) * np.maximum.accumulate(frames[7][lo:]) * np.arange(1, len(mine) - lo + 1)
                turned = (frames[3][lo:] != 0) != (frames[3][lo] != 0)
                hi = lo + max(1, int(np.argmax(np.append((pixels > _PIXELS) | turned, True))))
                at = mine[lo:hi]
                got = _drawn(shape, height[at], width[at], cx[at], cy[at], tuple(f[lo:hi] for f in frames), phase[at], settings, runs)
                for name in lists:
                    if runs:
                        of, rows = got.pop(name)
                        lists[name].append((at[of], rows))
                for name, v in got.items():
                    out.setdefault(name, np.empty((len(centre), *v.shape[1:]), v.dtype))[at] = v
                lo = hi
        weights, roi, cells = _numbers(batch.column("weights"), GRID * GRID), np.zeros((batch.num_rows, GRID * GRID), bool), np.zeros((batch.num_rows, GRID * GRID))
        region = batch.column("roi")
        t, of = region.flatten().fill_null(-1).to_numpy(zero_copy_only=False), np.repeat(np.arange(len(region)), region.value_lengths().to_numpy(zero_copy_only=False))
        known = (t >= 0) & (t < GRID * GRID)
        roi[of[known], t[known]] = True
        corner = np.arange(GRID + 1)
        sides = [np.diff(-(-corner * side[:, None] // GRID), axis=1) for side in (h, w)]
        cells = (sides[0][:, :, None] * sides[1][:, None, :]).reshape(len(h), GRID * GRID)
        tokens, roi = out.pop("tokens"), roi[centre]
        part = tokens / cells[centre] * weights[centre]
        total = lambda v: np.cumsum(v, axis=1)[:, -1]  # noqa: E731  one by one, in the order of tokens
        out |= {"inside": (tokens * roi).sum(1, dtype=np.int64), "got": total(part), "got_roi": total(np.where(roi, part, 0.0))}
        take = pa.array(centre)
        made = {c: batch.column(c).take(take) for c in keep} | {c: v for c, v in tried.items() if c != "phase"} | {"candidate_id": ids}
        made |= {name: pa.array(out[name], {"render_radius": pa.int32(), "render_status": pa.string()}.get(name)) for name in (d.split()[0] for d in _DRAWN.split(", "))}
        if runs:
            made |= {name: _as_lists(*map(np.concatenate, zip(*lists[name])), len(centre)) for name in lists}
        return list(made.values()), list(made)

    return draw


def candidates(samples: DataFrame, families: DataFrame, search: dict, render: dict, seed: int = 0, runs: bool = True) -> DataFrame:
    """Every configured footprint of every sample, with runs (core, render; on demand), geometry and coverage; none is dropped or preferred.

    samples: (sample, height, width, roi, weights, angle: facade angle in degrees), a row per sample; families: (family, shape, area_low, area_high, area_samples, aspects,
    angles), a row per family. search: center_offsets, roi_anchors, anchor_separation_tokens; render: radius and area bounds.
    Coverage keeps each token's weight whatever its pixels; it is null where all weights are zero. A sample without region makes no candidates.
    Samples are dealt over all shuffle partitions, whatever their bytes, and carry their maps into the tasks that draw, once for each centre; there
    footprints of one shape and like size are drawn together, as arrays. Footprints are never shuffled or joined.
    """
    dealt = samples.where("size(roi) > 0").repartition(int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")), "sample")  # a fixed number: small rows, much work
    grid = F.sequence(F.lit(0), F.lit(GRID * GRID - 1))
    side = lambda k, size: _token_edge(k + 1, F.col(size)) - _token_edge(k, F.col(size))
    dealt = dealt.withColumns({
        "roi": F.col("roi").cast("array<int>"), "weights": F.col("weights").cast("array<double>"), "facade": F.coalesce("angle", F.lit(0.0)), "in_roi": F.transform(grid, lambda t: F.array_contains(F.col("roi").cast("array<int>"), t).cast("int")),
        "sizes": F.transform(grid, lambda t: (side(F.floor(t / GRID), "height") * side(t % GRID, "width")).cast("int")),
    })
    added = lambda a, b: a + b
    dealt = dealt.withColumns({
        "total": F.nullif(F.aggregate("weights", F.lit(0.0), added), F.lit(0.0)), "total_roi": F.nullif(F.aggregate(F.zip_with("weights", "in_roi", lambda w, i: F.when(i > 0, w).otherwise(0.0)), F.lit(0.0), added), F.lit(0.0)),
        "roi_pixels": F.aggregate(F.zip_with("sizes", "in_roi", lambda c, i: c * i), F.lit(0), added),
    })
    step = (F.col("area_high") - F.col("area_low")) / F.greatest(F.col("area_samples") - 1, F.lit(1))
    areas = F.transform(F.sequence(F.lit(0), F.col("area_samples") - 1), lambda k: F.when((k == F.col("area_samples") - 1) & (k > 0), F.col("area_high")).otherwise(F.col("area_low") + k * step))
    shapes = families.withColumn("area_fraction", F.explode(areas)).withColumn("aspect", F.explode(F.array_distinct("aspects"))).withColumn("offset", F.explode(F.array_distinct("angles"))).select("family", "shape", "area_fraction", "aspect", "offset")
    # A configuration's families, some hundred rows, go with every sample as one list; what names a footprint is written once a sample or centre, not once a footprint.
    dealt = dealt.join(F.broadcast(shapes.agg(F.collect_list(F.struct(*shapes.columns)).alias("shapes"))))
    turn = lambda s: s["offset"] + F.when(s["shape"] == "facade_rectangle", F.col("facade")).otherwise(0.0)
    written = lambda c: F.format_string("%.12g", c)
    dealt = dealt.withColumn("tried", F.transform("shapes", lambda s: F.struct(s["family"].alias("family"), s["shape"].alias("shape"), s["area_fraction"].alias("area_fraction"), s["aspect"].alias("aspect"), turn(s).alias("angle"), _phase(seed, F.col("sample"), s["family"]).alias("phase"))))
    dealt = dealt.withColumn("said", F.transform("tried", lambda s: F.concat_ws("|", F.lit(str(seed)), F.col("sample").cast("string"), s["family"], s["shape"], *(written(s[c]) for c in ("area_fraction", "aspect", "angle")))))
    known = ("weights", "roi", "tried", "said", "total", "total_roi", "roi_pixels")
    centres = candidate_centres(dealt, tuple(search["center_offsets"]), search["roi_anchors"], search["anchor_separation_tokens"], known)
    place = F.concat_ws("|", written(F.col("x")), written(F.col("y")))
    centres = centres.withColumn("place", place).withColumn("ids", F.transform("said", lambda s: F.substring(F.sha2(F.concat_ws("|", s, F.col("place")), 256), 1, 24))).drop("said", "place")
    keep = [f for f in centres.schema if f.name not in ("weights", "roi", "tried", "ids")]
    drawn = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in keep), _TRIED, _DRAWN, *([f"core {RUNS}, render {RUNS}"] if runs else [])])
    d = centres.mapInArrow(_draw(render, [f.name for f in keep], runs), drawn)
    area = F.nullif(F.col("area"), F.lit(0))
    return d.select(
        "sample", F.col("x").alias("center_x"), F.col("y").alias("center_y"), "family", "shape", "area_fraction", "aspect", "angle", "candidate_id", *(["core"] if runs else []), "clipped_pixels", *(["render"] if runs else []), "render_radius", "render_status",
        F.col("area").alias("area_pixels"), (F.col("area") / (F.col("height") * F.col("width"))).alias("area_fraction_drawn"), F.when(area > 0, F.col("inside") / area).otherwise(0.0).alias("target_precision"),
        (F.col("got") / F.col("total")).alias("weighted_coverage"), (F.col("got_roi") / F.col("total_roi")).alias("roi_weighted_coverage"), (F.col("inside").cast("double") / F.col("roi_pixels")).alias("binary_roi_coverage"),
        F.when(area > 0, F.col("sx") / area + 0.5).alias("cx"), F.when(area > 0, F.col("sy") / area + 0.5).alias("cy"), "render_area",
    )


def _facade_angle(height: int, width: int, values: list[float]) -> tuple[float, str, float]:
    """Angle of the strongest orthogonal frame of an image's edges, how it was found, and the share of edge strength near it."""
    gy, gx = np.gradient(np.array(values, float).reshape(height, width))
    strength = np.hypot(gx, gy)
    edges = (strength >= np.quantile(strength, 0.85)) & (strength > 0)
    if edges.sum() < 16:
        return 0.0, "image_axis_fallback", 0.0
    turn, weight = np.mod(np.degrees(np.arctan2(gy[edges], gx[edges])) + 135, 90) - 45, strength[edges]  # the tangent, modulo a right angle
    bins = np.bincount(np.minimum(np.floor(turn + 45.5).astype(int), 90), weight, 91)
    run = np.concatenate(([0.0, 0.0, 0.0], np.cumsum(bins), np.full(2, bins.sum())))
    axis = int(np.argmax(np.round(run[5:] - run[:-5], 9))) - 45
    near = np.abs(turn - axis) <= 2.5
    share = float(weight[near].sum() / weight.sum())
    if share < 0.15 or abs(axis) > 30:
        return 0.0, "image_axis_fallback", share
    return float((turn[near] * weight[near]).sum() / weight[near].sum()), "local_gradient_orthogonal_frame", share


def facade_angles(images: DataFrame) -> DataFrame:
    """(image, angle_degrees, method, evidence_fraction) of grey images (image, height, width, values by rows), two pixels a side at least.

    Edges over the 85th percentile of strength vote for their direction modulo 90 degrees in bins of one degree, summed over five neighbours; the
    angle is the mean of those within 2.5 degrees of the best. Too few edges, votes or too steep an axis give 0 by the image's own axis.
    """

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_facade_angle(r["height"], r["width"], r["values"]) for r in batch.to_pylist()]
            yield pa.record_batch([batch.column("image"), *(pa.array([g[k] for g in got], t) for k, t in enumerate((pa.float64(), pa.string(), pa.float64())))], names=["image", "angle_degrees", "method", "evidence_fraction"])

    kind = images.schema["image"].dataType.simpleString()
    return images.select("image", "height", "width", "values").mapInArrow(turn, f"image {kind}, angle_degrees double, method string, evidence_fraction double")


def canonical_levels(masks: DataFrame) -> DataFrame:
    """masks (mode, width, height, want_width, want_height, levels: pixels by value) with foreground (pixels over 0) and fault, null where the mask may be used.

    Single-channel masks of the wanted size with the values 0 and 1, or 0 and 255, are accepted as they are; nothing is resized or thresholded.
    """
    held = F.map_keys(F.map_filter("levels", lambda k, n: n > 0))
    only = lambda *v: F.size(F.array_except(held, F.array(*map(F.lit, v)))) == 0
    fault = F.when(~F.coalesce(F.col("mode").isin("1", "L"), F.lit(False)), "not a single channel").when((F.col("width") != F.col("want_width")) | (F.col("height") != F.col("want_height")), "size differs from the image").when(~(only(0, 1) | only(0, 255)), "not binary")
    front = F.aggregate(F.map_entries("levels"), F.lit(0).cast("long"), lambda s, e: s + F.when(e["key"] > 0, e["value"].cast("long")).otherwise(0))
    return masks.withColumns({"foreground": F.when(fault.isNull(), front), "fault": fault})


#: The footprint of every family, and the maps that may weigh tokens.
FAMILY_SHAPES = {
    "parked_vehicle": "horizontal_compact", "construction_barrier": "horizontal_compact", "traffic_cones": "cone_triangle", "temporary_sign": "vertical_rectangle",
    "vegetation": "compact_irregular_blob", "scaffolding": "facade_rectangle", "construction_tarp": "facade_rectangle",
}
WEIGHT_MAPS = ("raw_attention_map", "attention_map", "intervention_map", "fused_map")


def configuration_faults(config: dict) -> list[str]:
    """What keeps a candidate configuration from being used: names of settings that are out of their bounds. Empty if it holds."""
    found: list[str] = []

    def number(value, name: str, low: float, high: float) -> None:
        if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value) or not low <= value <= high:
            found.append(name)

    def whole(value, name: str, low: int, high: int) -> None:
        if type(value) is not int or not low <= value <= high:
            found.append(name)

    families, search, render = (config.get(k) or {} for k in ("families", "search", "render"))
    found += [n for n, ok in (("schema_version", config.get("schema_version") == 1), ("families", set(families) == set(FAMILY_SHAPES)), ("weight_map", config.get("weight_map") in WEIGHT_MAPS), ("weighted_coverage_scope", config.get("weighted_coverage_scope") == "full_map"), ("weighted_coverage_thresholds", config.get("weighted_coverage_thresholds") == [0.3, 0.5, 0.7])) if not ok]
    number(config.get("tau_target_precision"), "tau_target_precision", 0, 1)
    offsets = search.get("center_offsets") or []
    if not offsets or len(set(offsets)) != len(offsets):
        found.append("center_offsets")
    for x in offsets:
        number(x, "center_offsets", -1, 1)
    whole(search.get("roi_anchors"), "roi_anchors", 0, 32)
    number(search.get("anchor_separation_tokens"), "anchor_separation_tokens", 0, 16)
    for name, spec in families.items():
        if spec.get("shape") != FAMILY_SHAPES.get(name):
            found.append(f"{name}.shape")
        low, high = spec.get("area_range") or (None, None)
        number(low, f"{name}.area_range", 0.001, 0.3)
        number(high, f"{name}.area_range", low if isinstance(low, (int, float)) else 0.001, 0.3)
        whole(spec.get("area_samples"), f"{name}.area_samples", 2, 10)
        aspects, angles = spec.get("aspect_ratios") or [], spec.get("angle_offsets_degrees") or []
        if not aspects or not angles:
            found.append(f"{name}.aspects_or_angles")
        for a in aspects:
            number(a, f"{name}.aspect_ratios", 0.2, 6)
            if spec.get("shape") == "horizontal_compact" and a <= 1 or spec.get("shape") in ("vertical_rectangle", "cone_triangle") and a >= 1:
                found.append(f"{name}.aspect_ratios")
        for a in angles:
            number(a, f"{name}.angle_offsets_degrees", -15, 15)
    number(render.get("radius_fraction_of_short_side"), "radius_fraction_of_short_side", 0, 0.05)
    number(render.get("max_added_area_ratio"), "max_added_area_ratio", 0, 1)
    number(render.get("max_image_area_fraction"), "max_image_area_fraction", 0.001, 1)
    whole(render.get("max_radius_pixels"), "max_radius_pixels", 0, 64)
    return list(dict.fromkeys(found))
