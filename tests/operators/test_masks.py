"""Mask adaptation and candidate footprints against plain loops over pixels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.operators import masks as M
from trailmark.operators.grouped import component_rows, components8


def to_runs(key, a):
    e = np.diff(np.pad(a.astype(int), ((0, 0), (1, 1))), axis=1)
    return [(key, int(y), int(p), int(q)) for (y, p), (_, q) in zip(zip(*np.nonzero(e == 1)), zip(*np.nonzero(e == -1)))]


def to_pixels(rows, h, w):
    a = np.zeros((h, w), bool)
    for r in rows:
        a[r["y"], r["x0"] : r["x1"]] = True
    return a


def geometry(pixels):
    n = len(pixels)
    if not n:
        return 0, 0.0, 0.0, 0.0
    sx, sy, ss = sum(x for _, x in pixels), sum(y for y, _ in pixels), sum(x * x + y * y for y, x in pixels)
    return n, sx / n + 0.5, sy / n + 0.5, min(1.0, n * n / (2 * math.pi * (ss - (sx * sx + sy * sy) / n + n / 6)))


def ellipse(w, h):
    out = []
    for y in range(h):
        v = (y + 0.5 - h / 2) / (h / 2)
        half = w / 2 * math.sqrt(max(0.0, 1 - v * v))
        out += [(y, x) for x in range(w) if w / 2 - half - 0.5 <= x <= w / 2 + half - 0.5]
    return out


def flood(a):
    left, out = set(zip(*map(list, np.nonzero(a)))), []
    while left:
        todo, part = [left.pop()], []
        while todo:
            y, x = todo.pop()
            part.append((y, x))
            for p in [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if p in left:
                    left.remove(p)
                    todo.append(p)
        out.append(part)
    return out


def plain_adapt(a, ratio=0.06, least=0.7, tolerance=0.05, stride=None, refine=8):
    h, w = a.shape
    n, mx, my, before = geometry(list(zip(*np.nonzero(a))))
    target, step = ratio * w * h, stride or max(1, min(w, h) // 32)
    lo, hi = max(1, math.ceil(max(0.04 * w * h, target * (1 - tolerance)))), math.floor(min(0.08 * w * h, target * (1 + tolerance)))
    if not n or hi < lo or n < math.ceil(least * lo):
        return None
    centres = [(mx, my)] + [geometry(p)[1:3] for p in sorted(flood(a), key=lambda p: geometry(p)[:3], reverse=True)[:32]]
    best = None
    for aspect in sorted(set(M.ASPECTS)):
        fits = []
        for tw in range(max(1, round(math.sqrt(4 * target * aspect / math.pi)) - 2), min(w, round(math.sqrt(4 * target * aspect / math.pi)) + 2) + 1):
            for th in range(max(1, round(math.sqrt(4 * target / aspect / math.pi)) - 2), min(h, round(math.sqrt(4 * target / aspect / math.pi)) + 2) + 1):
                area, cx, cy, compact = geometry(ellipse(tw, th))
                if 0.5 <= tw / th <= 2 and lo <= area <= hi and compact + 1e-12 >= before:
                    fits.append((abs(area - target), abs(tw / th - aspect), tw, th, area, cx, cy, compact))
        if not fits:
            continue
        _, _, tw, th, area, cx, cy, compact = min(fits)
        shape = ellipse(tw, th)

        def rank(x, y):
            shared = sum(a[y + i, x + j] for i, j in shape)
            return (-shared / area, (x + cx - mx) ** 2 + (y + cy - my) ** 2, abs(area - target), -compact, y, x, tw, th)

        places = {(x, y) for x in {*range(0, w - tw + 1, step), w - tw} for y in {*range(0, h - th + 1, step), h - th}}
        places |= {(max(0, min(w - tw, round(px - cx))), max(0, min(h - th, round(py - cy)))) for px, py in centres}
        for r in sorted(rank(*p) for p in places)[:refine]:
            places |= {(x, y) for x in range(max(0, r[5] - step), min(w - tw, r[5] + step) + 1) for y in range(max(0, r[4] - step), min(h - th, r[4] + step) + 1)}
        found = min(rank(*p) for p in places)
        if -found[0] >= least and (best is None or found < best):
            best = found
    return best and (best[5], best[4], best[6], best[7], pytest.approx(-best[0]))


@pytest.mark.parametrize("stride", [None, 3])
def test_adaptation_against_plain_search(spark, stride):
    rng = np.random.default_rng(7)
    runs, images, want = [], [], {}
    for m in range(14):
        h, w = [(26, 31), (18, 44), (66, 20)][m % 3]
        a = np.zeros((h, w), bool)
        for _ in range(1 + m % 4):
            y, x = rng.integers(0, h - 4), rng.integers(0, w - 4)
            a[y : y + rng.integers(1, 12), x : x + rng.integers(1, 14)] ^= True
        if m == 5:
            a[:] = False
        runs += to_runs(m, a)
        images.append((m, w, h))
        want[m] = plain_adapt(a, stride=stride)
    r = spark.createDataFrame(runs, "mask long, y long, x0 long, x1 long").repartition(3)
    got = M.adapt_masks(r, spark.createDataFrame(images, "mask long, width int, height int"), stride=stride)
    for row in got.collect():
        assert (row.status == "success") == (want[row.mask] is not None) == (row.failure_reason is None)
        if want[row.mask]:
            assert (row.x, row.y, row.w, row.h, row.overlap_ratio) == want[row.mask]
    assert {x.failure_reason for x in got.collect()} >= {None, "empty_vulnerability_mask"}
    drawn = M.adapted_runs(got)
    areas = {x.mask: x.n for x in drawn.groupBy("mask").agg({"y": "count"}).withColumnRenamed("count(y)", "n").collect()}
    assert set(areas) == {m for m, v in want.items() if v}
    assert all(c.components == 1 for c in components8(drawn, "mask").collect())


def test_adaptation_refuses_bad_settings(spark):
    r = spark.createDataFrame([], "mask long, y long, x0 long, x1 long")
    i = spark.createDataFrame([], "mask long, width int, height int")
    assert M.adapt_masks(r, i).count() == 0
    for bad in ({"ratio": 0.1}, {"least_overlap": 0}, {"tolerance": 0.3}, {"refine": 0}, {"aspects": ()}, {"aspects": (3.0,)}, {"stride": 0}):
        with pytest.raises(ValueError):
            M.adapt_masks(r, i, **bad)


def test_component_centroids(spark):
    a = np.random.default_rng(2).random((12, 15)) < 0.35
    got = {(r.n, round(r.cx, 9), round(r.cy, 9)) for r in component_rows(spark.createDataFrame(to_runs("k", a), "k string, y long, x0 long, x1 long"), "k").collect()}
    assert got == {(g[0], round(g[1], 9), round(g[2], 9)) for g in map(geometry, flood(a))}


def test_dilation_is_euclidean():
    rng = np.random.default_rng(4)
    for radius in (0, 1, 2, 5):
        core = rng.random((9, 11)) < 0.08
        got = M.dilate(core, radius)
        ys, xs = np.nonzero(core)
        want = [[bool(len(ys)) and ((ys - (y - radius)) ** 2 + (xs - (x - radius)) ** 2).min() <= radius**2 for x in range(11 + 2 * radius)] for y in range(9 + 2 * radius)]
        assert (got == np.array(want)).all()


def test_rasters_have_the_asked_area():
    for shape, aspect in zip(M.SHAPES, (1.6, 0.8, 1.5, 0.7, 1.5)):
        pixels, top, left, cut = M.raster(shape, 480, 640, 320.0, 240.0, 0.05, aspect, 0.0, 0.4)
        assert cut == 0 and abs(pixels.sum() / (480 * 640) - 0.05) < 0.001
        inside, _, _, cut = M.raster(shape, 48, 64, 1.0, 47.0, 0.05, aspect, 30.0, 0.4)
        assert cut > 0 and inside.sum() > 0


def plain_anchors(cells, most, apart):
    out = []
    for w, y, x in sorted((-w, y, x) for w, y, x in cells):
        if len(out) < most and all(math.dist((y, x), p) >= apart for p in out):
            out.append((y, x))
    return out


def test_candidates_against_pixels(spark):
    rng = np.random.default_rng(3)
    samples = [(1, 75, 97, sorted(rng.choice(256, 9, replace=False).tolist()), rng.random(256).tolist(), 7.5), (2, 48, 40, [0, 1, 16], [0.0] * 256, None), (3, 40, 40, [], [1.0] * 256, 0.0)]
    families = [("bus", "horizontal_compact", 0.03, 0.1, 3, [1.0, 2.0, 1.0], [0.0]), ("cone", "cone_triangle", 0.3, 0.3, 1, [0.7], [10.0]), ("sign", "facade_rectangle", 0.02, 0.05, 2, [1.5], [-5.0]), ("hedge", "compact_irregular_blob", 0.05, 0.05, 1, [1.3], [0.0])]
    search = {"center_offsets": (-0.25, 0.25), "roi_anchors": 3, "anchor_separation_tokens": 2.0}
    render = {"radius_fraction_of_short_side": 0.05, "max_radius_pixels": 3, "max_added_area_ratio": 0.4, "max_image_area_fraction": 0.25}
    s = spark.createDataFrame(samples, "sample long, height int, width int, roi array<int>, weights array<double>, angle double")
    f = spark.createDataFrame(families, "family string, shape string, area_low double, area_high double, area_samples int, aspects array<double>, angles array<double>")
    got = M.candidates(s, f, search, render).collect()
    assert len({(r.sample, r.candidate_id) for r in got}) == len(got)
    by_sample = {1: samples[0], 2: samples[1]}
    want_centres = {}
    for k, h, w, roi, weights, _ in by_sample.values():
        token = (np.arange(h) * 16 // h)[:, None] * 16 + np.arange(w) * 16 // w
        ys, xs = np.nonzero(np.isin(token, roi))
        cx, cy, bw, bh = xs.mean() + 0.5, ys.mean() + 0.5, xs.max() - xs.min() + 1, ys.max() - ys.min() + 1
        c = {(round(cx + i * bw, 6), round(cy + j * bh, 6)) for i in (-0.25, 0.25) for j in (-0.25, 0.25)} | {((xs.min() + xs.max() + 1) / 2, (ys.min() + ys.max() + 1) / 2)}
        for y, x in plain_anchors([(weights[t], t // 16, t % 16) for t in roi], 3, 2.0):
            py, px = np.nonzero(token == y * 16 + x)
            c.add(((px.min() + px.max() + 1) / 2, (py.min() + py.max() + 1) / 2))
        want_centres[k] = {(round(float(x), 5), round(float(y), 5)) for x, y in c if 0 <= x < w and 0 <= y < h}
    assert {k: {(round(r.center_x, 5), round(r.center_y, 5)) for r in got if r.sample == k} for k in (1, 2)} == want_centres
    per_centre = 3 * 2 + 1 + 2 + 1
    assert len(got) == per_centre * sum(map(len, want_centres.values()))
    for r in got:
        _, h, w, roi, weights, facade = by_sample[r.sample]
        core, wide = to_pixels(r.core, h, w), to_pixels(r.render, h, w)
        token = (np.arange(h) * 16 // h)[:, None] * 16 + np.arange(w) * 16 // w
        cells = np.bincount(token.ravel(), minlength=256)
        part = np.bincount(token[core], minlength=256) / cells
        assert r.area_pixels == core.sum() and r.angle == {"bus": 0.0, "cone": 10.0, "hedge": 0.0, "sign": (facade or 0.0) - 5.0}[r.family]
        assert r.target_precision == pytest.approx(np.isin(token[core], roi).mean() if core.any() else 0.0)
        assert r.weighted_coverage == (None if r.sample == 2 else pytest.approx((part * weights).sum() / sum(weights)))
        assert r.binary_roi_coverage == pytest.approx(np.isin(token[core], roi).sum() / np.isin(token, roi).sum())
        asked, n = min(3, round(min(h, w) * 0.05)), int(core.sum())
        if not n or n > math.floor(h * w * 0.25):
            assert r.render_status in ("empty_core", "core_exceeds_render_area_cap") and (wide == core).all()
            continue
        ys, xs = np.nonzero(core)
        away = np.min((np.arange(h)[:, None, None] - ys) ** 2 + (np.arange(w)[None, :, None] - xs) ** 2, axis=2)
        most = min(n + math.floor(n * 0.4), math.floor(h * w * 0.25))
        radius = max(k for k in range(asked + 1) if (away <= k * k).sum() <= most)
        assert r.render_radius == radius and r.render_area == (away <= radius**2).sum() and (wide == (away <= radius**2)).all()


def test_candidates_are_drawn_in_many_tasks(spark):
    """Samples are few bytes and much work: however they come, footprints are drawn all over the cluster."""
    s = spark.range(40).coalesce(1).selectExpr("id AS sample", "48 AS height", "64 AS width", "array(17, 18, 34) AS roi", "array_repeat(1D, 256) AS weights", "0D AS angle")
    f = spark.createDataFrame([("sign", "facade_rectangle", 0.03, 0.05, 1, [1.5], [0.0])], "family string, shape string, area_low double, area_high double, area_samples int, aspects array<double>, angles array<double>")
    search = {"center_offsets": (0.0,), "roi_anchors": 0, "anchor_separation_tokens": 2.0}
    render = {"radius_fraction_of_short_side": 0.02, "max_radius_pixels": 2, "max_added_area_ratio": 0.35, "max_image_area_fraction": 0.25}
    out = M.candidates(s, f, search, render).select("sample", F.spark_partition_id().alias("task")).collect()
    assert len({r.sample for r in out}) == 40 and len({r.task for r in out}) > 3


def test_footprints_of_like_size_are_drawn_together(monkeypatch):
    """One by one a footprint took more than a millisecond; some hundred are a few array steps, and equal those drawn alone."""
    rng = np.random.default_rng(8)
    n, calls, plain = 240, [], M._drawn
    settings = {"radius_fraction_of_short_side": 0.05, "max_radius_pixels": 4, "max_added_area_ratio": 0.5, "max_image_area_fraction": 0.2}
    shapes, tried = M.SHAPES, []
    for _ in range(n):
        tried.append([{"family": s, "shape": s, "area_fraction": a, "aspect": 1.4, "angle": t, "phase": float(rng.random() * 6)} for s in shapes for a, t in ((0.04, 0.0), (0.15, 0.0), (0.06, 20.0), (0.3, -5.0))])
    h, w = rng.choice([40, 56], n), rng.choice([48, 64], n)
    x, y = rng.random(n) * w, rng.random(n) * h
    one = np.ones(n)
    batch = M.pa.record_batch({"sample": np.arange(n), "height": h, "width": w, "x": x, "y": y, "weights": M.pa.array(rng.random((n, 256)).tolist()), "roi": M.pa.array([[1, 2, 18, None, 300]] * n, M.pa.list_(M.pa.int32())), "tried": M.pa.array(tried), "ids": M.pa.array([["i"] * 20] * n), "total": one})
    monkeypatch.setattr(M, "_drawn", lambda *a: calls.append(len(a[1])) or plain(*a))
    got = [r for b in M._draw(settings, ["sample", "height", "width", "x", "y", "total"], True)(iter([batch])) for r in b.to_pylist()]
    assert len(got) == sum(calls) == n * 20 and len(calls) < n
    status = set()
    for k, r in enumerate(got):
        phase = tried[k // 20][k % 20]["phase"]
        kept, top, left, cut = M.raster(r["shape"], r["height"], r["width"], r["x"], r["y"], r["area_fraction"], r["aspect"], r["angle"], phase)
        core = np.zeros((r["height"], r["width"]), bool)
        core[top : top + kept.shape[0], left : left + kept.shape[1]] = kept
        assert (to_pixels(r["core"], *core.shape) == core).all() and (r["area"], r["clipped_pixels"]) == (core.sum(), cut)
        rr = r["render_radius"]
        wide = M.dilate(core, rr)[rr : rr + core.shape[0], rr : rr + core.shape[1]]
        assert (to_pixels(r["render"], *core.shape) == wide).all() and r["render_area"] == wide.sum()
        status.add(r["render_status"])
    assert len(status) >= 3


def test_masks_of_one_size_are_searched_together(spark):
    rng = np.random.default_rng(11)
    masks = rng.random((40, 9, 30)) < 0.4
    runs = [r for m in range(40) for r in to_runs(m, masks[m])]
    of, y, x0, x1 = np.array(runs).T
    seen = M._prefixes(of, y, x0, x1, 40, 30, 9)
    spans = np.array([[0, 1, 4], [1, 0, 5], [2, 1, 4]])
    mx, my = rng.random(40) * 30, rng.random(40) * 9
    got = list(zip(*(v.tolist() for v in M._best_places(seen, (*spans.T, 2.5, 1.5), mx, my)[:3])))
    for m in range(40):
        places = [(-sum(int(masks[m, y + d, x + a : x + b].sum()) for d, a, b in spans), (x + 2.5 - mx[m]) ** 2 + (y + 1.5 - my[m]) ** 2, y, x) for y in range(7) for x in range(26)]
        n, _, y, x = min(places)
        assert got[m] == (x, y, -n)
    plan = M.adapt_masks(spark.createDataFrame(runs, "mask long, y long, x0 long, x1 long"), spark.range(40).selectExpr("id AS mask", "30 AS width", "9 AS height")).select("mask", "x")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1  # components are not made where nobody asks for them


def test_coverage_never_sorts_maps(spark):
    """Rows with 256 weights stream past the runs; sorted they took thousands of MB of a task."""
    r = spark.range(60).selectExpr("id % 20 AS mask", "id div 20 AS y", "id % 7 AS x0", "id % 7 + 5 AS x1")
    i = spark.range(20).selectExpr("id AS mask", "16 AS height", "32 AS width", "array(0, 1, 2) AS roi", "array_repeat(1D, 256) AS weights")
    out = M.roi_coverage(r, i)
    assert [(x.area, x.weighted_coverage) for x in out.collect()] == [(15, 7.5 / 256)] * 20
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
