"""Queries of mask adaptation and candidate generation: orders are masks, suppliers are samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.operators import masks as M

from .aggregate_plans import _RUNS, runs
from .registry import query, table

_W, _H = 92, 9


@query(
    "u11_mask_adaptation",
    f"""WITH r AS ({_RUNS}),
px AS (SELECT mask, y, unnest(range(x0, x1)) AS x FROM r),
g AS (SELECT mask, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x + y * y) AS ss FROM px GROUP BY mask),
m AS (SELECT mask, n, sx / n + 0.5 AS mx, sy / n + 0.5 AS my, least(1.0, n * n / (2 * pi() * (ss - (sx * sx + sy * sy) / n + n / 6))) AS before FROM g),
c AS (SELECT {_W * _H} * 0.06::DOUBLE AS target, greatest(1, ceil(greatest(0.04::DOUBLE * {_W * _H}, {_W * _H} * 0.06::DOUBLE * (1 - 0.05::DOUBLE)))) AS least_area, floor(least(0.08::DOUBLE * {_W * _H}, {_W * _H} * 0.06::DOUBLE * (1 + 0.05::DOUBLE))) AS most_area),
a AS (SELECT unnest([1.0::DOUBLE, 0.75::DOUBLE, 4 / 3::DOUBLE, 0.5::DOUBLE, 2.0::DOUBLE]) AS aspect, c.* FROM c),
wh AS (SELECT *, CAST(round_even(sqrt(4 * target * aspect / pi()), 0) AS INT) + dw AS w, CAST(round_even(sqrt(4 * target / (aspect * pi())), 0) AS INT) + dh AS h FROM a, range(-2, 3) AS p(dw), range(-2, 3) AS q(dh)),
ok AS (SELECT * FROM wh WHERE w BETWEEN 1 AND {_W} AND h BETWEEN 1 AND {_H} AND w / h BETWEEN 0.5 AND 2.0),
half AS (SELECT DISTINCT w, h, y, w / 2 * sqrt(greatest(0.0::DOUBLE, 1 - ((y + 0.5 - h / 2) / (h / 2)) * ((y + 0.5 - h / 2) / (h / 2)))) AS v FROM ok, range(0, {_H}) AS s(y) WHERE y < h),
span AS (SELECT w, h, y AS dy, CAST(greatest(0, ceil(w / 2 - v - 0.5)) AS BIGINT) AS l, CAST(least(w, floor(w / 2 + v - 0.5) + 1) AS BIGINT) AS r FROM half),
spx AS (SELECT w, h, dy, unnest(range(l, r)) AS x FROM span WHERE l < r),
sg AS (SELECT w, h, count(*) AS area, sum(x) AS sx, sum(dy) AS sy, sum(x * x + dy * dy) AS ss FROM spx GROUP BY w, h),
shape AS (SELECT w, h, area, sx / area + 0.5 AS cx, sy / area + 0.5 AS cy, least(1.0, area * area / (2 * pi() * (ss - (sx * sx + sy * sy) / area + area / 6))) AS compactness FROM sg),
fit AS (SELECT mask, aspect, w, h, target FROM m, ok JOIN shape USING (w, h) WHERE n >= ceil(0.7::DOUBLE * least_area) AND area BETWEEN least_area AND most_area AND compactness + 1e-12 >= before
  QUALIFY row_number() OVER (PARTITION BY mask, aspect ORDER BY abs(area - target), abs(w / h - aspect), w, h) = 1),
pos AS (SELECT w, h, x, y FROM shape, range(0, {_W}) AS p(x), range(0, {_H}) AS q(y) WHERE x + w <= {_W} AND y + h <= {_H}),
seen AS (SELECT f.mask, f.w, f.h, p.x, p.y, sum(greatest(0, least(r.x1, p.x + s.r) - greatest(r.x0, p.x + s.l))) AS shared FROM (SELECT DISTINCT mask, w, h FROM fit) f JOIN r USING (mask) JOIN span s USING (w, h) JOIN pos p ON p.w = f.w AND p.h = f.h AND p.y + s.dy = r.y GROUP BY ALL),
every AS (SELECT f.mask, f.w, f.h, p.x, p.y, coalesce(shared, 0) AS shared FROM fit f JOIN pos p USING (w, h) LEFT JOIN seen s USING (mask, w, h, x, y)),
ranked AS (SELECT e.*, area, compactness, shared / area AS share, (e.x + cx - mx) * (e.x + cx - mx) + (e.y + cy - my) * (e.y + cy - my) AS away, abs(area - target) AS off FROM every e JOIN shape USING (w, h) JOIN m USING (mask), c),
best AS (SELECT *, max(share) OVER (PARTITION BY mask) AS most FROM ranked QUALIFY row_number() OVER (PARTITION BY mask ORDER BY share < 0.7, -share, away, off, -compactness, y, x) = 1)
SELECT mask, n AS vulnerability_area, CASE WHEN n < ceil(0.7::DOUBLE * least_area) THEN 'insufficient_vulnerability_area_for_required_overlap' WHEN best.mask IS NULL THEN 'no_template_meets_area_size_and_compactness_constraints' WHEN share < 0.7 THEN 'no_compact_candidate_meets_overlap_in_configured_search' END AS failure_reason,
  CASE WHEN share >= 0.7 THEN x END AS x, CASE WHEN share >= 0.7 THEN y END AS y, CASE WHEN share >= 0.7 THEN w END AS w, CASE WHEN share >= 0.7 THEN h END AS h, CASE WHEN share >= 0.7 THEN area ELSE 0 END AS generation_area, CAST(CASE WHEN share >= 0.7 THEN shared ELSE 0 END AS BIGINT) AS overlap_pixels, round(most, 6) AS best_overlap
FROM m LEFT JOIN best USING (mask), c""".replace("round_even(", "roundbankers("),
)
def mask_adaptation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ellipse in the place of every mask, with diagnostics."""
    r = runs(spark, sf_dir)
    images = r.select("mask").distinct().select("mask", F.lit(_W).alias("width"), F.lit(_H).alias("height"))
    out = M.adapt_masks(r, images)
    return out.select("mask", "vulnerability_area", "failure_reason", "x", "y", "w", "h", "generation_area", "overlap_pixels", F.round("best_candidate_overlap_ratio", 6).alias("best_overlap"))


_FAMILIES = (
    ("bus", "horizontal_compact", 0.06, 0.12, 2, [1.6], [0.0]), ("van", "vertical_rectangle", 0.05, 0.1, 2, [0.8], [0.0]), ("cone", "cone_triangle", 0.02, 0.05, 1, [0.7], [0.0]),
    ("hedge", "compact_irregular_blob", 0.05, 0.1, 1, [1.5], [0.0]), ("sign", "facade_rectangle", 0.03, 0.1, 1, [1.5], [-5.0, 5.0]),
)
_SEARCH = {"center_offsets": (-0.25, 0.0, 0.25), "roi_anchors": 3, "anchor_separation_tokens": 2.0}
_RENDER = {"radius_fraction_of_short_side": 0.02, "max_radius_pixels": 12, "max_added_area_ratio": 0.35, "max_image_area_fraction": 0.25}


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample by supplier: its region of interest is a block of tokens, weights fall with the distance from one of them."""
    s = table(spark, sf_dir, "supplier", "s_suppkey AS sample", "CAST(96 + s_suppkey % 5 * 16 AS INT) AS height", "CAST(128 + s_suppkey % 3 * 16 AS INT) AS width", "CAST(s_suppkey % 11 AS INT) AS a", "CAST(s_nationkey % 9 AS INT) AS b", "CAST(s_suppkey % 41 - 20 AS DOUBLE) AS angle")
    block = "transform(filter(sequence(0, 255), t -> t DIV 16 BETWEEN a AND a + 3 AND t % 16 BETWEEN b AND b + 4), t -> t)"
    return s.selectExpr("sample", "height", "width", "angle", f"{block} AS roi", "transform(sequence(0, 255), t -> 1D / (1 + abs(t DIV 16 - a - 1) + abs(t % 16 - b - 2))) AS weights")


@query("u8_candidates")
def candidate_footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every configured footprint of every sample with its coverage (U8, T5, AG9); rasters of five shapes, so SQL can't state it (tests hold it against pixels)."""
    families = spark.createDataFrame(list(_FAMILIES), "family string, shape string, area_low double, area_high double, area_samples int, aspects array<double>, angles array<double>")
    out = M.candidates(_samples(spark, sf_dir), families, _SEARCH, _RENDER, runs=False)
    return out.select("sample", "family", "candidate_id", "center_x", "center_y", "angle", "area_pixels", "clipped_pixels", "target_precision", "weighted_coverage", "roi_weighted_coverage", "render_area", "render_radius", "render_status")


@query(
    "t5_spread_anchors",
    """WITH RECURSIVE s AS (SELECT s_suppkey AS sample, s_suppkey % 11 AS a, s_nationkey % 9 AS b FROM supplier),
t AS (SELECT sample, k // 16 AS y, k % 16 AS x, row_number() OVER (PARTITION BY sample ORDER BY -1 / (1 + abs(k // 16 - a - 1) + abs(k % 16 - b - 2)), k // 16, k % 16) AS place FROM s, range(256) AS r(k) WHERE k // 16 BETWEEN a AND a + 3 AND k % 16 BETWEEN b AND b + 4),
walk AS (SELECT sample, 0 AS place, CAST([] AS STRUCT(y BIGINT, x BIGINT)[]) AS taken FROM s
  UNION ALL SELECT w.sample, w.place + 1, CASE WHEN len(taken) < 3 AND len(list_filter(taken, lambda p: sqrt((p.y - t.y) * (p.y - t.y) + (p.x - t.x) * (p.x - t.x)) < 2)) = 0 THEN list_append(taken, {'y': t.y, 'x': t.x}) ELSE taken END FROM walk w JOIN t ON t.sample = w.sample AND t.place = w.place + 1)
SELECT sample, list_transform(arg_max(taken, place), lambda p: p.y * 16 + p.x) AS anchors FROM walk GROUP BY sample""",
)
def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heavy tokens that keep their distance, greedily (T5)."""
    tokens = F.transform("roi", lambda t: F.struct(F.floor(t / 16).alias("y"), (t % 16).cast("long").alias("x"), F.element_at("weights", t + 1).alias("weight")))
    taken = M.spread_anchors(tokens, 3, 2.0)
    return _samples(spark, sf_dir).select("sample", F.transform(taken, lambda p: p["y"] * 16 + p["x"]).alias("anchors"))


@query(
    "ag9_roi_coverage",
    f"""WITH r AS ({_RUNS}), i AS (SELECT DISTINCT mask, 8 + mask % 13 AS h, 92 + mask % 7 AS w, mask % 5 AS m FROM r),
px AS (SELECT i.mask, h, w, m, y, unnest(range(x0, x1)) AS x FROM r JOIN i USING (mask)), t AS (SELECT *, (y * 16 // h) * 16 + x * 16 // w AS token FROM px),
grid AS (SELECT mask, h, w, m, (y * 16 // h) * 16 + x * 16 // w AS token, x, y FROM i, range(20) AS p(y), range(98) AS q(x) WHERE y < h AND x < w),
area AS (SELECT mask, token, count(*) AS cells FROM grid GROUP BY ALL), c AS (SELECT mask, m, token, count(*) AS n FROM t GROUP BY ALL),
s AS (SELECT c.mask, sum(n) AS area, sum(n / cells * (token % 9)) AS got, sum(n / cells * (token % 9)) FILTER (token % 7 = m) AS got_roi, coalesce(sum(n) FILTER (token % 7 = m), 0) AS shared FROM c JOIN area USING (mask, token) GROUP BY c.mask),
roi AS (SELECT mask, count(*) AS pixels, avg(x) + 0.5 AS rx, avg(y) + 0.5 AS ry FROM grid WHERE token % 7 = m GROUP BY mask), o AS (SELECT mask, avg(x) + 0.5 AS cx, avg(y) + 0.5 AS cy FROM px GROUP BY mask),
k AS (SELECT m, sum(token % 9) FILTER (token % 7 = m) AS all_roi FROM range(256) AS a(token), range(5) AS b(m) GROUP BY m)
SELECT s.mask, CAST(area AS BIGINT) AS area, round(shared / area, 6) AS precision, round(got / (SELECT sum(token % 9) FROM range(256) AS a(token)), 6) AS coverage, round(coalesce(got_roi, 0) / all_roi, 6) AS roi_coverage, round(shared / pixels, 6) AS binary,
  round(sqrt((cx - rx) * (cx - rx) + (cy - ry) * (cy - ry)) / sqrt(h * h + w * w), 6) AS away FROM s JOIN roi USING (mask) JOIN o USING (mask) JOIN i USING (mask) JOIN k ON k.m = i.m""",
)
def roi_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of a region of interest at native resolution, with the distance of the centroids (AG9, J9, J10, J11)."""
    r = runs(spark, sf_dir)
    roi = F.filter(F.sequence(F.lit(0), F.lit(255)), lambda t: t % 7 == F.col("mask") % 5)
    weights = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda t: (t % 9).cast("double"))
    images = r.select("mask").distinct().select("mask", (8 + F.col("mask") % 13).alias("height"), (92 + F.col("mask") % 7).alias("width"), roi.alias("roi"), weights.alias("weights"))
    out = M.roi_coverage(r, images)
    six = {"target_precision": "precision", "weighted_coverage": "coverage", "roi_weighted_coverage": "roi_coverage", "binary_roi_coverage": "binary", "centroid_distance_normalized": "away"}
    return out.select("mask", "area", *(F.round(a, 6).alias(b) for a, b in six.items()))
