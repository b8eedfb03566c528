"""Queries of the projections, predicates and rule tables.

Planner outputs are stood in for by arithmetic on ids, the same in Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.functions import numbers as N
from trailmark.functions import text as T
from trailmark.operators import rules
from trailmark.operators.aggregates import summary
from trailmark.plans.registry import query, sql_list, table

ROUTE_WORDS = ("global", "local", "dual", "skip", " Weather ", "both", "occlusion_only", "other")
CONDITIONS = ("rain+vehicle", "snow", "Person + fog", "rainy-night", "Road-traffic occlusion", "none", "overcast+person+vehicle", "")
NUMBERS = ("0.5", "7", "12", "-1", "x", "", "NaN", "0.12345", "1e-3", "1")
SWITCHES = ("1", "TRUE", " yes ", "y", "no", "0", "", "t")


def pick(values: tuple[str, ...], at: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.expr(at) % len(values) + 1).cast("int"))


def sql_pick(values: tuple[str, ...], at: str) -> str:
    return f"{sql_list(values)}[CAST(({at}) % {len(values)} + 1 AS INT)]"


_SQL_ROUTE = "CASE trim(lower({0})) WHEN 'weather' THEN 'global' WHEN 'weather_only' THEN 'global' WHEN 'occlusion' THEN 'local' WHEN 'occlusion_only' THEN 'local' WHEN 'both' THEN 'dual' WHEN 'weather_and_occlusion' THEN 'dual' WHEN 'pass' THEN 'skip' WHEN 'global' THEN 'global' WHEN 'local' THEN 'local' WHEN 'dual' THEN 'dual' WHEN 'skip' THEN 'skip' ELSE '{1}' END"
_SCENES = f"""
scenes AS (
  SELECT d.doc_id, ['local', 'global', 'dual', 'skip'][CAST(d.doc_id % 4 + 1 AS INT)] AS route, ['rain', 'snow', 'Rainy-Night', 'fog'][CAST(d.doc_id // 4 % 4 + 1 AS INT)] AS weather,
    ['vehicle', 'person'][CAST(d.doc_id // 16 % 2 + 1 AS INT)] AS occlusion, d.doc_id * 37 % 100 / 100.0 AS s_geo, d.doc_id * 53 % 40 / 100.0 AS s_div
  FROM documents d
), gated AS (
  SELECT *, route = 'skip' AS skipped, route <> 'skip' AND s_geo >= CASE route WHEN 'local' THEN 0.82 WHEN 'global' THEN 0.78 ELSE 0.72 END AS geo_ok,
    route <> 'skip' AND s_div >= CASE WHEN route = 'dual' AND weather IN ('rain', 'Rainy-Night') AND occlusion = 'vehicle' THEN 0.12 WHEN route = 'local' THEN 0.09 WHEN route = 'global' THEN 0.15 ELSE 0.20 END AS div_ok
  FROM scenes
)"""


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "doc_id * 37 % 100 / 100.0D AS s_geo", "doc_id * 53 % 40 / 100.0D AS s_div")
    return d.select("*", pick(("local", "global", "dual", "skip"), "doc_id").alias("route"), pick(("rain", "snow", "Rainy-Night", "fog"), "doc_id div 4").alias("weather"), pick(("vehicle", "person"), "doc_id div 16").alias("occlusion"))


@query(
    "summary_by_route",
    f"""WITH {_SCENES}, good AS (
  SELECT g.*, coalesce(l.toxic, 0) = 0 AND geo_ok AND div_ok AS passed FROM gated g LEFT JOIN labels l USING (doc_id)
)
SELECT r.route, count(g.doc_id) AS total, count(*) FILTER (passed) AS passed, CASE WHEN count(g.doc_id) > 0 THEN round_even(count(*) FILTER (passed) / count(g.doc_id), 6) ELSE 0.0 END AS pass_rate
FROM (VALUES ('global'), ('local'), ('dual'), ('skip')) r(route) LEFT JOIN good g ON g.route = r.route GROUP BY r.route""",
)
def summary_by_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores, gates by route, labels, zero-filled summary (PF7, PF20, J7, AG1)."""
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic")
    rows = rules.verify(scenes(spark, sf_dir)).join(labels, "doc_id", "left").withColumn("passed", F.col("passed") & (F.coalesce("toxic", F.lit(0)) == 0))
    return summary(rows, "route", ("global", "local", "dual", "skip"), "passed")


@query("pf20_verification_gate", f"WITH {_SCENES} SELECT doc_id, route, skipped, geo_ok, div_ok, geo_ok AND div_ok AS passed FROM gated")
def verification_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.verify(scenes(spark, sf_dir)).select("doc_id", "route", "skipped", "geo_ok", "div_ok", "passed")


@query("pf1_safe_ids", r"""SELECT page_id, nullif(regexp_replace(regexp_replace(trim(url), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), '') AS sample_id,
  replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '\.[^./]*$', ''), '/', '__') AS path_id FROM pages""")
def safe_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids from free text and from relative paths (PF1, SC2)."""
    return table(spark, sf_dir, "pages", "page_id", "url").select("page_id", T.safe_id(F.col("url")).alias("sample_id"), T.path_id(F.regexp_replace("url", "^[a-z]+://", "")).alias("path_id"))


@query("pf2_routes", f"""WITH r AS (SELECT doc_id, {_SQL_ROUTE.format(sql_pick(ROUTE_WORDS, 'doc_id'), 'skip')} AS route, {_SQL_ROUTE.format(sql_pick(ROUTE_WORDS, 'doc_id'), 'dual')} AS judged FROM documents)
SELECT doc_id, route, CASE judged WHEN 'skip' THEN 'pass' ELSE judged END AS judged_route FROM r""")
def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route aliases with the planner's and the judge's default (PF2, PF3)."""
    raw = pick(ROUTE_WORDS, "doc_id")
    return table(spark, sf_dir, "documents", "doc_id").select("doc_id", T.route(raw).alias("route"), T.judged_route(raw).alias("judged_route"))


@query(
    "pf5_conditions",
    f"""WITH w AS (SELECT doc_id, lower(trim({sql_pick(CONDITIONS, 'doc_id')})) AS raw FROM documents),
p AS (SELECT doc_id, raw, list_transform(string_split(raw, '+'), lambda x: trim(x)) AS parts FROM w),
n AS (SELECT doc_id, raw, parts, list_filter(list_transform(parts, lambda x: CASE WHEN x IN ('rainy-night', 'rainy night') THEN 'rainy_night' ELSE x END), lambda x: x IN {tuple(T.WEATHERS)}) AS named, list_filter(parts, lambda x: x IN ('vehicle', 'person')) AS who FROM p)
SELECT doc_id, named[1] AS weather, coalesce(who[1], CASE WHEN raw = 'road-traffic occlusion' THEN 'vehicle' END) AS occlusion FROM n""",
)
def conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather and occlusion from a condition text (PF4, PF5)."""
    return table(spark, sf_dir, "documents", "doc_id").select("doc_id", T.condition(pick(CONDITIONS, "doc_id")).alias("c")).select("doc_id", "c.*")


_SQL_NUMBER = f"coalesce(TRY_CAST({sql_pick(NUMBERS, 'event_id')} AS DOUBLE), 0.0)"


@query(
    "pf7_scores",
    f"""WITH n AS (SELECT event_id, {_SQL_NUMBER} AS x, {sql_pick(SWITCHES, 'event_id')} AS b FROM events),
s AS (SELECT event_id, b, CASE WHEN isnan(x) THEN 1.0 ELSE greatest(0.0, least(1.0, CASE WHEN x > 1 THEN x / 10 ELSE x END)) END AS score FROM n)
SELECT event_id, CAST(score AS DOUBLE) AS score, CAST(format('{{:.4f}}', CAST(score AS DOUBLE)) AS DOUBLE) AS score4, lower(trim(b)) IN ('1', 'true', 'yes', 'y') AS flag FROM s""",
)
def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lenient numbers and switches (PF7, PF8, PF9)."""
    s = N.score(pick(NUMBERS, "event_id"))
    return table(spark, sf_dir, "events", "event_id").select("event_id", s.alias("score"), N.round_even(s).alias("score4"), N.boolish(pick(SWITCHES, "event_id")).alias("flag"))


@query("pf10_json_part", r"""SELECT event_id, CAST(json_extract(CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN regexp_extract('Answer: ' || props || ' done', '(?s)\{.*\}', 0) END, '$.k') AS BIGINT) AS k FROM events""")
def json_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object as the whole answer or inside prose; none is null (PF10)."""
    raw = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Answer: "), "props", F.lit(" done"))).otherwise("no object")
    return table(spark, sf_dir, "events", "event_id", "props").select("event_id", F.from_json(T.json_part(raw), "k bigint")["k"].alias("k"))


PHRASES = ("Parked cars near the curb", "an empty square", "traffic lane ahead", "existing car, parking lane and sidewalk", "wide crosswalk", "dense green tree by the parking bay", "no visible road", "roadside parking")
_SQL_TEXT = f"({sql_pick(PHRASES, 'doc_id')} || '. ' || coalesce(text, ''))"


def placed(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text", *more).withColumn("text", F.concat(pick(PHRASES, "doc_id"), F.lit(". "), F.coalesce("text", F.lit(""))))


def _found(words: tuple[str, ...], text: str = "low") -> str:
    return f"list_filter({sql_list(words)}, lambda t: contains({text}, t))"


@query(
    "pf13_surfaces",
    f"""WITH t AS (SELECT doc_id, lower({_SQL_TEXT}) AS low FROM documents),
f AS (SELECT doc_id, len({_found(T.VEHICLE_SURFACES)}) AS v, len({_found(T.PERSON_SURFACES)}) AS p, list_sort({_found(T.CROWDING_STRONG)}) AS strong, list_sort({_found(T.CROWDING_WEAK)}) AS weak FROM t)
SELECT doc_id, CASE WHEN v > 0 THEN 'vehicle' WHEN p > 0 THEN 'person' END AS occlusion, doc_id % 3 > 0 AND v > 0 AND (len(strong) > 0 OR len(weak) >= 2) AS crowded,
  CASE WHEN doc_id % 3 > 0 AND v > 0 THEN array_to_string(CASE WHEN len(strong) > 0 THEN strong ELSE weak END, '|') ELSE '' END AS reasons FROM f""",
)
def surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places for vehicles and persons in whole texts, and crowding (PF13, PF14, PF16)."""
    low = placed(spark, sf_dir).select("doc_id", F.lower("text").alias("text"), F.when(F.col("doc_id") % 3 > 0, "local").otherwise("dual").alias("route"))
    rows = low.withColumn("occlusion", T.occlusion(F.col("text")))
    return T.crowding(rows).select("doc_id", "occlusion", "crowded", F.array_join("reasons", "|").alias("reasons"))


@query(
    "pf15_bad_image",
    f"""WITH t AS (SELECT doc_id, lower({_SQL_TEXT}) AS low, ['local', 'global', 'dual'][CAST(doc_id % 3 + 1 AS INT)] AS route, CASE WHEN doc_id % 5 > 0 THEN ['rain', 'night'][CAST(doc_id // 3 % 2 + 1 AS INT)] END AS weather,
  CASE WHEN doc_id % 7 > 0 THEN ['vehicle', 'person'][CAST(doc_id // 9 % 2 + 1 AS INT)] END AS occlusion, ['high', 'low'][CAST(doc_id // 2 % 2 + 1 AS INT)] AS feasible FROM documents),
s AS (SELECT *, route IN ('local', 'dual') AS placed, len({_found(T.VEHICLE_SURFACES)}) > 0 AS v, len({_found(T.PERSON_SURFACES)}) > 0 AS p FROM t),
f AS (SELECT *, list_filter([CASE WHEN placed AND occlusion IS NULL THEN 'missing_occlusion' END, CASE WHEN route IN ('global', 'dual') AND weather IS NULL THEN 'missing_weather' END,
  CASE WHEN placed AND len({_found(('taxi rear', 'rear of the', 'specific sign'))}) > 0 THEN 'over_specific_occlusion_target' END,
  CASE WHEN len({_found(('facade close-up', 'no visible sidewalk', 'no visible road', 'no plausible sidewalk'))}) > 0 THEN 'occlusion_implausible' END,
  CASE WHEN placed AND occlusion = 'person' AND v THEN 'person_selected_despite_vehicle_surface' END, CASE WHEN placed AND occlusion = 'vehicle' AND NOT v THEN 'vehicle_surface_not_explicit' END,
  CASE WHEN placed AND occlusion = 'person' AND NOT p THEN 'person_surface_not_explicit' END, CASE WHEN placed AND contains(low, 'dense green tree') THEN 'foreground_foliage_may_confuse_occluder' END,
  CASE WHEN route = 'dual' AND occlusion = 'vehicle' AND weather = 'night' THEN 'night_vehicle_high_hallucination_risk' END], lambda x: x IS NOT NULL) AS flags FROM s)
SELECT doc_id, array_to_string(flags, '|') AS flags, CAST(least(10, len(flags) * 3) AS INT) AS risk_score,
  CASE WHEN least(10, len(flags) * 3) >= 6 AND placed AND (list_has_any(flags, {sql_list(rules.HARD_SKIP)}) OR feasible = 'low') THEN 'skip' WHEN least(10, len(flags) * 3) >= 6 AND placed THEN 'global' ELSE route END AS final_route FROM f""",
)
def bad_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk flags, score and the skip policy (PF15, PF17, PF18, SO4)."""
    rows = placed(spark, sf_dir).select(
        "*",
        pick(("local", "global", "dual"), "doc_id").alias("route"),
        F.when(F.col("doc_id") % 5 > 0, pick(("rain", "night"), "doc_id div 3")).alias("weather"),
        F.when(F.col("doc_id") % 7 > 0, pick(("vehicle", "person"), "doc_id div 9")).alias("occlusion"),
        pick(("high", "low"), "doc_id div 2").alias("weather_feasibility"),
    )
    return rules.bad_image_policy(rules.bad_image(rows)).select("doc_id", F.array_join("risk_flags", "|").alias("flags"), "risk_score", "final_route")


_LEVELS = {"vegetation_level": ("high", "low"), "facade_density": ("low", "high", "medium"), "close_building": ("no", "yes", ""), "road_visibility": ("clear", "partial", "none", "low", "clear"), "global_weather_risk": ("low", "medium", "low", "high", "low", "low", "low"), "distant_landmarks_readable": ("high", "low"), "sky_visibility": ("clear", "none", "clear")}


@query(
    "pf19_scene_risk",
    f"""WITH l AS (SELECT doc_id, {', '.join(f"{sql_pick(v, f'doc_id // {k + 1}')} AS {c}" for k, (c, v) in enumerate(_LEVELS.items()))} FROM documents),
b AS (SELECT *, vegetation_level = 'high' AS green, facade_density = 'high' OR close_building IN ('yes', 'true', '1') AS facade, road_visibility IN ('partial', 'none', 'low') AS road FROM l)
SELECT doc_id, CASE WHEN global_weather_risk = 'high' OR (green AND road) OR (facade AND road) OR (distant_landmarks_readable = 'low' AND road) THEN 'high'
  WHEN global_weather_risk = 'medium' OR green OR facade OR road OR sky_visibility = 'none' THEN 'medium' ELSE 'low' END AS scene_risk FROM b""",
)
def scene_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = [pick(v, f"doc_id div {k + 1}").alias(c) for k, (c, v) in enumerate(_LEVELS.items())]
    return rules.scene_risk(table(spark, sf_dir, "documents", "doc_id").select("doc_id", *levels)).select("doc_id", "scene_risk")


_FAMILIES, _REGIONS, _SUPPORTS = tuple(rules.ALLOWED_REGIONS), tuple(rules.REGION_SUPPORTS), ("paved_ground", "soil_ground", "building_base", "facade_attachment", "none", "unknown")


def _in(table_: dict, a: str, b: str) -> str:
    return f"({a} || '/' || {b}) IN ({', '.join(repr(f'{k}/{v}') for k, vs in table_.items() for v in vs)})"


@query(
    "pf24_hard_rules",
    f"""WITH d AS (SELECT doc_id, doc_id % 11 > 0 AS editable, {sql_pick(_REGIONS, 'doc_id')} AS region, {sql_pick(_SUPPORTS, 'doc_id // 9')} AS support, {sql_pick(_FAMILIES, 'doc_id // 5')} AS family, doc_id * 29 % 100 / 100.0 AS confidence FROM documents),
r AS (SELECT doc_id, editable, family, list_filter([CASE WHEN NOT editable THEN 'vlm_rejected' END, CASE WHEN region = 'sky' THEN 'sky_not_editable' END, CASE WHEN confidence < 0.7 THEN 'low_confidence' END, CASE WHEN region = 'unknown' THEN 'unknown_region_not_supported' END,
  CASE WHEN support IN ('none', 'unknown') THEN 'no_visible_support' END, CASE WHEN editable AND NOT {_in(rules.ALLOWED_REGIONS, 'family', 'region')} THEN 'family_region_incompatible' END,
  CASE WHEN editable AND NOT ({_in(rules.ALLOWED_SUPPORTS, 'family', 'support')} AND {_in(rules.REGION_SUPPORTS, 'region', 'support')}) THEN 'support_incompatible' END], lambda x: x IS NOT NULL) AS reasons FROM d)
SELECT doc_id, array_to_string(reasons, '|') AS reasons, len(reasons) = 0 AS accepted, editable AND len(reasons) = 0 AS editable, CASE WHEN len(reasons) = 0 THEN family ELSE 'none' END AS occluder_family FROM r""",
)
def hard_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "doc_id % 11 > 0 AS editable", "doc_id * 29 % 100 / 100.0D AS confidence")
    d = d.select("*", pick(_REGIONS, "doc_id").alias("region_type"), pick(_SUPPORTS, "doc_id div 9").alias("support_surface"), pick(_FAMILIES, "doc_id div 5").alias("occluder_family"))
    return rules.hard_rules(d).select("doc_id", F.array_join("reject_reasons", "|").alias("reasons"), "accepted", "editable", "occluder_family")


_CANDIDATES = """c AS (SELECT l_orderkey, l_linenumber, l_orderkey * 8 + l_linenumber AS candidate_id, ['sign', 'cones', 'tarp'][CAST(l_linenumber % 3 + 1 AS INT)] AS family,
  l_discount * 10 AS precision_, CASE WHEN l_tax > 0 THEN l_quantity / 50 END AS coverage, l_quantity / 100 AS area, l_suppkey % 3 AS clipped, 1 + CAST(l_partkey % 4 = 0 AS INT) AS components FROM lineitem)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(
        spark, sf_dir, "lineitem", "l_orderkey", "l_orderkey * 8 + l_linenumber AS candidate_id", "l_linenumber", "l_discount * 10 AS target_precision", "CASE WHEN l_tax > 0 THEN l_quantity / 50 END AS weighted_coverage",
        "l_quantity / 100 AS area_fraction", "l_suppkey % 3 AS clipped_pixels", "1 + CAST(l_partkey % 4 = 0 AS INT) AS num_components", "0.05D AS area_low", "0.45D AS area_high",
    )
    return c.withColumn("family", pick(("sign", "cones", "tarp"), "l_linenumber"))


@query(
    "ag5_thresholds",
    f"""WITH {_CANDIDATES}, t AS (SELECT c.*, tau FROM c, (VALUES (0.3), (0.5), (0.7)) x(tau)),
p AS (SELECT family, tau, l_orderkey, area BETWEEN 0.05 AND 0.45 AND clipped <= 0 AND components = 1 AND precision_ >= 0.7 AND coverage IS NOT NULL AND NOT coalesce(coverage < tau, false) AS ok, coverage IS NULL AS undefined FROM t)
SELECT family, CAST(tau AS DOUBLE) AS tau, count(*) AS candidates, count(*) FILTER (ok) AS passes, count(DISTINCT CASE WHEN ok THEN l_orderkey END) AS samples, count(*) FILTER (undefined) AS undefined FROM p GROUP BY family, tau""",
)
def threshold_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons by threshold, counted by family (PF27, AG5)."""
    return rules.threshold_summary(candidates(spark, sf_dir).withColumn("clipped_pixels", F.col("clipped_pixels").cast("int")), "family", "l_orderkey")


ERRORS = ("insufficient_quota", "connection error", "Error code: 502 - bad gateway", "timed out", "fine", "Access Denied", "rate limit", "InternalServerError: overload", "parse failed")


@query("pf11_system_errors", f"SELECT event_id, len({_found(T.SYSTEMIC_ERRORS, 'lower(' + sql_pick(ERRORS, 'event_id') + ')')}) > 0 AS systemic FROM events")
def system_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the service as a whole (PF11)."""
    return table(spark, sf_dir, "events", "event_id").select("event_id", T.systemic_error(pick(ERRORS, "event_id")).alias("systemic"))


@query("fn_seeds", "SELECT page_id, 1 + CAST('0x' || substr(sha256('7|' || page_id || '|' || url), 1, 8) AS BIGINT) % 2000000000 AS seed, sha256(url) AS digest FROM pages")
def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages", "page_id", "url").select("page_id", N.seed(7, F.col("page_id").cast("string"), F.col("url")).alias("seed"), F.sha2("url", 256).alias("digest"))


@query("fn_shorten", r"""WITH f AS (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM benchmark)
SELECT item_id, CASE WHEN length(flat) > 140 THEN regexp_replace(substr(flat, 1, 140), ' [^ ]*$', '') ELSE flat END AS short FROM f""")
def shortened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark", "item_id", "text").select("item_id", T.shorten(F.col("text")).alias("short"))


@query(
    "pf28_in_bounds",
    """WITH m AS (SELECT l_orderkey, l_quantity * 2 - 20 AS x0, l_discount * 500 AS y0, l_tax * 800 AS x1, l_quantity AS y1, l_suppkey % 10 AS conf FROM lineitem)
SELECT l_orderkey, count(*) AS matches, count(*) FILTER (x0 >= 0 AND x0 < 60 AND y0 >= 0 AND y0 < 40 AND x1 >= 0 AND x1 < 50 AND y1 >= 0 AND y1 < 30) AS inside,
  count(*) FILTER (x0 >= 0 AND x0 < 60 AND y0 >= 0 AND y0 < 40 AND x1 >= 0 AND x1 < 50 AND y1 >= 0 AND y1 < 30 AND conf > 4) / count(*) AS s_geo FROM m GROUP BY l_orderkey""",
)
def in_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches inside both images and the inlier share (PF28, PF31, AG10)."""
    m = table(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity * 2 - 20 AS x0", "l_discount * 500 AS y0", "l_tax * 800 AS x1", "l_quantity AS y1", "l_suppkey % 10 AS conf")
    inside = F.expr("x0 >= 0 AND x0 < 60 AND y0 >= 0 AND y0 < 40 AND x1 >= 0 AND x1 < 50 AND y1 >= 0 AND y1 < 30")
    return m.groupBy("l_orderkey").agg(F.count("*").alias("matches"), F.count_if(inside).alias("inside"), (F.count_if(inside & (F.col("conf") > 4)) / F.count("*")).alias("s_geo"))
