"""Queries of record contracts, whole policies and digests. Records are stood in for by JSON made from ids, with one change each in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.functions import text as T
from trailmark.operators import contracts as C
from trailmark.operators import rules
from trailmark.operators.scheduler import SAFE_WEATHERS, WEATHER_ORDER

from .registry import query, sql_list, table
from .rule_plans import _SQL_TEXT, _found, pick, placed, sql_pick

_BASE = '{"schema_version": 1, "sample_id": "s#", "image_key": "paris/#.jpg", "place_key": "p", "source_path": "/r/paris/#.jpg", "mask_original_path": "m", "target_type": "attention", "mask_ratio": 0.25, "clean_margin": 0, "mask_mode": "top", "mask_token_count": 5, "checkpoint_path": "c", "checkpoint_sha256": "d", "stage2_commit": "e", "seed": 3}'
_CHANGES = (
    ('"seed": 3', '"seed": 4'), ('"seed": 3', '"seed": null'), (', "seed": 3', ""), ('"seed": 3', '"seed": -3'), ('"seed": 3', '"seed": 3.5'), ('"seed": 3', '"seed": "3"'), ("version\": 1", "version\": 2"), ("version\": 1", "version\": \"1\""),
    ('"p"', '" "'), ('"p"', "7"), ('"attention"', '"fused"'), ('"attention"', '"both"'), ('"seed": 3', '"seed": 3, "target_role": "primary"'), ('"seed": 3', '"seed": 3, "target_role": "supplementary"'), ('"seed": 3', '"seed": 3, "source_role": "MASK"'),
    ('"paris/', '"/paris/'), ('"paris/', '"paris/../'), ('"paris/', '"paris//'), ('"paris/', '"./paris/'), ("0.25", "0"), ("0.25", "1"), ("0.25", "1.5"), ("0.25", "true"), ("margin\": 0", "margin\": \"0\""), ("count\": 5", "count\": 0"),
    ('"seed": 3', '"seed": 3, "source_width": 0'), ('"seed": 3', '"seed": 3, "source_width": null'), ('"seed": 3', '"seed": 3, "source_height": 12'), ('"seed": 3}', '"seed": 3'), ('"seed": 3', '"seed": 3, "seed": 3'),
)
_OLD, _NEW = tuple(a for a, _ in _CHANGES), tuple(b for _, b in _CHANGES)


def _quoted(values: tuple[str, ...], key: str) -> str:
    return f"[{', '.join(chr(39) + v + chr(39) for v in values)}][CAST({key} % {len(values)} + 1 AS INT)]"


_RAW = f"SELECT o_orderkey, replace(replace('{_BASE}', {_quoted(_OLD, 'o_orderkey')}, {_quoted(_NEW, 'o_orderkey')}), '#', CAST(o_orderkey AS VARCHAR)) AS raw FROM orders"


def _given(name: str) -> str:
    return f"coalesce(json_type(raw, '$.{name}'), 'NULL') <> 'NULL'"


def _whole(name: str, low: int) -> str:
    return f"(json_type(raw, '$.{name}') IN ('UBIGINT', 'BIGINT') AND TRY_CAST(json_extract_string(raw, '$.{name}') AS BIGINT) >= {low})"


_KIND = lambda name: f"json_type(raw, '$.{name}')"
_SAID = lambda name: f"json_extract_string(raw, '$.{name}')"


@query(
    "pf21_record_contract",
    f"""WITH r AS ({_RAW}) SELECT o_orderkey, CASE
  WHEN NOT json_valid(raw) OR len(json_keys(raw)) <> len(list_distinct(json_keys(raw))) THEN 'not_an_object'
  WHEN NOT ({' AND '.join(map(_given, C.REQUIRED))}) THEN 'missing_required_fields'
  WHEN NOT ({_whole('schema_version', 1)} AND {_SAID('schema_version')} = '1') THEN 'unsupported_schema_version'
  {' '.join(f"WHEN {_KIND(n)} <> 'VARCHAR' OR trim({_SAID(n)}) = '' THEN '{n}_not_a_nonempty_string'" for n in C.TEXTS)}
  WHEN {_KIND('target_type')} <> 'VARCHAR' OR {_SAID('target_type')} NOT IN ('attention', 'fused') THEN 'invalid_target_type'
  WHEN {_KIND('target_role')} IS NOT NULL AND coalesce({_SAID('target_role')}, '') <> CASE {_SAID('target_type')} WHEN 'attention' THEN 'primary' ELSE 'supplementary' END THEN 'target_role_disagrees'
  WHEN {_KIND('source_role')} IS NOT NULL AND coalesce({_SAID('source_role')}, '') <> 'SOURCE' THEN 'source_role_not_source'
  WHEN len(list_filter(string_split({_SAID('image_key')}, '/'), lambda p: p IN ('', '.', '..'))) > 0 OR contains({_SAID('image_key')}, '\\') THEN 'image_key_not_normalized'
  WHEN {_KIND('mask_ratio')} NOT IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN 'mask_ratio_not_a_finite_number'
  WHEN {_KIND('clean_margin')} NOT IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN 'clean_margin_not_a_finite_number'
  WHEN CAST({_SAID('mask_ratio')} AS DOUBLE) <= 0 OR CAST({_SAID('mask_ratio')} AS DOUBLE) > 1 THEN 'mask_ratio_out_of_range'
  WHEN NOT {_whole('seed', 0)} THEN 'seed_not_a_whole_number' WHEN NOT {_whole('mask_token_count', 1)} THEN 'mask_token_count_not_positive'
  WHEN {_KIND('source_width')} IS NOT NULL AND NOT {_whole('source_width', 1)} THEN 'source_width_not_positive' WHEN {_KIND('source_height')} IS NOT NULL AND NOT {_whole('source_height', 1)} THEN 'source_height_not_positive'
END AS fault FROM r""",
)
def record_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first broken rule of every target record (PF21, PF34's checks of types)."""
    key = F.col("o_orderkey")
    raw = F.replace(F.replace(F.lit(_BASE), pick(_OLD, "o_orderkey"), pick(_NEW, "o_orderkey")), F.lit("#"), key.cast("string"))
    return C.target_faults(table(spark, sf_dir, "orders", "o_orderkey").select("o_orderkey", raw.alias("raw"))).select("o_orderkey", F.get("faults", F.lit(0)).alias("fault"))


@query("fn_canonical_json", """SELECT event_id, '{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || ',"value":{"half":' || CASE WHEN event_id % 2 = 0 THEN '0.5' ELSE '1.5' END || ',"id":' || CAST(event_id AS VARCHAR) || ',"none":null}}' AS text FROM events""")
def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects with sorted keys and tight separators (FN canonical JSON)."""
    e = table(spark, sf_dir, "events", "event_id", "get_json_object(props, '$.k') AS k")
    text = F.concat(F.lit('{"value": {"none": null, "id": '), F.col("event_id").cast("string"), F.lit(', "half": '), F.when(F.col("event_id") % 2 == 0, "5e-1").otherwise("1.50"), F.lit('}, "k": '), "k", F.lit("}"))
    return e.select("event_id", T.canonical_json(text).alias("text"))


_RISK = f"""t AS (SELECT doc_id, lower({_SQL_TEXT}) AS low, ['local', 'global', 'dual'][CAST(doc_id % 3 + 1 AS INT)] AS route, CASE WHEN doc_id % 5 > 0 THEN ['rain', 'night', 'Rainy Night', 'storm'][CAST(doc_id // 3 % 4 + 1 AS INT)] END AS weather,
  CASE WHEN doc_id % 7 > 0 THEN ['vehicle', 'person'][CAST(doc_id // 9 % 2 + 1 AS INT)] END AS occlusion, ['high', 'low'][CAST(doc_id // 2 % 2 + 1 AS INT)] AS feasible, doc_id % 23 = 0 OR doc_id % 29 = 0 AS bad, CASE WHEN doc_id % 4 = 0 THEN ' why ' END AS given FROM documents),
s AS (SELECT *, route IN ('local', 'dual') AS placed, len({_found(T.VEHICLE_SURFACES)}) > 0 AS v, len({_found(T.PERSON_SURFACES)}) > 0 AS p FROM t),
f AS (SELECT *, list_filter([CASE WHEN placed AND occlusion IS NULL THEN 'missing_occlusion' END, CASE WHEN route IN ('global', 'dual') AND weather IS NULL THEN 'missing_weather' END,
  CASE WHEN placed AND len({_found(('taxi rear', 'rear of the', 'specific sign'))}) > 0 THEN 'over_specific_occlusion_target' END, CASE WHEN len({_found(('facade close-up', 'no visible sidewalk', 'no visible road', 'no plausible sidewalk'))}) > 0 THEN 'occlusion_implausible' END,
  CASE WHEN placed AND occlusion = 'person' AND v THEN 'person_selected_despite_vehicle_surface' END, CASE WHEN placed AND occlusion = 'vehicle' AND NOT v THEN 'vehicle_surface_not_explicit' END,
  CASE WHEN placed AND occlusion = 'person' AND NOT p THEN 'person_surface_not_explicit' END, CASE WHEN placed AND contains(low, 'dense green tree') THEN 'foreground_foliage_may_confuse_occluder' END,
  CASE WHEN route = 'dual' AND occlusion = 'vehicle' AND weather = 'night' THEN 'night_vehicle_high_hallucination_risk' END], lambda x: x IS NOT NULL) AS flags FROM s),
d AS (SELECT *, NOT bad AND placed AND len(flags) >= 2 AS risky, list_has_any(flags, {sql_list(rules.HARD_SKIP)}) OR feasible = 'low' AS hard FROM f)"""


@query(
    "pf17_policy_rewrites",
    f"""WITH {_RISK} SELECT doc_id, CASE WHEN bad OR risky AND hard THEN 'skip' WHEN risky THEN 'global' ELSE route END AS route, CASE WHEN bad OR risky THEN route END AS original_route,
  CASE WHEN bad OR risky AND hard THEN NULL WHEN risky THEN CASE WHEN weather IN ('rain', 'night') THEN weather WHEN weather = 'Rainy Night' THEN 'rainy_night' ELSE 'rain' END ELSE weather END AS weather, CASE WHEN NOT bad AND NOT risky THEN occlusion END AS occlusion,
  CASE WHEN bad THEN CASE WHEN given IS NULL THEN 'bad_image_requires_direct_skip' ELSE 'why' END WHEN risky AND hard THEN CASE WHEN list_contains(flags, 'occlusion_implausible') THEN 'no_valid_street_surface_for_occlusion' WHEN list_contains(flags, 'foreground_foliage_may_confuse_occluder') THEN 'occlusion_would_be_unreliable_or_edge_artifact'
    WHEN list_contains(flags, 'night_vehicle_high_hallucination_risk') THEN 'vehicle_occlusion_high_hallucination_risk_and_weather_not_feasible' ELSE 'local_or_dual_risk_too_high' END ELSE given END AS skip_reason, CASE WHEN risky AND NOT hard THEN '{rules.DOWNGRADE_REASON}' END AS downgrade_reason FROM d""",
)
def policy_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows rewritten by the bad-image policies (PF17, PF18)."""
    rows = placed(spark, sf_dir).select(
        "*",
        pick(("local", "global", "dual"), "doc_id").alias("route"),
        F.when(F.col("doc_id") % 5 > 0, pick(("rain", "night", "Rainy Night", "storm"), "doc_id div 3")).alias("weather"),
        F.when(F.col("doc_id") % 7 > 0, pick(("vehicle", "person"), "doc_id div 9")).alias("occlusion"),
        pick(("high", "low"), "doc_id div 2").alias("weather_feasibility"),
        F.when(F.col("doc_id") % 23 == 0, "yes").otherwise("no").alias("bad_image"),
        F.when(F.col("doc_id") % 29 == 0, "Bad").alias("street_scene_quality"),
        F.when(F.col("doc_id") % 4 == 0, " why ").alias("skip_reason"),
    )
    return rules.enforce_bad_image_policy(rows).select("doc_id", "route", "original_route", "weather", "occlusion", "skip_reason", "downgrade_reason")


_SCENE_WORDS = ("a quiet street", "Trees on both sides", "a car park", "parking spaces", "storefront row near the kerb", "no clear road in view", "a billboard over a weak road", "facade-dominated view", "treeline, limited road", "Busy junction")


def _says(terms: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(low, '{t}')" if " " in t or "-" in t else f"regexp_matches(low, '(^|[^\\p{{L}}\\p{{N}}_]){t}($|[^\\p{{L}}\\p{{N}}_])')" for t in terms) + ")"


@query(
    "pf19_scene_policy",
    f"""WITH l AS (SELECT doc_id, lower({sql_pick(_SCENE_WORDS, 'doc_id')}) AS low, ['global', 'local', 'global'][CAST(doc_id % 3 + 1 AS INT)] AS route, {sql_pick(('high', 'low', ''), 'doc_id // 2')} AS vegetation, {sql_pick(('clear', 'partial', 'none', 'clear', 'low'), 'doc_id // 3')} AS road_level,
  {sql_pick(('low', 'medium', 'low', 'high', 'low', 'low'), 'doc_id // 4')} AS asked, {sql_pick(('high', 'low'), 'doc_id // 5')} AS landmarks, {sql_pick(('clear', 'none', 'clear'), 'doc_id // 6')} AS sky, CASE WHEN doc_id % 4 = 0 THEN ['fog', 'snow'] WHEN doc_id % 4 = 1 THEN ['hail'] ELSE [] END AS own FROM documents),
b AS (SELECT *, vegetation = 'high' OR {_says(rules.VEGETATION_TERMS + rules.BILLBOARD_TERMS)} AS green, {_says(rules.DENSE_FACADE_TERMS)} AS facade, road_level IN ('partial', 'none', 'low') OR {_says(rules.WEAK_ROAD_TERMS)} AS road FROM l),
h AS (SELECT *, asked = 'high' OR (green AND road) OR (facade AND road) OR (landmarks = 'low' AND road) AS high, landmarks = 'low' AND road AS mark FROM b),
o AS (SELECT *, route = 'global' AND high AND road_level = 'none' AS skip, list_filter({sql_list(WEATHER_ORDER)}, lambda w: NOT high OR w IN ('overcast', 'fog')) AS pool FROM h)
SELECT doc_id, CASE WHEN skip THEN 'skip' ELSE route END AS route, CASE WHEN route = 'global' THEN CASE WHEN high THEN 'high' WHEN asked = 'medium' OR green OR facade OR road OR sky = 'none' THEN 'medium' ELSE 'low' END END AS scene_risk,
  CASE WHEN route = 'global' THEN array_to_string(list_filter([CASE WHEN asked IN ('medium', 'high') THEN 'global_weather_risk=' || asked END, CASE WHEN green THEN 'vegetation_or_billboard_risk' END, CASE WHEN facade THEN 'dense_or_close_facade_risk' END, CASE WHEN road THEN 'weak_road_visibility' END,
    CASE WHEN mark THEN 'weak_landmark_with_weak_road' END, CASE WHEN sky = 'none' THEN 'no_sky_visibility' END], lambda x: x IS NOT NULL), '|') END AS reasons,
  CASE WHEN route = 'global' AND NOT skip THEN array_to_string(CASE WHEN len(list_filter(pool, lambda w: list_contains(own, w))) > 0 THEN list_filter(pool, lambda w: list_contains(own, w)) ELSE pool END, '|') END AS pool FROM o""",
)
def scene_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene risk from levels and texts with its reasons, guard and weathers to choose from (PF19)."""
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "documents", "doc_id").select(
        "doc_id", pick(_SCENE_WORDS, "doc_id").alias("prompt"), pick(("global", "local", "global"), "doc_id").alias("route"), pick(("high", "low", ""), "doc_id div 2").alias("vegetation_level"), pick(("clear", "partial", "none", "clear", "low"), "doc_id div 3").alias("road_visibility"),
        pick(("low", "medium", "low", "high", "low", "low"), "doc_id div 4").alias("global_weather_risk"), pick(("high", "low"), "doc_id div 5").alias("distant_landmarks_readable"), pick(("clear", "none", "clear"), "doc_id div 6").alias("sky_visibility"),
        none.alias("facade_density"), none.alias("close_building"), none.alias("weather"), none.alias("occlusion"), none.alias("skip_reason"),
        F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("Fog "), F.lit("snow"))).when(F.col("doc_id") % 4 == 1, F.array(F.lit("hail"))).alias("safe_global_weathers"),
    )
    out = rules.scene_policy(rows, tuple(w for w in WEATHER_ORDER if w in SAFE_WEATHERS), WEATHER_ORDER)
    return out.select("doc_id", "route", "scene_risk", F.array_join("scene_reasons", "|").alias("reasons"), F.array_join("weather_pool", "|").alias("pool"))
