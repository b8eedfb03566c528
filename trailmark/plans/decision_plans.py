"""Queries of the decision parsers and the selecting operators.

Planner answers are stood in for by a list of texts with one fault each, taken in turn by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.operators import decisions as D
from trailmark.operators import selection as S
from trailmark.plans.registry import query, sql_list, table
from trailmark.plans.rule_plans import _SQL_ROUTE, CONDITIONS, ROUTE_WORDS, pick, sql_pick


def _answer(**fields: str) -> str:
    whole = {"editable": "true", "region_type": '"road"', "support_surface": '"paved_ground"', "occluder_family": '"traffic_cones"', "object_name": '"traffic cones"', "confidence": "0.75", "reason": '"dry road with room"'} | fields
    return "{" + ", ".join(f'"{k}": {v}' for k, v in whole.items() if v) + "}"


DECISIONS = (
    _answer(), _answer(confidence="1"), _answer(editable='"true"'), _answer(editable="1"), _answer(region_type='"river"'), _answer(support_surface="null"), _answer(confidence='"0.5"'), _answer(confidence="1.5"),
    _answer(reason='"  "'), _answer(reason=""), _answer(bbox="[1]"), _answer(object_name='"scaffolding"'), _answer(occluder_family='"none"', object_name='"none"'), _answer(editable="false", occluder_family='"none"', object_name='"none"'),
    _answer() + " ok", _answer() + ", 1", "```" + _answer() + "```", "[" + _answer() + "]", "", _answer(occluder_family='"cones"'), _answer(object_name="7"), '{"editable": true, ' + _answer()[1:],
)


def _scene(**fields: str) -> str:
    whole = {"editable": "true", "region_type": '"sidewalk"', "support_surface": '"paved_ground"', "feasible_families": '["traffic_cones", "scaffolding"]', "confidence": "0.5", "reason": '"Wide paved walk beside a shop."'} | fields
    return "{" + ", ".join(f'"{k}": {v}' for k, v in whole.items() if v) + "}"


SCENES = (
    _scene(), _scene(feasible_families="[]"), _scene(editable="false", feasible_families="[]"), _scene(editable="false"), _scene(feasible_families='["traffic_cones", "traffic_cones"]'), _scene(feasible_families='["none"]'),
    _scene(feasible_families='"traffic_cones"'), _scene(feasible_families='["scaffolding", 1]'), _scene(confidence="-0.1"), _scene(confidence="true"), _scene(reason='"A walk 3 m wide."'), _scene(reason='"The Bounding  Box is wide."'),
    _scene(reason='"Insert cones on the walk."'), _scene(reason='"A bus in position; unmasked, generated."'), _scene(reason='""'), _scene(object_name='"none"'), _scene()[:-1], _scene(region_type='"Road"'),
)

_CHECKED = """CASE WHEN NOT json_valid(raw) OR json_type(raw) <> 'OBJECT' OR len(json_keys(raw)) <> len(list_distinct(json_keys(raw))) THEN 'json' WHEN list_sort(json_keys(raw)) <> {keys} THEN 'fields' WHEN json_type(raw, '$.editable') <> 'BOOLEAN' THEN 'editable'
  WHEN json_type(raw, '$.region_type') <> 'VARCHAR' OR region NOT IN ({regions}) THEN 'region_type' WHEN json_type(raw, '$.support_surface') <> 'VARCHAR' OR support NOT IN ({supports}) THEN 'support_surface'"""
_FIELDS = "raw->>'$.region_type' AS region, raw->>'$.support_surface' AS support, raw->>'$.reason' AS reason, try_cast(raw->>'$.confidence' AS DOUBLE) AS confidence, raw->>'$.editable' = 'true' AS editable"


def _words(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _checked(*keys: str) -> str:
    return _CHECKED.format(keys=sql_list(sorted(keys)), regions=_words(D.REGIONS), supports=_words(D.SUPPORTS))


_SURE = "json_type(raw, '$.confidence') NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE') OR NOT confidence BETWEEN 0 AND 1"
_NAME = f"map({sql_list(D.OBJECT_NAMES)}, {sql_list(D.OBJECT_NAMES.values())})[family]"


@query(
    "pf23_parse_decision",
    f"""WITH t AS (SELECT doc_id, {sql_pick(DECISIONS, 'doc_id')} AS raw FROM documents), v AS (SELECT doc_id, raw AS text, CASE WHEN json_valid(raw) THEN raw ELSE 'null' END AS raw FROM t),
f AS (SELECT *, {_FIELDS}, raw->>'$.occluder_family' AS family, raw->>'$.object_name' AS name FROM v),
e AS (SELECT *, {_checked('editable', 'region_type', 'support_surface', 'occluder_family', 'object_name', 'confidence', 'reason')}
  WHEN json_type(raw, '$.occluder_family') <> 'VARCHAR' OR family NOT IN ({_words(D.OBJECT_NAMES)}) THEN 'occluder_family' WHEN json_type(raw, '$.object_name') <> 'VARCHAR' OR name NOT IN ({_words(D.OBJECT_NAMES.values())}) THEN 'object_name'
  WHEN {_SURE} THEN 'confidence' WHEN json_type(raw, '$.reason') <> 'VARCHAR' OR NOT length(trim(reason)) BETWEEN 1 AND 1200 THEN 'reason' WHEN name <> {_NAME} THEN 'object_of_family' WHEN editable <> (family <> 'none') THEN 'family_of_editable' END AS error FROM f)
SELECT doc_id, error, CASE WHEN error IS NULL THEN editable END AS editable, CASE WHEN error IS NULL THEN family END AS occluder_family, CASE WHEN error IS NULL THEN confidence END AS confidence, CASE WHEN error IS NULL THEN reason END AS reason FROM e""",
)
def parse_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict parser of editability decisions (PF23, SO2)."""
    rows = table(spark, sf_dir, "documents", "doc_id").withColumn("raw", pick(DECISIONS, "doc_id"))
    return D.parse_decision(rows).select("doc_id", "error", "editable", "occluder_family", "confidence", "reason")


@query(
    "pf25_parse_scene",
    f"""WITH t AS (SELECT doc_id, {sql_pick(SCENES, 'doc_id')} AS raw FROM documents), v AS (SELECT doc_id, CASE WHEN json_valid(raw) THEN raw ELSE 'null' END AS raw FROM t),
f AS (SELECT *, {_FIELDS}, CASE WHEN json_type(raw, '$.feasible_families') = 'ARRAY' THEN raw->'$.feasible_families' END AS families FROM v), l AS (SELECT *, CAST(families->>'$[*]' AS VARCHAR[]) AS listed FROM f),
e AS (SELECT *, {_checked('editable', 'region_type', 'support_surface', 'feasible_families', 'confidence', 'reason')}
  WHEN families IS NULL OR len(list_filter(listed, lambda x: x NOT IN ({_words(x for x in D.OBJECT_NAMES if x != 'none')}))) > 0 OR len(list_distinct(listed)) <> len(listed) THEN 'feasible_families' WHEN editable <> (len(listed) > 0) THEN 'families_of_editable'
  WHEN {_SURE} THEN 'confidence' WHEN json_type(raw, '$.reason') <> 'VARCHAR' OR NOT length(trim(reason)) BETWEEN 1 AND 600 THEN 'reason' WHEN regexp_matches(reason, '(?i)[0-9]|\\b({D.BANNED_WORDS})\\b|\\b({D.BANNED_ORDERS})\\s+') THEN 'observation' END AS error FROM l)
SELECT doc_id, error, CASE WHEN error IS NULL THEN editable END AS editable, CASE WHEN error IS NULL THEN array_to_string(listed, '|') END AS families FROM e""",
)
def parse_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict parser of scene decisions, whose reason may only describe (PF25)."""
    rows = table(spark, sf_dir, "documents", "doc_id").withColumn("raw", pick(SCENES, "doc_id"))
    return D.parse_scene(rows).select("doc_id", "error", "editable", F.array_join("feasible_families", "|").alias("families"))


_SAID = "CASE {0} WHEN 0 THEN {1} WHEN 1 THEN {2} WHEN 2 THEN {3} WHEN 3 THEN {4} WHEN 4 THEN {5} WHEN 6 THEN {6} END"
_OUT_W = _SAID.format("event_id // 8 % 8", "'rain'", "'snow'", "'fog'", "'rainy_night'", "NULL", "'overcast'")
_OUT_O = _SAID.format("event_id // 8 % 8", "'vehicle'", "NULL", "'person'", "NULL", "'vehicle'", "'person'")


@query(
    "pf6_released_prompt",
    f"""WITH r AS (SELECT event_id, {_SQL_ROUTE.format(sql_pick(ROUTE_WORDS, 'event_id'), 'skip')} AS route, CASE WHEN event_id % 5 = 0 THEN CASE WHEN event_id % 10 = 0 THEN 'fog' END ELSE {_OUT_W} END AS weather,
  CASE WHEN event_id % 7 = 0 THEN CASE WHEN event_id % 14 = 0 THEN 'person' END ELSE {_OUT_O} END AS occlusion, event_id % 9 = 0 AS empty FROM events)
SELECT event_id, CASE WHEN route = 'skip' THEN 'skip' WHEN empty THEN 'prompt' WHEN (weather IS NOT NULL) <> (route IN ('global', 'dual')) OR (occlusion IS NOT NULL) <> (route IN ('local', 'dual')) THEN 'condition' END AS error,
  CASE WHEN NOT empty AND route <> 'skip' AND (weather IS NOT NULL) = (route IN ('global', 'dual')) AND (occlusion IS NOT NULL) = (route IN ('local', 'dual')) THEN CASE route WHEN 'global' THEN '{D.MODELS['global']}' WHEN 'local' THEN '{D.MODELS['local']}' ELSE '{D.MODELS['dual']}' END END AS selected_model FROM r""",
)
def released_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route, weather and occlusion of released prompts by their truth table (PF6)."""
    e = table(spark, sf_dir, "events", "event_id", "CASE WHEN event_id % 5 = 0 THEN CASE WHEN event_id % 10 = 0 THEN ' Fog' ELSE 'hail' END END AS weather", "CASE WHEN event_id % 7 = 0 THEN CASE WHEN event_id % 14 = 0 THEN 'Person ' ELSE 'dog' END END AS occlusion", "CASE WHEN event_id % 9 = 0 THEN ' ' ELSE 'as it is' END AS prompt")
    return D.released_prompt(e.withColumns({"route": pick(ROUTE_WORDS, "event_id"), "condition": pick(CONDITIONS, "event_id div 8")})).select("event_id", "error", "selected_model")


PLACES = ("left lane by the kerb", "brick wall", "Sidewalk, shaded", "", "parking bay")
_V, _P = _words(("left lane by the kerb", "parking bay")), _words(("left lane by the kerb", "Sidewalk, shaded"))


@query(
    "pf12_normalise",
    f"""WITH r AS (SELECT doc_id, {_SQL_ROUTE.format(sql_pick(ROUTE_WORDS, 'doc_id'), 'skip')} AS route, {sql_list(('rain', 'x', 'fog'))}[CAST(doc_id // 3 % 3 + 1 AS INT)] AS weather, {sql_pick(PLACES, 'doc_id // 2')} AS place, doc_id % 3 = 0 AS forced,
  doc_id % 10 / 10.0 AS ws, doc_id // 7 % 10 / 10.0 AS os, CASE WHEN doc_id % 23 = 0 THEN 'blurred' ELSE '' END AS said FROM documents),
i AS (SELECT * REPLACE (CASE WHEN weather <> 'x' THEN weather END AS weather), CASE WHEN place IN ({_V}) THEN 'vehicle' WHEN place IN ({_P}) THEN 'person' END AS who FROM r),
a AS (SELECT *, CASE WHEN forced AND route = 'global' AND os >= 0.2 AND who IS NOT NULL THEN CASE WHEN ws >= 0.6 AND weather IS NOT NULL THEN 'dual' ELSE 'local' END ELSE route END AS asked FROM i), d AS (SELECT *, asked IN ('local', 'dual') AND who IS NULL AS none FROM a)
SELECT doc_id, CASE WHEN none THEN 'skip' ELSE asked END AS route, CASE WHEN asked = 'global' OR asked = 'dual' AND NOT none THEN coalesce(weather, 'rain') END AS weather, CASE WHEN asked IN ('local', 'dual') THEN who END AS occlusion,
  CASE WHEN said <> '' THEN said WHEN none THEN 'no_legal_vehicle_or_person_surface_for_' || asked || '_occlusion' WHEN asked = 'skip' THEN 'invalid_or_unsuitable_scene' ELSE '' END AS skip_reason,
  CASE CASE WHEN none THEN 'skip' ELSE asked END WHEN 'skip' THEN 'None' WHEN 'global' THEN '{D.MODELS['global']}' WHEN 'local' THEN '{D.MODELS['local']}' ELSE '{D.MODELS['dual']}' END AS selected_model, CAST(ws AS DOUBLE) AS weather_score, 'bad' AS street_scene_quality FROM d""",
)
def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normal form of planner decisions: surfaces, demotion to skip, forced lifts (PF12, PF14)."""
    blank = ("target_region", "prompt", "reason", *(c for c in D.PLAIN_FIELDS if c != "street_scene_quality"))
    d = table(spark, sf_dir, "documents", "doc_id", "CASE WHEN doc_id % 3 = 0 THEN 'Yes' END AS force_occlusion", "CAST(doc_id % 10 AS STRING) AS tenths", "CAST(doc_id div 7 % 10 / 10D AS STRING) AS occlusion_score", "CASE WHEN doc_id % 23 = 0 THEN ' blurred' END AS skip_reason", "' BAD' AS street_scene_quality", "'vehicle' AS occlusion", *(f"CAST(NULL AS STRING) AS {c}" for c in blank))
    d = d.withColumns({"route": pick(ROUTE_WORDS, "doc_id"), "weather": pick(("rain", "x", "fog"), "doc_id div 3"), "position": pick(PLACES, "doc_id div 2"), "weather_score": F.when(F.col("tenths") == "1", "0.1").otherwise(F.col("tenths"))})
    return D.normalise_decision(d).select("doc_id", "route", "weather", "occlusion", "skip_reason", "selected_model", "weather_score", "street_scene_quality")


def _candidate_sql(ok: str) -> str:
    return f"""WITH c AS (SELECT l_orderkey, l_linenumber, ['sign', 'cones', 'tarp'][CAST(l_linenumber % 3 + 1 AS INT)] AS family, l_quantity / 50 AS coverage, l_discount AS target, l_tax AS area, l_suppkey % 7 AS away FROM lineitem WHERE l_partkey % 4 > 0 AND l_suppkey % 5 > 0 AND {ok}),
b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY coverage DESC, target DESC, area, away, l_linenumber) AS r FROM c)
SELECT o_orderkey, l_linenumber AS candidate_id, family, o_custkey % 9 > 0 AND (family = 'sign' OR family = 'cones' AND o_custkey % 2 = 0) AS allowed FROM orders JOIN b ON o_orderkey = l_orderkey AND r = 1"""


def _selected(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    rows = table(
        spark, sf_dir, "lineitem", "l_orderkey AS image_key", "l_linenumber AS candidate_id", "l_linenumber", "l_quantity / 50 AS weighted_coverage", "l_discount AS target_precision", "l_tax AS area_fraction", "l_suppkey % 7 AS distance", "l_suppkey % 5 > 0 AS feasible",
        f"array_compact(array(CASE WHEN l_quantity < 20 THEN '{S.SHORT}' END, CASE WHEN l_partkey % 4 = 0 THEN 'core_not_one_8_connected_component' END)) AS reasons",
    ).withColumn("family", pick(("sign", "cones", "tarp"), "l_linenumber"))
    samples = table(spark, sf_dir, "orders", "o_orderkey AS image_key", "o_custkey % 9 > 0 AS editable", "CASE WHEN o_custkey % 2 = 0 THEN array('sign', 'cones') ELSE array('sign') END AS families")
    return S.select_candidates(samples, rows, mode).select(F.col("image_key").alias("o_orderkey"), "candidate_id", "family", "allowed")


@query("j8_frozen_candidates", _candidate_sql("l_quantity >= 20"))
def frozen_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best candidate of each sample among those that pass every threshold."""
    return _selected(spark, sf_dir, "frozen")


@query("t3_semantic_candidates", _candidate_sql("true"))
def semantic_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where too little coverage alone does not rule a candidate out."""
    return _selected(spark, sf_dir, "render_semantics")


_FLOW = "SELECT l_linenumber AS pair, l_partkey % 40 AS y, l_orderkey % 60 AS x, max(l_quantity / 50) AS conf FROM lineitem GROUP BY 1, 2, 3"


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem", "l_linenumber AS pair", "l_partkey % 40 AS y", "l_orderkey % 60 AS x", "l_quantity / 50 AS conf")
    return rows.groupBy("pair", "y", "x").agg(F.max("conf").alias("conf"))


@query("t6_top_matches", f"SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY conf DESC, y, x) AS r FROM ({_FLOW}) WHERE conf > 0.2) WHERE r <= 50")
def top_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sample_matches(flow(spark, sf_dir), "pair", 50, "topk", 40, 60, 0.2)


@query("t6_grid_matches", f"WITH g AS (SELECT CAST(floor(i // 7 * 39 / 7 + 1e-9) AS BIGINT) AS y, CAST(floor(i % 7 * 59 / 6 + 1e-9) AS BIGINT) AS x FROM range(50) r(i)) SELECT pair, f.y, f.x, conf FROM ({_FLOW}) f JOIN g ON f.y = g.y AND f.x = g.x WHERE conf > 0.2")
def grid_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sample_matches(flow(spark, sf_dir), "pair", 50, "grid", 40, 60, 0.2)


@query("t6_drawn_matches")
def drawn_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted draw without replacement; its order comes from Spark's hash, so it has no SQL (tested by its frequencies)."""
    return S.sample_matches(flow(spark, sf_dir), "pair", 50, "probabilistic", 40, 60, 0.2, 7)


@query(
    "t8_block_map",
    """WITH b AS (SELECT conv_id, turn, length(coalesce(text, '')) / 100 AS score, turn % 5 = 2 AS forced, turn <= 1 + conv_id % 9 AS causal FROM conversations),
x AS (SELECT *, CASE WHEN causal AND NOT forced THEN exp(score - max(CASE WHEN causal AND NOT forced THEN score END) OVER (PARTITION BY conv_id)) ELSE 0 END AS e FROM b),
s AS (SELECT *, sum(e) OVER (PARTITION BY conv_id ORDER BY e DESC, turn ROWS UNBOUNDED PRECEDING) / sum(e) OVER (PARTITION BY conv_id) AS run FROM x)
SELECT conv_id, turn FROM s WHERE causal AND (e > 0 AND run <= 0.7 OR forced) OR turn = 0""",
)
def block_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks kept by running softmax share, forced ones and the sink."""
    b = table(spark, sf_dir, "conversations", "conv_id", "turn", "length(coalesce(text, '')) / 100 AS score")
    return S.block_map(b, "conv_id", "turn", "score", F.col("turn") % 5 == 2, F.col("turn") <= 1 + F.col("conv_id") % 9, share=0.7, sink=True)


@query("so5_ordered_union", "SELECT user_id, list_sort(list_distinct(list_concat(list(event_id % 10), list(event_id % 7)))) AS frames FROM events GROUP BY user_id")
def ordered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of two lists once, in order (SO5); the sets are built distinct, so a list is bounded by its values."""
    e = table(spark, sf_dir, "events", "user_id", "event_id % 10 AS a", "event_id % 7 AS b").groupBy("user_id").agg(F.collect_set("a").alias("a"), F.collect_set("b").alias("b"))
    return e.select("user_id", S.ordered_union(F.col("a"), F.col("b")).alias("frames"))


@query("t13_random_window")
def random_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight neighbouring frames of each track from a seeded start (T13); the start is Spark's hash, so it has no SQL (tested by its shape)."""
    return S.random_window(table(spark, sf_dir, "events", "user_id", "event_id"), "user_id", "event_id", 8, 3)
