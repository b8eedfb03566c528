"""Expected errors and choices, written down by hand."""

import collections

import pytest
from pyspark.sql import functions as F

from trailmark.operators import decisions as D
from trailmark.operators import selection as S
from trailmark.plans.decision_plans import DECISIONS, SCENES, _answer, _scene

ERRORS = (
    None, None, "editable", "editable", "region_type", "support_surface", "confidence", "confidence", "reason", "fields", "fields", "object_of_family", "family_of_editable", None,
    "json", "json", "json", "json", "json", "occluder_family", "object_name", "json",
)
SCENE_ERRORS = (
    None, "families_of_editable", None, "families_of_editable", "feasible_families", "feasible_families", "feasible_families", "feasible_families", "confidence", "confidence",
    "observation", "observation", "observation", None, "reason", "fields", "json", "region_type",
)


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "i int, raw string")


def test_decision_errors(spark):
    got = D.parse_decision(texts(spark, DECISIONS)).orderBy("i").collect()
    assert tuple(r.error for r in got) == ERRORS
    assert got[0].asDict() | {"raw": 0} == {"i": 0, "raw": 0, "error": None, "editable": True, "region_type": "road", "support_surface": "paved_ground", "occluder_family": "traffic_cones", "object_name": "traffic cones", "confidence": 0.75, "reason": "dry road with room"}
    assert got[2].editable is None and got[2].reason is None


def test_decision_text_around(spark):
    odd = [None, "", "null", " \n" + _answer() + "\t", _answer() + "] , [1", _answer() + "} , {\"a\": 1", _answer() + " " + _answer(), _answer(reason='"' + "x" * 1200 + '"'), _answer(reason='"' + "x" * 1201 + '"'), _answer(confidence="1e-3"), _answer(confidence="NaN")]
    got = [r.error for r in D.parse_decision(texts(spark, odd)).orderBy("i").collect()]
    assert got == ["json", "json", "json", None, "json", "json", "json", None, "reason", None, "json"]


def test_scene_errors(spark):
    got = D.parse_scene(texts(spark, SCENES)).orderBy("i").collect()
    assert tuple(r.error for r in got) == SCENE_ERRORS
    assert got[0].feasible_families == ["traffic_cones", "scaffolding"] and got[2].feasible_families == []
    more = D.parse_scene(texts(spark, [_scene(feasible_families="[null]"), _scene(reason='"x²"'), _scene(reason='"Removed generators"')])).orderBy("i").collect()
    assert [r.error for r in more] == ["feasible_families", "observation", None]


def test_released_prompt(spark):
    cols = "i int, route string, condition string, weather string, occlusion string, prompt string"
    rows = [(0, "global", "rain", None, None, "x"), (1, "local", "rain+vehicle", None, None, "x"), (2, "both", "snow+person", None, None, "x"), (3, "pass", "rain", None, None, "x"), (4, "global", "rain", None, None, " "), (5, "global", None, "rainy-night", None, "x"), (6, "dual", "fog+person", None, "dog", "x"), (7, None, None, None, None, None)]
    got = D.released_prompt(spark.createDataFrame(rows, cols)).orderBy("i").collect()
    assert [(r.error, r.selected_model) for r in got] == [(None, "IC-Light"), ("condition", None), (None, "LightX2V-Dual"), ("skip", None), ("prompt", None), (None, "IC-Light"), ("condition", None), ("skip", None)]
    assert got[5].final_weather == "rainy_night" and got[0].prompt == "x"


def test_normalised(spark):
    base = dict.fromkeys(("route", "weather", "occlusion", "weather_score", "occlusion_score", "position", "target_region", "prompt", "reason", "skip_reason", "force_occlusion", *D.PLAIN_FIELDS))
    rows = [
        base | {"route": "local", "occlusion": "person", "position": "sidewalk", "weather": "rain"},  # a person has a place to stand
        base | {"route": "dual", "occlusion": "vehicle", "position": "wall"},  # no surface: skipped
        base | {"route": "local", "street_scene_quality": "traffic lane"},  # context names a lane, but no legal surface
        base | {"route": "global", "force_occlusion": "1", "occlusion_score": "3", "weather_score": "0.6", "weather": "snow", "reason": "parking bay"},
        base | {"route": "global", "force_occlusion": "1", "occlusion_score": "0.1", "reason": "parking bay"},
        base | {"route": "skip", "force_occlusion": "1", "occlusion_score": "1", "reason": "parking bay"},
    ]
    schema = "i int, " + ", ".join(f"{c} string" for c in base)
    got = D.normalise_decision(spark.createDataFrame([(i, *r.values()) for i, r in enumerate(rows)], schema)).orderBy("i").collect()
    assert [(r.route, r.weather, r.occlusion) for r in got] == [("local", None, "person"), ("skip", None, None), ("skip", None, "vehicle"), ("dual", "snow", "vehicle"), ("global", "rain", None), ("skip", None, None)]
    assert [r.skip_reason for r in got] == ["", "no_legal_vehicle_or_person_surface_for_dual_occlusion", "no_legal_vehicle_or_person_surface_for_local_occlusion", "", "", "invalid_or_unsuitable_scene"]


def test_candidates(spark):
    cols = "image_key int, candidate_id int, family string, reasons array<string>, feasible boolean, weighted_coverage double, target_precision double, area_fraction double, distance double"
    rows = spark.createDataFrame([(1, 1, "sign", [S.SHORT], True, 0.9, 0.9, 0.1, 0.0), (1, 2, "tarp", [], True, 0.5, 0.9, 0.1, 0.2), (1, 3, "sign", [], True, 0.5, 0.9, 0.1, 0.1), (1, 4, "sign", [], False, 1.0, 1.0, 0.1, 0.0), (2, 5, "sign", ["other"], True, 1.0, 1.0, 0.1, 0.0)], cols)
    samples = spark.createDataFrame([(1, True, ["sign"]), (2, True, ["sign"]), (3, True, [])], "image_key int, editable boolean, families array<string>")
    assert [(r.image_key, r.candidate_id, r.allowed) for r in S.select_candidates(samples, rows).collect()] == [(1, 3, True)]
    assert [r.candidate_id for r in S.select_candidates(samples, rows, "render_semantics").collect()] == [1]
    with pytest.raises(ValueError):
        S.select_candidates(samples, rows, "all")


def test_drawn_matches_follow_their_weights(spark):
    flow = spark.range(2000).select("id", F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(c).alias("conf")) for x, c in ((0, 0.1), (1, 0.3), (2, 0.6), (3, 0.0))])).alias("p")).select("id", F.lit(0).alias("y"), "p.x", "p.conf")
    got = S.sample_matches(flow, "id", 1, "probabilistic", 1, 4).groupBy("x").count().collect()
    share = {r.x: r["count"] / 2000 for r in got}
    assert share.keys() == {0, 1, 2} and all(abs(share[x] - c) < 0.04 for x, c in ((0, 0.1), (1, 0.3), (2, 0.6)))
    twice = S.sample_matches(flow, "id", 3, "probabilistic", 1, 4)
    assert twice.count() == 6000 and twice.distinct().count() == 6000


def test_block_map(spark):
    rows = spark.createDataFrame([(0, k, s) for k, s in enumerate((0.0, 5.0, 1.0, 4.0, 9.0))], "q int, k int, score double")
    kept = lambda **more: sorted(r.k for r in S.block_map(rows, "q", "k", "score", F.col("k") == 2, F.col("k") < 4, **more).collect())
    assert kept(count=1) == [1, 2] and kept(count=2) == [1, 2, 3] and kept(count=1, sink=True) == [0, 1, 2]
    assert kept(share=0.5) == [2]  # the first share is over the limit already, so none is taken
    assert kept(share=0.99) == [1, 2]


def test_random_window(spark):
    rows = spark.range(100).select((F.col("id") % 5).alias("u"), "id").union(spark.createDataFrame([(9, 1), (9, 2)], "u long, id long"))
    found = collections.defaultdict(list)
    for r in S.random_window(rows, "u", "id", 4, 1).orderBy("id").collect():
        found[r.u].append(r.id)
    assert found[9] == [1, 2] and all(len(v) == 4 and v[3] - v[0] == 15 for u, v in found.items() if u != 9)
