"""Planner decisions: strict parsers of JSON answers, released prompts, and the normal form of a decision.

Parsers never drop rows: each row gets an error (the first rule that it breaks, null if none), and its fields are null where it has one.
A null text is not JSON. Extra columns pass.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions import numbers as N
from trailmark.functions import text as T
from trailmark.operators.rules import REGION_SUPPORTS

# Fixed values.
REGIONS = tuple(REGION_SUPPORTS)
SUPPORTS = ("paved_ground", "soil_ground", "building_base", "facade_attachment", "none", "unknown")
OBJECT_NAMES = {
    "parked_vehicle": "parked car",
    "construction_barrier": "construction barrier",
    "traffic_cones": "traffic cones",
    "temporary_sign": "temporary sign",
    "vegetation": "shrub",
    "scaffolding": "scaffolding",
    "construction_tarp": "construction tarp",
    "none": "none",
}
MODELS = {"skip": "None", "global": "IC-Light", "local": "LightX2V-Local", "dual": "LightX2V-Dual"}
BANNED_WORDS = r"bbox|bounding\s+box|coordinates?|mask|prompt"
BANNED_ORDERS = r"place|insert|add|generate|render|move|position|put|create|draw"


def _strict(df: DataFrame, raw: str) -> DataFrame:
    """df with the text as one JSON object (_object, a variant) and its keys; null where it is anything else, repeats a key or goes on after it.

    The parser alone ignores what follows a value. Inside brackets and as a field's value, only white space may follow it in both.
    """
    text = F.col(raw)
    listed, field = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    out = df.withColumns({"_list": listed, "_field": field})
    whole = F.col("_field").isNotNull() & F.schema_of_variant(F.try_variant_get(F.col("_list"), "$[0]", "variant")).startswith("OBJECT") & F.schema_of_variant(F.try_variant_get(F.col("_list"), "$[1]", "variant")).isNull()
    out = out.withColumn("_object", F.when(whole, F.try_variant_get(F.col("_list"), "$[0]", "variant")))
    return out.withColumn("_keys", F.when(F.col("_object").isNotNull(), F.array_sort(F.json_object_keys(text)))).drop("_list", "_field")


def _kind(name: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(F.col("_object"), f"$.{name}", "variant"))


def _text(name: str) -> Column:
    return F.when(_kind(name) == "STRING", F.try_variant_get(F.col("_object"), f"$.{name}", "string"))


def _one_of(name: str, values: Iterable[str]) -> Column:
    return F.coalesce(_text(name).isin(*values), F.lit(False))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _first_error(checks: dict[str, Column]) -> Column:
    """The name of the first check that does not hold (null does not)."""
    return F.coalesce(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()))


def _common(required: tuple[str, ...]) -> dict[str, Column]:
    return {
        "json": F.col("_object").isNotNull(),
        "fields": F.col("_keys") == F.array(*map(F.lit, sorted(required))),
        "editable": _kind("editable") == "BOOLEAN",
        "region_type": _one_of("region_type", REGIONS),
        "support_surface": _one_of("support_surface", SUPPORTS),
    }


def _sure() -> Column:
    return _kind("confidence").rlike("^(BIGINT|DECIMAL|DOUBLE)") & F.try_variant_get(F.col("_object"), "$.confidence", "double").between(0, 1)


def _parsed(df: DataFrame, checks: dict[str, Column], fields: dict[str, Column]) -> DataFrame:
    out = df.withColumn("error", _first_error(checks))
    return out.withColumns({name: F.when(F.col("error").isNull(), c) for name, c in fields.items()}).drop("_object", "_keys")


def parse_decision(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds error and the seven fields of an editability decision; no coercion, no further fields, no text around the object."""
    names = ("editable", "region_type", "support_surface", "occluder_family", "object_name", "confidence", "reason")
    family = _text("occluder_family")
    editable = F.try_variant_get(F.col("_object"), "$.editable", "boolean")
    checks = _common(names) | {
        "occluder_family": _one_of("occluder_family", OBJECT_NAMES),
        "object_name": _one_of("object_name", OBJECT_NAMES.values()),
        "confidence": _sure(),
        "reason": F.length(_stripped(_text("reason"))).between(1, 1200),
        "object_of_family": _text("object_name") == T.lookup(family, OBJECT_NAMES),
        "family_of_editable": editable == (family != "none"),
    }
    fields = {n: _text(n) for n in names} | {"editable": editable, "confidence": F.try_variant_get(F.col("_object"), "$.confidence", "double")}
    return _parsed(_strict(df, raw), checks, fields)


def parse_scene(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds error and the six fields of a scene decision; the reason only describes: no digits, geometry words or orders."""
    names = ("editable", "region_type", "support_surface", "feasible_families", "confidence", "reason")
    families = F.when(_kind("feasible_families").isin("ARRAY<STRING>", "ARRAY<VOID>"), F.try_variant_get(F.col("_object"), "$.feasible_families", "array<string>"))
    known = F.array(*(F.lit(x) for x in OBJECT_NAMES if x != "none"))
    editable, reason = F.try_variant_get(F.col("_object"), "$.editable", "boolean"), _text("reason")
    checks = _common(names) | {
        "feasible_families": F.forall(families, lambda x: F.coalesce(F.array_contains(known, x), F.lit(False))) & (F.size(F.array_distinct(families)) == F.size(families)),
        "families_of_editable": editable == (F.size(families) > 0),
        "confidence": _sure(),
        "reason": F.length(_stripped(reason)).between(1, 600),
        "observation": ~reason.rlike(rf"(?iU)\p{{Nd}}|[²³¹⁰-⁹₀-₉]|\b({BANNED_WORDS})\b|\b({BANNED_ORDERS})\s+"),
    }
    fields = {n: _text(n) for n in names} | {"editable": editable, "feasible_families": families, "confidence": F.try_variant_get(F.col("_object"), "$.confidence", "double")}
    return _parsed(_strict(df, raw), checks, fields)


def released_prompt(df: DataFrame) -> DataFrame:
    """Adds final_route, final_weather, final_occlusion, selected_model and error to released prompts (route, condition, weather, occlusion, prompt).

    A prompt must be one of global (weather alone), local (occlusion alone) or dual (both); it is never rewritten.
    """
    said = T.condition(F.col("condition"))
    who = F.lower(F.trim("occlusion"))
    out = df.withColumns({
        "final_route": T.route(F.col("route")),
        "final_weather": F.when(F.col("weather").isNotNull(), T.weather(F.col("weather"))).otherwise(said["weather"]),
        "final_occlusion": F.when(F.col("occlusion").isNotNull(), F.when(who.isin("vehicle", "person"), who)).otherwise(said["occlusion"]),
    })
    lit, placed, route = F.col("final_weather").isNotNull(), F.col("final_occlusion").isNotNull(), F.col("final_route")
    checks = {"skip": route != "skip", "prompt": _stripped(F.col("prompt")) != "", "condition": (lit == route.isin("global", "dual")) & (placed == route.isin("local", "dual"))}
    return out.withColumn("error", _first_error(checks)).withColumn("selected_model", F.when(F.col("error").isNull(), T.lookup(route, MODELS)))


PLAIN_FIELDS = ("street_scene_quality", "occlusion_feasibility", "weather_feasibility", "road_visibility", "sky_visibility", "vegetation_level", "facade_density", "close_building", "distant_landmarks_readable", "global_weather_risk")


def normalise_decision(df: DataFrame) -> DataFrame:
    """A planner's raw fields (strings, null if absent) in normal form; prompts are left as they are, templates are not part of this.

    Local and dual rows need a surface that the text names, or they are skipped with a reason. force_occlusion lifts a global row to
    dual or local where such a surface is named; skipped rows are never lifted.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    surface = ("position", "target_region", "prompt", "reason", "skip_reason")
    out = df.withColumn("_surface", F.lower(F.concat_ws(" ", *surface))).withColumn("_context", F.lower(F.concat_ws(" ", *surface, "street_scene_quality", "occlusion_feasibility")))
    legal = T.mentions_any(F.col("_surface"), T.VEHICLE_SURFACES) | T.mentions_any(F.col("_surface"), T.PERSON_SURFACES)
    who = F.lower(F.trim("occlusion"))
    out = out.withColumns({
        "_legal": legal, "_inferred": T.occlusion(F.col("_context")), "_route": T.route(F.col("route")), "_weather": T.weather(F.col("weather")),
        "weather_score": N.round_even(N.score(F.col("weather_score"))), "occlusion_score": N.round_even(N.score(F.col("occlusion_score"))),
    })
    lift = F.lower(blank("force_occlusion")).isin("1", "true", "yes") & (F.col("_route") == "global") & (F.col("occlusion_score") >= 0.2) & F.col("_legal") & F.col("_inferred").isNotNull()
    lifted = F.when((F.col("weather_score") >= 0.6) & F.col("_weather").isNotNull(), "dual").otherwise("local")
    out = out.withColumn("_asked", F.when(lift, lifted).otherwise(F.col("_route")))
    asked = F.col("_asked")
    out = out.withColumn("_none", asked.isin("local", "dual") & (F.col("_inferred").isNull() | ~F.col("_legal")))
    given = F.trim(blank("skip_reason"))
    cause = F.when(given != "", given).when(F.col("_none"), F.concat(F.lit("no_legal_vehicle_or_person_surface_for_"), asked, F.lit("_occlusion"))).when(asked == "skip", "invalid_or_unsuitable_scene").otherwise("")
    out = out.withColumns({
        "skip_reason": cause,
        "route": F.when(F.col("_none"), "skip").otherwise(asked),
        "weather": F.when((asked == "global") | (asked == "dual") & ~F.col("_none"), F.coalesce("_weather", F.lit("rain"))),
        "occlusion": F.when((asked == "local") | (asked == "dual") & ~F.col("_none"), F.col("_inferred")),
        "position": F.trim(F.when(blank("position") != "", F.col("position")).otherwise(blank("target_region"))),
        "reason": F.trim(blank("reason")),
    } | {c: F.trim(F.lower(blank(c))) for c in PLAIN_FIELDS})
    return out.withColumn("selected_model", T.lookup(F.col("route"), MODELS)).drop("_surface", "_context", "_legal", "_inferred", "_route", "_weather", "_asked", "_none")
