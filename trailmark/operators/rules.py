"""Rule tables over planner rows: risk flags, policies, gates, hard rules, candidate thresholds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions import numbers as N
from trailmark.functions import text as T

# Fixed values.
HARD_SKIP = ("occlusion_implausible", "foreground_foliage_may_confuse_occluder")
GATES = {"local": (0.82, 0.09), "global": (0.78, 0.15), "dual": (0.72, 0.20)}
DUAL_RAIN_VEHICLE_DIV = 0.12
ALLOWED_REGIONS = {
    "parked_vehicle": ("road", "parking_area"),
    "construction_barrier": ("road", "sidewalk"),
    "traffic_cones": ("road", "sidewalk"),
    "temporary_sign": ("road", "sidewalk", "parking_area", "grass", "wall_or_fence"),
    "vegetation": ("grass", "vegetation"),
    "scaffolding": ("building_front",),
    "construction_tarp": ("building_front",),
    "none": (),
}
ALLOWED_SUPPORTS = {
    "parked_vehicle": ("paved_ground",),
    "construction_barrier": ("paved_ground",),
    "traffic_cones": ("paved_ground",),
    "temporary_sign": ("paved_ground", "soil_ground", "facade_attachment"),
    "vegetation": ("soil_ground",),
    "scaffolding": ("building_base",),
    "construction_tarp": ("building_base", "facade_attachment"),
    "none": (),
}
REGION_SUPPORTS = {
    "road": ("paved_ground",),
    "sidewalk": ("paved_ground",),
    "parking_area": ("paved_ground",),
    "grass": ("soil_ground",),
    "vegetation": ("soil_ground",),
    "building_front": ("building_base", "facade_attachment"),
    "wall_or_fence": ("facade_attachment",),
    "sky": (),
    "unknown": (),
}


HIGH_SKIP_REASONS = {
    "occlusion_implausible": "no_valid_street_surface_for_occlusion",
    "foreground_foliage_may_confuse_occluder": "occlusion_would_be_unreliable_or_edge_artifact",
    "night_vehicle_high_hallucination_risk": "vehicle_occlusion_high_hallucination_risk_and_weather_not_feasible",
}
DOWNGRADE_REASON = "lightx2v_risk_high_weather_feasible"
SCENE_TEXT = ("city", "position", "prompt", "reason", "skip_reason", "street_scene_quality", "weather_feasibility")
VEGETATION_TERMS = ("tree", "trees", "vegetation", "foliage", "bush", "bushes", "park", "greenery", "roadside scene dominated by vegetation", "dense green")
BILLBOARD_TERMS = ("billboard", "advertisement", "advertising", "signboard", "roadside sign")
DENSE_FACADE_TERMS = ("dense facade", "repetitive facade", "high-density facade", "storefront row", "narrow building facade", "close facade", "building fills", "facade-dominated")
WEAK_ROAD_TERMS = ("weak road", "limited road", "peripheral road", "partial road", "no clear road", "road barely visible", "road is partly visible")


def flags(**rules: Column) -> Column:
    """Names of the rules that hold, in the given order."""
    return F.filter(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())), lambda f: f.isNotNull())


def _pairs(table: dict[str, tuple[str, ...]], key: Column, value: Column) -> Column:
    """Whether value is among the table's values of key, as one membership test on joined words."""
    return F.coalesce(F.concat_ws("/", key, value).isin(*(f"{k}/{v}" for k, vs in table.items() for v in vs)), F.lit(False))


def bad_image(df: DataFrame) -> DataFrame:
    """Adds risk_flags, risk_score and skip_recommendation to (route, weather, occlusion, text)."""
    # Projections of their own: the text is lowered once, and surfaces are looked for once.
    seen = df.withColumn("_low", F.lower("text"))
    seen = seen.withColumn("_vehicle", T.mentions_any(F.col("_low"), T.VEHICLE_SURFACES)).withColumn("_person", T.mentions_any(F.col("_low"), T.PERSON_SURFACES))
    low, route, vehicle, person = F.col("_low"), F.col("route"), F.col("_vehicle"), F.col("_person")
    placed, lit = route.isin("local", "dual"), route.isin("global", "dual")
    any_of = lambda *terms: T.mentions_any(low, terms)
    found = flags(
        missing_occlusion=placed & F.col("occlusion").isNull(),
        missing_weather=lit & F.col("weather").isNull(),
        over_specific_occlusion_target=placed & any_of("taxi rear", "rear of the", "specific sign"),
        occlusion_implausible=any_of("facade close-up", "no visible sidewalk", "no visible road", "no plausible sidewalk"),
        person_selected_despite_vehicle_surface=placed & (F.col("occlusion") == "person") & vehicle,
        vehicle_surface_not_explicit=placed & (F.col("occlusion") == "vehicle") & ~vehicle,
        person_surface_not_explicit=placed & (F.col("occlusion") == "person") & ~person,
        foreground_foliage_may_confuse_occluder=placed & any_of("dense green tree"),
        night_vehicle_high_hallucination_risk=(route == "dual") & (F.col("occlusion") == "vehicle") & (F.col("weather") == "night"),
    )
    out = seen.withColumn("risk_flags", found).drop("_low", "_vehicle", "_person").withColumn("risk_score", F.least(F.lit(10), F.size("risk_flags") * 3))
    return out.withColumn("skip_recommendation", F.col("risk_score") >= 6)


def bad_scene(bad_image: Column, street_scene_quality: Column) -> Column:
    """Whether a row is skipped before any quota: the planner calls the image or the street scene bad."""
    return N.boolish(bad_image) | F.coalesce(F.lower(street_scene_quality) == "bad", F.lit(False))


def bad_image_policy(df: DataFrame) -> DataFrame:
    """Adds final_route: risky local and dual rows are skipped, or become global where weather editing is feasible."""
    risky = F.col("skip_recommendation") & F.col("route").isin("local", "dual")
    hard = F.arrays_overlap("risk_flags", F.array(*map(F.lit, HARD_SKIP))) | ~F.coalesce(F.lower("weather_feasibility").isin("high", "medium"), F.lit(False))
    return df.withColumn("final_route", F.when(risky & hard, "skip").when(risky, "global").otherwise(F.col("route")))


def enforce_bad_image_policy(df: DataFrame) -> DataFrame:
    """Rows (route, weather, occlusion, text, weather_feasibility, bad_image, street_scene_quality, skip_reason) rewritten by the policies.

    A bad image or scene is skipped before its risk is looked at. A risky local or dual row is skipped, or becomes global with the asked weather
    (rain if it names none). Rewritten rows keep their original_route; skipped ones lose weather and occlusion and
    say why, downgraded ones lose the occlusion. Others keep what they have, and original_route is null.
    """
    bad = bad_scene(F.col("bad_image"), F.col("street_scene_quality"))
    out = bad_image_policy(bad_image(df)).withColumn("_bad", bad)
    skip, down = (F.col("_bad") | ((F.col("final_route") == "skip") & (F.col("route") != "skip"))), (~F.col("_bad") & (F.col("final_route") == "global") & (F.col("route") != "global"))
    given = F.nullif(F.trim(F.coalesce("skip_reason", F.lit(""))), F.lit(""))
    risk = F.coalesce(*(F.when(F.array_contains("risk_flags", flag), reason) for flag, reason in HIGH_SKIP_REASONS.items()), F.lit("local_or_dual_risk_too_high"))
    new = {
        "original_route": F.when(skip | down, F.col("route")),
        "skip_reason": F.when(F.col("_bad"), F.coalesce(given, F.lit("bad_image_requires_direct_skip"))).when(skip, risk).otherwise(F.col("skip_reason")),
        "downgrade_reason": F.when(down, DOWNGRADE_REASON),
        "weather": F.when(down, F.coalesce(T.weather(F.col("weather")), F.lit("rain"))).when(~skip, F.col("weather")),
        "occlusion": F.when(~skip & ~down, F.col("occlusion")),
        "bad_image": F.col("_bad"),
        "route": F.when(skip, "skip").otherwise(F.col("final_route")),
    }
    return out.withColumns(new).drop("_bad", "final_route")


def _says(low: Column, terms: tuple[str, ...]) -> Column:
    """Whether a lowered text holds one of the terms: those of one word as whole words, others as they are."""
    words = [t for t in terms if " " not in t and "-" not in t]
    parts = [F.contains(low, F.lit(t)) for t in terms if t not in words]
    if words:
        parts.append(low.rlike(rf"(^|[^\p{{L}}\p{{N}}_])({'|'.join(words)})($|[^\p{{L}}\p{{N}}_])"))
    return reduce(lambda a, b: a | b, parts)


def scene_risk(df: DataFrame) -> DataFrame:
    """Adds scene_risk (high, medium, low) and scene_reasons from the levels a planner reports and from what its texts say (absent texts say nothing)."""
    c = lambda name: F.lower(F.coalesce(F.col(name), F.lit("")))
    said = [F.coalesce(F.col(name), F.lit("")) for name in SCENE_TEXT if name in df.columns]
    out = df.withColumn("_low", F.lower(F.concat_ws(" ", *said)) if said else F.lit(""))  # a projection of its own: the text is lowered once
    low, asked = F.col("_low"), c("global_weather_risk")
    out = out.withColumns({
        "_green": (c("vegetation_level") == "high") | _says(low, VEGETATION_TERMS + BILLBOARD_TERMS),
        "_facade": (c("facade_density") == "high") | c("close_building").isin("yes", "true", "1") | _says(low, DENSE_FACADE_TERMS),
        "_road": c("road_visibility").isin("partial", "none", "low") | _says(low, WEAK_ROAD_TERMS),
    })
    green, facade, road = F.col("_green"), F.col("_facade"), F.col("_road")
    landmark, no_sky = (c("distant_landmarks_readable") == "low") & road, c("sky_visibility") == "none"
    high, medium = (asked == "high") | (green & road) | (facade & road) | landmark, (asked == "medium") | green | facade | road | no_sky
    named = F.when(asked.isin("medium", "high"), F.concat(F.lit("global_weather_risk="), asked))
    found = flags(vegetation_or_billboard_risk=green, dense_or_close_facade_risk=facade, weak_road_visibility=road, weak_landmark_with_weak_road=landmark, no_sky_visibility=no_sky)
    reasons = F.concat(F.array_compact(F.array(named)), found)
    return out.withColumns({"scene_risk": F.when(high, "high").when(medium, "medium").otherwise("low"), "scene_reasons": reasons}).drop("_low", "_green", "_facade", "_road")


def scene_policy(df: DataFrame, safe_pool: tuple[str, ...], whole_pool: tuple[str, ...]) -> DataFrame:
    """Global rows rewritten by their scene: at high risk without a visible road they are skipped, else they get the weathers to choose from.

    Adds scene_risk, scene_reasons, scene_restricted and weather_pool (null for other routes and skipped rows): the safe weathers at high risk, of these the
    row's own safe_global_weathers where any is left. The choice itself follows the quota (`scheduler.schedule`).
    """
    asked = F.col("route") == "global"
    out = scene_risk(df)
    skip = F.coalesce(asked & (F.col("scene_risk") == "high") & (F.lower("road_visibility") == "none"), F.lit(False))
    pool = F.when(F.col("scene_risk") == "high", F.array(*map(F.lit, safe_pool))).otherwise(F.array(*map(F.lit, whole_pool)))
    own = F.transform(F.coalesce("safe_global_weathers", F.array().cast("array<string>")), lambda w: F.trim(F.lower(w)))
    kept = F.filter(pool, lambda w: F.array_contains(own, w))
    live = asked & ~skip
    had = F.col("original_route") if "original_route" in df.columns else F.lit(None).cast("string")
    return out.withColumns({
        "original_route": F.when(skip, F.coalesce(had, F.col("route"))).otherwise(had),
        "weather_pool": F.when(live, F.when(F.size(kept) > 0, kept).otherwise(pool)),
        "scene_restricted": F.when(live, F.col("scene_risk") == "high"),
        "skip_reason": F.when(skip, "scene_aware_global_skip: high-risk global scene with no clear road geometry").otherwise(F.col("skip_reason")),
        "weather": F.when(~skip, F.col("weather")), "occlusion": F.when(~asked, F.col("occlusion")),
        "scene_risk": F.when(asked, F.col("scene_risk")), "scene_reasons": F.when(asked, F.col("scene_reasons")),
        "route": F.when(skip, "skip").otherwise(F.col("route")),
    })


def verify(df: DataFrame) -> DataFrame:
    """Adds skipped, geo_ok, div_ok and passed by the thresholds of the route (dual where the route has none); skip routes are not scored."""
    table = df.sparkSession.createDataFrame([(r, *t) for r, t in GATES.items()], "route string, tau_geo double, tau_div double")
    out = df.join(F.broadcast(table), "route", "left").fillna({"tau_geo": GATES["dual"][0], "tau_div": GATES["dual"][1]})
    out = out.withColumn("skipped", F.coalesce(F.col("route").isin("skip", "pass"), F.lit(False)))
    wet = (F.col("route") == "dual") & T.weather(F.col("weather")).isin("rain", "rainy_night") & (F.lower("occlusion") == "vehicle")
    out = out.withColumn("tau_div", F.when(wet, DUAL_RAIN_VEHICLE_DIV).otherwise(F.col("tau_div")))
    sound = lambda s: ~F.col("skipped") & ~F.isnan(s) & F.col(s).isNotNull()
    out = out.withColumn("geo_ok", sound("s_geo") & (F.col("s_geo") >= F.col("tau_geo"))).withColumn("div_ok", sound("s_div") & (F.col("s_div") >= F.col("tau_div")))
    return out.withColumn("passed", F.col("geo_ok") & F.col("div_ok"))


def hard_rules(df: DataFrame, least: float = 0.70) -> DataFrame:
    """Adds reject_reasons to (editable, region_type, support_surface, occluder_family, confidence); rules only reject."""
    region, support, family = F.col("region_type"), F.col("support_surface"), F.col("occluder_family")
    found = flags(
        vlm_rejected=~F.col("editable"),
        sky_not_editable=region == "sky",
        low_confidence=F.col("confidence") < least,
        unknown_region_not_supported=region == "unknown",
        no_visible_support=support.isin("none", "unknown"),
        family_region_incompatible=F.col("editable") & ~_pairs(ALLOWED_REGIONS, family, region),
        support_incompatible=F.col("editable") & ~(_pairs(ALLOWED_SUPPORTS, family, support) & _pairs(REGION_SUPPORTS, region, support)),
    )
    out = df.withColumn("reject_reasons", found).withColumn("accepted", F.size("reject_reasons") == 0)
    out = out.withColumn("editable", F.col("editable") & F.col("accepted"))
    for name in ("occluder_family", "object_name"):  # a rejected row places nothing
        if name in df.columns:
            out = out.withColumn(name, F.when(F.col("accepted"), F.col(name)).otherwise("none"))
    return out


def _shape_faults(precision: float) -> Column:
    return flags(
        actual_core_area_outside_family_range=~F.col("area_fraction").between(F.col("area_low"), F.col("area_high")),
        core_footprint_clipped_at_image_boundary=F.col("clipped_pixels") > 0,
        core_not_one_8_connected_component=F.col("num_components") != 1,
        target_precision_below_threshold=F.col("target_precision") < precision,
        zero_total_weight_coverage_undefined=F.col("weighted_coverage").isNull(),
    )


def thresholds(df: DataFrame, taus: tuple[float, ...] = (0.3, 0.5, 0.7), precision: float = 0.7) -> DataFrame:
    """One row per candidate and coverage threshold: passes and reasons."""
    out = df.withColumn("shape", _shape_faults(precision)).withColumn("tau", F.explode(F.array(*map(F.lit, taus))))
    short = F.when(F.col("weighted_coverage") < F.col("tau"), F.array(F.lit("weighted_coverage_below_threshold"))).otherwise(F.array().cast("array<string>"))
    out = out.withColumn("reasons", F.concat("shape", short))
    return out.withColumn("passes", F.size("reasons") == 0).drop("shape")


def threshold_summary(df: DataFrame, family: str, sample: str, taus: tuple[float, ...] = (0.3, 0.5, 0.7), precision: float = 0.7) -> DataFrame:
    """(family, tau, candidates, passes, samples, undefined): counts by threshold, and samples with a candidate that passes.

    Counted by family and sample first, as a count for each threshold, so that neither candidates nor samples meet more than once.
    """
    sound = df.withColumn("_ok", F.size(_shape_faults(precision)) == 0)
    passes = [F.count_if(F.col("_ok") & ~F.coalesce(F.col("weighted_coverage") < t, F.lit(False))).alias(f"_p{k}") for k, t in enumerate(taus)]
    by = sound.groupBy(family, sample).agg(F.count("*").alias("_n"), F.count_if(F.col("weighted_coverage").isNull()).alias("_u"), *passes)
    sums = by.groupBy(family).agg(F.sum("_n").alias("candidates"), F.sum("_u").alias("undefined"), *(x for k in range(len(taus)) for x in (F.sum(f"_p{k}").alias(f"_p{k}"), F.count_if((F.col(f"_p{k}") > 0) & F.col(sample).isNotNull()).alias(f"_s{k}"))))
    rows = F.array(*(F.struct(F.lit(float(t)).alias("tau"), F.col(f"_p{k}").alias("passes"), F.col(f"_s{k}").alias("samples")) for k, t in enumerate(taus)))
    return sums.select(family, "candidates", "undefined", F.explode(rows).alias("r")).select(family, "r.tau", "candidates", "r.passes", "r.samples", "undefined")
