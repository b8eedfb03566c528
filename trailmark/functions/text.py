"""Text rules as columns: ids, routes, weather, surfaces, error classes."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of the planner's vocabulary.
WEATHERS = ("rain", "snow", "night", "overcast", "fog", "rainy_night")
WEATHER_ALIASES = {"rainy-night": "rainy_night", "rainy night": "rainy_night"}
ROUTES = ("skip", "global", "local", "dual")
ROUTE_ALIASES = {"weather": "global", "weather_only": "global", "occlusion": "local", "occlusion_only": "local", "both": "dual", "weather_and_occlusion": "dual", "pass": "skip"}
OCCLUSION_TAXONOMY = {
    "curbside / parked-vehicle occlusion": "vehicle",
    "road-traffic occlusion": "vehicle",
    "other local occlusions": "person",
    "curbside_parked_vehicle_occlusion": "vehicle",
    "road_traffic_occlusion": "vehicle",
    "other_local_occlusions": "person",
}
VEHICLE_SURFACES = (
    "traffic lane", "road lane", "visible lane", "curbside lane", "curb lane", "parking bay", "parking lane", "roadside parking", "roadside parking area",
    "parking area", "parked car", "parked cars", "roadway", "carriageway", "street lane", "right lane", "left lane", "near lane", "foreground lane",
)
PERSON_SURFACES = ("sidewalk", "paved sidewalk", "curb", "kerb", "crosswalk", "zebra crossing", "roadside pavement", "road-edge pavement", "visible pavement", "pedestrian area")
CROWDING_STRONG = (
    "existing traffic", "existing vehicles", "existing vehicle flow", "behind existing traffic", "between existing vehicles", "traffic constrained", "foreground car clutter", "vehicle clutter",
    "road is cluttered", "traffic jam", "dense vehicle", "dense traffic", "many vehicles", "several vehicles", "multiple vehicles", "parked cars", "bus dominance",
)
CROWDING_WEAK = ("existing car", "curbside parking", "parking lane", "roadside parking")


def lookup(col: Column, table: dict[str, str]) -> Column:
    """The table's value for col, or null."""
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[col]


def mentions(col: Column, terms: tuple[str, ...]) -> Column:
    """Terms that occur in col as plain substrings, in the given order (plain tests, so that code generation covers them)."""
    return F.array_compact(F.array(*(F.when(F.contains(col, F.lit(t)), F.lit(t)) for t in terms)))


def mentions_any(col: Column, terms: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(col, F.lit(t)) for t in terms))


def safe_id(col: Column) -> Column:
    """Runs of other characters become one underscore; dots and underscores go from both ends; null if nothing stays."""
    made = F.regexp_replace(F.regexp_replace(F.trim(col), "[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.when(made != "", made)


def path_id(col: Column) -> Column:
    """The parts of a relative path joined by two underscores, without the suffix."""
    return F.array_join(F.split(F.regexp_replace(col, r"\.[^./]*$", ""), "/"), "__")


def route(col: Column, default: str = "skip") -> Column:
    raw = F.lower(F.trim(F.coalesce(col, F.lit(""))))
    known = F.coalesce(lookup(raw, ROUTE_ALIASES), raw)
    return F.when(known.isin(*ROUTES), known).otherwise(default)


def judged_route(col: Column) -> Column:
    """The judge's reading: dual where none is named, and pass for rows that are left alone."""
    known = route(col, "dual")
    return F.when(known == "skip", "pass").otherwise(known)


def weather(col: Column) -> Column:
    raw = F.trim(F.lower(F.coalesce(col, F.lit(""))))
    known = F.coalesce(lookup(raw, WEATHER_ALIASES), raw)
    return F.when(known.isin(*WEATHERS), known)


def condition(col: Column) -> Column:
    """struct<weather, occlusion> of a `weather+occlusion` text; the first valid word of each kind counts."""
    raw = F.lower(F.trim(F.coalesce(col, F.lit(""))))
    words = F.filter(F.transform(F.split(raw, r"\+"), lambda w: F.trim(w)), lambda w: w != "")
    named = F.filter(F.transform(words, weather), lambda w: w.isNotNull())
    who = F.filter(words, lambda w: w.isin("vehicle", "person"))
    return F.struct(F.get(named, F.lit(0)).alias("weather"), F.coalesce(F.get(who, F.lit(0)), lookup(raw, OCCLUSION_TAXONOMY)).alias("occlusion"))


def occlusion(text: Column) -> Column:
    """Vehicles first; a person only where the text names a place to stand."""
    low = F.lower(text)
    vehicle, person = mentions_any(low, VEHICLE_SURFACES), mentions_any(low, PERSON_SURFACES)
    return F.when(vehicle, "vehicle").when(person, "person")


def crowding(df: DataFrame, text: str = "text") -> DataFrame:
    """df (route, occlusion, text) with crowded and reasons: one strong phrase or two weak ones, where a vehicle is to be placed locally.

    The text is lowered once, and phrases are looked for once, in projections of their own.
    """
    asked = (F.col("route") == "local") & (F.col("occlusion") == "vehicle")
    low = df.withColumn("_low", F.when(asked, F.lower(text)))
    found = low.withColumn("_strong", F.array_sort(mentions(F.col("_low"), CROWDING_STRONG))).withColumn("_weak", F.array_sort(mentions(F.col("_low"), CROWDING_WEAK)))
    none = F.array().cast("array<string>")
    out = found.withColumn("crowded", F.coalesce(asked & ((F.size("_strong") > 0) | (F.size("_weak") >= 2)), F.lit(False)))
    out = out.withColumn("reasons", F.when(~F.coalesce(asked, F.lit(False)), none).when(F.size("_strong") > 0, F.col("_strong")).otherwise(F.col("_weak")))
    return out.drop("_low", "_strong", "_weak")


#: What tells an error of the service from one of the request.
SYSTEMIC_ERRORS = (
    "quota is not enough", "insufficient_quota", "arrearage", "overdue-payment", "access denied", "account is in good standing",
    "internalservererror", "error code: 502", "bad gateway", "service unavailable", "upstream",
)


def systemic_error(col: Column) -> Column:
    """Whether an error text means that the service fails as a whole."""
    return F.coalesce(mentions_any(F.lower(col), SYSTEMIC_ERRORS), F.lit(False))


def json_part(col: Column) -> Column:
    """The whole text if it parses as an object, else what lies between the first and the last brace."""
    whole = F.trim(col)
    return F.when(F.json_object_keys(whole).isNotNull(), whole).otherwise(F.nullif(F.regexp_extract(whole, r"(?s)\{.*\}", 0), F.lit("")))


def canonical_json(col: Column) -> Column:
    """A JSON text with sorted keys, tight separators and Python's number text; null if it does not parse or holds NaN or Infinity.

    Numbers need Python: Java writes some doubles with another digit, so an expression of Spark's own can't give the same digest.
    Of repeated keys the last counts. Arrow batches, one short call a row.
    """
    return _canonical(col)


@F.pandas_udf(StringType())
def _canonical(texts: pd.Series) -> pd.Series:
    import json

    def refuse(constant: str) -> None:
        raise ValueError(constant)

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(json.loads(text, parse_constant=refuse), ensure_ascii=False, allow_nan=False, sort_keys=True, separators=(",", ":"))
        except ValueError:
            return None

    return texts.map(one)


def shorten(col: Column, most: int = 140) -> Column:
    """White space to single spaces, cut at the last space within the limit."""
    flat = F.trim(F.regexp_replace(col, r"\s+", " "))
    head = F.substring(flat, 1, most)
    return F.when(F.length(flat) > most, F.regexp_replace(head, r" [^ ]*$", "")).otherwise(flat)
