"""Contracts of target records: one reason per broken rule, as columns over the raw JSON; files and companions of a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .rules import flags

# Fixed values.
SCHEMA_VERSION = 1
TARGET_ROLES = {"attention": "primary", "fused": "supplementary"}
REQUIRED = (
    "schema_version", "sample_id", "image_key", "place_key", "source_path", "mask_original_path", "target_type", "mask_ratio", "clean_margin",
    "mask_mode", "mask_token_count", "checkpoint_path", "checkpoint_sha256", "stage2_commit", "seed",
)
TEXTS = ("sample_id", "image_key", "place_key", "source_path", "mask_original_path", "mask_mode", "checkpoint_path", "checkpoint_sha256", "stage2_commit")
BLANKS = r"[\s\x1c-\x1f\x85\p{Z}]*"


class _Record:
    """Fields of a variant column with their kinds."""

    def __init__(self, v: Column):
        self.v = v

    def field(self, name: str) -> Column:
        return F.try_variant_get(self.v, f"$.{name}", "variant")

    def has(self, name: str) -> Column:
        return self.field(name).isNotNull()

    def kind(self, name: str) -> Column:
        """VOID for a JSON null, null for an absent field."""
        return F.schema_of_variant(self.field(name))

    def text(self, name: str) -> Column:
        return F.when(self.kind(name) == "STRING", F.try_variant_get(self.v, f"$.{name}", "string"))

    def number(self, name: str) -> Column:
        return F.when(self.kind(name).rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.try_variant_get(self.v, f"$.{name}", "double"))

    def whole(self, name: str) -> Column:
        """Integers as JSON writes them; 1.0 is none (it becomes a short decimal, an integer one of 19 digits or more)."""
        return F.when(self.kind(name).rlike(r"^(BIGINT|DECIMAL\((19|[23]\d),0\))$"), F.try_variant_get(self.v, f"$.{name}", "decimal(38,0)"))


def target_faults(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """lines with sample_id, faults (names of the broken rules, the first is the one to report) and missing (absent or null required fields).

    A line that is no JSON object (repeated fields, NaN and Infinity included) has the fault not_an_object, and no other. Rules of a field that
    is missing do not fire.
    """
    out = lines.withColumn("_v", F.try_parse_json(F.col(raw)))
    r = _Record(F.col("_v"))
    blank = lambda name: F.coalesce(r.text(name).rlike(f"^{BLANKS}$"), r.kind(name) != "STRING", F.lit(False))
    given = lambda name: r.has(name) & (r.kind(name) != "VOID")
    missing = F.array_compact(F.array(*(F.when(~F.coalesce(given(name), F.lit(False)), name) for name in REQUIRED)))
    key, kind = r.text("image_key"), r.text("target_type")
    role = F.create_map(*(F.lit(x) for pair in TARGET_ROLES.items() for x in pair))[kind]
    not_a = lambda value, name, rule: F.coalesce(given(name) & ~F.coalesce(rule(value), F.lit(False)), F.lit(False))
    least = lambda name, low: not_a(r.whole(name), name, lambda x: x >= low)
    unlike = lambda name, want: r.has(name) & ~F.coalesce(F.equal_null(r.text(name), want), F.lit(False))
    rules = {
        "missing_required_fields": F.size(missing) > 0,
        "unsupported_schema_version": not_a(r.whole("schema_version"), "schema_version", lambda x: x == SCHEMA_VERSION),
        **{f"{name}_not_a_nonempty_string": given(name) & blank(name) for name in TEXTS},
        "invalid_target_type": not_a(kind, "target_type", lambda x: x.isin(*TARGET_ROLES)),
        "target_role_disagrees": unlike("target_role", role),
        "source_role_not_source": unlike("source_role", F.lit("SOURCE")),
        "image_key_not_normalized": (key != ".") & (key.rlike(r"(^|/)\.{0,2}(/|$)") | F.contains(key, F.lit("\\"))),
        **{f"{name}_not_a_finite_number": not_a(r.number(name), name, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) for name in ("mask_ratio", "clean_margin")},
        "mask_ratio_out_of_range": (r.number("mask_ratio") <= 0) | (r.number("mask_ratio") > 1),
        "seed_not_a_whole_number": least("seed", 0),
        "mask_token_count_not_positive": least("mask_token_count", 1),
        **{f"{name}_not_positive": r.has(name) & ~F.coalesce(r.whole(name) >= 1, F.lit(False)) for name in ("source_width", "source_height")},
    }
    is_object = F.coalesce(F.schema_of_variant(F.col("_v")).startswith("OBJECT"), F.lit(False))
    found = F.when(is_object, flags(**{k: F.coalesce(v, F.lit(False)) for k, v in rules.items()})).otherwise(F.array(F.lit("not_an_object")))
    return out.withColumns({"sample_id": r.text("sample_id"), "missing": F.when(is_object, missing), "faults": found}).drop("_v")


def target_file_faults(records: DataFrame, files: DataFrame) -> DataFrame:
    """records with faults against the files they name.

    records: (sample_id, image_key, source_path, mask_original_path, and optional source_width, source_height, actual_pixel_area_original, source_sha256,
    mask_original_sha256; null means not given). files: (path, width, height, format, mode, sha256, levels: pixels by value as map<int, bigint>).
    """
    every = ("path", "width", "height", "format", "mode", "sha256", "levels")
    source = files.select(*(F.col(c).alias(f"s_{c}") for c in every))
    mask = files.select(*(F.col(c).alias(f"m_{c}") for c in every))
    out = records.join(source, F.col("source_path") == F.col("s_path"), "left").join(mask, F.col("mask_original_path") == F.col("m_path"), "left")
    one = F.when(F.col("m_mode") == "1", 255).otherwise(1)  # a bilevel image holds its ones as 255
    ones = F.coalesce(F.try_element_at("m_levels", one), F.lit(0))
    others = F.aggregate(F.map_entries("m_levels"), F.lit(0).cast("long"), lambda a, e: a + F.when(e["key"].isin(0) | (e["key"] == one), 0).otherwise(e["value"]))
    given = lambda name, actual: F.col(name).isNotNull() & (F.col(name) != actual) if name in records.columns else F.lit(False)
    found = flags(**{k: F.coalesce(v, F.lit(False)) for k, v in {
        "source_file_missing": F.col("s_path").isNull(), "mask_file_missing": F.col("m_path").isNull(),
        "source_path_does_not_match_image_key": ~(F.concat(F.lit("/"), "source_path").endswith(F.concat(F.lit("/"), "image_key"))),
        "mask_not_single_channel_png": F.col("m_path").isNotNull() & ~(F.coalesce(F.col("m_format") == "PNG", F.lit(False)) & F.coalesce(F.col("m_mode").isin("1", "L"), F.lit(False))),
        "mask_size_differs": (F.col("s_width") != F.col("m_width")) | (F.col("s_height") != F.col("m_height")),
        "mask_not_binary": others > 0, "mask_empty": F.col("m_path").isNotNull() & (ones == 0),
        "source_width_mismatch": given("source_width", F.col("s_width")), "source_height_mismatch": given("source_height", F.col("s_height")),
        "pixel_area_mismatch": given("actual_pixel_area_original", ones),
        "source_sha256_mismatch": given("source_sha256", F.col("s_sha256")), "mask_sha256_mismatch": given("mask_original_sha256", F.col("m_sha256")),
    }.items()})
    return out.withColumns({"file_faults": found, "pixel_area": ones}).select(*(F.col(c) for c in records.columns), "pixel_area", "file_faults")


def file_digest(spark: SparkSession, path: str) -> str | None:
    """SHA-256 of one file's bytes, or null if there is none."""
    folder, _, name = path.rpartition("/")
    found = spark.read.format("binaryFile").option("pathGlobFilter", name).load(folder).select(F.sha2("content", 256).alias("d")).first()
    return found and found.d


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """(line, raw, sample_id, missing, faults) of a manifest of target records, whose companion export_manifest.json must agree where there is one.

    Beside a record's own faults: blank lines and repeated ids (after the first). An empty manifest, a companion of another schema, hash or count, and a
    manifest that changes while it is read are errors, because then no line can be trusted.
    """
    folder, _, name = path.rpartition("/")
    digest = file_digest(spark, path)
    if digest is None:
        raise ValueError(f"targets manifest does not exist or is empty: {path}")
    text = spark.read.format("binaryFile").option("pathGlobFilter", name).load(folder).select(F.posexplode(F.split(F.regexp_replace(F.decode("content", "UTF-8"), r"\r?\n\z", ""), r"\r?\n")).alias("pos", "raw"))
    checked = target_faults(text.select((F.col("pos") + 1).alias("line"), "raw"))
    first = checked.where("sample_id IS NOT NULL").groupBy("sample_id").agg(F.min("line").alias("_first"))
    blank = F.col("raw").rlike(f"^{BLANKS}$")
    out = checked.join(first, "sample_id", "left").withColumn("faults", F.when(blank, F.array(F.lit("blank_record"))).when(F.col("line") > F.col("_first"), F.concat(F.array(F.lit("duplicate_sample_id")), "faults")).otherwise(F.col("faults"))).drop("_first")
    rows = out.count()
    companion = spark.read.format("binaryFile").option("pathGlobFilter", "export_manifest.json").load(folder).select(F.decode("content", "UTF-8").alias("raw")).first()
    if companion:
        r = _Record(F.col("v"))
        got = spark.createDataFrame([(companion.raw,)], "raw string").select(F.try_parse_json("raw").alias("v")).select(r.whole("schema_version").alias("version"), r.text("targets_sha256").alias("digest"), r.whole("record_count").alias("n")).first()
        if got.version is None or int(got.version) != SCHEMA_VERSION:
            raise ValueError("unsupported export manifest schema_version")
        if got.digest != digest or got.n is None or int(got.n) != rows:
            raise ValueError("export manifest targets hash/count mismatch")
    if file_digest(spark, path) != digest:
        raise ValueError("targets manifest changed while reading")
    return out.select("line", "raw", "sample_id", "missing", "faults")


def result_faults(results: DataFrame) -> DataFrame:
    """results of a matcher with the broken rules of its contract, none if they hold.

    matched0, matched1, all0, all1: arrays of points (arrays of two numbers); desc0, desc1: arrays of descriptors, empty where a matcher
    has none; confidences: an array of numbers, or null.
    """
    pairs = lambda c: F.forall(c, lambda p: F.coalesce(F.size(p) == 2, F.lit(False)))
    even = lambda c: F.size(F.array_distinct(F.transform(c, F.size))) <= 1
    rules = {f"{c}_missing": F.col(c).isNull() for c in ("matched0", "matched1", "all0", "all1", "desc0", "desc1")}
    rules |= {f"{c}_not_pairs": ~pairs(c) for c in ("matched0", "matched1", "all0", "all1")}
    rules["matches_differ_in_number"] = F.size("matched0") != F.size("matched1")
    rules |= {f"desc{k}_uneven": ~even(f"desc{k}") for k in (0, 1)}
    rules |= {f"desc{k}_differ_from_points": (F.size(f"desc{k}") != 0) & (F.size(f"desc{k}") != F.size(f"all{k}")) for k in (0, 1)}
    rules["confidences_differ_from_matches"] = F.col("confidences").isNotNull() & (F.size("confidences") != F.size("matched0"))
    return results.withColumn("faults", flags(**{k: F.coalesce(v, F.lit(False)) for k, v in rules.items()}))


def declared(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """The declared fields of df in their order; those that df lacks are null, others are dropped."""
    have = set(df.columns)
    return df.select(*(F.col(c) if c in have else F.lit(None).alias(c) for c in fields))
