"""Sources: strict JSON lines, listings, source tables, layered settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmark.functions.text import path_id, safe_id

#: Image suffixes.
IMAGES = r"(?i)\.(jpg|jpeg|png|webp)$"


def images(spark: SparkSession, root: str) -> DataFrame:
    """(path, sample_id, length) of image files below root; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    found = files.where(F.col("path").rlike(IMAGES))
    base = root.rstrip("/").split(":")[-1].lstrip("/")
    return found.withColumn("sample_id", path_id(F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", ""), f"^{base}/", "")))


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, faults) of a JSON-lines file: rows have their line, faults name line and reason.

    Lines that are no objects are faults, as are repeated sample ids after sanitising; strict adds blank lines, repeated keys and NaN.
    """
    text = spark.read.text(path).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_m"))
    # Line numbers without reading a file in one task: lines of the blocks before, plus the place in the own block.
    blocks = text.groupBy("_file", "_at").agg(F.count("*").alias("_n"), F.min("_m").alias("_m0"))
    before = blocks.withColumn("_before", F.sum("_n").over(Window.partitionBy("_file").orderBy("_at")) - F.col("_n"))
    lines = text.join(before, ["_file", "_at"]).select((F.col("_before") + F.col("_m") - F.col("_m0") + 1).alias("line"), "raw")
    keys = F.json_object_keys("raw")
    row = F.from_json("raw", schema, {"mode": "PERMISSIVE", "allowNonNumericNumbers": "false"})
    blank = F.trim("raw") == ""
    reason = F.when(blank, "blank line" if strict else None).when(keys.isNull(), "not an object")
    if strict:
        reason = F.coalesce(reason, F.when(~blank & (F.size(keys) != F.size(F.array_distinct(keys))), "repeated key"), F.when(~blank & F.col("raw").rlike(r"\b(NaN|Infinity)\b"), "not a finite number"))
    read = lines.select("line", "raw", row.alias("row"), reason.alias("reason")).where(~blank | F.col("reason").isNotNull())
    rows = read.where("reason is null").select("line", "row.*").withColumn("sample_id", safe_id(F.col("sample_id")))
    twice = rows.groupBy("sample_id").agg(F.min("line").alias("_first"), F.count("*").alias("_copies"))
    ids = rows.select("line", "sample_id")
    again = ids.join(twice, "sample_id").where("_copies > 1 and line > _first").select("line", F.lit("repeated sample_id").alias("reason"))
    faults = read.where("reason is not null").select("line", "reason").union(again).union(ids.where("sample_id is null").select("line", F.lit("empty sample_id")))
    return rows, faults


def source_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV of (city, source_id, gsvcities_path) with the reasons a row is refused."""
    rows = spark.read.csv(path, header=True, schema="city string, source_id string, gsvcities_path string")
    many = rows.groupBy("source_id").agg(F.count("*").alias("n"))
    p = F.col("gsvcities_path")
    reasons = F.filter(
        F.array(
            F.when(F.col("n") > 1, F.lit("repeated source_id")),
            F.when(p.startswith("/") | p.rlike(r"(^|/)\.\.(/|$)"), F.lit("path leaves the root")),
            F.when(F.substring_index(p, "/", -1) != F.col("source_id"), F.lit("path names another source")),
        ),
        lambda r: r.isNotNull(),
    )
    return rows.join(many, "source_id").select("city", "source_id", "gsvcities_path", reasons.alias("reasons"))


def resolve_sources(entries: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """entries (sample_id, city, source_id) with path: an absolute source_id that exists, else root/city/source_id, else root/source_id; fault where none does.

    files: (path); repeated paths count once. Blank cities are passed over; without a source_id nothing is tried.
    """
    known = files.select("path").distinct()
    city, source = F.nullif(F.trim(F.coalesce("city", F.lit(""))), F.lit("")), F.nullif(F.trim(F.coalesce("source_id", F.lit(""))), F.lit(""))
    base = root.rstrip("/")
    asked = entries.withColumns({"_p0": F.when(source.startswith("/"), source), "_p1": F.when(city.isNotNull(), F.concat(F.lit(f"{base}/"), city, F.lit("/"), source)), "_p2": F.concat(F.lit(f"{base}/"), source)})
    # A place not tried would send its rows to one task; no path holds a NUL, so these keys spread and meet nothing.
    none = F.concat(F.lit("\0"), F.pmod(F.xxhash64("sample_id", "city", "source_id"), F.lit(4096)).cast("string"))
    for k in range(3):
        asked = asked.join(known.select(F.col("path").alias(f"_f{k}")), F.coalesce(F.col(f"_p{k}"), none) == F.col(f"_f{k}"), "left")
    path = F.coalesce("_f0", "_f1", "_f2")
    fault = F.when(source.isNull(), "missing source_id").when(path.isNull(), F.concat(F.lit("source image not found; tried "), F.concat_ws(", ", "_p1", "_p2")))
    return asked.select(*entries.columns, path.alias("path"), fault.alias("fault"))


def image_pairs(files: DataFrame, root: str) -> DataFrame:
    """(folder, path0, path1, fault) of the pairs below root: root itself where it holds just two files, else every folder in it, sorted by path.

    files: (path) of all files below root. A folder with another number of files, or a file beside the folders, is a fault.
    """
    base = root.rstrip("/")
    inner = files.where(F.startswith("path", F.lit(f"{base}/"))).select("path", F.expr(f"substring(path, {len(base) + 2})").alias("_rest")).withColumn("folder", F.when(F.contains("_rest", F.lit("/")), F.substring_index("_rest", "/", 1)))
    by = inner.groupBy("folder").agg(F.slice(F.array_sort(F.collect_set("path")), 1, 3).alias("paths"), F.countDistinct("path").alias("n"))  # folders of a pair; a crowded one is cut to three
    shape = by.agg(F.count("*").alias("folders"), F.max(F.when(F.col("folder").isNull(), F.col("n"))).alias("loose"))
    by = by.join(F.broadcast(shape))  # a single row
    whole = (F.col("folders") == 1) & (F.col("loose") == 2)
    pair = (F.col("n") == 2) & (F.col("folder").isNotNull() | whole)
    fault = F.when(~pair, F.when(F.col("folder").isNull(), "files beside folders").otherwise("not a pair of files"))
    return by.select("folder", F.when(pair, F.get("paths", F.lit(0))).alias("path0"), F.when(pair, F.get("paths", F.lit(1))).alias("path1"), fault.alias("fault"))


def pair_lines(lines: DataFrame) -> DataFrame:
    """(line, path0, path1, fault) of texts (line, raw) of two paths each, parted by one blank."""
    parts = F.split(F.trim("raw"), " ")
    good = (F.size(parts) == 2) & (F.trim("raw") != "")
    return lines.select("line", *(F.when(good, F.get(parts, F.lit(k))).alias(f"path{k}") for k in (0, 1)), F.when(~F.coalesce(good, F.lit(False)), "not a pair of paths").alias("fault"))


def training_records(lines: DataFrame, folder: str) -> DataFrame:
    """(line, target_image, prompt, source_images, fault) of metadata lines (line, raw); paths are taken from the folder of the list, blank lines are passed over."""
    row = F.from_json("raw", "prompt string, target_image string, source_images array<string>")
    resolve = lambda p: F.when(p.startswith("/"), p).otherwise(F.concat(F.lit(f"{folder.rstrip('/')}/"), p))
    read = lines.where(~F.coalesce(F.trim("raw") == "", F.lit(True))).withColumns({"_r": row, "_keys": F.json_object_keys("raw")})
    fault = F.when(F.col("_keys").isNull(), "not an object").when(F.col("_r.prompt").isNull(), "no prompt")
    return read.select("line", resolve(F.col("_r.target_image")).alias("target_image"), F.trim("_r.prompt").alias("prompt"), F.transform(F.coalesce("_r.source_images", F.array().cast("array<string>")), resolve).alias("source_images"), fault.alias("fault"))


def world_records(spark: SparkSession, path: str, root: str) -> DataFrame:
    """(video_path, caption, w2c, intrinsic, action, image_cond) of a JSON list of videos; paths start at root, absent fields are null, an absent caption is empty."""
    schema = "video_path string, caption string, w2c array<array<array<double>>>, intrinsic array<array<double>>, action array<int>, image_cond string"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    below = lambda c: F.when(F.col(c).startswith("/"), F.col(c)).otherwise(F.concat(F.lit(f"{root.rstrip('/')}/"), c))
    return raw.select(below("video_path").alias("video_path"), F.coalesce("caption", F.lit("")).alias("caption"), "w2c", "intrinsic", "action", below("image_cond").alias("image_cond"))


def merged_settings(*layers: dict) -> dict:
    """Layers merged in order; later values win, nested tables merge."""
    out: dict = {}
    for layer in layers:
        for k, v in layer.items():
            out[k] = merged_settings(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out
