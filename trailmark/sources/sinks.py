"""Sinks: record upserts, accepted manifests, output paths, prefix-checked task lists."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; where it is unset and Spark is local, a fresh one of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        base = f"file://{tempfile.mkdtemp(prefix='trailmark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """df as written to the shared folder: rounds of a loop neither grow the plan nor are lost with an executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def upsert(records: DataFrame, errors: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """The latest record of each key, and the errors of keys without a record."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    latest = records.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return latest, errors.join(latest.select(key), key, "left_anti")


def accepted(records: DataFrame) -> DataFrame:
    """One row per training candidate that passed and is eligible."""
    flat = records.select("sample_id", F.explode("training_candidates").alias("c")).where("c.passed and c.eligible_for_training")
    return flat.select("sample_id", "c.*")


def output_path(stem: Column, route: Column, weather: Column, occlusion: Column, passed: Column) -> Column:
    name = F.concat(stem, F.lit("__"), F.concat_ws("_", route, F.nullif(weather, F.lit("")), F.nullif(occlusion, F.lit(""))), F.lit("__"), F.when(passed, "final").otherwise("rejected"), F.lit(".jpg"))
    return F.concat_ws("/", F.when(~passed, "rejected"), route, name)


def write_lines(df: DataFrame, path: str, order: str) -> None:
    """JSON lines sorted by a column over as many files as needed (a range sort, not one task)."""
    df.orderBy(order).write.mode("error").json(path)


def prefix_faults(existing: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Rows that keep an existing task list from being an identical prefix of a new one; none if it may be resumed."""
    value = lambda d, name: d.select(order, F.to_json(F.struct(*sorted(c for c in d.columns if c != order))).alias(name))
    both = value(existing, "old").join(value(new, "new"), order, "left")
    return both.where(~F.equal_null("old", "new")).select(order, F.when(F.col("new").isNull(), "not in the new list").otherwise("changed").alias("reason"))


def append_cases(df: DataFrame, path: str) -> None:
    """JSON lines added to what is there; each write is a set of files of its own, so writers do not meet."""
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def review_rows(df: DataFrame, lists: tuple[str, ...], blanks: tuple[str, ...]) -> DataFrame:
    """df as a sheet for reviewers: lists as texts with bars between, and empty columns to fill in."""
    return df.withColumns({c: F.array_join(c, "|") for c in lists} | {c: F.lit(None).cast("string") for c in blanks})


def write_review(df: DataFrame, path: str, lists: tuple[str, ...], blanks: tuple[str, ...]) -> None:
    review_rows(df, lists, blanks).write.mode("error").csv(path, header=True, emptyValue="", nullValue="")


def materialize(records: DataFrame, ids: DataFrame, key: str, path: str) -> None:
    """The records of the given ids as JSON lines sorted by key, over as many files as needed."""
    write_lines(records.join(ids.select(key).distinct(), key, "left_semi"), path, key)
