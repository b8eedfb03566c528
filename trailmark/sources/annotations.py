"""Annotations with optimistic concurrency: a table of labels whose revision is a digest of its content."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(ValueError):
    """Somebody else saved since the revision that a change was made on."""


def _file_system(spark: SparkSession, folder: str):
    jvm = spark.sparkContext._jvm  # the file system of Spark's own paths has no Python interface
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return jvm, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def digest(df: DataFrame) -> str:
    """A digest of a table's rows, whatever their order and partitions: SHA-256 over the sums of four 64-bit hashes of the rows, and their number."""
    said = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    sums = [F.sum(F.conv(F.substring(F.sha2(said, 256), 1 + 16 * k, 16), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"s{k}") for k in range(4)]
    r = df.agg(F.count("*").alias("n"), *sums).select(F.sha2(F.concat_ws("|", "n", *(F.coalesce(f"s{k}", F.lit("")) for k in range(4))), 256).alias("d")).first()
    return r.d


def current(spark: SparkSession, folder: str) -> tuple[str | None, DataFrame | None]:
    """(revision, labels) as last saved; nothing before the first."""
    jvm, fs = _file_system(spark, folder)
    at, revision = jvm.org.apache.hadoop.fs.Path(f"{folder}/next"), None
    names = {s.getPath().getName() for s in fs.listStatus(at)} if fs.exists(at) else set()
    name = "start"
    while name in names:  # every revision names the one that replaced it
        revision = name = spark.read.text(f"{folder}/next/{name}").first()[0]
    return (revision, spark.read.parquet(f"{folder}/revisions/{revision}")) if revision else (None, None)


def save(spark: SparkSession, folder: str, changes: DataFrame, revision: str | None, key: str = "sample_id") -> str:
    """Labels with the changes (rows by key) laid over them, as the next revision after `revision`; Conflict if that is no longer the last.

    Revisions are folders that never change, so each is the backup of the next. A writer claims to follow a revision by creating the file next/<revision>, which
    only one can create; its content names the new revision, whose rows are whole before that. A change to the same content keeps the revision.
    Repeated keys in changes are refused.
    """
    if changes.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError("repeated keys")
    now, labels = current(spark, folder)
    if now != revision:
        raise Conflict(f"saved on {revision}, but the last revision is {now}")
    merged = changes if labels is None else labels.join(changes.select(key), key, "left_anti").unionByName(changes)
    new = f"{digest(merged)}-{uuid.uuid4().hex[:8]}"
    if now and new.split("-")[0] == now.split("-")[0]:
        return now
    merged.write.parquet(f"{folder}/revisions/{new}")
    jvm, fs = _file_system(spark, folder)
    claim = jvm.org.apache.hadoop.fs.Path(f"{folder}/next/{revision or 'start'}")
    try:
        out = fs.create(claim, False)
    except Exception as e:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{folder}/revisions/{new}"), True)
        raise Conflict(f"another writer has followed {revision}") from e
    out.write(bytearray(new.encode()))
    out.close()
    return new


def conflicts(base: DataFrame, theirs: DataFrame, mine: DataFrame, key: str = "sample_id") -> DataFrame:
    """(key, mine, theirs) of my changes that meet another change of the same row since base, as JSON; equal changes do not conflict."""
    said = lambda df, name: df.select(key, F.to_json(F.struct(*sorted(c for c in df.columns if c != key)), {"ignoreNullFields": "false"}).alias(name))
    met = said(mine, "mine").join(said(theirs, "theirs"), key, "left").join(said(base, "base"), key, "left")
    return met.where(~F.equal_null("theirs", "base") & ~F.equal_null("theirs", "mine")).select(key, "mine", "theirs")
