"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest row count of a side that may be broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 1_000_000
#: Bytes of an Arrow batch between the JVM and Python where the session sets no bound; of Spark's own 64 MB every task holds several copies.
ARROW_BYTES = "2m"
#: Rows that a Parquet reader decodes at once where the session sets none; Spark's own 4,096 rows of texts are arrays of many MB on the heap of every task.
READ_ROWS = "1024"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a fresh one of this machine where it is unset and Spark is local."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        base = f"file://{tempfile.mkdtemp(prefix='trailmark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of bounded bytes and short Parquet batches for the session, so that a task's memory does not follow the length of the texts; bounds of the user's own stay."""
    for name, bound in (("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES), ("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)):
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, bound)


def save(df: DataFrame, tag: str, done: bool = False) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors.

    done: the shuffle files behind df are large and not needed again; Spark's cleaner drops them as soon as the
    driver's JVM has collected their owners, so ask for that now rather than at its next periodic collection.
    """
    bound_batches(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if done:
        df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_rows(spark: SparkSession, **columns: pa.Array) -> DataFrame:
    """A few rows of the driver. They go as Arrow: from a list of rows Spark would start Python workers of another kind, which stay beside those of mapInArrow."""
    return spark.createDataFrame(pa.table(columns))


def give_back() -> None:
    """Return to the system what this Python process has freed: Arrow's pool, and the heap where the C library can (glibc)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    bound_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def checked_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast df when its counted rows stay under the bound, otherwise leave the join to the shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def row_keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, bool]:
    """((row, id, text), whether row is the id itself): row is a unique long that orders rows by id, then text.

    Where ids are unique and not null, row is the id itself. Otherwise the rows are sorted once
    (null ids first, ties by text) and numbered, and the numbered table is written to the shared folder.
    """
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = named.groupBy("id").count()
    odd = ids.agg(F.max(F.when(F.col("id").isNull() | (F.col("count") > 1), 1).otherwise(0))).first()[0]
    if not odd:
        return named.select(F.col("id").alias("row"), "id", "text"), True
    numbered = named.orderBy(F.col("id").asc_nulls_first(), "text").select(F.monotonically_increasing_id().alias("row"), "id", "text")
    return save(numbered, "rows"), False


ROW = "_trailmark_row"


def with_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with a unique long column ROW in the order of row_keyed: the id where ids are unique and not null."""
    ids = docs.groupBy(F.col(id_col).cast("long").alias("id")).count()
    odd = ids.agg(F.max(F.when(F.col("id").isNull() | (F.col("count") > 1), 1).otherwise(0))).first()[0]
    if not odd:
        return docs.withColumn(ROW, F.col(id_col).cast("long"))
    order = docs.orderBy(F.col(id_col).cast("long").asc_nulls_first(), F.coalesce(F.col(text_col), F.lit("")))
    return save(order.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def lower_ascii(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
