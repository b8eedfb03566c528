"""Weight shards: tensors packed into files by count or by block with an index, files of one header and its bytes, and a data source that reads headers only."""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .sinks import cut_lineage

#: The longest header that is read, and the block number in a key.
MOST_HEADER = 64 * 1024 * 1024
BLOCK = r"blocks\.(\d+)\."


def _running(df: DataFrame, size: str, order: str) -> DataFrame:
    """df in the order of a column, with place (from 0) and start (sizes of all rows before) over the whole table.

    A range sort deals the rows; only one row per task, its count and its sum, is summed over in one place.
    """
    placed = cut_lineage(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()))
    parts = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.sum(size).alias("_s"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"))
    inside = Window.partitionBy("_part").orderBy(order)
    out = placed.withColumns({"_k": F.row_number().over(inside) - 1, "_r": F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(size)})
    return out.join(F.broadcast(parts), "_part").withColumns({"place": F.col("_n0") + F.col("_k"), "start": F.col("_s0") + F.col("_r")}).drop("_part", "_n0", "_s0", "_k", "_r")  # a row per task


def pack(tensors: DataFrame, per_shard: int = 0, most_bytes: int = 0, by_block: bool = False, block_factor: dict[str, int] | None = None) -> DataFrame:
    """(key, bytes, shard, offset, shard_bytes, total_bytes) of tensors (key, bytes), in key order.

    by_block: the number in `blocks.N.` names the shard, other keys share one (-1); block_factor multiplies the number of keys that hold a word.
    per_shard: so many keys a shard; most_bytes: a key goes to the shard in whose span of so many bytes it begins, so a shard is over
    by less than one tensor; neither: one shard. Repeated keys would share an offset and are refused.
    """
    if sum(map(bool, (per_shard, most_bytes, by_block))) > 1 or min(per_shard, most_bytes) < 0:
        raise ValueError("name one rule of packing")
    t = tensors.select("key", F.col("bytes").cast("long").alias("bytes"))
    if t.groupBy("key").count().where("count > 1").limit(1).count():
        raise ValueError("repeated keys")
    if by_block:
        block = F.nullif(F.regexp_extract("key", BLOCK, 1), F.lit("")).cast("long")
        for word, factor in (block_factor or {}).items():
            block = F.when(F.contains("key", F.lit(word)), block * factor).otherwise(block)
        out = t.withColumn("shard", F.coalesce(block, F.lit(-1).cast("long")))
    else:
        out = _running(t, "bytes", "key").withColumn("shard", F.floor(F.col("place") / per_shard) if per_shard else F.floor(F.col("start") / most_bytes) if most_bytes else F.lit(0).cast("long")).drop("place", "start")
    inside = Window.partitionBy("shard").orderBy("key")
    out = out.withColumn("offset", F.sum("bytes").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("bytes"))
    sums = out.groupBy("shard").agg(F.sum("bytes").alias("shard_bytes"))
    total = sums.agg(F.sum("shard_bytes").alias("total_bytes"))
    return out.join(sums, "shard").join(F.broadcast(total))  # a single row


def shard_bytes(tensors: list[tuple[str, str, list[int], bytes]]) -> bytes:
    """A file of tensors (key, dtype, shape, bytes): length of the header, the header, and all bytes in order."""
    header, at = {}, 0
    for key, dtype, shape, data in tensors:
        header[key] = {"dtype": dtype, "shape": shape, "data_offsets": [at, at + len(data)]}
        at += len(data)
    text = json.dumps(header, separators=(",", ":")).encode()
    return struct.pack("<Q", len(text)) + text + b"".join(d for *_, d in tensors)


def write_shards(tensors: DataFrame, folder: str, prefix: str = "part") -> DataFrame:
    """(file, tensors, bytes) of files written to a folder that all executors reach, one for each shard of (shard, key, dtype, shape, data), in key order.

    A file is named by its shard and written whole, so a task that runs again writes the same file. A shard is held by one task, as `pack` bounds it.
    """
    root = folder if "://" in folder else f"file://{folder}"

    def write(t: pa.Table) -> pa.Table:
        from pyarrow import fs

        rows = sorted(t.to_pylist(), key=lambda r: r["key"].encode())
        uri = f"{root}/{prefix}_{rows[0]['shard']}.safetensors"
        system, path = fs.FileSystem.from_uri(uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        data = shard_bytes([(r["key"], r["dtype"], r["shape"], r["data"]) for r in rows])
        with system.open_output_stream(path) as out:
            out.write(data)
        return pa.table({"file": [uri], "tensors": pa.array([len(rows)], pa.int64()), "bytes": pa.array([len(data)], pa.int64())})

    return tensors.select("shard", "key", "dtype", F.col("shape").cast("array<long>").alias("shape"), F.col("data").cast("binary").alias("data")).groupBy("shard").applyInArrow(write, "file string, tensors long, bytes long")


class _File(InputPartition):
    def __init__(self, uris: list[str]):
        self.uris = uris


def _read_header(uri: str) -> Iterator[tuple]:
    """Rows of one file: its tensors, or one row with the fault. Reads the length, then the header, by range."""
    from pyarrow import fs

    none = (None,) * 6
    try:
        system, path = fs.FileSystem.from_uri(uri)
        size = system.get_file_info(path).size
        with system.open_input_file(path) as f:
            first = f.read_at(8, 0)
            length = struct.unpack("<Q", first)[0] if len(first) == 8 else 0
            if not 0 < length <= MOST_HEADER:
                yield (uri, size, *none, "invalid header length")
                return
            raw = f.read_at(length, 8)
        header = json.loads(raw)
        tensors = {k: v for k, v in header.items() if k != "__metadata__"}
        rows = [(k, v["dtype"], [int(n) for n in v["shape"]], int(v["data_offsets"][0]), int(v["data_offsets"][1])) for k, v in tensors.items()]
    except (OSError, ValueError, KeyError, TypeError, IndexError, AttributeError) as e:
        yield (uri, None, *none, f"unreadable header: {type(e).__name__}")
        return
    if size != 8 + length + max((r[4] for r in rows), default=0):
        yield (uri, size, *none, "truncated or longer than its header says")
        return
    digest = hashlib.sha256(raw).hexdigest()
    for r in rows or [(None,) * 5]:
        yield (uri, size, *r, digest, None)


class _HeaderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.each = options["path"], int(options.get("filespertask", 64))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        root = self.root if "://" in self.root else f"file://{self.root}"
        system, path = fs.FileSystem.from_uri(root)
        head = root[: len(root) - len(path)]
        info = system.get_file_info(path)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
        names = sorted(head + f.path for f in found if f.is_file and f.path.endswith(".safetensors"))
        return [_File(names[k : k + self.each]) for k in range(0, len(names), self.each)] or [_File([])]

    def read(self, partition: _File) -> Iterator[tuple]:
        for uri in partition.uris:
            yield from _read_header(uri)


class TensorHeaders(DataSource):
    """`spark.read.format("tensor_headers").load(folder)`: a row per tensor, or one with the fault of a broken file.

    The paths must be readable by pyarrow's file systems (local or mounted folders, hdfs, s3, gs), as tasks open them by range; filesPerTask deals the files.
    """

    @classmethod
    def name(cls) -> str:
        return "tensor_headers"

    def schema(self) -> str:
        return "file string, file_bytes long, key string, dtype string, shape array<long>, begin long, end long, header_sha256 string, fault string"

    def reader(self, schema) -> DataSourceReader:
        return _HeaderReader(self.options)


def tensor_headers(spark: SparkSession, folder: str, files_per_task: int = 64) -> DataFrame:
    spark.dataSource.register(TensorHeaders)
    return spark.read.format("tensor_headers").option("filesPerTask", files_per_task).load(folder)
