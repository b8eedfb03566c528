"""Operator 5, token-id output with Elias-Fano document boundaries.

Texts are encoded with a public tokenizer, an end id closes each document, and ids are written in ascending
document order as blocks of a binary format (one row of a Parquet file holds one block, so that any store
Spark writes to will do and Spark's commit protocol covers lost executors):

    magic "TMK1" | id bytes (1) | documents u32 | ids u64 | two Elias-Fano lists | ids, little-endian

The lists are the ends of the documents in the block's id array, and the row keys relative to the first one.
An Elias-Fano list of n values below u takes about n * (2 + log2(u / n)) bits: low bits packed, high bits in
unary, and the place of every 256th set bit as a u32 directory for select, which every offset is read by.

Null or empty texts are documents of the end id alone. Null ids sort first, repeated ids by text. Texts of any length are encoded whole. An empty
table writes no block and gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, row_keyed, save

BLOCK_IDS = 262_144
CACHE_CHUNKS = 500_000
_DIRECTORY = 256


class EliasFano:
    """A non-decreasing list of integers, read in place by select(i); all() unpacks the whole list."""

    def __init__(self, n: int, universe: int, low: np.ndarray, high: np.ndarray, directory: np.ndarray):
        self.n, self.universe, self.low, self.high, self.directory = n, universe, low, high, directory
        self.bits = self.low_bits(n, universe)

    @staticmethod
    def low_bits(n: int, universe: int) -> int:
        return max(0, (universe // n).bit_length() - 1) if n else 0

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        """values below or equal to universe."""
        values = np.asarray(values, np.uint64)
        n, bits = len(values), cls.low_bits(len(values), universe)
        low = np.packbits(((values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        place = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros((universe >> bits) + n + 1, np.uint8)
        flags[place] = 1
        return cls(n, universe, low, np.packbits(flags, bitorder="little"), place[::_DIRECTORY].astype("<u4"))

    def _low(self, i: int) -> int:
        at = i * self.bits
        raw = int.from_bytes(self.low[at // 8 : (at + self.bits + 7) // 8].tobytes(), "little")
        return (raw >> (at % 8)) & ((1 << self.bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value: the directory gives a nearby set bit, and set bits are counted from there."""
        at, left = int(self.directory[i // _DIRECTORY]), i % _DIRECTORY
        byte = at // 8
        word = int(self.high[byte]) >> (at % 8) << (at % 8)
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        place = byte * 8 + (word & -word).bit_length() - 1
        return ((place - i) << self.bits) | self._low(i)

    def all(self) -> np.ndarray:
        place = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        high = (place - np.arange(self.n)) << self.bits
        low = np.unpackbits(self.low, bitorder="little")[: self.n * self.bits].reshape(self.n, self.bits).astype(np.int64)
        return high + (low << np.arange(self.bits)).sum(axis=1)

    def dump(self) -> bytes:
        parts = (self.low.tobytes(), self.high.tobytes(), self.directory.tobytes())
        return struct.pack("<QQIII", self.n, self.universe, *map(len, parts)) + b"".join(parts)

    @classmethod
    def load(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        n, universe, *sizes = struct.unpack_from("<QQIII", data, at)
        at += 28
        parts = []
        for size, kind in zip(sizes, (np.uint8, np.uint8, "<u4")):
            parts.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
            at += size
        return cls(n, universe, *parts), at


def pack_block(rows: list[int], docs: list[bytes], width: int) -> bytes:
    """rows ascending; docs: the ids of each, little-endian, width bytes an id."""
    ends = np.cumsum([len(d) // width for d in docs])
    keys = np.array(rows, np.int64) - rows[0]
    body = b"".join(docs)
    return struct.pack("<4sBIQ", b"TMK1", width, len(rows), int(ends[-1])) + EliasFano.of(ends, int(ends[-1])).dump() + EliasFano.of(keys, int(keys[-1])).dump() + body


class Block:
    """A block read back: row keys relative to the first, and ids by document."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        magic, self.width, self.documents, self.n_ids = struct.unpack_from("<4sBIQ", view, 0)
        if magic != b"TMK1":
            raise ValueError("not a token block")
        self.ends, at = EliasFano.load(view, 17)
        self.keys, at = EliasFano.load(view, at)
        self.ids = np.frombuffer(view, f"<u{self.width}", self.n_ids, at)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


#: Fixed values of the tokenizer's word split, for text of the simple kind below.
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
_SIMPLE = re.compile(r"[!-~À-ÿ]+")


class _Chunks(dict):
    """Ids of pieces of text between blanks, kept while they fit CACHE_CHUNKS.

    The tokenizer drops blanks and never joins across them, so pieces can be encoded on their own; pieces of
    plain Latin letters skip its normaliser (lower case is all it does to them), others take its whole path.
    """

    def __init__(self, path: str, width: int):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer, self.kind, self.words = Tokenizer.from_file(path), f"<u{width}", {}
        self.model = self.tokenizer.model
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.byte_names = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}

    def word(self, w: str) -> bytes:
        got = self.words.get(w)
        if got is None:
            ids = [t.id for t in self.model.tokenize(w.encode().decode("latin-1").translate(self.byte_names))]
            got = self.words[w] = np.array(ids, self.kind).tobytes()
        return got

    def __missing__(self, chunk: str) -> bytes:
        if not chunk:
            got = b""
        elif _SIMPLE.fullmatch(chunk) and "<|" not in chunk:
            got = b"".join(map(self.word, _WORDS.findall(chunk.lower())))
        else:
            got = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, self.kind).tobytes()
        self[chunk] = got
        return got

    def encode(self, text: str) -> bytes:
        out = b"".join(map(self.__getitem__, text.replace("\n", " ").replace("\t", " ").split(" ")))
        if len(self) > CACHE_CHUNKS:
            self.clear()
        if len(self.words) > CACHE_CHUNKS // 2:
            self.words.clear()
        return out


@lru_cache(maxsize=2)
def _chunks(path: str, width: int) -> _Chunks:
    return _Chunks(path, width)


_BLOCKS = "part int, seq int, first long, n_ids long, block binary"


def _write(path, width, end_id):
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("block", pa.binary())])

    def run(batches):
        chunks, end = _chunks(path, width), int(end_id).to_bytes(width, "little")
        part, seq, rows, docs, held = TaskContext.get().partitionId(), 0, [], [], 0

        def flush():
            nonlocal seq, rows, docs, held
            block = pack_block(rows, docs, width)
            out = pa.record_batch([[part], [seq], [rows[0]], [held], [block]], schema=schema)
            seq, rows, docs, held = seq + 1, [], [], 0
            return out

        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text")):
                rows.append(row)
                docs.append(chunks.encode(text.as_py()) + end)
                held += len(docs[-1]) // width
                if held >= BLOCK_IDS:
                    yield flush()
        if rows:
            yield flush()

    return run


def write_tokens(docs: DataFrame, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", width: int = 2) -> tuple[DataFrame, DataFrame]:
    """Write the blocks to the shared folder; returns (blocks as read back, keyed rows)."""
    keyed, plain = row_keyed(docs, id_col, text_col)
    ordered = keyed.select("row", "text").repartitionByRange("row").sortWithinPartitions("row")
    return save(ordered.mapInArrow(_write(path, width, end_id), _BLOCKS), "op5-tokens"), None if plain else keyed.select("row", "id")


def _read(batches):
    schema = pa.schema([("row", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in batches:
        for first, base, data in zip(batch.column("first").to_pylist(), batch.column("base").to_pylist(), batch.column("block")):
            block = Block(data.as_buffer())
            ends = [block.ends.select(i) for i in range(block.documents)]
            keys = [first + block.keys.select(i) for i in range(block.documents)]
            starts = [0, *ends[:-1]]
            crc = [zlib.crc32(block.ids[a:b].astype("<u4")) for a, b in zip(starts, ends)]
            sizes = [b - a for a, b in zip(starts, ends)]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in (keys, [base + a for a in starts], sizes, crc)], schema=schema)


def read_tokens(blocks: DataFrame) -> DataFrame:
    """(row, start, n_tokens, ids_crc32) of every document in the files.

    A block's base is the sum of ids before it: sums by part run in one window, whose rows are as many as tasks wrote (numbers alone),
    and sums inside a part in a window of its own.
    """
    slim = blocks.select("part", "seq", "n_ids")
    parts = slim.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = slim.select("part", "seq", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")).alias("inside"))
    base = inside.join(before, "part").select("part", "seq", (F.col("inside") + F.col("before")).alias("base"))
    return blocks.join(checked_broadcast(base, slim.count()), ["part", "seq"]).select("first", "base", "block").mapInArrow(_read, "row long, start long, n_tokens long, ids_crc32 long")
