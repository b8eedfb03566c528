"""Vectorised rolling hashes over byte buffers (small numpy helpers used inside tasks)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MASK = (1 << 64) - 1


class Poly:
    """Polynomial hash mod 2**64 of any substring of a buffer, from prefix sums.

    Bytes go through a random table first, and sums through a finaliser, so that low bits are usable.
    """

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.byte = rng.integers(1, _MASK, 256, dtype=np.uint64)
        self.base = int(rng.integers(1, _MASK, dtype=np.uint64)) | 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self.pow = self.inv = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.pow) < n:
            n = max(n, 1 << 16)
            for name, b in (("pow", self.base), ("inv", self.inverse)):
                x = np.full(n, b, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums of already mapped uint64 values, one longer than the input."""
        self._powers(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.pow[: len(values)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.inv[start] + (end - start).astype(np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA24BAED4963EE407)
    x ^= x >> np.uint64(32)
    return x


def join_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One byte buffer for many texts, and the boundaries of each in it."""
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    return np.frombuffer(b"".join(texts), np.uint8), bounds


def slices(sizes: list[int], limit: int):
    """Ranges of items whose sizes add up to about limit (one item at least)."""
    start, total = 0, 0
    for i, s in enumerate(sizes):
        if total and total + s > limit:
            yield start, i
            start, total = i, 0
        total += s
    if start < len(sizes):
        yield start, len(sizes)


def text_slices(column: pa.Array, limit: int):
    """(first, end, texts as UTF-8 bytes) of a string column, in slices of about limit bytes; null is empty."""
    raw = column.cast(pa.binary())
    sizes = pc.fill_null(pc.binary_length(raw), 0).to_pylist()
    for a, b in slices(sizes, limit):
        yield a, b, [t or b"" for t in raw.slice(a, b - a).to_pylist()]


def in_slices(batch: pa.RecordBatch, column: str, limit: int):
    """Parts of a batch, each with about limit bytes in a column of texts or id lists (one row at least)."""
    col = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(col) if pa.types.is_string(col.type) else pc.multiply(pc.list_value_length(col), 4), 0)
    for a, b in slices(sizes.to_pylist(), limit):
        yield batch.slice(a, b - a)
