"""Operator 4, removal of long repeated byte strings by sampled suffixes.

Every byte covered by a `length`-byte string that also starts earlier (in a smaller row, or earlier in the
same row) is removed. Matches never cross documents, overlaps count, and strings are judged on the input.

Suffixes are sampled at local minima of a hash (the smallest `gram`-byte hash in each window), so equal
windows sample the same relative position; every window belongs to one sample, and the windows of a sample
form one run. Order among the other suffixes is induced from the samples:

1.  Map side: runs with print (hash of the run's bytes) seen before in the task are repeats at once.
2.  One external sort by (sample hash, run print, row, start), in Spark's spilling sorter: the first run of
    each print stays, later ones are repeats. A sample hash with several prints shares a prefix only in part;
    its first runs go on to step 3.
3.  Those runs carry their bytes and meet by sample hash, where prints of single windows tell all but the first of each.
    A sample with more than HOT_RUNS such runs is dealt out by the windows' own prints instead, reduced in the
    task to the first of each, so that a passage that many documents share does not meet in one task.
4.  Repeats are united to spans per document, and the rest of the text is kept.

Null or empty texts count as empty and keep nothing. Repeated or null ids are ordered null first, ties by
text, and each row is a document of its own. Texts of any length are treated whole, in slices that overlap. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_keyed, save
from .rolling import Poly, join_texts, mix, text_slices

_GRAM, _RUN = Poly(41), Poly(42)
_SLICE = 1_000_000
HOT_RUNS = 200
_LOW = np.uint64((1 << 24) - 1)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, from block-wise prefix and suffix minima."""
    n = len(x)
    pad = -n % w
    y = np.concatenate((x, np.full(pad, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, w)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def runs(texts: list[bytes], length: int, gram: int):
    """Runs of windows that share a sample: (sample hash, run print, text, first window, windows)."""
    raw, bounds = join_texts(texts)
    n = len(raw)
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    if n < length:
        return none
    pre = _GRAM.prefix(_GRAM.byte[raw])
    at = np.arange(n - gram + 1)
    h = _GRAM.spans(pre, at, at + gram)
    best = _sliding_min((h & ~_LOW) | at.astype(np.uint64), length - gram + 1)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    start = np.flatnonzero(owner[: n - length + 1] == owner[length - 1 :])
    if not len(start):
        return none
    sample = (best[start] & _LOW).astype(np.int64)
    cut = np.ones(len(start), bool)
    cut[1:] = (sample[1:] != sample[:-1]) | (owner[start[1:]] != owner[start[:-1]])
    first = np.flatnonzero(cut)
    count = np.diff(np.concatenate((first, [len(start)])))
    s, p = start[first], sample[first]
    pre = _RUN.prefix(_RUN.byte[raw])
    g = mix(_RUN.spans(pre, s, s + count + length - 1) + (p - s).astype(np.uint64))
    return h[p], g, owner[s], s - bounds[:-1][owner[s]], count


def _pieces(batches, length):
    """(rows, texts, offsets): long texts are cut so that pieces hold every window once."""
    for batch in batches:
        rows = batch.column("row").to_numpy(zero_copy_only=False)
        for a, b, texts in text_slices(batch.column("text"), _SLICE):
            if b - a > 1 or len(texts[0]) <= _SLICE:
                yield rows[a:b], texts, np.zeros(b - a, np.int64)
            else:
                for o in range(0, len(texts[0]), _SLICE):
                    yield rows[a:b], [texts[0][o : o + _SLICE + length - 1]], np.array([o])


def _first_of(keys: tuple, rows, starts):
    """Mask of the earliest (row, start) of each key."""
    order = np.lexsort((starts, rows, *keys[::-1]))
    new = np.ones(len(order), bool)
    for k in keys:
        new[1:] &= k[order][1:] == k[order][:-1]
    first = np.zeros(len(order), bool)
    new[1:] = ~new[1:]
    first[order] = new
    return first


def _spans(rows, starts, ends):
    """Unite overlapping or touching spans of the same row."""
    if not len(rows):
        return rows, starts, ends
    order = np.lexsort((starts, rows))
    rows, starts, ends = rows[order], starts[order], ends[order]
    base = np.cumsum(np.concatenate(([0], (rows[1:] != rows[:-1]).astype(np.int64)))) * (int(ends.max()) + 2)
    reach = np.maximum.accumulate(ends + base)
    cut = np.concatenate(([True], (starts + base)[1:] > reach[:-1]))
    first = np.flatnonzero(cut)
    last = np.concatenate((first[1:], [len(rows)])) - 1
    return rows[first], starts[first], (reach - base)[last]


_KEYED = pa.schema([("h", pa.int64()), ("g", pa.int64()), ("row", pa.int64()), ("start", pa.int32()), ("size", pa.int32())])
_KEYED_SQL = "h long, g long, row long, start int, size int"
#: Spans already known to be repeats travel with a negative size and their row as key.


def _emit(h, g, rows, starts, sizes, first, length):
    r, s, e = _spans(rows[~first], starts[~first], starts[~first] + sizes[~first] + length - 1)
    return pa.record_batch(
        [
            pa.array(np.concatenate((h[first].view(np.int64), r))),
            pa.array(np.concatenate((g[first].view(np.int64), s))),
            pa.array(np.concatenate((rows[first], r))),
            pa.array(np.concatenate((starts[first], s)).astype(np.int32)),
            pa.array(np.concatenate((sizes[first], s - e)).astype(np.int32)),
        ],
        schema=_KEYED,
    )


def _reduced(make, length, held_most=300_000):
    """Gather (h, g, row, start, size) of a task up to a bound, then emit first ones and known repeats."""

    def run(batches):
        held, n = [], 0
        for part in make(batches):
            held.append(part)
            n += len(part[0])
            if n >= held_most:
                cols = [np.concatenate(x) for x in zip(*held)]
                yield _emit(*cols, _first_of((cols[0], cols[1]), cols[2], cols[3]), length)
                held, n = [], 0
        if n:
            cols = [np.concatenate(x) for x in zip(*held)]
            yield _emit(*cols, _first_of((cols[0], cols[1]), cols[2], cols[3]), length)

    return run


def _sampled(length, gram):
    def make(batches):
        for rows, texts, offsets in _pieces(batches, length):
            h, g, owner, start, count = runs(texts, length, gram)
            yield h, g, rows[owner], start + offsets[owner], count

    return make


def _asked(batches, name):
    """(row, text, hashes, starts, windows) for the list of runs in a column."""
    for batch in batches:
        rows = batch.column("row").to_pylist()
        for i in range(batch.num_rows):
            asked = batch.column(name)[i].values
            if len(asked):
                text = np.frombuffer(batch.column("text")[i].as_py().encode("utf-8", "surrogatepass"), np.uint8)
                yield rows[i], text, *(asked.field(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2))


def _window_prints(text: np.ndarray, s: np.ndarray, c: np.ndarray, length: int):
    """Starts and prints of the single windows of runs (start, windows)."""
    start = np.repeat(s.astype(np.int64), c) + np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
    pre = _RUN.prefix(_RUN.byte[text])
    return start, _RUN.spans(pre, start, start + length)


def _windows(length):
    """Single windows of the asked runs."""

    def make(batches):
        for row, text, h, s, c in _asked(batches, "many"):
            lo = int(s.min())
            start, g = _window_prints(text[lo : int((s + c).max()) + length - 1], s - lo, c, length)
            yield np.repeat(h, c).view(np.uint64), g, np.full(len(start), row, np.int64), start + lo, np.ones(len(start), np.int64)

    return make


_ASKED_SQL = "h long, g long, row long, start int, size int, bytes binary"


def _both(length):
    """Asked runs with their bytes (column few), and reduced single windows without (column many)."""
    schema = pa.schema([*_KEYED, ("bytes", pa.binary())])

    def run(batches):
        def passed():  # hands each batch on to the windows after its runs were taken
            for batch in batches:
                cols: list[list] = [[] for _ in range(5)]
                for row, text, h, s, c in _asked([batch], "few"):
                    parts = [text[a : a + n + length - 1].tobytes() for a, n in zip(s.tolist(), c.tolist())]
                    for col, x in zip(cols, (h, np.full(len(h), row, np.int64), s, c)):
                        col.append(x)
                    cols[4] += parts
                if cols[0]:
                    h, row, s, c = map(np.concatenate, cols[:4])
                    held.append(pa.record_batch([pa.array(h), pa.array(np.zeros(len(h), np.int64)), pa.array(row), pa.array(s), pa.array(c), pa.array(cols[4], pa.binary())], schema=schema))
                yield batch

        held: list = []
        for done in _reduced(_windows(length), length)(passed()):
            yield pa.record_batch([*done.columns, pa.nulls(done.num_rows, pa.binary())], schema=schema)
            yield from held
            held.clear()
        yield from held

    return run


def _compare(length):
    """Over asked runs sorted by (h, row, start): spans of windows met before under the same hash."""

    def spans(h, row, start, size, parts):
        raw, bounds = join_texts(parts)
        at, g = _window_prints(raw, bounds[:-1], size, length)
        shift = np.repeat(start - bounds[:-1], size)
        h, row, at = np.repeat(h, size), np.repeat(row, size), at + shift
        repeat = ~_first_of((h, g), row, at)
        r, s, e = _spans(row[repeat], at[repeat], at[repeat] + length)
        return pa.record_batch([pa.array(x.astype(t)) for x, t in zip((np.zeros(len(r)), r, r, s, e - s), (np.int32, np.int64, np.int64, np.int32, np.int32))], schema=_FOUND)

    def run(batches):
        held: list = []
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in ("h", "row", "start", "size")] + [np.array(batch.column("bytes").to_pylist() + [None], object)[:-1]]
            if held:
                cols = [np.concatenate((a, b)) for a, b in zip(held, cols)]
            # Slices of whole groups; the last group may go on in the next batch.
            cuts = np.flatnonzero(np.diff(cols[0])) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            done = 0
            for cut in [*cuts[20_000::20_000].tolist(), last]:
                cut = min(cut, last)
                if cut > done:
                    yield spans(*(c[done:cut] for c in cols[:4]), list(cols[4][done:cut]))
                    done = cut
            held = [c[last:] for c in cols]
        if held and len(held[0]):
            yield spans(*held[:4], list(held[4]))

    return run


_FOUND = pa.schema([("kind", pa.int32()), ("h", pa.int64()), ("row", pa.int64()), ("start", pa.int32()), ("size", pa.int32())])
_FOUND_SQL = "kind int, h long, row long, start int, size int"


def _repeats(length, ask):
    """Over rows sorted by (h, g, row, start): kind 0 are spans of repeats (size in bytes); with ask, kind 1 are the
    first runs of samples that have several prints (size in windows)."""

    def run(batches):
        last, held, many = None, None, 0  # last (h, g); first run of the last h while alone; prints of the last h
        for batch in batches:
            h, g, row, start, size = (batch.column(c).to_numpy() for c in ("h", "g", "row", "start", "size"))
            known = size < 0
            out = [(np.zeros(int(known.sum()), np.int32), h[known], row[known], start[known], -size[known])]
            h, g, row, start, size = (x[~known] for x in (h, g, row, start, size))
            if len(h):
                goes_on = last is not None and last[0] == h[0]
                new_h = np.concatenate(([not goes_on], h[1:] != h[:-1]))
                new_g = new_h | np.concatenate(([not goes_on or last[1] != g[0]], g[1:] != g[:-1]))
                last = (h[-1], g[-1])
                r, s = row[~new_g], start[~new_g].astype(np.int64)
                r, s, e = _spans(r, s, s + size[~new_g] + length - 1)
                out.append((np.zeros(len(r), np.int32), r, r, s, e - s))
                if ask:
                    group = np.cumsum(new_h) - int(new_h[0])
                    prints = np.bincount(group, weights=new_g).astype(np.int64)
                    prints[0] += many * goes_on
                    if goes_on and held is not None and prints[0] > 1:
                        out.append(held)
                        held = None
                    pick = new_g & (prints[group] > 1)
                    out.append((np.ones(int(pick.sum()), np.int32), h[pick], row[pick], start[pick], size[pick]))
                    if not goes_on or group[-1] > 0:
                        k = np.flatnonzero(new_g)[-1:]
                        held = (np.ones(1, np.int32), h[k], row[k], start[k], size[k]) if prints[-1] == 1 else None
                    many = int(prints[-1])
            cols = [np.concatenate([np.asarray(o[k]) for o in out]) for k in range(5)]
            yield pa.record_batch([pa.array(c.astype(t)) for c, t in zip(cols, (np.int32, np.int64, np.int64, np.int32, np.int32))], schema=_FOUND)

    return run


def _kept(batches):
    schema = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.string()), ("kept_sha256", pa.string())])
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            text = batch.column("text")[i].as_py().encode("utf-8", "surrogatepass")
            spans = batch.column("spans")[i].values if batch.column("spans")[i].is_valid else None
            pieces, at, removed, count = [], 0, 0, 0
            if spans is not None and len(spans):
                s, e = (spans.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
                _, s, e = _spans(np.zeros(len(s), np.int64), s, e)
                removed, count = int((e - s).sum()), len(s)
                for a, b in zip(s.tolist(), e.tolist()):
                    pieces.append(text[at:a])
                    at = b
            pieces.append(text[at:])
            kept = b"".join(pieces)
            out.append((batch.column("row")[i].as_py(), batch.column("id")[i].as_py(), len(text), removed, count, kept.decode("utf-8", "replace"), hashlib.sha256(kept).hexdigest()))
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), schema.types)] if out else [pa.array([], t) for t in schema.types], schema=schema)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, gram: int = 32) -> DataFrame:
    """(row, id, n_bytes, n_removed, n_spans, kept, kept_sha256); kept is the rest of the text (broken UTF-8 replaced)."""
    keyed, _ = row_keyed(docs, id_col, text_col)
    slim = keyed.select("row", "text")
    samples = slim.mapInArrow(_reduced(_sampled(length, gram), length), _KEYED_SQL)

    def in_order(df: DataFrame) -> DataFrame:
        return df.repartition(F.col("h")).sortWithinPartitions("h", "g", "row", "start")

    found = save(in_order(samples).mapInArrow(_repeats(length, True), _FOUND_SQL), "op4-found", True)
    runs_asked = found.where("kind = 1")
    hot = runs_asked.groupBy("h").count().where(F.col("count") > HOT_RUNS).select("h", F.lit(True).alias("hot"))
    runs_asked = runs_asked.join(hot, "h", "left").select("h", "row", "start", "size", F.coalesce("hot", F.lit(False)).alias("hot"))
    per_row = runs_asked.groupBy("row").agg(*(F.collect_list(F.when(F.col("hot") == k, F.struct("h", "start", "size"))).alias(name) for k, name in ((False, "few"), (True, "many"))))
    asked = save(slim.join(per_row, "row").mapInArrow(_both(length), _ASKED_SQL), "op4-asked", True)
    few = asked.where("bytes is not null").select("h", "row", "start", "size", "bytes").repartition(F.col("h")).sortWithinPartitions("h", "row", "start")
    # A window's own print deals it out, so that a common sample does not meet in one task.
    many = asked.where("bytes is null").select(F.when(F.col("size") > 0, F.xxhash64("h", "g")).otherwise(F.col("h")).alias("h"), "g", "row", "start", "size")
    more = save(few.mapInArrow(_compare(length), _FOUND_SQL).union(in_order(many).mapInArrow(_repeats(length, False), _FOUND_SQL)), "op4-windows", True)
    spans = found.where("kind = 0").union(more).groupBy("row").agg(F.collect_list(F.struct("start", (F.col("start") + F.col("size")).alias("end"))).alias("spans"))
    return keyed.join(spans, "row", "left").mapInArrow(_kept, "row long, id long, n_bytes long, n_removed long, n_spans long, kept string, kept_sha256 string")
