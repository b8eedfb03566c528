"""Operator 11, phrase collocation mining by contiguous pattern growth over projected occurrences.

Words are runs of other characters than blanks and tabs inside a piece; pieces end at . , ; : ! ? and line ends. A-Z are lower-cased, and
everything is counted by language (null: `und`). Words travel as 64-bit prints; their spelling is joined to the report only.

1.  One pass over all texts counts words and pairs of neighbours, summed in each task before the shuffle. Pairs seen min_count times are
    frequent prefixes; a bitmap of their prints (16 bits a pair, MAX_BITS at most) goes to all tasks. A false bit costs a row, never a count.
2.  A second pass projects the occurrences of the frequent prefixes: the prefix and the words after it as far as every pair of
    neighbours may be frequent, `longest` words at most. Equal projections of a task, then of all tasks, become one row with a count.
3.  Each prefix of two words is one unit of work, dealt by its print: a task sorts the projections of its prefixes and extends each prefix
    to the right, depth first, as long as the extension stays frequent. A task holds one prefix of three words at a time; what a
    prefix of two words has over several of them is added up afterwards.
4.  Candidates are cut in two at every word, and the counts of both parts are joined to them; longer phrases tell their parts how often
    they occur, and a candidate that one of them covers goes. The first `top` of every language are chosen in salted parts, then over them.

Null texts are empty and texts of any length are counted whole; repeated rows count as often as they occur; ids are not read; an empty
table gives an empty report. Ties of score and count go to the smaller phrase in byte order. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, save
from .rolling import Poly, mix, text_slices

MAX_BITS = 1 << 29  # of the bitmap of frequent pairs, 64 MB
HELD_ROWS = 800_000  # counts or projections that a task holds before it passes them on
_SLICE = 1_500_000
_SALTS = 64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)  # 0 word, 1 blank, 2 end of a piece
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_STEP = np.uint64(0x9E3779B97F4A7C15)  # an odd factor that keeps the order of words in a print
_TOTAL, _WORD, _PAIR = 0, 1, 2
_COUNTED = "kind int, lang string, print long, word string, n long"


class _Words:
    """Words of some texts: prints, places and whether the next word follows in the same piece."""

    def __init__(self, texts: list[bytes], poly: Poly):
        raw = b"\n".join(texts)
        self.buf = _LOWER[np.frombuffer(raw, np.uint8)]
        kind = _KIND[self.buf]
        edge = np.diff(np.concatenate(([False], kind == 0, [False])).astype(np.int8))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        piece = np.searchsorted(np.flatnonzero(kind == 2), self.start)
        bounds = np.cumsum([len(t) + 1 for t in texts])
        self.text = np.searchsorted(bounds, self.start, "right")
        self.print = poly.spans(poly.prefix(poly.byte[self.buf]), self.start, self.end)
        self.print[self.print == 0] = 1  # 0 stands for no word
        self.follows = np.zeros(len(piece), bool)
        self.follows[:-1] = piece[1:] == piece[:-1]

    def pairs(self, salt: np.ndarray) -> np.ndarray:
        """Print of every word with the next one in its language (salt, by word)."""
        after = np.append(self.print[1:], np.uint64(0))
        return mix(self.print * _STEP + after + mix(salt))

    def spelling(self, at: np.ndarray) -> list[str]:
        data = self.buf.tobytes()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(self.start[at].tolist(), self.end[at].tolist(), strict=True)]


def _tongue(langs: list[str], poly: Poly) -> np.ndarray:
    """A print of each language name."""
    raw = [x.encode() for x in langs]
    at = np.cumsum([0, *map(len, raw)])
    return poly.spans(poly.prefix(poly.byte[np.frombuffer(b"".join(raw), np.uint8)]), at[:-1], at[1:])


def _slices(batches, poly: Poly):
    """(words, language by word, names of languages, their prints) of slices of the batches."""
    for batch in batches:
        for a, b, texts in text_slices(batch.column("text"), _SLICE):
            langs = batch.column("lang").slice(a, b - a).to_pylist()
            names = sorted(set(langs))
            words = _Words(texts, poly)
            place = {x: i for i, x in enumerate(names)}
            yield words, np.array([place[x] for x in langs])[words.text], names, _tongue(names, poly)


def _sums(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(first place of each different key, sum of its counts)."""
    order = np.argsort(keys, kind="stable")
    starts = np.flatnonzero(np.append(True, np.diff(keys[order]) != 0)) if len(keys) else np.zeros(0, int)
    total = np.diff(np.append(starts, len(keys))) if n is None else np.add.reduceat(n[order], starts) if len(keys) else n
    return order[starts], total


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals, words and pairs of a task."""
    poly, totals, held, many = Poly(11), {}, [], 0

    def pairs():
        keys, langs, n = (np.concatenate(x) for x in zip(*held, strict=True))
        at, total = _sums(keys, n)
        held.clear()
        return pa.record_batch([pa.array(np.full(len(at), _PAIR, np.int32)), pa.array(langs[at], pa.string()), pa.array(keys[at].view(np.int64)), pa.nulls(len(at), pa.string()), pa.array(total)], names=["kind", "lang", "print", "word", "n"])

    for words, lang, names, salt in _slices(batches, poly):
        for i, x in enumerate(np.bincount(lang, minlength=len(names)).tolist()):
            totals[names[i]] = totals.get(names[i], 0) + x
        at, n = _sums(words.print + mix(salt)[lang])
        name = np.array(names, object)
        yield pa.record_batch([pa.array(np.full(len(at), _WORD, np.int32)), pa.array(name[lang[at]], pa.string()), pa.array(words.print[at].view(np.int64)), pa.array(words.spelling(at), pa.string()), pa.array(n)], names=["kind", "lang", "print", "word", "n"])
        inside = np.flatnonzero(words.follows)
        keys = words.pairs(salt[lang])[inside]
        at, n = _sums(keys)
        held.append((keys[at], name[lang[inside[at]]], n))
        many += len(at)
        if many > HELD_ROWS:
            yield pairs()
            many = 0
    if held:
        yield pairs()
    if totals:
        yield pa.record_batch([pa.array([_TOTAL] * len(totals), pa.int32()), pa.array(list(totals), pa.string()), pa.array([0] * len(totals), pa.int64()), pa.nulls(len(totals), pa.string()), pa.array(list(totals.values()), pa.int64())], names=["kind", "lang", "print", "word", "n"])


def _bitmap(pairs: DataFrame, n: int) -> np.ndarray:
    """Bits of the frequent pairs' prints: 16 bits a pair, MAX_BITS at most, gathered as longs of 64 bits."""
    bits = min(max(1 << (max(n, 1) * 16 - 1).bit_length(), 1 << 16), MAX_BITS)
    at = F.expr(f"print & {bits - 1}L")
    longs = pairs.select(F.shiftright(at, 6).alias("at"), F.expr(f"shiftleft(1L, cast((print & {bits - 1}L) & 63 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[longs.column("at").to_numpy()] = longs.column("bits").to_numpy()
    return out.view(np.uint64)


def _projector(shared, longest: int):
    """Task function: projected occurrences of the frequent prefixes, equal ones summed."""
    cols = [f"w{k}" for k in range(1, longest + 1)]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        poly, bits, held, many = Poly(11), shared.value, [], 0
        mask = np.uint64(len(bits) * 64 - 1)

        def summed():
            keys, langs, ws, n = (np.concatenate(x) for x in zip(*held, strict=True))
            at, total = _sums(keys, n)
            held.clear()
            return pa.record_batch([pa.array(langs[at], pa.string()), *(pa.array(ws[at, k].view(np.int64)) for k in range(longest)), pa.array(total)], names=["lang", *cols, "n"])

        for words, lang, names, salt in _slices(batches, poly):
            print_ = words.pairs(salt[lang])
            slot = print_ & mask
            opens = words.follows & ((bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)
            at = np.flatnonzero(opens)
            ws = np.zeros((len(at), longest), np.uint64)
            ws[:, 0], go = words.print[at], np.ones(len(at), bool)
            key = mix(words.print[at] + mix(salt)[lang[at]])
            for k in range(1, longest):
                go &= opens[np.minimum(at + k - 1, len(opens) - 1)]
                ws[go, k] = words.print[at[go] + k]
                key = mix(key * _STEP + ws[:, k])
            first, n = _sums(key)
            held.append((key[first], np.array(names, object)[lang[at[first]]], ws[first], n))
            many += len(first)
            if many > HELD_ROWS // 2:
                yield summed()
                many = 0
        if held:
            yield summed()

    return project


def _grower(min_count: int, longest: int):
    """Task function over projections sorted by language and words: the frequent prefixes, extended to the right depth first."""
    cols = [f"w{k}" for k in range(1, longest + 1)]

    def grow_chunk(t: pa.Table) -> pa.RecordBatch:
        lang, n = t.column("lang").combine_chunks(), t.column("n").to_numpy()
        codes = lang.dictionary_encode() if not pa.types.is_dictionary(lang.type) else lang
        ws = [t.column(c).to_numpy() for c in cols]
        seen = np.concatenate(([0], np.cumsum(n)))
        new = np.append(True, np.diff(codes.indices.to_numpy()) != 0)
        starts = []
        for w in ws:  # runs of equal prefixes by depth
            new |= np.append(True, np.diff(w) != 0)
            starts.append(np.append(np.flatnonzero(new), len(n)))
        found: list[tuple[int, int, int]] = []  # (first projection, words, count) of each frequent prefix

        def grow(depth: int, lo: int, hi: int) -> None:
            runs = starts[depth][slice(*np.searchsorted(starts[depth], (lo, hi)))]
            ends = np.append(runs[1:], hi)
            total = seen[ends] - seen[runs]
            # Of a prefix of two words other chunks may hold more, so it is told whatever its count.
            for i in np.flatnonzero((ws[depth][runs] != 0) & ((total >= min_count) | (depth == 1))).tolist():
                found.append((runs[i], depth + 1, total[i]))
                if depth + 1 < longest and total[i] >= min_count:
                    grow(depth + 1, runs[i], ends[i])

        for lo, hi in zip(starts[0][:-1].tolist(), starts[0][1:].tolist(), strict=True):
            grow(1, lo, hi)
        at, size, count = np.array(found, np.int64).reshape(-1, 3).T
        return pa.record_batch([codes.take(pa.array(at)).cast(pa.string()), *(pa.array(np.where(size > k, ws[k][at], 0)) for k in range(longest)), pa.array(size.astype(np.int32)), pa.array(count)], names=["lang", *cols, "words", "a"])

    def grow_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, rows = [], 0
        for batch in batches:
            rest.append(batch)
            rows += batch.num_rows
            if rows < HELD_ROWS // 2:
                continue
            t = pa.Table.from_batches(rest)
            last = np.flatnonzero(np.logical_or.reduce([t.column(c).to_numpy()[1:] != t.column(c).to_numpy()[:-1] for c in cols[:3]]))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last prefix of three words may go on
            if cut:
                yield grow_chunk(t.slice(0, cut))
            rest = t.slice(cut).to_batches()
            rows = t.num_rows - cut
        if rows:
            yield grow_chunk(pa.Table.from_batches(rest))

    return grow_all


def frequent_phrases(docs: DataFrame, min_count: int = 30, longest: int = 4, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases (lang, w1..., words, a) of one word and more, spelling (lang, print, word), totals (lang, n))."""
    if longest < 3:
        raise ValueError("phrases grow to three words at least")
    texts = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    counted = texts.mapInArrow(_count, _COUNTED).groupBy("kind", "lang", "print", "word").agg(F.sum("n").alias("n"))
    counted = save(counted.where((F.col("n") >= min_count) | (F.col("kind") == _TOTAL)), "op11-counts")
    words, pairs = counted.where(F.col("kind") == _WORD), counted.where(F.col("kind") == _PAIR)
    cols = [f"w{k}" for k in range(1, longest + 1)]
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(pairs, pairs.count()))
    schema = "lang string, " + ", ".join(f"{c} long" for c in cols)
    projected = texts.mapInArrow(_projector(shared, longest), f"{schema}, n long").groupBy("lang", *cols).agg(F.sum("n").alias("n"))
    tasks = projected.repartition("lang", "w1", "w2").sortWithinPartitions("lang", *cols)
    grown = tasks.mapInArrow(_grower(min_count, longest), f"{schema}, words int, a long")
    grown = grown.groupBy("lang", *cols, "words").agg(F.sum("a").alias("a")).where(F.col("a") >= min_count)
    alone = words.groupBy("lang", "print").agg(F.sum("n").alias("a")).select("lang", F.col("print").alias("w1"), *(F.lit(0).cast("long").alias(c) for c in cols[1:]), F.lit(1).alias("words"), "a")
    phrases = save(alone.unionByName(grown), "op11-phrases")
    return phrases, words.select("lang", "print", "word"), counted.where(F.col("kind") == _TOTAL).groupBy("lang").agg(F.sum("n").alias("n"))


def collocations(docs: DataFrame, min_count: int = 30, longest: int = 4, covered_percent: int = 80, top: int = 2000, **columns) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of every language."""
    phrases, spelling, totals = frequent_phrases(docs, min_count, longest, **columns)
    cols = [f"w{k}" for k in range(1, longest + 1)]
    none = F.lit(0).cast("long")

    def part(first: int, words: int) -> F.Column:
        """The words of a phrase from one on, as a struct of all word columns."""
        return F.struct(*((F.col(cols[first + k]) if k < words and first + k < longest else none).alias(c) for k, c in enumerate(cols)))

    def parts(size: int) -> F.Column:
        return F.array(*(F.struct(F.lit(k).alias("cut"), part(0, k).alias("left"), part(k, size - k).alias("right")) for k in range(1, size)))

    key = ["lang", *cols]
    counts = phrases.select("lang", F.struct(*cols).alias("part"), F.col("a").alias("f"))
    found = phrases.where("words > 1").withColumn("phrase", F.struct(*cols))
    by_size = F.coalesce(*(F.when(F.col("words") == s, parts(s)) for s in range(2, longest + 1)))
    cuts = found.select("lang", "phrase", "a", F.explode(by_size).alias("c")).select("lang", "phrase", "a", "c.*")
    cuts = cuts.join(counts.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(counts.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731  exact beyond 64 bits
    cuts = cuts.withColumn("score", F.expr("cast(cast(a as decimal(19,0)) * 2000000 div (cast(l as decimal(19,0)) + cast(r as decimal(19,0))) as bigint)"))
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("low")).select("lang", "phrase", "a", "low.score", "low.l", "low.r")

    inside = lambda size: F.array(*(part(first, n) for n in range(2, size) for first in range(size - n + 1)))
    longer = found.where("words > 2").select("lang", "a", F.explode(F.coalesce(*(F.when(F.col("words") == s, inside(s)) for s in range(3, longest + 1)))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * covered_percent))

    best = [F.desc("score"), F.desc("a")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)).alias("salt")
    some = kept.select("lang", "phrase.*", "a", "l", "r", "score", salt).withColumn("place", F.rank().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("place") <= top)
    for c in cols:
        some = some.join(spelling.select("lang", F.col("print").alias(c), F.col("word").alias(f"said_{c}")), ["lang", c], "left")
    said = some.select("lang", "salt", F.concat_ws(" ", *(f"said_{c}" for c in cols)).alias("phrase"), "a", "l", "r", "score")
    order = [*best, F.asc("phrase")]
    said = said.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= top)
    ranked = said.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    n_langs = totals.count()
    return ranked.join(checked_broadcast(totals, n_langs), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
