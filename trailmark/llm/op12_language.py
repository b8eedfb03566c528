"""Operator 12, language identification by interpolated Kneser-Ney character models, one per language.

A text is lower-cased, and its words are runs of letters; a word is read as its characters between two blanks, and characters are predicted
from at most order - 1 characters before them inside the word. So a text's entropy is a sum over its words, and a word is scored once per task.

Fitting covers all labelled texts. Words are counted in each task, cut into grams there, and summed by Spark: counts of full grams (and of those
that begin a word, which have no longer history), and from their kinds the continuation counts of shorter ones. Discounts come from the
counts of counts, n1 / (n1 + 2 n2) for every language and order. A history's weight of the next lower order is what its grams leave of 1, so every
distribution sums to 1. No gram is dropped. Up to MAX_GRAMS the model goes to all tasks as a sorted array of 64-bit gram prints for every language,
beside it the grams' shares and weights. A larger one stays a table: what a character costs in each language is found by joins, once for every different
gram of the texts, and only the costs of the most frequent ones, as many as fill the same memory, go to all tasks; the others of a text are joined and summed by Spark.

The prediction is the language of the lowest cross-entropy per character; equal ones go to the smaller name. A fifth of the labelled texts is
not counted but held for calibration: how often predictions are right by their lead over the second language (per text, in fixed bins, pooled
until it rises with the lead) is the score, and predictions under `reject` or whose entropy is above the `odd` quantile of
their own language are marked rejected.

Texts that are null or without letters are `und` with score 0. Empty texts likewise; texts of any length are read whole; repeated rows and null
ids are rows of their own; equal entropies go to the smaller language name. Without a labelled text there is no language to learn and all texts are `und`.
Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save
from .rolling import Poly, mix, slices

ORDER = 5
MAX_GRAMS = 1_000_000  # over all languages and orders, 24 bytes each; larger models are joined, not sent
HELD_WORDS = 300_000  # entropies that a task remembers
_SLICE = 1_500_000
_BINS = 400
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BLANK = " "
UNIT = 2.0**-32  # of costs that Spark sums: whole numbers, so equal texts cost the same in whatever order
UNIFORM = 2.0**-17  # what the lowest order leaves to a character that no text has


def folds(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; null counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5


def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class _Texts:
    """Words of some texts as numbers of different words."""

    def __init__(self, texts: list[str], letter: np.ndarray, poly: Poly):
        lowered = [t.lower() for t in texts]
        codes = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
        edge = np.diff(np.concatenate(([False], letter[codes], [False])).astype(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.text = np.searchsorted(np.cumsum([len(t) + 1 for t in lowered]), start, "right")
        prints = poly.spans(poly.prefix(mix(codes.astype(np.uint64) + np.uint64(1))), start, end)
        self.prints, first, self.word = np.unique(prints, return_index=True, return_inverse=True)
        self.codes, self.start, self.size = codes, start[first], (end - start)[first]

    def spelled(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters of some words, each between two blanks, and where each begins."""
        size = self.size[of] + 2
        at = np.cumsum(size) - size
        out = np.full(int(size.sum()), ord(_BLANK), np.uint32)
        inner = np.arange(len(out)) - np.repeat(at, size)
        inside = (inner > 0) & (inner < np.repeat(size, size) - 1)
        out[inside] = self.codes[(np.repeat(self.start[of], size) + inner - 1)[inside]]
        return out, at


def _slices(batches: Iterator[pa.RecordBatch], letter: np.ndarray, poly: Poly):
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        for lo, hi in slices(list(map(len, texts)), _SLICE):
            yield batch.slice(lo, hi - lo), _Texts(texts[lo:hi], letter, poly)


def _gram_prints(codes: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of each character in its word, prints [order, characters] of the grams of 1.. characters that end there; 0 beyond the word's start)."""
    inner = np.arange(len(codes)) - np.repeat(at, np.diff(np.append(at, len(codes))))
    out = np.zeros((order, len(codes)), np.uint64)
    own = mix(codes.astype(np.uint64) + np.uint64(1))
    key = np.zeros(len(codes), np.uint64)
    for n in range(1, min(order, len(codes)) + 1):  # a gram's print from its characters, last to first
        key[n - 1 :] = mix(key[n - 1 :] * _STEP + own[: len(own) - n + 1])
        out[n - 1] = np.where(inner >= n - 1, key, 0)
    return inner, out


def _count(order: int):
    """Task function: (lang, gram, first, n) of the longest grams that end at each character of the words; first: it begins the word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter, poly, held = _letters(), Poly(12), {}
        for batch, t in _slices(batches, letter, poly):
            names, lang = np.unique(np.array(batch.column("lang").to_pylist(), object).astype(str), return_inverse=True)
            key, n = np.unique(lang[t.text] * len(t.prints) + t.word, return_counts=True)
            of_lang, word = np.divmod(key, max(len(t.prints), 1))
            for i, name in enumerate(names.tolist()):
                mine = of_lang == i
                codes, at = t.spelled(word[mine])
                inner, prints = _gram_prints(codes, at, order)
                times = np.repeat(n[mine], np.diff(np.append(at, len(codes))))
                size = np.minimum(inner + 1, order)
                keep = inner > 0
                longest = prints[size[keep] - 1, np.flatnonzero(keep)]
                got, first, which = np.unique(longest, return_index=True, return_inverse=True)
                total = np.bincount(which, times[keep]).astype(np.int64)
                end = np.flatnonzero(keep)[first]
                text = codes.tobytes()
                size = size[end]
                mine_held = held.setdefault(name, {})
                for p, k, a, b in zip(got.tolist(), total.tolist(), ((end - size + 1) * 4).tolist(), ((end + 1) * 4).tolist(), strict=True):
                    if p in mine_held:
                        mine_held[p][1] += k
                    else:
                        mine_held[p] = [text[a:b], k]
                if sum(map(len, held.values())) > HELD_WORDS:
                    yield from told(held)
                    held = {}
        yield from told(held)

    def told(held):
        for name, grams in held.items():
            if grams:
                said = [g.decode("utf-32-le", "replace") for g, _ in grams.values()]
                yield pa.record_batch([pa.array([name] * len(said)), pa.array(said), pa.array([k for _, k in grams.values()], pa.int64())], names=["lang", "gram", "n"])

    return count


def gram_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n) of the longest grams that end at the characters of (lang, text)."""
    return save(texts.mapInArrow(_count(order), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "op12-grams")


def gram_model(texts: DataFrame, order: int = ORDER, max_grams: int | None = None) -> DataFrame:
    """(lang, gram, p, weight) of interpolated Kneser-Ney models of (lang, text).

    p is a gram's discounted share after its history, weight what the gram, as a history, leaves to the next lower order.
    max_grams: for a smaller model, only so many of the most frequent grams; all without it.
    """
    return model_of_counts(gram_counts(texts, order), order, max_grams)


def model_of_counts(counted: DataFrame, order: int = ORDER, max_grams: int | None = None) -> DataFrame:
    size = F.length("gram")
    # Counts of order k: of full grams, and of those that begin a word, as often as they occur; of others, how many kinds of characters precede them.
    levels = [counted.select("lang", "gram", "n", size.alias("k"))]
    longer = counted.where(size == order).select("lang", "gram")
    for k in range(order - 1, 0, -1):
        shorter = longer.select("lang", F.substring("gram", 2, k).alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("n"))
        levels.append(shorter.withColumn("k", F.lit(k)))
        longer = counted.where(size == k).select("lang", "gram").unionByName(shorter.select("lang", "gram"))
    grams = levels[0]
    for level in levels[1:]:
        grams = grams.unionByName(level)
    grams = save(grams, "op12-counts")
    ones = grams.groupBy("lang", "k").agg(F.sum((F.col("n") == 1).cast("long")).alias("n1"), F.sum((F.col("n") == 2).cast("long")).alias("n2"), F.count("*").alias("kinds"))
    ones = ones.withColumn("discount", F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(F.lit(0.5)))
    history = F.expr("substring(gram, 1, k - 1)")
    grams = grams.withColumn("history", history)
    totals = grams.groupBy("lang", "k", "history").agg(F.sum("n").alias("total"))
    if max_grams is not None:  # the languages share the places alike; in each, the most frequent grams stay
        langs = max(ones.select("lang").distinct().count(), 1)
        salted = Window.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(64))).orderBy(F.desc("n"), "gram")
        grams = grams.withColumn("place", F.row_number().over(salted)).where(F.col("place") <= max(max_grams // langs // 64, 1)).drop("place")
    grams = grams.join(totals, ["lang", "k", "history"]).join(ones.select("lang", "k", "discount"), ["lang", "k"])
    shares = save(grams.select("lang", "gram", "history", "k", (F.greatest(F.col("n") - F.col("discount"), F.lit(0.0)) / F.col("total")).alias("p")), "op12-shares")
    left = shares.groupBy("lang", F.col("history").alias("gram")).agg((1 - F.sum("p")).alias("weight"))
    return shares.select("lang", "gram", "p").join(left, ["lang", "gram"], "full").select("lang", "gram", F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("weight", F.lit(1.0)).alias("weight"))


def _prints(grams: list[str], order: int) -> np.ndarray:
    """Prints of grams of `order` characters at most, as _gram_prints gives them."""
    size = np.array([len(g) for g in grams], np.int64)
    end = np.cumsum(size)
    own = mix(np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1))
    prints = np.zeros(len(grams), np.uint64)
    for n in range(1, order + 1):
        has = size >= n
        prints[has] = mix(prints[has] * _STEP + own[end[has] - n])
    return prints


class Models:
    """Sorted hash arrays of every language's grams."""

    def __init__(self, rows: pa.Table, order: int):
        langs, grams = np.array(rows.column("lang").to_pylist(), object), rows.column("gram").to_pylist()
        p, weight = rows.column("p").to_numpy(), rows.column("weight").to_numpy()
        self.order, self.langs = order, sorted(set(langs.tolist()))
        size, prints = np.array([len(g) for g in grams], np.int64), _prints(grams, order)
        self.start, self.keys, self.p, self.weight = [], [], [], []
        for name in self.langs:
            mine = np.flatnonzero(langs == name)
            self.start.append(next((weight[i] for i in mine.tolist() if not grams[i]), 1.0))
            mine = mine[size[mine] > 0]
            mine = mine[np.argsort(prints[mine])]
            self.keys.append(prints[mine])
            self.p.append(p[mine])
            self.weight.append(weight[mine])

    def entropies(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Negative log likelihood [languages, words] of the characters after each word's first blank."""
        inner, prints = _gram_prints(codes, at, self.order)
        known, which = np.unique(prints, return_inverse=True)
        which = which.reshape(prints.shape)
        out = np.zeros((len(self.langs), len(at)))
        for i, (keys, p, weight) in enumerate(zip(self.keys, self.p, self.weight, strict=True)):
            place = np.minimum(np.searchsorted(keys, known), max(len(keys) - 1, 0))
            found = (keys[place] == known) if len(keys) else np.zeros(len(known), bool)
            share = np.where(found, p[place], 0.0) if len(keys) else np.zeros(len(known))
            left = np.where(found, weight[place], 1.0) if len(keys) else np.ones(len(known))
            said = share[which[0]] + self.start[i] * UNIFORM
            for k in range(1, self.order):  # a gram of k + 1 characters, its history of k that ends one before
                more = share[which[k][1:]] + left[which[k - 1][:-1]] * said[1:]
                said[1:] = np.where(inner[1:] >= k, more, said[1:])
            cost = -np.log(said)
            cost[at] = 0.0  # the first blank is given
            out[i] = np.add.reduceat(cost, at)
        return out


def _scorer(shared):
    """Task function: predicted language, entropies per character of it and of the second, and characters of every text."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, letter, poly = shared.value, _letters(), Poly(12)
        known, costs = np.zeros(0, np.uint64), np.zeros((len(models.langs), 0))
        for batch, t in _slices(batches, letter, poly):
            new = np.flatnonzero(~np.isin(t.prints, known, assume_unique=True))
            if len(known) + len(new) > HELD_WORDS:
                known, costs, new = known[:0], costs[:, :0], np.arange(len(t.prints))
            if len(new):
                order = np.argsort(all_ := np.concatenate((known, t.prints[new])))
                known, costs = all_[order], np.concatenate((costs, models.entropies(*t.spelled(new))), axis=1)[:, order]
            mine = costs[:, np.searchsorted(known, t.prints)]
            n = np.bincount(t.text, t.size[t.word] + 1, batch.num_rows)
            each = np.array([np.bincount(t.text, c[t.word], batch.num_rows) for c in mine]) / np.maximum(n, 1)
            order = np.argsort(each, axis=0, kind="stable")
            first = np.take_along_axis(each, order[:1], 0)[0]
            second = np.take_along_axis(each, order[1:2], 0)[0] if len(models.langs) > 1 else np.full(batch.num_rows, -np.log(UNIFORM))
            names = np.array(models.langs, object)[order[0]]
            names[n == 0] = None
            cols = [batch.column(c) for c in ("id", "fold", "lang")]
            yield pa.record_batch([*cols, pa.array(names, pa.string()), pa.array(first), pa.array(second), pa.array(n.astype(np.int64))], names=["id", "fold", "lang", "pred", "first", "second", "chars"])

    return score


def gram_costs(model: DataFrame, grams: DataFrame, langs: list[str], order: int = ORDER) -> DataFrame:
    """grams with `cost`: the negative log likelihood of each gram's last character after the others, by language, in units of UNIT.

    Every gram asks the model for its endings and for their histories: joins by gram, whatever the size of either side.
    """
    start = {r.lang: r.weight for r in model.where("gram = ''").collect()}
    every = lambda x: F.array(*[F.lit(x)] * len(langs))
    known = model.groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", F.struct("p", "weight")))).alias("of"))
    names = F.array(*map(F.lit, langs))
    column = lambda name, absent: F.transform(names, lambda x: F.coalesce(F.try_element_at("of", x)[name], F.lit(absent)))
    known = known.select(F.col("gram").alias("part"), column("p", 0.0).alias("p"), column("weight", 1.0).alias("weight"))
    part = lambda k, n: F.substring(F.col("gram"), F.length("gram") - k, n)
    parts = [F.struct(F.lit(k).alias("k"), F.lit(history).alias("history"), part(k, F.lit(k + 1 - history)).alias("part")) for k in range(order) for history in ((0, 1) if k else (0,))]
    asked = grams.select("gram", F.explode(F.filter(F.array(*parts), lambda a: a["k"] < F.length("gram"))).alias("a")).select("gram", "a.*")
    told = asked.join(known, "part", "left").groupBy("gram").agg(*(F.max(F.when((F.col("k") == k) & (F.col("history") == h), F.col(name))).alias(f"{name}{k}") for h, name in enumerate(("p", "weight")) for k in range(h, order)))
    said = F.zip_with(F.coalesce("p0", every(0.0)), F.array(*(F.lit(start.get(x, 1.0) * UNIFORM) for x in langs)), lambda a, b: a + b)
    for k in range(1, order):
        more = F.zip_with(F.coalesce(f"p{k}", every(0.0)), F.zip_with(F.coalesce(f"weight{k}", every(1.0)), "said", lambda a, b: a * b), lambda a, b: a + b)
        told = told.withColumn("said", said)
        said = F.when(F.length("gram") > k, more).otherwise(F.col("said"))
    return grams.join(told.select("gram", F.transform(said, lambda x: F.rint(-F.log(x) / UNIT).cast("long")).alias("cost")), "gram")


def _most_frequent(grams: DataFrame, most: int) -> Column:
    """Which rows have an n so high that at most `most` rows do, by steps of a tenth of an octave."""
    step = F.floor(F.log2("n") * 10)
    left, least = most, None
    for r in sorted(grams.groupBy(step.alias("step")).count().collect(), reverse=True):
        left -= r["count"]
        if left < 0:
            break
        least = r.step
    return F.lit(False) if least is None else step >= least


class Costs:
    """What the last characters of frequent grams cost: sorted prints, and a row of costs for every language."""

    def __init__(self, rows: pa.Table, langs: list[str], order: int):
        prints, cost = _prints(rows.column("gram").to_pylist(), order), rows.column("cost").combine_chunks().flatten().to_numpy().reshape(-1, len(langs))
        at = np.argsort(prints)
        self.order, self.langs, self.keys, self.cost = order, langs, prints[at], np.ascontiguousarray(cost[at].T)

    def of(self, codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Costs [languages, words] of the words' known characters, and of the others where the longest gram begins and ends."""
        inner, prints = _gram_prints(codes, at, self.order)
        size = np.minimum(inner + 1, self.order)
        asked, which = np.unique(prints[size - 1, np.arange(len(codes))], return_inverse=True)
        place = np.minimum(np.searchsorted(self.keys, asked), max(len(self.keys) - 1, 0))
        found = self.keys[place] == asked if len(self.keys) else np.zeros(len(asked), bool)
        cost = np.where(found, self.cost[:, place], 0) if len(self.keys) else np.zeros((len(self.langs), len(asked)), np.int64)
        here = np.where(inner > 0, cost[:, which], 0)  # the first blank is given
        end = np.flatnonzero((inner > 0) & ~found[which])
        return np.add.reduceat(here, at, axis=1) if len(at) else np.zeros((len(self.langs), 0), np.int64), end - size[end] + 1, end + 1


def _summer(shared):
    """Task function: a row for every text with its costs by language as far as its grams are known, and rows (row, gram, n) of its other grams."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs, letter, poly = shared.value, _letters(), Poly(12)
        known, held = np.zeros(0, np.uint64), np.zeros((len(costs.langs), 0), np.int64)
        for batch, t in _slices(batches, letter, poly):
            seen = np.isin(t.prints, known, assume_unique=True)
            new, here = np.flatnonzero(~seen), np.zeros((len(costs.langs), len(t.prints)), np.int64)
            here[:, seen] = held[:, np.searchsorted(known, t.prints[seen])]
            codes, at = t.spelled(new)
            here[:, new], start, end = costs.of(codes, at)
            word = np.searchsorted(at, start, "right") - 1  # of new, for each unknown gram
            n = np.bincount(t.text, t.size[t.word] + 1, batch.num_rows)
            halves = lambda c: (np.bincount(t.text, h[t.word], batch.num_rows).astype(np.int64) for h in (c >> 26, c & (1 << 26) - 1))  # noqa: B023, E731  doubles add them exactly
            sums = np.array([(high << 26) + low for high, low in map(halves, here)]).T
            none = lambda kind, many=batch.num_rows: pa.nulls(many, kind)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * len(costs.langs), pa.int32()), pa.array(sums.ravel()))
            yield pa.record_batch([*(batch.column(c) for c in ("row", "id", "fold", "lang")), pa.array(n.astype(np.int64)), lists, none(pa.string()), none(pa.int64())], names=_SUMMED)
            if len(start):
                yield from unknown(batch, t, new, word, start, end, codes)
            kept = np.setdiff1d(np.arange(len(new)), word)
            if len(known) + len(kept) > HELD_WORDS:
                known, held = known[:0], held[:, :0]
            order = np.argsort(all_ := np.concatenate((known, t.prints[new[kept]])))
            known, held = all_[order], np.concatenate((held, here[:, new[kept]]), axis=1)[:, order]

    def unknown(batch, t, new, word, start, end, codes):
        text = codes.tobytes()
        said = [text[a * 4 : b * 4] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        grams, which = np.unique(np.array(said, object), return_inverse=True)
        first = np.searchsorted(word, np.arange(len(new) + 1))  # of each new word, its unknown grams
        place = np.full(len(t.prints), -1)
        place[new] = np.arange(len(new))
        use = place[t.word]
        many = np.where(use >= 0, first[use + 1] - first[use], 0)
        hit = np.flatnonzero(many)
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many[hit]) - many[hit], many[hit]) + np.repeat(first[use[hit]], many[hit])
        pair, n = np.unique(np.repeat(t.text[hit], many[hit]) * len(grams) + which[at], return_counts=True)
        of, gram = np.divmod(pair, len(grams))
        names = pa.array([g.decode("utf-32-le", "replace") for g in grams.tolist()])
        none = lambda kind: pa.nulls(len(pair), kind)
        yield pa.record_batch([batch.column("row").take(pa.array(of)), none(pa.int64()), none(pa.int64()), none(pa.string()), none(pa.int64()), none(pa.list_(pa.int64())), names.take(pa.array(gram)), pa.array(n.astype(np.int64))], names=_SUMMED)

    return score


_SUMMED = ["row", "id", "fold", "lang", "chars", "costs", "gram", "n"]


def _by_joins(texts: DataFrame, model: DataFrame, learned: DataFrame, others: DataFrame, order: int, max_grams: int) -> DataFrame:
    """What _scorer gives, for a model of any size. learned: (lang, gram, n) of the texts behind the model; others: the texts that are not among them."""
    langs = [r.lang for r in model.select("lang").distinct().orderBy("lang").collect()]
    grams = learned.select("gram", "n").unionByName(gram_counts(others.select(F.lit("").alias("lang"), "text"), order).select("gram", "n")).groupBy("gram").agg(F.sum("n").alias("n"))
    costs = save(gram_costs(model, grams, langs, order), "op12-costs", done=True)
    often = _most_frequent(costs, 3 * max_grams // (1 + len(langs)))
    shared = texts.sparkSession.sparkContext.broadcast(Costs(costs.where(often).select("gram", "cost").toArrow(), langs, order))
    rows = texts.withColumn("row", F.monotonically_increasing_id())
    summed = save(rows.mapInArrow(_summer(shared), "row long, id long, fold long, lang string, chars long, costs array<long>, gram string, n long"), "op12-summed")
    added = [F.sum(F.col("n") * F.col("cost")[i]).alias(f"c{i}") for i in range(len(langs))]
    more = summed.where("gram is not null").select("row", "gram", "n").join(costs.select("gram", "cost"), "gram").groupBy("row").agg(*added)
    each = F.array(*((F.col("costs")[i] + F.coalesce(f"c{i}", F.lit(0))) * UNIT / F.greatest("chars", F.lit(1)) for i in range(len(langs))))
    ranked = F.array_sort(F.transform(each, lambda x, i: F.struct(x.alias("cost"), i.alias("i"))))
    found = summed.where("gram is null").join(more, "row", "left").withColumn("ranked", ranked)
    name = F.element_at(F.array(*map(F.lit, langs)), F.col("ranked")[0]["i"] + 1)
    second = F.col("ranked")[1]["cost"] if len(langs) > 1 else F.lit(float(-np.log(UNIFORM)))
    return found.select("id", "fold", "lang", F.when(F.col("chars") > 0, name).alias("pred"), F.col("ranked")[0]["cost"].alias("first"), second.alias("second"), "chars")


def _rising(right: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Shares of right ones by bin, neighbours pooled until they rise; empty bins take the share before them."""
    pools: list[list[float]] = []  # [right, total, bins]
    for r, t in zip(right.tolist(), total.tolist(), strict=True):
        pools.append([r, t, 1])
        while len(pools) > 1 and (not pools[-1][1] or pools[-2][1] == 0 or pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]):
            r1, t1, n1 = pools.pop()
            pools[-1] = [pools[-1][0] + r1, pools[-1][1] + t1, pools[-1][2] + n1]
    return np.concatenate([np.full(n, (r + 1) / (t + 2)) for r, t, n in pools])


def _bin() -> Column:
    """Bin of a prediction's lead: its total over the text on a log scale."""
    lead = (F.col("second") - F.col("first")) * F.col("chars")
    return F.least(F.floor(F.log1p(F.greatest(lead, F.lit(0.0))) * 20), F.lit(_BINS - 1)).cast("int")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, max_grams: int = MAX_GRAMS, reject: float = 0.5, odd: float = 0.999) -> DataFrame:
    """(id, held_out, lang_pred, score, rejected, entropy) of every text; fold 0 of the ids is never learned from, fold 1 calibrates.

    max_grams: up to so many grams the model goes to all tasks; a larger one, of any size, is joined, with the same results.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), folds(id_col).alias("fold"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    labelled = texts.where("lang is not null and text is not null")
    learned = gram_counts(labelled.where("fold > 1").select("lang", "text"), order)
    model = save(model_of_counts(learned, order), "op12-model")
    grams = model.count()
    if not grams:
        return texts.select("id", (F.col("fold") == 0).alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"), F.lit(None).cast("double").alias("entropy"))
    if grams <= max_grams:
        shared = docs.sparkSession.sparkContext.broadcast(Models(model.toArrow(), order))
        found = texts.mapInArrow(_scorer(shared), "id long, fold long, lang string, pred string, first double, second double, chars long")
    else:
        found = _by_joins(texts, model, learned, texts.where("text is not null and (lang is null or fold <= 1)"), order, max_grams)
    scored = save(found.withColumn("bin", _bin()), "op12-scored")
    tried = scored.where("fold = 1 and lang is not null and pred is not null")
    bins = tried.groupBy("bin").agg(F.count("*").alias("total"), F.sum((F.col("pred") == F.col("lang")).cast("long")).alias("right")).toArrow()
    right, total = np.zeros(_BINS, np.int64), np.zeros(_BINS, np.int64)
    at = bins.column("bin").to_numpy()
    right[at], total[at] = bins.column("right").to_numpy(), bins.column("total").to_numpy()
    usual = tried.where("pred = lang").groupBy("pred").agg(F.percentile_approx("first", odd, 10_000).alias("usual"))
    score = F.when(F.col("pred").isNull(), 0.0).otherwise(F.element_at(F.array(*map(F.lit, _rising(right, total).tolist())), F.col("bin") + 1))
    out = scored.join(usual, "pred", "left").withColumn("score", score)
    strange = F.coalesce(F.col("first") > F.col("usual"), F.lit(False))
    return out.select("id", (F.col("fold") == 0).alias("held_out"), F.coalesce("pred", F.lit("und")).alias("lang_pred"), "score", (F.col("pred").isNull() | (F.col("score") < reject) | strange).alias("rejected"), F.when(F.col("pred").isNotNull(), F.col("first")).alias("entropy"))
