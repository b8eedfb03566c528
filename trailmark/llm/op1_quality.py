"""Operator 1, quality classifier by co-training on two views of a document.

The text view sees the words and the style of a text; the metadata view sees source, language and length. Each is
a logistic regression. In every round both views score all unlabelled documents in one Spark job, each marks those it is most sure of
(at least SURE after calibration, as many as ROUND_SHARE of the labelled ones), and the other view trains on those too. At the end both are
calibrated on held-out labels, and a last regression on the two calibrated log-odds scores every document.
Two targets are learned in this way: good quality, and toxicity. A document is kept if it is likely good and not likely toxic.

Labelled documents are a bounded sample (`labelled`, by hash of the id), which also gives the words and style cuts of the text view; of the
unlabelled ones, all compete in every round, and at most `pool` are marked in all. Tasks keep no more than a round takes, so only
marked documents reach the driver. Scoring reads every whole text of all documents, however long.

Null or empty texts are scored by their style alone; null metadata are values of their own. Null labels and labels
of missing documents are not used; of several labels of a document the largest counts. Repeated rows get equal scores. Without labels of both
classes a target gets its prior (0.5 without any). An empty table gives an empty result. All other columns pass through; columns named
p_text, p_meta, p_quality, p_toxic and keep are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, checked_broadcast, give_back, local_rows, save
from .rolling import Poly, join_texts, mix, text_slices

ROUNDS, SURE, ROUND_SHARE = 3, 0.97, 0.15
WORDS = 1600  # words that a text model looks at
META_SLOTS = 512
_WORD, _VALUE = Poly(11), Poly(12)
_BYTES = np.arange(256)
_FOLD = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_LETTER = ((_FOLD >= 97) & (_FOLD <= 122)) | (_BYTES >= 128) | ((_BYTES >= 48) & (_BYTES <= 57))
#: Byte classes whose shares describe a style.
_CLASSES = np.zeros(256, np.int64)
for _k, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?", b"#$%&*@^~", b"|<>{}[]()/\\_=+", b".,;:'\"-", b"\n", b" \t\r")):
    _CLASSES[list(_set)] = _k + 1
_N_CLASSES = 9


def text_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prints of each text's different words, owner of each, style numbers by text)."""
    raw, bounds = join_texts([t + b" " for t in texts])
    inside = _LETTER[raw]
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    words = _WORD.spans(_WORD.prefix(_WORD.byte[_FOLD[raw]]), start, end)
    owner = np.searchsorted(bounds, start, side="right") - 1
    n = np.bincount(owner, minlength=len(texts))
    again = np.bincount(owner[1:][(words[1:] == words[:-1]) & (owner[1:] == owner[:-1])], minlength=len(texts))
    size = np.diff(bounds)
    kinds = np.bincount(np.repeat(np.arange(len(texts)), size) * _N_CLASSES + _CLASSES[raw], minlength=len(texts) * _N_CLASSES).reshape(-1, _N_CLASSES)
    long = np.bincount(owner, weights=end - start, minlength=len(texts))
    words, owner, _ = _counted(words, owner)
    distinct = np.bincount(owner, minlength=len(texts))
    some = np.maximum(n, 1)
    style = np.column_stack([kinds / size[:, None], distinct / some, again / some, long / some, np.log1p(n), distinct / np.sqrt(some)])
    # Families of words: starts of four and six bytes, by how many different words of the text share them.
    place = np.searchsorted(bounds, start, side="right") - 1
    prefix = _WORD.prefix(_WORD.byte[_FOLD[raw]])
    for size in (4, 6):
        longer = end - start > size
        stems = _WORD.spans(prefix, start[longer], start[longer] + size)
        whole = _WORD.spans(prefix, start[longer], end[longer])
        pair, at, _ = _counted(mix(stems) ^ (whole & np.uint64(0xFFFFF)), place[longer], mix(stems))
        stems, at, count = _counted(pair, at)
        for least in (1, 2, 4):
            some_ = count >= least
            words, owner = np.concatenate((words, mix(stems[some_] + np.uint64(31 * size + least)))), np.concatenate((owner, at[some_]))
    order = np.argsort(owner, kind="stable")
    return words[order], owner[order], style


def _counted(values: np.ndarray, owner: np.ndarray, show: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different values of each owner (or what to show for them), their owners, and how often each came."""
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    first = np.flatnonzero(new)
    return (v if show is None else show[order])[first], o[first], np.diff(np.concatenate((first, [len(v)])))


def meta_features(source: list, lang: list, n_chars: list) -> np.ndarray:
    """Slots of a document's metadata values: source, language, length band."""
    values = [f"{k}={v}".encode() for s, l, n in zip(source, lang, n_chars) for k, v in (("s", s), ("l", l), ("n", None if n is None else int(max(n, 0)).bit_length()))]
    if not values:
        return np.zeros((0, 3), np.int64)
    raw, bounds = join_texts(values)
    return (_VALUE.spans(_VALUE.prefix(_VALUE.byte[raw]), bounds[:-1], bounds[1:]) % np.uint64(META_SLOTS)).astype(np.int64).reshape(-1, 3)


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 2.0, rounds: int = 80) -> np.ndarray:
    """Logistic regression by accelerated gradient steps; the last coefficient is the constant."""
    d = x.shape[1]
    # Columns count as if scaled to equal weight, so that rare words learn as fast as common ones; the matrix itself is neither copied nor turned.
    size = np.sqrt(np.maximum(np.einsum("ij,ij->j", x, x) / len(x), 1e-4)).astype(x.dtype)
    small = lambda v: v.astype(x.dtype)  # noqa: E731  products stay in the matrix's own precision
    ahead = lambda v: x @ small(v / size)
    back = lambda v: (x.T @ small(v)) / size
    w, look = np.zeros(d + 1), np.zeros(d + 1)
    total = weight.sum()
    # The step is safe for the largest eigenvalue, which power steps bound.
    v = np.ones(d) / np.sqrt(d)
    for _ in range(6):
        v = back(weight * ahead(v))
        v /= max(np.linalg.norm(v), 1e-12)
    top = float(np.linalg.norm(np.sqrt(weight) * ahead(v)) ** 2) / total + 1.0
    step, t = 1.0 / (0.3 * top + l2 / total), 1.0
    for _ in range(rounds):
        p = _sigmoid(ahead(look[:-1]) + look[-1])
        r = weight * (p - y) / total
        g = np.append(back(r) + l2 / total * look[:-1], r.sum())
        new = look - step * g
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return np.append(w[:-1] / size, w[-1])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Target:
    """One target: weights of both views, their calibration, and how they combine."""

    text: np.ndarray
    meta: np.ndarray
    scale: np.ndarray  # slope and constant by view
    mixed: np.ndarray  # weights of the two calibrated log-odds, constant

    def scores(self, text_raw: np.ndarray, meta_raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        views = [a * raw + b for raw, (a, b) in zip((text_raw, meta_raw), self.scale)]
        both = self.mixed[0] * views[0] + self.mixed[1] * views[1] + self.mixed[2]
        return _sigmoid(views[0]), _sigmoid(views[1]), _sigmoid(both)


@dataclass
class Model:
    words: np.ndarray  # sorted prints
    cuts: np.ndarray  # style bins
    targets: dict[str, Target]


def _binned(style: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Bin of every style number, as columns of one wide indicator matrix."""
    return np.column_stack([np.searchsorted(c, style[:, j], side="right") + j * (cuts.shape[1] + 1) for j, c in enumerate(cuts)])


def _matrix(words, owner, style, known, cuts, n, x: np.ndarray | None = None) -> np.ndarray:
    """Rows of a view, into the zeros x if they are given."""
    bins = cuts.shape[0] * (cuts.shape[1] + 1)
    x = np.zeros((n, len(known) + bins), np.float32) if x is None else x
    if len(known) and len(words):
        at = np.minimum(np.searchsorted(known, words), len(known) - 1)
        hit = known[at] == words
        x[owner[hit], at[hit]] = 1
    x[np.arange(n)[:, None], len(known) + _binned(style, cuts)] = 1
    return x


def _telling(sample: DataFrame, rows: DataFrame, target: str, y: np.ndarray, count: int) -> np.ndarray:
    """Prints of the words whose presence differs most between the classes (chi-square); rows: at and class of the sample's documents."""
    n, n1 = int((y >= 0).sum()), int((y == 1).sum())
    kinds = sample.join(F.broadcast(rows.where(F.col(target) >= 0)), "at").select(F.explode("words").alias("word"), target)
    seen = kinds.groupBy("word").agg(F.count("*").cast("double").alias("all"), F.sum(target).cast("double").alias("pos")).where("all >= 3")
    want = F.col("all") * F.lit(float(n1)) / F.lit(float(max(n, 1)))
    off, other = F.col("pos") - want, F.col("all") - F.col("pos") - (F.col("all") - want)
    chi = off * off / F.greatest(want, F.lit(1e-9)) + other * other / F.greatest(F.col("all") - want, F.lit(1e-9))
    best = seen.select("word", chi.alias("chi")).where("chi > 0").orderBy(F.desc("chi"), F.col("word") < 0, "word").limit(count)  # prints are unsigned
    return best.select("word").toArrow().column(0).to_numpy().view(np.uint64)


def _rows(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of a view in the precision of the fit; views themselves hold a byte for a cell."""
    return x[at].astype(np.float32)


class _CoTraining:
    """Fits of both views of one target, and the documents that each learns from the other."""

    def __init__(self, y: np.ndarray):
        """y: 1, 0, or -1 for documents without a label, in hash order of the ids."""
        labelled = np.flatnonzero(y >= 0)
        self.y = y
        self.held = labelled[np.arange(len(labelled)) % 4 == 3]
        self.train = np.setdiff1d(labelled, self.held)
        self.prior = float(np.clip(y[labelled].mean(), 1e-3, 1 - 1e-3)) if len(labelled) else 0.5
        self.learns = min((y[part] == v).sum() for part in (self.train, self.held) for v in (0, 1)) > 0
        self.marks: tuple[dict[int, int], dict[int, int]] = ({}, {})  # place of a marked document, and its class, by learning view

    def fitted(self, k: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights and calibration of a view."""
        marked = np.array(list(self.marks[k]), np.int64)
        use = np.concatenate((self.train, marked))
        label = np.concatenate((self.y[self.train], np.array(list(self.marks[k].values()), np.int64))).astype(float)
        w = _fit(_rows(x, use), label, np.where(np.arange(len(use)) < len(self.train), 1.0, 0.3))
        raw = _rows(x, self.held) @ w[:-1].astype(np.float32) + w[-1]
        scale = _fit(raw[:, None].astype(float), self.y[self.held].astype(float), np.ones(len(self.held)), l2=1e-3, rounds=300)
        return w, np.array([max(scale[0], 0.0), scale[1]])

    def target(self, x: tuple[np.ndarray, np.ndarray], last: bool) -> Target:
        if not self.learns:
            return Target(np.zeros(x[0].shape[1] + 1), np.zeros(x[1].shape[1] + 1), np.zeros((2, 2)), np.array([0, 0, np.log(self.prior / (1 - self.prior))]))
        (wt, st), (wm, sm) = (self.fitted(k, x[k]) for k in (0, 1))
        mixed = np.array([0.5, 0.5, 0.0])
        if last:
            both = np.column_stack([s[0] * (_rows(v, self.held) @ w[:-1].astype(np.float32) + w[-1]) + s[1] for v, w, s in zip(x, (wt, wm), (st, sm))])
            mixed = _fit(both, self.y[self.held].astype(float), np.ones(len(self.held)), l2=1e-3, rounds=300)
        return Target(wt, wm, np.array([st, sm]), np.array([max(mixed[0], 0.0), max(mixed[1], 0.0), mixed[2]]))

    def wanted(self, value: int) -> int:
        return max(1, int(ROUND_SHARE * len(self.train) * (self.prior if value else 1 - self.prior)))


def _view_scores(m: Model, batch: pa.RecordBatch, text_col: str):
    """(first row, end, scores of both views and of both together by target) in slices of bounded bytes."""
    n_bins = m.cuts.shape[1] + 1
    for a, b, texts in text_slices(batch.column(text_col), 300_000):
        words, owner, style = text_features(texts)
        meta = meta_features(*(batch.column(c).slice(a, b - a).to_pylist() for c in ("source", "lang", "n_chars")))
        at = np.minimum(np.searchsorted(m.words, words), max(len(m.words) - 1, 0))
        hit = m.words[at] == words if len(m.words) else np.zeros(len(words), bool)
        bins, out = _binned(style, m.cuts), {}
        for name, t in m.targets.items():
            w = t.text[: len(m.words)]
            raw = np.bincount(owner[hit], weights=w[at[hit]], minlength=b - a) + t.text[len(m.words) : len(m.words) + n_bins * len(m.cuts)][bins].sum(1) + t.text[-1]
            out[name] = t.scores(raw, t.meta[:-1][meta].sum(1) + t.meta[-1])
        yield a, b, out


def _surest(docs: DataFrame, model: Model, text_col: str, lists: list[tuple[str, int, int, int]], taken: dict[int, set]) -> list[tuple[int, int]]:
    """(list, id) of the unlabelled documents that a view is most sure of; lists: target, marking view, class, how many."""
    shared = docs.sparkSession.sparkContext.broadcast((model, lists, {n: np.array(sorted(ids), np.int64) for n, ids in taken.items()}))
    schema = pa.schema([("list", pa.int32()), ("sure", pa.float64()), ("turn", pa.int64()), ("id", pa.int64())])

    def run(batches):
        m, wanted, taken = shared.value
        best = {n: tuple(np.zeros(0, t) for t in (float, np.int64, np.int64)) for n in range(len(wanted))}
        for batch in batches:
            ids, turn = batch.column("id").to_numpy(), batch.column("turn").to_numpy()
            for a, b, scores in _view_scores(m, batch, text_col):
                for n, (target, view, value, most) in enumerate(wanted):
                    p = scores[target][view]
                    sure = p if value else 1 - p
                    new = (sure >= SURE) & ~np.isin(ids[a:b], taken[n])
                    if new.any():
                        s, t, i = (np.concatenate(x) for x in zip(best[n], (sure[new], turn[a:b][new], ids[a:b][new])))
                        order = np.lexsort((i, t, -s))[: 2 * most]  # an id may come twice
                        best[n] = s[order], t[order], i[order]
        for n, (s, t, i) in best.items():
            yield pa.record_batch([pa.array(np.full(len(s), n, np.int32)), pa.array(s), pa.array(t), pa.array(i)], schema=schema)

    found = docs.mapInArrow(run, "list int, sure double, turn long, id long").groupBy("list", "id").agg(F.max("sure").alias("sure"), F.min("turn").alias("turn"))
    limits = local_rows(docs.sparkSession, list=pa.array(range(len(lists)), pa.int32()), most=pa.array([most for *_, most in lists], pa.int32()))
    place = F.row_number().over(Window.partitionBy("list").orderBy(F.desc("sure"), "turn", "id"))
    return [(r["list"], r["id"]) for r in found.withColumn("place", place).where(F.col("place") <= max(most for *_, most in lists)).join(F.broadcast(limits), "list").where("place <= most").orderBy("place", "list").select("list", "id").collect()]


def _features(docs: DataFrame, text_col: str, known: np.ndarray | None = None) -> DataFrame:
    """Ids, features and metadata of documents, made by tasks; words: prints, or the places in known of those that are in it."""
    schema = pa.schema([("id", pa.int64()), ("words", pa.list_(pa.int64())), ("style", pa.list_(pa.float64())), ("meta", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for a, b, texts in text_slices(batch.column(text_col), 300_000):
                words, owner, style = text_features(texts)
                words, owner = _places(words, owner, known)
                meta = meta_features(*(batch.column(c).slice(a, b - a).to_pylist() for c in ("source", "lang", "n_chars")))
                ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=b - a))))
                yield pa.record_batch([batch.column("id").slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(words.view(np.int64))), pa.array(style.tolist(), pa.list_(pa.float64())), pa.array(meta.tolist(), pa.list_(pa.int64()))], schema=schema)

    return docs.mapInArrow(run, "id long, words array<long>, style array<double>, meta array<long>")


def _places(words: np.ndarray, owner: np.ndarray, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    if known is None or not len(words):
        return words, owner
    at = np.minimum(np.searchsorted(known, words), max(len(known) - 1, 0))
    hit = known[at] == words if len(known) else np.zeros(len(words), bool)
    return at[hit], owner[hit]


def _known_words(sample: DataFrame, known: np.ndarray) -> pa.Table:
    """at and places in known of the words of the sample's documents."""

    def run(batches):
        for batch in batches:
            lists = batch.column("words")
            owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            words, owner = _places(lists.flatten().to_numpy().view(np.uint64), owner, known)
            ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(lists)))))
            yield pa.record_batch([batch.column("at"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(words.astype(np.int64)))], names=["at", "words"])

    return sample.select("at", "words").mapInArrow(run, "at long, words array<long>").toArrow()


def _list_parts(column: pa.ChunkedArray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values of the lists of some rows, in their order; the position in rows of each)."""
    lists = column.take(pa.array(rows)).combine_chunks()
    ends = lists.offsets.to_numpy()
    return lists.values.to_numpy()[ends[0] : ends[-1]], np.repeat(np.arange(len(rows)), np.diff(ends))


def _slots(meta: np.ndarray) -> np.ndarray:
    x = np.zeros((len(meta), META_SLOTS), np.uint8)
    x[np.arange(len(meta))[:, None], meta] = 1
    return x


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: int = 5000, pool: int = 5000) -> Model:
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    plain = docs.select(F.col(id_col).cast("long").alias("id"), text_col, *(F.col(c) for c in ("source", "lang", "n_chars")))
    marked = marks.where("quality is not null or toxic is not null").join(plain.select("id"), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(labelled).toPandas()
    spark = docs.sparkSession
    bound_batches(spark)

    def wanted(ids: list[int]) -> DataFrame:
        some = local_rows(spark, id=pa.array(ids, pa.int64()))  # at most labelled or pool ids
        return plain.join(F.broadcast(some), "id", "left_semi")

    def firsts(got: pa.Table, ids: list[int]) -> np.ndarray:
        """Rows of got in the order of ids; the first row of a repeated id."""
        found, place = got.column("id").to_numpy(), {int(i): k for k, i in enumerate(ids)}
        return np.array(sorted(np.unique(found, return_index=True)[1], key=lambda k: place[int(found[k])]), np.int64)

    def dense(got: pa.Table, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(rows):
            return text_features([b""])[2][:0], np.zeros((0, 3), np.int64)
        some = got.select(["style", "meta"]).take(pa.array(rows))
        return np.array(some.column("style").to_pylist(), float), np.array(some.column("meta").to_pylist(), np.int64).reshape(-1, 3)

    # The sample's words stay in the shared folder: they are counted there, and only those that the model knows come to the driver.
    names = [int(i) for i in marked["id"]]
    sample = save(_features(wanted(names), text_col).withColumn("at", F.monotonically_increasing_id()), "op1-sample", True)
    got = sample.select("id", "at", "style", "meta").toArrow().sort_by("at")
    rows = firsts(got, names)
    ids, ats, (style, meta) = got.column("id").to_numpy()[rows], got.column("at").to_numpy()[rows], dense(got, rows)
    cuts = np.quantile(style if len(style) else text_features([b""])[2], np.linspace(0.1, 0.9, 9), axis=0).T
    by_id = marked.set_index("id")
    y = {t: np.array([-1 if (v := by_id[t].get(int(i))) is None or v != v else int(v > 0) for i in ids], np.int64) for t in ("quality", "toxic")}
    known = np.zeros(0, np.uint64)
    if len(ids):
        classes = local_rows(spark, at=pa.array(ats, pa.int64()), quality=pa.array(y["quality"], pa.int32()), toxic=pa.array(y["toxic"], pa.int32()))
        known = np.unique(np.concatenate([_telling(sample, classes, t, v, WORDS // 2) for t, v in y.items()]))
    # One matrix of bytes with room for what is marked later: its pages are taken as they are written, so rounds make no copies of it.
    room = np.zeros((len(ids) + pool, len(known) + cuts.shape[0] * (cuts.shape[1] + 1)), np.uint8)
    x = (_matrix(known[:0], np.zeros(0, np.int64), style, known, cuts, len(ids), room[: len(ids)]), _slots(meta))
    if len(ids):
        words = _known_words(sample, known)
        at = words.column("at").to_numpy()
        order = np.argsort(at, kind="stable")
        column, owner = _list_parts(words.column("words"), order[np.searchsorted(at[order], ats)])
        x[0][owner, column] = 1
        del words, column, owner
    del got, style, meta
    place, learners = {int(i): k for k, i in enumerate(ids)}, {t: _CoTraining(v) for t, v in y.items()}
    model = lambda last: Model(known, cuts, {t: c.target(x, last) for t, c in learners.items()})
    n_marks = marks.count()
    free = plain.where("id is not null").join(checked_broadcast(marks.select("id"), n_marks), "id", "left_anti").withColumn("turn", F.xxhash64("id"))
    lists = [(t, k, v, c.wanted(v)) for t, c in learners.items() if c.learns for k in (0, 1) for v in (1, 0)]
    left = pool
    for _ in range(ROUNDS if lists else 0):
        at = dict((k, i) for i, k in place.items())
        taken = {n: {at[k] for k in learners[t].marks[1 - view]} for n, (t, view, _, _) in enumerate(lists)}
        found = _surest(free, model(False), text_col, lists, taken)
        fresh = list(dict.fromkeys(i for _, i in found if i not in place))[:left]
        left -= len(fresh)
        if fresh:
            got = _features(wanted(fresh), text_col, known).toArrow()
            rows = firsts(got, fresh)
            new, (style, meta), (column, owner) = got.column("id").to_numpy()[rows], dense(got, rows), _list_parts(got.column("words"), rows)
            end = len(x[0]) + len(new)
            _matrix(known[:0], owner[:0], style, known, cuts, len(new), room[len(x[0]) : end])[owner, column] = 1
            x = (room[:end], np.concatenate((x[1], _slots(meta))))
            del got, style, meta, column, owner
            place |= {int(i): len(place) + k for k, i in enumerate(new)}
        for n, i in found:
            t, view, value, _ = lists[n]
            if i in place:
                learners[t].marks[1 - view].setdefault(place[i], value)
        if not fresh:
            break
    out = model(True)
    del x, room
    give_back()  # later stages share the driver
    return out


_ADDED = ("p_text", "p_meta", "p_quality", "p_toxic", "keep")


def classify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with p_text, p_meta and p_quality (of good quality), p_toxic and keep appended."""
    bound_batches(docs.sparkSession)
    kept = docs.drop(*_ADDED)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            parts = [np.column_stack([*out["quality"], out["toxic"][2]]) for _, _, out in _view_scores(m, batch, text_col)]
            p = np.concatenate(parts) if parts else np.zeros((0, 4))
            keep = (p[:, 2] >= 0.5) & (p[:, 3] < 0.5)
            yield pa.record_batch([*batch.columns, *(pa.array(p[:, k]) for k in range(4)), pa.array(keep)], names=[*batch.schema.names, *_ADDED])

    schema = kept.select("*", *(F.lit(None).cast("double").alias(c) for c in _ADDED[:4]), F.lit(None).cast("boolean").alias("keep")).schema
    return kept.mapInArrow(run, schema)
