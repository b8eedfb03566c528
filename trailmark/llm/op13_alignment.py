"""Operator 13, cross-tokenizer alignment over packed bitsets of token ends.

Tokenizer A (a byte-level BPE file of the tokenizers library) encodes space+text, tokenizer B (a SentencePiece model) the text, to which it
adds the space. Where tokens end is a bit by byte offset. The AND of both bitsets has the shared cuts, whose ranks (running popcounts)
are the token ranges of the groups between them. The OR has all cuts: every stretch between two of them lies in exactly one token of either
side, and a further stretch in another pair, so its stretches are the overlapping pairs, the links.

A text is cut before every blank between two characters that are no white space. No token of A crosses such a place (its pattern starts
anew there, and its merges stay inside a match), nor one of B (checked: no piece has a mark after another character). So each
different stretch of a task is encoded once, joined with others, and its groups and links are remembered; the cuts
are checked on the bitsets. A stretch with white space at its end is encoded by itself.

1.  First pass: id pairs by document, counted by task, then over the corpus; the highest count of every A id follows.
2.  Second pass: groups, links and the counts of the links' pairs. The most frequent pairs, MAX_PAIRS at most, go to all tasks; what they do
    not hold (nothing unless there are more) leaves the task as rows and is joined to the counted pairs by a shuffle.

Texts null, empty, or whose joined bytes differ on one side have no tokens: zeros and '' for the groups. Texts of any length are aligned whole;
repeated rows and null ids are documents of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save
from .rolling import slices

MAX_PAIRS = 4_000_000  # counted pairs that go to every task, 17 bytes each
HELD_PAIRS = 1_000_000  # counts that a task holds before it passes them on
HELD_STRETCHES = 800_000  # remembered by a task, about 300 bytes each
_SLICE = 3_000_000
_JOINED = 20_000  # characters that are encoded at once; more take longer
_PAIR_BITS = 40  # of the number of a pair of ids; what is left of 63 bits numbers the texts of a slice
MARK = "▁"
_ODD = re.compile(r" (?:\s|\Z)|\s ")
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


def byte_level() -> dict[str, int]:
    """The byte of every character of a byte-level vocabulary: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class _Side:
    """Bytes of the tokens of one tokenizer, and its ids of a text."""

    def __init__(self, tokens: list[bytes], encode):
        self.encode = encode
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        end = np.cumsum(size)
        return self.bytes[np.repeat(self.at[ids] - end + size, size) + np.arange(end[-1] if len(end) else 0)]


class Tokenizers:
    """Both tokenizers of a task."""

    def __init__(self, a_path: str, b_path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        a = Tokenizer.from_file(a_path)
        a.encode_special_tokens = True
        letters = byte_level()
        spell = lambda t: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
        names = [a.id_to_token(i) for i in range(a.get_vocab_size())]
        self.a = _Side([spell(t or "") for t in names], lambda s: np.array(a.encode_batch_fast([s], add_special_tokens=False)[0].ids, np.int64))
        b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        self.cuts = not any(MARK in p.lstrip(MARK) for p in pieces)
        spelled = [bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.b = _Side(spelled, lambda s: np.array(b.encode(s[1:]), np.int64))
        self.digits = len(str(max(len(names), len(pieces))))
        if len(names) * len(pieces) >> _PAIR_BITS:
            raise ValueError("too many pairs of ids for their numbers")

    def stretches(self, text: str) -> list[str]:
        """Parts of a text which both encode independently of each other, each with a space before it."""
        if not self.cuts:
            return [text]
        if not _ODD.search(text) and not text[0].isspace():
            return text.split(" ")
        parts = _BETWEEN.split(" " + text)  # the leading space belongs to the first part
        return [parts[0][1:], *parts[1:]]


class _Ends:
    """A packed bitset of token ends with ranks."""

    def __init__(self, ends: np.ndarray | None, n: int, words: np.ndarray | None = None):
        if words is None:
            flags = np.zeros((n // 64 + 1) * 64, np.uint8)
            flags[ends] = 1
            words = np.packbits(flags, bitorder="little").view(np.uint64)
        self.words, self.n = words, n
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many tokens end at or before each offset."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = self.words[word] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - bit))
        return self.before[word] + np.bitwise_count(below)

    def select(self) -> np.ndarray:
        """All offsets where a token ends."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


class _Numbers(dict):
    """Numbers things as they come."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class Aligned:
    """Tokens, groups and links of different stretches, by stretch; those of a task are remembered up to HELD_STRETCHES."""

    def __init__(self, both: Tokenizers):
        self.both, self.number = both, _Numbers()
        self.said: list[bytes] = []
        self.good = np.zeros(0, bool)
        self.n_a = self.n_b = self.n_groups = self.n_links = self.links = np.zeros(0, np.int64)
        self.link_at = np.zeros(1, np.int64)

    def learn(self) -> None:
        """Encode what has been numbered since the last time."""
        old, new = len(self.said), len(self.number) - len(self.said)
        fresh = [" " + p for p in islice(self.number, old, None)]
        self.said += [b""] * new
        good, counts, links = np.zeros(new, bool), np.zeros((4, new), np.int64), []
        together, alone = [], []
        for i, s in enumerate(fresh):
            if MARK not in s:  # it would read back as a blank
                (alone if s[-1].isspace() else together).append(i)
        done = [x for lo, hi in slices([len(fresh[i]) for i in together], _JOINED) for x in self._encoded(fresh, together[lo:hi])]
        done += [x for i in alone for x in self._encoded(fresh, [i])]
        for of, a, b, ends in done:
            good[of] = True
            links.append(self._aligned(np.array(of), a, b, ends, old, counts))
        size = counts[3]
        flat, of_links = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*links, strict=True) if links else ((), ())))
        self.links = np.concatenate((self.links, flat[np.argsort(of_links, kind="stable")]))
        self.link_at = np.concatenate((self.link_at, self.link_at[-1] + np.cumsum(size)))
        self.good = np.concatenate((self.good, good))
        self.n_a, self.n_b, self.n_groups, self.n_links = (np.concatenate(x) for x in zip((self.n_a, self.n_b, self.n_groups, self.n_links), counts, strict=True))

    def _encoded(self, fresh: list[str], of: list[int]):
        """(stretches, ids of A, of B, ends of the stretches in bytes), in parts as large as both give back in whole."""
        texts = [fresh[i] for i in of]
        joined = "".join(texts)
        raw = np.frombuffer(joined.encode(), np.uint8)
        a, b = self.both.a.encode(joined), self.both.b.encode(joined)
        if np.array_equal(self.both.a.spelled(a), raw) and np.array_equal(self.both.b.spelled(b), raw):
            yield of, a, b, np.cumsum([len(s.encode()) for s in texts])
        elif len(of) > 1:
            yield from self._encoded(fresh, of[: len(of) // 2])
            yield from self._encoded(fresh, of[len(of) // 2 :])

    def _aligned(self, of: np.ndarray, a: np.ndarray, b: np.ndarray, ends: np.ndarray, old: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and written groups of some stretches; their links (A id * ids of B + B id) and whose they are."""
        size = int(ends[-1])
        ends_a, ends_b = _Ends(np.cumsum(self.both.a.size[a]), size), _Ends(np.cumsum(self.both.b.size[b]), size)
        shared, every = _Ends(None, size, ends_a.words & ends_b.words), _Ends(None, size, ends_a.words | ends_b.words)
        cuts, steps = shared.select(), every.select()
        last = np.searchsorted(cuts, ends)
        if not np.array_equal(cuts[last], ends):
            raise ValueError("a token crosses a blank between two words: these tokenizers can't be aligned by stretches")
        to_a, to_b = ends_a.rank(cuts), ends_b.rank(cuts)
        group_of, link_of = np.searchsorted(ends, cuts), np.searchsorted(ends, steps)
        text, at = self._written(a, b, to_a, to_b, group_of, len(of))
        at = at.tolist()
        for i, x, y in zip((of + old).tolist(), at[:-1], at[1:], strict=True):
            self.said[i] = text[x:y]
        counts[:, of] = np.diff(np.append(0, to_a[last])), np.diff(np.append(0, to_b[last])), np.bincount(group_of, minlength=len(of)), np.bincount(link_of, minlength=len(of))
        begin = np.concatenate(([0], steps[:-1]))
        return a[ends_a.rank(begin)] * len(self.both.b.size) + b[ends_b.rank(begin)], of[link_of]

    def _written(self, a, b, to_a, to_b, group_of, n) -> tuple[bytes, np.ndarray]:
        """a1,a2|b1;... of every stretch with a ; after every group, and where each stretch ends in it."""
        from_a, from_b = np.concatenate(([0], to_a[:-1])), np.concatenate(([0], to_b[:-1]))
        ids = np.zeros(len(a) + len(b), np.int64)
        mark = np.full(len(ids), ord(","), np.uint8)
        group_a, group_b = np.repeat(np.arange(len(to_a)), to_a - from_a), np.repeat(np.arange(len(to_b)), to_b - from_b)
        ids[np.arange(len(a)) + from_b[group_a]] = a
        ids[np.arange(len(b)) + to_a[group_b]] = b
        mark[to_a + from_b - 1] = ord("|")
        mark[to_a + to_b - 1] = ord(";")
        wide = self.both.digits
        out, shown = np.zeros((len(ids), wide + 1), np.uint8), np.ones((len(ids), wide + 1), bool)
        rest = ids
        for k in range(wide - 1, -1, -1):
            shown[:, k] = (rest > 0) | (k == wide - 1)
            rest, digit = np.divmod(rest, 10)
            out[:, k] = digit + ord("0")
        out[:, wide] = mark
        size = np.concatenate(([0], np.cumsum(shown.sum(1))))
        last = np.concatenate(([0], (to_a + to_b)[np.searchsorted(group_of, np.arange(n), "right") - 1]))
        return out[shown].tobytes(), size[last]


class _Slice:
    """The texts of a slice as numbers of their stretches."""

    def __init__(self, aligned: Aligned, texts: list[str | None]):
        number, split = aligned.number.__getitem__, aligned.both.stretches
        at = [list(map(number, split(t))) if t else [] for t in texts]
        aligned.learn()
        self.aligned = aligned
        sizes = np.array([len(x) for x in at], np.int64)
        self.part = np.array(list(chain.from_iterable(at)), np.int64)
        text = np.repeat(np.arange(len(texts)), sizes)
        self.whole = (sizes > 0) & (np.bincount(text, ~aligned.good[self.part], len(texts)) == 0)
        if not self.whole[sizes > 0].all():
            keep = self.whole[text]
            self.part, text = self.part[keep], text[keep]
        self.text = text
        self.bounds = np.searchsorted(text, np.arange(len(texts) + 1))

    def total(self, by_stretch: np.ndarray) -> np.ndarray:
        """Sums over the stretches of each text (whole numbers)."""
        run = np.concatenate(([0], np.cumsum(by_stretch[self.part], dtype=np.int64)))
        return run[self.bounds[1:]] - run[self.bounds[:-1]]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, links) of every different pair of each text."""
        al = self.aligned
        keys, times = np.unique(self.text << 32 | self.part, return_counts=True)
        text, part = keys >> 32, keys & 0xFFFFFFFF
        size = al.n_links[part]
        end = np.cumsum(size)
        place = np.repeat(al.link_at[part] - end + size, size) + np.arange(end[-1] if len(end) else 0)
        key = np.repeat(text, size) << _PAIR_BITS | al.links[place]
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        links = np.add.reduceat(np.repeat(times, size)[order], first) if len(key) else np.zeros(0, np.int64)
        return key[first] >> _PAIR_BITS, key[first] & ((1 << _PAIR_BITS) - 1), links


def _slices(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str):
    """(batch, its texts as numbers of stretches) in slices of bounded characters."""
    aligned = None
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for lo, hi in slices([len(t or "") for t in texts], _SLICE):
            if aligned is None or len(aligned.said) > HELD_STRETCHES:
                aligned = Aligned(aligned.both if aligned else Tokenizers(a_path, b_path))
            yield batch.slice(lo, hi - lo), _Slice(aligned, texts[lo:hi])


def _pair_counter(a_path: str, b_path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0

        def told():
            keys, which = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            n = np.bincount(which, np.concatenate([n for _, n in held])).astype(np.int64)
            held.clear()
            return pa.record_batch([pa.array(keys), pa.array(n)], names=["pair", "n"])

        for _, s in _slices(batches, a_path, b_path):
            held.append(np.unique(s.pairs()[1], return_counts=True))
            many += len(held[-1][0])
            if many > HELD_PAIRS:
                yield told()
                many = 0
        if held:
            yield told()

    return count


def _aligner(a_path: str, b_path: str, shared, groups: bool):
    names = ["row", "id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups"] if groups else []), "rest"]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best, all_ = shared.value
        valued, by_stretch = None, np.zeros((3, 0), np.int64)  # counted links, of them the best, and the sum of counts, by stretch
        for batch, s in _slices(batches, a_path, b_path):
            al = s.aligned
            if al is not valued:
                valued, by_stretch = al, np.zeros((3, 0), np.int64)
            old = by_stretch.shape[1]
            links = al.links[al.link_at[old] :]
            at = np.minimum(np.searchsorted(keys, links), max(len(keys) - 1, 0))
            known = keys[at] == links if len(keys) else np.zeros(len(links), bool)
            sums = [np.concatenate(([0], np.cumsum(x, dtype=np.int64))) for x in (known, *(np.where(known, x[at], 0) if len(keys) else np.zeros(len(links), np.int64) for x in (best, counts)))]
            edge = al.link_at[old:] - al.link_at[old]
            by_stretch = np.concatenate((by_stretch, [np.diff(x[edge]) for x in sums]), axis=1)
            out = [s.total(x) for x in (al.n_a, al.n_b, al.n_groups, al.n_links, by_stretch[1], by_stretch[2])]
            parts, bounds, saying = s.part.tolist(), s.bounds.tolist(), al.said.__getitem__
            said = [b"".join(map(saying, parts[lo:hi]))[:-1] if ok else None for ok, lo, hi in zip(s.whole.tolist(), bounds[:-1], bounds[1:], strict=True)]
            rest: list[list] = [[] for _ in said]
            if not all_:
                text, pair, times = s.pairs()
                at = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
                missing = keys[at] != pair if len(keys) else np.ones(len(pair), bool)
                for t, p, n in zip(text[missing].tolist(), pair[missing].tolist(), times[missing].tolist(), strict=True):
                    rest[t].append({"pair": p, "links": n})
            cols = [batch.column("row"), batch.column("id"), *map(pa.array, out), pa.array([hashlib.sha256(x).hexdigest() if x is not None else "" for x in said])]
            cols += [pa.array([x.decode() if x is not None else "" for x in said])] if groups else []
            cols.append(pa.array(rest, pa.list_(pa.struct([("pair", pa.int64()), ("links", pa.int64())]))))
            yield pa.record_batch(cols, names=names)

    return align


def pair_counts(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text") -> DataFrame:
    """(pair (A id * ids of B + B id), a, n: documents that hold it linked, best: whether n is its A id's highest)."""
    texts = docs.select(F.col(text_col).alias("text"))
    counted = save(texts.mapInArrow(_pair_counter(a_path, b_path), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "op13-pairs")
    import sentencepiece

    of_a = F.expr(f"pair div {sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()}")
    highest = counted.groupBy(of_a.alias("a")).agg(F.max("n").alias("highest"))
    return save(counted.withColumn("a", of_a).join(highest, "a").select("pair", "n", (F.col("n") == F.col("highest")).cast("int").alias("best")), "op13-counts")


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", groups: bool = False, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256[, groups]) of every text; groups: also written out."""
    counted = pair_counts(docs, a_path, b_path, text_col)
    total = counted.count()
    sent = counted
    if total > max_pairs:  # only the most frequent, the others by a shuffle
        least = counted.agg(F.percentile_approx("n", F.lit(1 - max_pairs / 2 / total), F.lit(10_000))).first()[0]
        sent = counted.where(F.col("n") > least)
    table = sent.orderBy("pair").toArrow()
    shared = docs.sparkSession.sparkContext.broadcast((*(table.column(c).to_numpy() for c in ("pair", "n", "best")), total <= max_pairs))
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    written = ", groups string" if groups else ""
    schema = f"row long, id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string{written}, rest array<struct<pair: long, links: long>>"
    out = texts.mapInArrow(_aligner(a_path, b_path, shared, groups), schema)
    if total <= max_pairs:
        return out.drop("row", "rest")
    out = save(out, "op13-aligned")
    more = out.select("row", F.explode("rest").alias("r")).select("row", "r.*").join(counted, "pair").groupBy("row").agg(F.sum(F.col("n") * F.col("links")).alias("more_sum"), F.sum(F.col("best") * F.col("links")).alias("more_best"))
    out = out.join(more, "row", "left")
    return out.withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}).drop("row", "rest", "more_sum", "more_best")
