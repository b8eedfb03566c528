"""Operator 3, SentencePiece encoding and decoding by a streaming Viterbi search.

Pieces and scores come from a public SentencePiece model file, and the ids are those that the model itself gives. The search walks
over the boundaries of a text and extends every live one by the pieces that start there; a boundary keeps the last piece of the best path to it:

-   A unigram model's best path has the highest sum of scores, and the longest last piece at equal sums.
-   A BPE model (piece_bpe_32k.model is one) joins the neighbours of the highest score, the leftmost at equal scores, until none can be
    joined. Pieces are its result exactly if it leaves every two neighbours among them as they are, so a path goes on only by such a
    piece, and exactly one path leads to each boundary. Whether two pieces stay apart is found by merging the two alone, and remembered.

Only the boundaries that a piece may still cross are live (the longest piece bounds them), and ids are committed as soon as all paths to them
meet in one boundary. Where no piece holds two neighbouring characters (a word's end and a blank or a full stop), the boundary between
them is always such a meeting point, so the stretches between them are searched one by one, and remembered up to a bound of bytes.

A space is the mark U+2581, one leads the text, and a character that no piece has becomes its UTF-8 bytes' pieces.
A literal U+2581 in a text also takes byte pieces, so that decoding is an exact round trip.

Null or empty texts encode to no ids. Ids and other columns pass through unread; repeated rows are encoded alike, and a text of any length
holds no more than its window and its ids. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import defaultdict
from functools import cached_property, lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, give_back
from .rolling import in_slices

CACHE_BYTES = 160 << 20  # about what the remembered stretches of a task may take
CACHE_PAIRS = 300_000
_ENTRY = 200  # bytes of a remembered stretch beside its characters and ids
_SLICE = 2_000_000
MARK = "▁"
MOST_PLACES = 2_000  # characters whose boundaries are looked up in a table of all their pairs
SHORT_STRETCH = 128  # characters up to which merges are found by plain scans
#: Fixed value: what an unknown character scores below the lowest piece.
UNKNOWN_PENALTY = 10.0


class Pieces:
    """Pieces, scores and bytes of a model file."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto.FromString(model.serialized_model_proto())
        kinds = {p.type for p in proto.pieces}
        self.merges = proto.trainer_spec.model_type == proto.trainer_spec.BPE
        if not self.merges and proto.trainer_spec.model_type != proto.trainer_spec.UNIGRAM:
            raise ValueError(f"{path} is neither a unigram nor a BPE model")
        if self.merges and kinds & {proto.SentencePiece.USER_DEFINED, proto.SentencePiece.UNUSED}:
            raise ValueError(f"{path} has user-defined or unused pieces, whose merges differ")
        self.size = model.get_piece_size()
        self.score, self.byte_id, self.text = {}, {}, []
        self.id = {}
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                b = int(piece[1:-1], 16)
                self.byte_id[b] = i
                self.text.append(bytes([b]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.text.append(b"")
            else:
                self.id[piece] = i
                self.score[piece] = model.get_score(i)
                self.text.append(piece.replace(MARK, " ").encode())
        self.unknown = min(self.score.values(), default=0.0) - UNKNOWN_PENALTY
        self.longest = max(map(len, self.score), default=1)
        self.alphabet = {c for p in self.score for c in p}
        self.inner = {p[k : k + 2] for p in self.score for k in range(len(p) - 1)}  # neighbours inside a piece; between all others a boundary lies
        # Blanks end a stretch if no piece has a mark after another character.
        self.splits = not any(MARK in p.lstrip(MARK) for p in self.score) and "\n" not in self.alphabet

        self.pairs: dict[str, dict[str, bool]] = defaultdict(dict)
        self.known_pairs = 0

    @cached_property
    def trie(self) -> dict:
        """By character: (further characters, score of the piece that ends here or None, the piece or None)."""
        root: dict = {}
        for p, v in self.score.items():
            node = root
            for c in p[:-1]:
                node = node.setdefault(c, ({}, None, None))[0]
            node[p[-1]] = (node[p[-1]][0] if p[-1] in node else {}, v, p)
        return root

    def apart(self, left: str, right: str) -> bool:
        """Whether a BPE model leaves two neighbours as they are (left may be empty); remembered by left, then right."""
        got = self.merged(left + right) == ([left, right] if left else [right])
        self.known_pairs += 1
        if self.known_pairs > CACHE_PAIRS:
            self.pairs.clear()
            self.known_pairs = 0
        self.pairs[left][right] = got
        return got

    def merged(self, s: str) -> list[str]:
        """Parts of a stretch after a BPE model's merges: the highest score first, then the leftmost."""
        score, low = self.score.get, float("-inf")
        parts = list(s)
        if len(s) <= SHORT_STRETCH:
            worth = [score(a + b, low) for a, b in zip(parts, parts[1:])]
            while worth and (v := max(worth)) > low:
                i = worth.index(v)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del worth[i]
                if i:
                    worth[i - 1] = score(parts[i - 1] + parts[i], low)
                if i < len(worth):
                    worth[i] = score(parts[i] + parts[i + 1], low)
            return parts
        n = len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))  # neighbours; a part that was joined to its left is empty
        todo = [(-v, i, i + 1, parts[i] + parts[i + 1]) for i in range(n - 1) if (v := score(parts[i] + parts[i + 1])) is not None]
        heapify(todo)
        while todo:
            _, i, j, both = heappop(todo)
            if not parts[i] or not parts[j] or parts[i] + parts[j] != both:
                continue  # one of them has grown or gone since
            parts[i], parts[j], k = both, "", after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if (v := score(both + parts[k])) is not None:
                    heappush(todo, (-v, i, k, both + parts[k]))
            if (h := before[i]) >= 0 and (v := score(parts[h] + both)) is not None:
                heappush(todo, (-v, h, i, parts[h] + both))
        return [p for p in parts if p]

    def search(self, s: str) -> list[tuple[int, int]]:
        """Spans of the pieces with the highest sum of scores, committed while the text streams by."""
        out: list[tuple[int, int]] = []
        live: dict[int, float] = {0: 0.0}  # boundaries ahead: score of the best path to each
        back: dict[int, int] = {}  # last piece's start by boundary, since the last commit
        done, root, unknown, n, low = 0, self.trie, self.unknown, len(s), float("-inf")
        for i in range(n):
            here = live.pop(i, None)
            if here is None:
                continue
            if len(back) > 4 * self.longest or not live and i:
                done = self._commit(i, live, back, done, out)
            node, single = root, False
            for j in range(i, n):
                found = node.get(s[j])
                if found is None:
                    break
                node, v, _ = found
                if v is not None:
                    single |= j == i
                    if here + v > live.get(j + 1, low):
                        live[j + 1], back[j + 1] = here + v, i
            if not single and here + unknown > live.get(i + 1, low):
                live[i + 1], back[i + 1] = here + unknown, i
        self._commit(n, (), back, done, out)
        return out

    def search_merged(self, s: str) -> list[tuple[int, int]]:
        """Spans of the pieces of a BPE model."""
        ends = np.cumsum([0, *map(len, self.stream_merged(s))]).tolist()
        return list(zip(ends[:-1], ends[1:]))

    def stream_merged(self, s: str) -> list[str]:
        """Pieces of a BPE model: a path goes on by pieces that stay apart from its last one, so each boundary has one path."""
        out: list[str] = []
        back: dict[int, str] = {}  # last piece of the path to a boundary
        done, most, last, pairs, trie, alphabet = 0, 4 * self.longest, "", self.pairs, self.trie, self.score
        for i in range(len(s)):
            if i:
                last = back[i]
                if len(back) > most:
                    done = self._commit_pieces(i, back, done, out)
            known, node, j = pairs[last], trie, i
            for c in s[i : i + self.longest]:
                found = node.get(c)
                if found is None:
                    break
                node, _, piece = found
                j += 1
                if piece is not None and j not in back:
                    stay = known.get(piece)
                    if stay is None:
                        stay = self.apart(last, piece)
                    if stay:
                        back[j] = piece
            if i + 1 not in back and s[i] not in alphabet:
                back[i + 1] = s[i]  # a character without a piece joins nothing
        path, k = [], len(s)
        while k > done:
            path.append(back[k])
            k -= len(path[-1])
        path.reverse()
        return out + path if out else path

    @staticmethod
    def _commit_pieces(at: int, back: dict[int, str], done: int, out: list[str]) -> int:
        """Append the pieces up to where the paths to all live boundaries (at and those reached beyond) meet, and forget them."""
        ends = {k for k in back if k >= at}
        while len(ends) > 1:
            top = max(ends)
            ends.remove(top)
            ends.add(top - len(back[top]))
        (meet,) = ends
        path, k = [], meet
        while k > done:
            path.append(back[k])
            k -= len(path[-1])
        out.extend(reversed(path))
        for k in [k for k in back if k < meet]:
            del back[k]
        return max(meet, done)

    @staticmethod
    def _commit(at: int, live, back: dict[int, int], done: int, out: list) -> int:
        """Append the spans up to where the paths to at and all live boundaries meet, and forget them; the new last commit."""
        ends = {at, *live}
        while len(ends) > 1:
            top = max(ends)
            ends.remove(top)
            ends.add(back[top])
        (meet,) = ends
        if meet > done:
            path, k = [], meet
            while k > done:
                path.append((back[k], k))
                k = back[k]
            out.extend(reversed(path))
            for k in [k for k in back if k < meet]:
                del back[k]
        return max(meet, done)

    def inside_window(self, s: str) -> list[tuple[int, int]]:
        return self.search(s)


class _Stretches(dict):
    """Ids by stretch, with blanks for marks; own: those of the model's kind, otherwise always by the highest sum of scores."""

    def __init__(self, path: str, own: bool = False, limit: int = CACHE_BYTES):
        super().__init__()
        self.limit = limit
        self.pieces = Pieces(path)
        self.merges = own and self.pieces.merges
        self.held, self.older = 0, {}  # bytes of the newer generation, and the older one
        self.place, self.cut = self.boundaries()
        self.wide = math.isqrt(len(self.cut))
        self.kind, self.code = ("<u2", "H") if self.pieces.size <= 1 << 16 else ("<u4", "I")

    def boundaries(self) -> tuple[np.ndarray, np.ndarray]:
        """(place of a code point, whether a boundary lies between two places); a character that no piece holds beside another is at 0."""
        chars = sorted(c for c in {c for pair in self.pieces.inner for c in pair} if c != MARK)[: MOST_PLACES - 1]
        place = np.zeros(max([32, *map(ord, chars)]) + 2, np.int64)
        place[list(map(ord, chars))] = np.arange(1, len(chars) + 1)
        if not place[32]:  # stands for the mark
            place[32] = len(chars) + 1
        n = len(chars) + 2
        at, cut = {MARK: place[32]} | {c: k for k, c in enumerate(chars, 1)}, np.ones((n, n), bool)
        for x, y in self.pieces.inner:
            if x in at and y in at:
                cut[at[x], at[y]] = False
        for x, y in self.pieces.inner:  # what has no place of its own is told apart where it is missed
            if x not in at or y not in at:
                cut[at.get(x, 0), at.get(y, 0)] = False
        return place, cut.ravel()

    def ids(self, s: str) -> list[int]:
        p, out = self.pieces, []
        known = p.id.get
        for part in p.stream_merged(s) if self.merges else (s[a:b] for a, b in p.search(s)):
            i = known(part)
            if i is None:
                out.extend(p.byte_id[x] for x in part.encode("utf-8", "surrogatepass"))
            else:
                out.append(i)
        return out

    def __missing__(self, s: str) -> bytes:
        got = self.older.pop(s, None)
        if got is None:
            inner, marked = self.pieces.inner, s.replace(" ", MARK)
            cuts = [k for k in range(1, len(s)) if marked[k - 1 : k + 1] not in inner]
            if cuts:
                return b"".join(self[s[a:b]] for a, b in zip([0, *cuts], [*cuts, len(s)]))
            got = array(self.code, self.ids(marked)).tobytes() if s else b""
            if len(s) > 1024:  # hardly comes again
                return got
        self.held += _ENTRY + 2 * len(s) + len(got)
        if self.held > self.limit // 2:  # those not asked for since the last time go
            self.older = dict(self)
            self.clear()
            self.held = 0
        self[s] = got
        return got

    def literal(self) -> bytes:
        return np.array([self.pieces.byte_id[x] for x in MARK.encode()], self.kind).tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.pieces.splits:
            parts = (MARK + text.replace(" ", MARK) if k == 0 else text.replace(" ", MARK) for k, text in enumerate(text.split(MARK)))
            return self.literal().join(np.array(self.ids(p), self.kind).tobytes() for p in parts)
        text = " " + text
        if MARK in text or "\x1f" in text:
            parts = re.findall(rf"{MARK}|\n| +[^ \n{MARK}]*|[^ \n{MARK}]+", text)
            return b"".join(self.literal() if p == MARK else self[p] for p in parts)
        # A separator goes into every boundary, so that the stretches are cut and looked up without a step of Python for each.
        code, kind = ("ascii", np.uint8) if text.isascii() else ("utf-32-le", np.uint32)
        raw = np.frombuffer(text.encode(code, "surrogatepass"), kind)
        at = self.place.take(raw, mode="clip")
        pair = at[:-1] * self.wide + at[1:]
        cuts = np.flatnonzero(self.cut[pair])
        to = np.arange(len(cuts)) + cuts + 1  # of the separators
        out = np.empty(len(raw) + len(cuts), raw.dtype)
        there = np.ones(len(out), bool)
        there[to] = False
        out[to], out[there] = 0x1F, raw
        return b"".join(map(self.__getitem__, out.tobytes().decode(code, "surrogatepass").split("\x1f")))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.pieces.text.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")


@lru_cache(maxsize=2)
def _stretches(path: str, limit: int = CACHE_BYTES) -> _Stretches:
    return _Stretches(path, own=True, limit=limit)


def encode_ids(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "ids", keep_text: bool = True, cache_bytes: int = CACHE_BYTES, forget: bool = False) -> DataFrame:
    """docs with out_col array<int> appended (a column of that name is replaced); keep_text: whether the text stays.

    cache_bytes bounds the stretches that a task remembers: fewer cost time, never ids. forget: the model's tables and the stretches go
    with the task, for jobs that have other uses for their workers' memory; otherwise a worker keeps them for its next task.
    """
    bound_batches(docs.sparkSession)
    kept = docs.drop(out_col)
    names = [c for c in kept.columns if keep_text or c != text_col]

    def run(batches):
        yield from encoded(_Stretches(path, own=True, limit=cache_bytes) if forget else _stretches(path, cache_bytes), batches)
        if forget:
            give_back()

    def encoded(known, batches):
        for whole in batches:
            for batch in in_slices(whole, text_col, _SLICE):
                done, ends = [], [0]
                for t in batch.column(text_col):
                    done.append(known.encode(t.as_py() or ""))
                    ends.append(ends[-1] + len(done[-1]) // np.dtype(known.kind).itemsize)
                ids = np.frombuffer(b"".join(done), known.kind).astype(np.int32)
                yield pa.record_batch([*(batch.column(c) for c in names), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))], names=[*names, out_col])

    return kept.mapInArrow(run, kept.select(*(F.col(f"`{c}`") for c in names), F.lit(None).cast("array<int>").alias(out_col)).schema)


def decode_ids(docs: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """docs with out_col string appended; null ids decode to the empty text."""
    bound_batches(docs.sparkSession)
    kept = docs.drop(out_col)

    def run(batches):
        known = _stretches(path)
        for whole in batches:
            for batch in in_slices(whole, ids_col, _SLICE):
                col = batch.column(ids_col)
                texts = [known.decode(x.values.to_pylist()) if x.is_valid and len(x.values) else "" for x in col]
                yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out_col])

    return kept.mapInArrow(run, kept.withColumn(out_col, F.lit(None).cast("string")).schema)
