import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2

from trailmark.llm.op3_sentencepiece import MARK, Pieces, _Stretches, decode_ids, encode_ids

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXT = st.lists(st.sampled_from([*"abcdeth  \n\n.É世▁\x1f", "ing", "the "]), max_size=60).map("".join)


def whole(pieces: Pieces, s: str) -> list[int]:
    """Brute force: every boundary's best score over the whole text, no window."""
    best, back = [0.0] + [None] * len(s), [0] * (len(s) + 1)
    for i in range(len(s)):
        known = False
        for j in range(i + 1, min(len(s), i + pieces.longest) + 1):
            if (v := pieces.score.get(s[i:j])) is not None:
                known |= j == i + 1
                if best[j] is None or best[i] + v > best[j]:
                    best[j], back[j] = best[i] + v, i
        if not known and (best[i + 1] is None or best[i] + pieces.unknown > best[i + 1]):
            best[i + 1], back[i + 1] = best[i] + pieces.unknown, i
    spans, at = [], len(s)
    while at:
        spans.append((back[at], at))
        at = back[at]
    return spans[::-1]


PIECES = Pieces(PATH)
KNOWN = _Stretches(PATH)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_stream_equals_whole(text):
    assert PIECES.search(text) == PIECES.inside_window(text) == whole(PIECES, text)
    s = MARK + text.replace(MARK, "").replace(" ", MARK)
    spans = whole(PIECES, s)
    ids = [x for a, b in spans for x in ([PIECES.id[s[a:b]]] if s[a:b] in PIECES.score else [PIECES.byte_id[y] for y in s[a:b].encode()])]
    import numpy as np

    plain = text.replace(MARK, "")
    assert np.frombuffer(KNOWN.encode(plain), KNOWN.kind).tolist() == (ids if plain else [])


def test_long_stream():
    text = "thequickbrownfoxandéthe世interestingly" * 400
    assert PIECES.search(text) == whole(PIECES, text)


def test_same_as_library():
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(PATH, "rb").read())
    proto.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    for t in ("hello world, the quick brown fox", "École 42\nnew line", "naïve  two spaces", "世界 q"):
        import numpy as np

        assert np.frombuffer(KNOWN.encode(t), KNOWN.kind).tolist() == library.encode(t)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_round_trip(text):
    import numpy as np

    assert KNOWN.decode(np.frombuffer(KNOWN.encode(text), KNOWN.kind).tolist()) == text


def test_frames(spark):
    rows = [(1, "the cat", 5), (1, "the cat", 5), (None, None, 6), (3, "", 7), (4, "x" * 50_000, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = decode_ids(encode_ids(df, PATH), PATH).collect()
    assert [r.decoded for r in out] == [r[1] or "" for r in rows]
    assert out[0].ids == out[1].ids and out[2].ids == []
    assert encode_ids(df.limit(0), PATH).count() == 0


def test_ids_are_the_models_own(spark):
    """Against the library with the model as shipped."""
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(100).collect() if MARK not in (r.text or "")]
    texts += ["École 42\nnew line", "naïve  two   spaces ", " 世界 q", "aaaaaaa", "thequickbrownfoxandéthe世interestingly" * 400, "x" * 3000]
    rows = encode_ids(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH).collect()
    assert len(rows) == len(texts) > 90
    for r in rows:
        assert r.ids == library.encode(r.text or "")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"aabcdeth.É世", "ing", "the ", "er"]), max_size=80).map("".join))
def test_merges_by_heap_equal_scans(text):
    import trailmark.llm.op3_sentencepiece as op3

    plain, limit = PIECES.merged(text), op3.SHORT_STRETCH
    try:
        op3.SHORT_STRETCH = 0 if len(text) <= limit else len(text)
        assert PIECES.merged(text) == plain
    finally:
        op3.SHORT_STRETCH = limit


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from([*"aabcdeth.É世", MARK, "ing", "the ", "er"]), max_size=80).map("".join))
def test_stream_of_merges_equals_merging_the_whole(text):
    """The boundary search of a BPE model against its merges over the whole text."""
    ends, want = 0, []
    for part in PIECES.merged(text):
        want.append((ends, ends + len(part)))
        ends += len(part)
    assert PIECES.search_merged(text) == want


def test_texts_longer_than_the_window():
    own = _Stretches(PATH, own=True)
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for text in ("thequickbrownfoxandéthe世interestingly" * 2000, "a" * 10_000, "".join(chr(97 + i * i % 26) for i in range(20_000))):
        assert own.ids(MARK + text) == library.encode(text)
        spans = PIECES.search_merged(text)
        assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_known_stretches_are_looked_up_without_a_miss(monkeypatch):
    """Stops, letters beyond ASCII and repeated blanks are cut before the lookup, not in a miss that comes again with every text."""
    own, texts = _Stretches(PATH, own=True), ["Naïve words, and more. ñandú: ß! éou", "two  blanks\n\nand 世界 q\x00", "plain words. Only (these)"]
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    first = [own.encode(t) for t in texts]
    assert [list(memoryview(x).cast("H")) for x in first] == [library.encode(t) for t in texts]
    missed = []
    monkeypatch.setattr(_Stretches, "__missing__", lambda self, s: missed.append(s) or b"")
    assert [own.encode(t) for t in texts] == first and not missed


def test_boundaries_without_places(monkeypatch):
    """Characters beyond the table's bound are told apart where they are missed."""
    import trailmark.llm.op3_sentencepiece as op3

    texts = ["Naïve words, and more.\nñandú: ß!  éou", "Привет, мир. éèê"]
    want = [_Stretches(PATH, own=True).encode(t) for t in texts]
    monkeypatch.setattr(op3, "MOST_PLACES", 20)
    assert [_Stretches(PATH, own=True).encode(t) for t in texts] == want
