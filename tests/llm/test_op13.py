import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from trailmark.llm import op13_alignment
from trailmark.llm.op13_alignment import align, byte_level

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_tokens(text, a, b):
    """Tokens of both as (id, start, end), by the libraries alone; none where the bytes differ."""
    letters, raw = byte_level(), (" " + text).encode()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
    if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
        return [], []
    out = []
    for ids, parts in ((ids_a, bytes_a), (ids_b, bytes_b)):
        at, spans = 0, []
        for i, p in zip(ids, parts):
            spans.append((i, at, at + len(p)))
            at += len(p)
        out.append(spans)
    return out


def brute(rows):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    docs, counts = [], Counter()
    for i, text in rows:
        x, y = plain_tokens(text or "", a, b)
        links = [(p, q) for p, s, e in x for q, s2, e2 in y if s < e2 and s2 < e]
        cuts = sorted({e for _, _, e in x} & {e for _, _, e in y})
        groups = [(",".join(str(p) for p, s, e in x if lo < e <= hi), ",".join(str(q) for q, s, e in y if lo < e <= hi)) for lo, hi in zip([0, *cuts], cuts)]
        docs.append((i, len(x), len(y), groups, links))
        counts.update(set(links))
    high = defaultdict(int)
    for (p, _), n in counts.items():
        high[p] = max(high[p], n)
    out = []
    for i, n_a, n_b, groups, links in docs:
        said = ";".join("|".join(g) for g in groups)
        out.append((i, n_a, n_b, len(groups), len(links), sum(counts[x] == high[x[0]] for x in links), sum(counts[x] for x in links), hashlib.sha256(said.encode()).hexdigest() if n_a else "", said))
    return sorted(out, key=repr)


ODD = [
    "", None, " ", "  ", "\n", "a", " a", "a ", "a  b", "x \n y", "don't we'll  'S", "a b c", "a 　 b", "e\x00f \x1c g\x1d h", "▁a b", "a ▁", "<|endoftext|> <s></s> <0x0A> <unk>",
    "日本語 テキスト 😀 👩‍👩‍👧 ‍", "ÀÉ ñ ß ﬁ İ", "word" * 300, "1234567 89.10", "tabs\tand\r\nlines\x0b\x0c\x85   end\n", "﻿ bom", "é combining", "a" * 5000 + " " + "b" * 3000,
]


def rows():
    rng = random.Random(13)
    vocabulary = ["the", "Straße", "été", "niño", "running,", "e.g.", "2024", "(x)", "naïve", "I'm", "<s>", "—", "zzzqx", "\t", "\n", "", "日本"]
    made = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40))) for _ in range(120)]
    out = list(enumerate(ODD + made))
    return out + [(None, "the the"), (5, "a"), (5, "a")]


@pytest.mark.parametrize("held", [4_000_000, 150])
def test_against_brute_force(spark, held):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows()], "doc_id long, text string, row string").repartition(4)
    got = [tuple(r) for r in align(df, A, B, groups=True, max_pairs=held).collect()]
    assert sorted(got, key=repr) == brute(rows())


def test_long_text_in_many_slices(monkeypatch):
    monkeypatch.setattr(op13_alignment, "_JOINED", 50)
    monkeypatch.setattr(op13_alignment, "HELD_STRETCHES", 20)
    both = op13_alignment.Tokenizers(A, B)
    text = " ".join(t for _, t in rows() if t and "▁" not in t) * 3
    s = op13_alignment._Slice(op13_alignment.Aligned(both), [text])
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    x, y = plain_tokens(text, a, sentencepiece.SentencePieceProcessor(model_file=B))
    assert s.whole.all()
    assert (s.total(s.aligned.n_a)[0], s.total(s.aligned.n_b)[0]) == (len(x), len(y))


def test_stretches_join_to_the_text():
    both = op13_alignment.Tokenizers(A, B)
    assert both.cuts
    for _, t in rows():
        if t:
            assert "".join(" " + p for p in both.stretches(t)) == " " + t


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert align(df, A, B).count() == 0
    got = align(spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string"), A, B).collect()
    assert {tuple(r)[1:] for r in got} == {(0, 0, 0, 0, 0, 0, "")}
