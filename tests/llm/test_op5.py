import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trailmark.llm.op5_token_files import Block, EliasFano, pack_block, read_tokens, write_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), min_size=1, max_size=700))
def test_elias_fano(values):
    values = sorted(values)
    made, at = EliasFano.load(memoryview(EliasFano.of(np.array(values), values[-1]).dump()), 0)
    assert made.all().tolist() == values
    assert [made.select(i) for i in range(len(values))] == values


def test_block():
    docs = [np.arange(k, dtype="<u2").tobytes() for k in (1, 5, 0, 300)]
    block = Block(pack_block([7, 9, 1 << 40, 1 << 41], docs, 2))
    assert [block.document(i).tobytes() for i in range(4)] == docs
    assert (block.keys.all() + 7).tolist() == [7, 9, 1 << 40, 1 << 41]


def test_same_as_library(spark):
    rng = np.random.default_rng(5)
    odd = ["it's 42nd_place, don't!", "É́cole ΑΣ Σ", "x" * 3000, "a\r\n\tb\x85c　d", "'S 'll''re", "日本語 テキスト", "<|endoftext|> x<|endoftext|>", "İstanbul ẞ ﬁ", "", None, "İ ́a"]
    docs = [(i, "".join(rng.choice(list("abcé' .,0\n\tAB_-<|>"), int(rng.integers(0, 80))))) for i in range(200)] + [(1000 - k, t) for k, t in enumerate(odd)]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, start int").repartition(6)
    blocks, _ = write_tokens(df, PATH)
    got = [tuple(r) for r in read_tokens(blocks).orderBy("row").collect()]
    library, start, want = Tokenizer.from_file(PATH), 0, []
    for i, t in sorted(docs, key=lambda d: d[0]):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "b"), (1, "a"), (1, "a"), (2, None)], "doc_id long, text string")
    blocks, ids = write_tokens(df, PATH)
    got = [(r.id, r.start, r.n_tokens) for r in read_tokens(blocks).join(ids, "row").orderBy("row").collect()]
    assert got == [(None, 0, 2), (1, 2, 2), (1, 4, 2), (2, 6, 1)]
    blocks, _ = write_tokens(df.limit(0), PATH)
    assert read_tokens(blocks).count() == 0


def test_long_text(spark):
    text = "Some words, 42 of them; and a naïve end.\n" * 40_000
    blocks, _ = write_tokens(spark.createDataFrame([(1, text), (2, "b")], "doc_id long, text string"), PATH)
    ids = [*Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids, 1]
    got = [tuple(r) for r in read_tokens(blocks).orderBy("row").collect()]
    assert got[0] == (1, 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) and got[1][:2] == (2, len(ids))
