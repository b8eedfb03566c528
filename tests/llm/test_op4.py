import hashlib
import random

from trailmark.llm.op4_suffix_dedup import suffix_dedup


def brute(docs, length):
    seen, out = {}, {}
    for row, text in docs:
        b = text.encode()
        cover = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                cover[s : s + length] = b"\1" * length
            else:
                seen[w] = 1
        spans = sum(1 for i, c in enumerate(cover) if c and (i == 0 or not cover[i - 1]))
        out[row] = (len(b), sum(cover), spans, hashlib.sha256(bytes(x for x, c in zip(b, cover) if not c)).hexdigest())
    return out


def corpus():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [prose(40) for _ in range(4)]
    docs = []
    for i in range(120):
        t = prose(rng.randint(0, 90))
        if i % 3 == 0:
            t += passages[i % 4] + prose(rng.randint(0, 20))
        if i % 7 == 0 and docs:
            t = docs[rng.randrange(len(docs))][1]
        if i % 11 == 0 and docs:
            x = docs[rng.randrange(len(docs))][1]
            k = rng.randrange(len(x) + 1)
            t = x[:k] + "Z" + x[k:]
        docs.append((i, t))
    docs += [(200, "a" * 500), (201, "ab" * 300), (202, ""), (203, "x" * 99), (204, passages[0] * 3)]
    return docs


def test_against_brute_force(spark):
    docs = corpus()
    shuffled = docs[:]
    random.Random(1).shuffle(shuffled)
    for parts in (1, 7):
        df = spark.createDataFrame([(i, t, "clash") for i, t in shuffled], "doc_id long, text string, row string").repartition(parts)
        for length, gram in ((100, 32), (30, 8)):
            got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(df, length=length, gram=gram).collect()}
            assert got == brute(docs, length)


def test_odd_rows(spark):
    t = "the quick brown fox jumps over the lazy dog " * 4
    df = spark.createDataFrame([(None, t), (1, t), (1, t), (2, None), (2, None)], "doc_id long, text string")
    got = sorted((r.id is not None, r.id or 0, r.n_bytes, r.n_removed > 100) for r in suffix_dedup(df).collect())
    assert got == [(False, 0, 176, True), (True, 1, 176, True), (True, 1, 176, True), (True, 2, 0, False), (True, 2, 0, False)]
    assert suffix_dedup(df.limit(0)).count() == 0


def test_long_text(spark):
    """Passages that repeat across the slices of a text of some megabytes, and one of another document in its middle."""
    rng = random.Random(44)
    noise = lambda n: "".join(chr(rng.randint(0x21, 0x7E)) for _ in range(n))
    a, b, c = noise(700), noise(150), noise(99)
    text = a + noise(1_050_000) + b + noise(1_100_000) + a + noise(10) + b + noise(50) + c + noise(900_000) + c
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup(spark.createDataFrame([(1, text), (2, noise(300) + b + noise(20))], "doc_id long, text string")).collect()}
    assert got == {1: (len(text), 850, 2), 2: (470, 150, 1)}
