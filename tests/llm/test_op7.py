import random
import re

from trailmark.llm.op7_jaccard import jaccard_components


def sets(docs, width=5):
    out = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    return out


def brute(docs):
    s = sets(docs)
    comp = {i: i for i in s}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(s)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {i: (len(s[i]), root(i)) for i in ids}


def corpus(n=260, seed=7):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgÉ") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    passage, docs = prose(60), []
    for i in range(n):
        t = prose(rng.randint(0, 70))
        if i % 4 == 0:
            t = t[: rng.randint(0, 30)] + passage + t[: rng.randint(0, 10)]
        if i % 3 == 0 and docs:
            t = docs[rng.randrange(len(docs))][1].split()
            for _ in range(rng.randint(0, 3)):
                if t:
                    t[rng.randrange(len(t))] = rng.choice(words)
        docs.append((i, rng.choice([" ", "  ", "\n"]).join(t)))
    docs += [(1000 + i, " ".join(passage[: 60 - i % 9])) for i in range(60)]
    return docs


def test_against_brute_force(spark, monkeypatch):
    import trailmark.llm.op7_jaccard as op

    for hot in (48, 3):
        monkeypatch.setattr(op, "HOT_FROM", hot)
        docs = corpus(seed=hot)
        mixed = [(i, t, i, "x") for i, t in docs]
        random.Random(2).shuffle(mixed)
        df = spark.createDataFrame(mixed, "doc_id long, text string, n long, component string").repartition(5)
        got = {r.id: (r.n, r.component_id) for r in jaccard_components(df).collect()}
        assert got == brute(docs)


def test_odd_rows(spark):
    t = "one two three four five six seven"
    df = spark.createDataFrame([(None, t), (5, t), (5, t.upper()), (6, None), (7, ""), (8, " \n"), (9, "a b"), (10, "A  b")], "doc_id long, text string")
    got = sorted(((r.id or -1), r.n, r.component_id or -1) for r in jaccard_components(df).collect())
    assert got == [(-1, 3, -1), (5, 3, -1), (5, 3, -1), (6, 0, 6), (7, 0, 7), (8, 0, 8), (9, 1, 9), (10, 1, 9)]
    assert jaccard_components(df.limit(0)).count() == 0


def test_families_that_share_a_passage_open_few_pairs(spark):
    """Two families of near copies with a passage in common: pairs of their members must not grow with their product."""
    from urllib.parse import urlparse
    from pathlib import Path

    from trailmark.llm.common import shared_dir

    folder = Path(urlparse(shared_dir(spark)).path)
    opened = []
    for n in (80,):
        rng = random.Random(n)
        words = [f"w{k}" for k in range(5000)]
        passage = [rng.choice(words) for _ in range(60)]
        docs = []
        for family in range(2):
            base = [rng.choice(words) for _ in range(200)]
            for i in range(n):
                t = base[:100] + passage + base[100:]
                t[rng.randrange(len(t))] = f"x{family}{i}"
                docs.append((family * n + i, " ".join(t)))
        before = set(folder.glob("op7-cross-open-*"))
        got = {r.id: (r.n, r.component_id) for r in jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        assert got == brute(docs) and {c for _, c in got.values()} == {0, n}
        (made,) = set(folder.glob("op7-cross-open-*")) - before
        opened.append(spark.read.parquet(str(made)).count())
    assert opened[0] <= 4 * 80, opened  # of 9,480 pairs


def test_long_text_and_null_columns(spark):
    t = " ".join(f"word{i % 977}x{i // 977}" for i in range(200_000))  # over one slice of bytes
    docs = [(1, t), (2, t + " tail"), (3, t[: len(t) // 2]), (4, None)]
    got = {r.id: (r.n, r.component_id) for r in jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1] == (199_996, 1) and got[2] == (199_997, 1) and got[3][1] == 3 and got[4] == (0, 4)
