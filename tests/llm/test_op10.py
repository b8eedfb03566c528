import random
import re

from trailmark.llm.op10_decontaminate import contamination, find_benchmark


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, width=10):
    out = []
    for i, t in docs:
        w, hit, met = words(t), set(), set()
        for item, text in items:
            v = words(text)
            k = min(width, len(v))
            for a in range(max(len(v) - width, 0) + 1) if v else ():
                for s in range(len(w) - k + 1):
                    if w[s : s + k] == v[a : a + k]:
                        hit.update(range(s, s + k))
                        met.add(str(item))
        out.append((i, len(w), len(hit), sorted(met)))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rng = random.Random(10)
    vocabulary = ["".join(rng.choice("abÉé9Z") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", ",", "."]) for _ in range(n))
    items = [(i, prose(rng.randint(8, 30))) for i in range(25)] + [(100, "q w"), (101, ""), (102, None), (103, "solo"), (104, "a a a a a a a a a a a a"), (105, items_text := prose(15)), (106, items_text)]
    docs = []
    for i in range(150):
        t = prose(rng.randint(0, 60))
        if i % 2:
            v = items[rng.randrange(len(items))][1] or ""
            t = t[: rng.randint(0, len(t))] + " | " + v.upper()[rng.randint(0, 5) :] + " | " + t[: rng.randint(0, 20)]
        docs.append((i, t))
    docs += [(500, "a " * 3000), (501, "solo q w"), (502, None), (503, ""), (503, ""), (None, "Solo")]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, row string").repartition(4)
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, row string")
    got = sorted(((r.id, r.n_words, r.n_hit, r["items"]) for r in contamination(d, b).collect()), key=repr)
    assert got == brute(docs, items)


def test_proximity_and_empty(spark):
    d = spark.createDataFrame([(1, "x rare1 filler rare2 y"), (2, "rare1 a b c d e f g rare2")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "rare1 rare2")], "item_id long, text string")
    _, exact, near = find_benchmark(d, b)
    assert exact.count() == 0 and [tuple(r) for r in near.collect()] == [(1, "7")]
    assert contamination(d.limit(0), b).count() == 0
    assert [r.n_hit for r in contamination(d, b.limit(0)).collect()] == [0, 0]


def test_long_text(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    d = spark.createDataFrame([(1, "common words " * 100_000 + item + " end " * 1000), (2, "alpha " * 50_000)], "doc_id long, text string")
    got = {r.id: (r.n_words, r.n_hit, r["items"]) for r in contamination(d, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert got == {1: (201_011, 11, ["7"]), 2: (50_000, 0, [])}
