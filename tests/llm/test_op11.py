import random
import re
from collections import Counter, defaultdict

from trailmark.llm.op11_phrases import collocations, frequent_phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_count, top, longest=4):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if a >= min_count}
        longer = Counter()
        for p, a in often.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        rows = []
        for p, a in often.items():
            if len(p) > 1 and 100 * longer[p] < 80 * a:
                score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def texts(rng, n):
    vocabulary = ["A", "b", "É", "é", "ß", "x1", "(c)", "d-e", "\x00", "\u00a0", "長い"]
    out = []
    for _ in range(n):
        said = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", ";", "! "]) for _ in range(rng.randint(0, 60)))
        if rng.random() < 0.4:
            said += rng.choice([" ", "."]) + "p q r s t"
        out.append((said, rng.choice(["xx", "xx", "xx", "yy", None, ""])))
    return out


def test_against_brute_force(spark):
    rows = texts(random.Random(11), 400) + [(None, "xx"), ("", None), (" . ", "zz"), ("same same same " * 500, "yy"), ("w " * 100_000, "long")]
    rows += rows[:20]
    df = spark.createDataFrame([(t, v, 1, "n") for t, v in rows], "text string, lang string, w1 int, phrase string").repartition(5)
    for min_count, top in ((30, 2000), (5, 40)):
        got = [tuple(r) for r in collocations(df, min_count=min_count, top=top).collect()]
        assert sorted(got) == brute(rows, min_count, top)
    assert len({g[0] for g in got}) == 5


def test_chunks_and_flushes(spark, monkeypatch):
    """Prefixes that several chunks and several batches of a task hold."""
    from trailmark.llm import op11_phrases

    rng = random.Random(12)
    rows = [(" ".join(rng.choice("abc") for _ in range(400)), "xx") for _ in range(60)]
    table = op11_phrases.pa.table({"lang": ["xx"] * 6, "w1": [1] * 6, "w2": [2] * 6, "w3": [3, 3, 3, 4, 4, 5], "w4": [0, 6, 7, 0, 8, 0], "n": [4, 3, 2, 2, 2, 1]})
    monkeypatch.setattr(op11_phrases, "HELD_ROWS", 8)
    grown = [tuple(r.values()) for b in op11_phrases._grower(3, 4)(iter(op11_phrases.pa.Table.to_batches(table, max_chunksize=2))) for r in b.to_pylist()]
    counts = Counter()
    for row in grown:
        counts[row[1:5]] += row[6]
    assert {k: v for k, v in counts.items() if v >= 3} == {(1, 2, 0, 0): 14, (1, 2, 3, 0): 9, (1, 2, 3, 6): 3, (1, 2, 4, 0): 4}
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    assert sorted(tuple(r) for r in collocations(df, min_count=10).collect()) == brute(rows, 10, 2000)


def test_empty(spark):
    df = spark.createDataFrame([], "text string, lang string")
    assert collocations(df).count() == 0
    phrases, spelling, totals = frequent_phrases(df)
    assert phrases.count() == spelling.count() == totals.count() == 0
    assert collocations(spark.createDataFrame([(None, None), ("", "x")], "text string, lang string")).count() == 0
