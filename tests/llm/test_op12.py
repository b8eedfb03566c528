import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from trailmark.llm import op12_language
from trailmark.llm.op12_language import UNIFORM, Models, _rising, folds, gram_model, identify

D = "/root/testdata/sf0.01"


def words(text):
    return "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()


class Plain:
    """Interpolated Kneser-Ney by dictionaries, from the definition."""

    def __init__(self, texts, order):
        self.order = order
        n = [Counter() for _ in range(order + 1)]
        for t in texts:
            for w in words(t):
                s = f" {w} "
                for j in range(1, len(s)):
                    k = min(j + 1, order)
                    n[k][s[j - k + 1 : j + 1]] += 1
        for k in range(order - 1, 0, -1):
            n[k].update(Counter(g[1:] for g in n[k + 1]))
        self.n, self.d, self.total, self.kinds = n, {}, defaultdict(int), defaultdict(int)
        for k in range(1, order + 1):
            one, two = (sum(v == x for v in n[k].values()) for x in (1, 2))
            self.d[k] = one / (one + 2 * two) if one else 0.5
            for g, v in n[k].items():
                self.total[g[:-1]] += v
                self.kinds[g[:-1]] += min(v, self.d[k])

    def p(self, c, h):
        lower = self.p(c, h[1:]) if h else UNIFORM
        if not self.total[h]:
            return lower
        k = len(h) + 1
        return max(self.n[k][h + c] - self.d[k], 0) / self.total[h] + self.kinds[h] / self.total[h] * lower

    def cost(self, word):
        s = f" {word} "
        return -sum(math.log(self.p(s[j], s[max(0, j - self.order + 1) : j])) for j in range(1, len(s)))


def prose(rng, alphabet, n):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 7))) for _ in range(n))


def test_models_against_plain_counts(spark):
    rng = random.Random(12)
    rows = [(lang, prose(rng, alphabet, rng.randint(0, 40)) + rng.choice(["", " İx.ß!", " 日本", "-" * 9])) for lang, alphabet in (("b", "aabc"), ("a", "aabdé")) for _ in range(80)]
    for order in (2, 5):
        model = Models(gram_model(spark.createDataFrame(rows, "lang string, text string").repartition(3), order).toArrow(), order)
        assert model.langs == ["a", "b"]
        asked = ["a", "abc", "ccccccc", "zzz", "é", "bdaé", "日", "aab"]
        codes = np.frombuffer("".join(f" {w} " for w in asked).encode("utf-32-le"), np.uint32)
        at = np.cumsum([0, *(len(w) + 2 for w in asked)])[:-1]
        got = model.entropies(codes, at)
        for i, lang in enumerate(model.langs):
            plain = Plain([t for x, t in rows if x == lang], order)
            assert np.allclose(got[i], [plain.cost(w) for w in asked], rtol=1e-9)


def test_pruned_model_sums_to_one(spark):
    rng = random.Random(5)
    rows = [("x", prose(rng, "abcdefgh", 60)) for _ in range(60)]
    for bound in (1_000_000, 900):
        model = Models(gram_model(spark.createDataFrame(rows, "lang string, text string"), 4, bound).toArrow(), 4)
        cost = lambda s: model.entropies(np.array([ord(c) for c in " " + s], np.uint32), np.array([0]))[0][0]
        for history in ("", "a", "abc", "hgf"):
            total = sum(math.exp(cost(history) - cost(history + c)) for c in "abcdefgh ")
            assert abs(total - 1) < 1e-3  # the rest is left to characters that no text has
    assert len(model.keys[0]) < 2000


def test_large_models_are_whole(spark, monkeypatch):
    """Beyond the grams that go to all tasks a model is joined: the same predictions and entropies as with all grams there."""
    rng = random.Random(21)
    made = {"a": "aabcdefgh", "b": "hgfedcbba", "c": "abcdxyz\u00e9\U0001d400"}
    rows = [(i % 350, prose(rng, made["abc"[i % 3]], rng.randint(0, 50)) + rng.choice(["", " \u65e5\u672c", " " + "abcd" * 30]), None if i % 11 == 0 else "abc"[i % 3]) for i in range(400)]
    df = spark.createDataFrame([*rows, (None, None, "a"), (None, "", "b"), (401, "qq qq", None)], "doc_id long, text string, lang string").repartition(4)
    key = lambda r: (str(r.id), r.held_out, r.lang_pred, -1.0 if r.entropy is None else round(r.entropy, 5))
    want = sorted(identify(df).collect(), key=key)
    for bound, words in ((0, 300_000), (400, 300_000), (1500, 20)):
        monkeypatch.setattr(op12_language, "HELD_WORDS", words)
        monkeypatch.setattr(op12_language, "_SLICE", 3000)
        got = sorted(identify(df, max_grams=bound).collect(), key=key)
        assert [(*key(r), r.score, r.rejected) for r in got] == [(*key(r), r.score, r.rejected) for r in want]
        assert all(abs((r.entropy or 0) - (w.entropy or 0)) < 1e-9 for r, w in zip(got, want, strict=True))
    lengths = [len(m.keys[0]) for m in (Models(gram_model(df.where("lang = 'a'").select("lang", "text"), 5, bound).toArrow(), 5) for bound in (None, 1500))]
    assert lengths[0] > lengths[1]  # the bound would have cut this model


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    got = identify(docs).join(docs.select(F.col("doc_id").alias("id"), "lang"), "id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out]
    assert len(held) > 100 and sum(r.lang_pred == r.lang for r in held) >= 0.99 * len(held)
    assert all(0 <= r.score <= 1 for r in got) and all(r.held_out == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)


def test_labels_of_held_out_rows_are_never_read(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    hidden = docs.withColumn("lang", F.when(folds() != 0, F.col("lang")).otherwise("nonsense"))
    assert sorted(identify(docs).collect()) == sorted(identify(hidden).collect())


def test_odd_rows(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, prose(rng, "abc" if i % 2 else "xyz", 30), "abc" if i % 2 else "xyz", "n") for i in range(200)]
    rows += [(1000, None, "abc", ""), (1001, "", "xyz", ""), (1002, "123 !? \n", None, ""), (1003, "abba " * 200_000, None, ""), (None, "zyx zyx", None, ""), (7, "cab", "abc", ""), (7, "cab", "abc", ""), (1004, "w\u00fc\U0001d400\u0130", None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, pred string").repartition(4)
    got = {}
    for r in identify(df).collect():
        got.setdefault(r.id, []).append(r)
    assert [got[i][0].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1000][0].score == 0.0 and got[1000][0].rejected
    assert got[1003][0].lang_pred == "abc" and got[None][0].lang_pred == "xyz" and len(got[7]) == 3
    assert got[1004][0].rejected and got[1004][0].lang_pred in ("abc", "xyz")
    assert sum(r.lang_pred == ("abc" if r.id % 2 else "xyz") for i in range(200) for r in got[i]) >= 200


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert identify(empty).count() == 0
    df = spark.createDataFrame([(1, "a", None), (2, None, "x")], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in identify(df).collect()] == [("und", 0.0)] * 2
    one = spark.createDataFrame([(i, "only words", "x") for i in range(30)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in identify(one).collect()} == {"x"}


def test_pooled_shares_rise():
    right, total = np.array([0, 3, 1, 9, 0, 50]), np.array([0, 4, 4, 10, 0, 50])
    got = _rising(right, total)
    assert len(got) == 6 and (np.diff(got) >= 0).all() and got[1] == got[2] == 5 / 10
    assert (_rising(np.zeros(4, int), np.zeros(4, int)) == 0.5).all()


def test_words_forgotten_in_between(monkeypatch):
    monkeypatch.setattr(op12_language, "HELD_WORDS", 10)
    monkeypatch.setattr(op12_language, "_SLICE", 60)
    pa = op12_language.pa
    rows = pa.table({"lang": ["x", "x", "y"], "gram": ["", "a", "b"], "p": [0.0, 0.5, 0.5], "weight": [0.5, 1.0, 1.0]})
    shared = type("S", (), {"value": Models(rows, 3)})
    texts = [prose(random.Random(i), "ab", 12) for i in range(20)]
    batch = pa.record_batch([pa.array(range(20)), pa.array([2] * 20), pa.nulls(20, pa.string()), pa.array(texts)], names=["id", "fold", "lang", "text"])
    got = [r for b in op12_language._scorer(shared)(iter([batch])) for r in b.to_pylist()]
    monkeypatch.setattr(op12_language, "HELD_WORDS", 10_000)
    assert np.allclose([r["first"] for r in got], [r["first"] for b in op12_language._scorer(shared)(iter([batch])) for r in b.to_pylist()])
