import numpy as np

from trailmark.llm.op1_quality import _matrix, classify, fit, text_features

D = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    scored = classify(docs, fit(docs, labels.where("doc_id % 5 <> 0"))).join(labels.where("doc_id % 5 = 0"), "doc_id").toPandas()
    quality, toxic = scored.p_quality >= 0.5, scored.p_toxic >= 0.5
    assert (quality == (scored.quality == 1)).mean() >= 0.95
    assert (toxic == (scored.toxic == 1)).mean() >= 0.97
    assert toxic[scored.toxic == 1].mean() >= 0.85 and toxic[scored.toxic == 0].mean() <= 0.02
    assert quality[scored.quality == 1].mean() >= 0.96


def test_features():
    words, owner, style = text_features([b"", b"The the CAT", b"x" * 50, "é é".encode()])
    assert len(style) == 4 and np.isfinite(style).all()
    assert (owner == 1).sum() == 2 and (owner == 3).sum() == 1 and (owner == 0).sum() == 0


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, None, None, None, 1), (1, "a b", "en", "s", 3, 1), (1, "a b", "en", "s", 3, 1), (2, "", "en", "s", -1, 1)], "doc_id long, text string, lang string, source string, n_chars long, keep int")
    labels = spark.createDataFrame([(1, 1, None), (1, None, 0), (None, 1, 1), (7, 0, 1)], "doc_id long, quality int, toxic int")
    for marks in (labels, labels.limit(0)):
        out = classify(docs, fit(docs, marks)).collect()
        assert len(out) == 4 and all(0 <= r[c] <= 1 for r in out for c in ("p_text", "p_meta", "p_quality", "p_toxic"))
        assert out[1] == out[2]
    assert classify(docs.limit(0), fit(docs.limit(0), labels)).count() == 0


def test_labels_of_absent_documents_take_no_places(spark):
    docs = spark.createDataFrame([(i, ("fine words here" if i % 2 else "bad $$$ junk") + f" {i}", "en", "s", 15) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    own = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    absent = spark.createDataFrame([(i, i % 2, 0) for i in range(1000, 3000)], own.schema)
    got, want = fit(docs, own.union(absent), labelled=40, pool=1), fit(docs, own, labelled=40, pool=1)
    assert want.targets["quality"].text.any()
    assert np.array_equal(got.words, want.words) and np.allclose(got.targets["quality"].text, want.targets["quality"].text)


def test_exchange_takes_the_surest_of_all(spark):
    """The marks of a round against sorting the scores of all documents."""
    import trailmark.llm.op1_quality as op
    from pyspark.sql import functions as F

    docs, labels = spark.read.parquet(f"{D}/documents.parquet").where("doc_id < 3000"), spark.read.parquet(f"{D}/labels.parquet")
    model = fit(docs, labels)
    scored = classify(docs, model).withColumn("turn", F.xxhash64("doc_id")).toPandas()
    free = docs.select(F.col("doc_id").alias("id"), "text", "source", "lang", "n_chars", F.xxhash64("doc_id").alias("turn")).repartition(7)
    lists, taken = [("quality", 0, 1, 40), ("quality", 0, 0, 15), ("quality", 1, 1, 30)], {0: set(range(0, 3000, 2)), 1: set(), 2: set()}
    got = {n: [] for n in range(3)}
    for n, i in op._surest(free, model, "text", lists, taken):
        got[n].append(i)
    for n, (_, view, value, most) in enumerate(lists):
        p = scored["p_text" if view == 0 else "p_meta"]
        scored["sure"] = p if value else 1 - p
        some = scored[(scored.sure >= op.SURE) & ~scored.doc_id.isin(taken[n])].sort_values(["sure", "turn"], ascending=[False, True])
        assert got[n] == some.doc_id.tolist()[:most]
    assert len(got[0]) == 40


def test_long_text(spark):
    docs = spark.createDataFrame([(1, "plain words " * 150_000, "en", "s", 1_800_000), (2, "x", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    assert classify(docs, fit(docs, labels)).count() == 2


def test_rows_of_a_view_go_into_the_room_given():
    words, owner = np.array([3, 5, 5, 9], np.uint64), np.array([0, 0, 1, 2])
    style, known, cuts = np.array([[0.1], [0.5], [0.9]]), np.array([3, 9], np.uint64), np.array([[0.3, 0.6]])
    room = np.zeros((5, 5), np.float32)
    got = _matrix(words, owner, style, known, cuts, 3, room[1:4])
    assert np.shares_memory(got, room) and (room[1:4] == _matrix(words, owner, style, known, cuts, 3)).all() and not room[[0, 4]].any()


def test_words_of_the_sample_stay_off_the_driver(spark, monkeypatch):
    """Only the places of known words are gathered, and they give the model that counting on the driver gave."""
    import trailmark.llm.op1_quality as op

    docs = spark.createDataFrame([(i, ("fine words here " if i % 2 else "bad $$$ junk ") + " ".join(f"w{i}x{k}" for k in range(500)), "en", "s", 15) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    sizes, whole = [], type(docs).toArrow
    monkeypatch.setattr(type(docs), "toArrow", lambda df: sizes.append((got := whole(df)).nbytes) or got)
    model = op.fit(docs, labels)
    assert 0 < sum(sizes) < 60_000  # every text has over 500 words of its own
    texts = [r.text.encode() for r in docs.where("doc_id < 40").orderBy("doc_id").collect()]
    words, owner, _ = text_features(texts)
    kinds, index = np.unique(words, return_inverse=True)
    seen = np.bincount(index).astype(float)
    pos = np.bincount(index, weights=owner % 2 == 1)
    chi = np.where(seen >= 3, (pos - seen / 2) ** 2 / (seen / 2) * 2, -1)
    best = np.argsort(-chi, kind="stable")[: op.WORDS // 2]
    assert np.array_equal(model.words, np.sort(kinds[best[chi[best] > 0]]))
