import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_op7 import brute as components
from tests.llm.test_op10 import brute as hits
from trailmark.llm.common import READ_ROWS, table
from trailmark.llm.op3_sentencepiece import MARK
from trailmark.llm.op9_secrets import find_secrets

D = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, seen = docs.columns, [{r.doc_id: r for r in docs.collect()}]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, D).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == 4 or docs.columns == columns
        seen.append({r.doc_id: r for r in docs.collect()})
    start, good, first, clean, safe, out = seen
    assert 0.5 * len(start) < len(good) <= len(start)
    marks = {r.doc_id: r for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    assert sum(i in good for i in start if i in marks and marks[i].quality and not marks[i].toxic) >= 0.9 * sum(bool(m.quality and not m.toxic) for m in marks.values())
    assert sorted(first) == sorted(i for i, (_, c) in components([(i, r.text) for i, r in good.items()]).items() if i == c)
    items = [tuple(r) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    assert sorted(clean) == sorted(i for i, _, n, _ in hits([(i, r.text) for i, r in first.items()], items) if n == 0)
    assert sorted(safe) == sorted(clean)
    for i, r in safe.items():
        assert not find_secrets(r.text) and r.n_chars == len(r.text)
        assert find_secrets(clean[i].text) or r == clean[i]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert not any(MARK in r.text for r in safe.values())
    assert {i: r.ids for i, r in out.items()} == {i: library.encode(r.text) for i, r in safe.items()}


def test_odd_rows(spark):
    rows = [(None, "one two three four five six"), (1, "one two three four five six"), (1, "one two three four five six"), (2, None), (2, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"), F.lit(1).alias("row"))
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, D)
    assert sorted((r.doc_id or 0, r.n_tokens > 0) for r in docs.collect()) == [(0, True), (2, False), (2, False), (3, False)]


def test_every_stage_takes_odd_rows(spark):
    """Nulls everywhere, repeated rows, long and empty texts, and columns that stages make themselves."""
    labels = spark.read.parquet(f"{D}/labels.parquet")
    some = spark.read.parquet(f"{D}/documents.parquet").join(labels.select("doc_id"), "doc_id").limit(60).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in some] + [(some[0].doc_id, some[0].text, some[0].lang, some[0].source, some[0].n_chars)]
    rows += [(None, "the text of a row without an id", None, None, None), (-5, None, None, "s", 0), (-6, "", "en", None, -3), (-7, "words and words " * 30_000, "en", "src0", 480_000), (-8, "token = abcdefghijkl12345 and plain words after it", "xx", "new source", None)]
    docs = spark.createDataFrame([(*r, 1, [2], 0.5, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _trailmark_row int, ids array<int>, p_text double, keep string")
    docs = docs.withColumnRenamed("keep", "n_tokens")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs.drop("_trailmark_row") if name != "quality" else docs, D)
        assert name == "tokens" or set(docs.columns) >= {"doc_id", "text", "lang", "source", "n_chars", "ids", "p_text", "n_tokens"}
        assert docs.count() <= before.count()
        if name == "secrets":
            assert all("abcdefghijkl12345" not in (r.text or "") for r in docs.collect())
    assert set(docs.columns) >= {"doc_id", "n_tokens", "ids"}


def test_empty_table(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, D)
        assert docs.count() == 0


def test_workers_forget_the_stretches_of_the_last_stage(spark):
    """The workers that made tokens serve other stages next: neither the model's tables nor the stretches stay in them."""
    docs = spark.range(0, 800, 1, 8).selectExpr("id AS doc_id", "'en' AS lang", "'s' AS source", "concat('some words of text ', id) AS text")
    assert corpus_pipeline.tokens(spark, docs, D).where("n_tokens = 0").count() == 0

    def left(batches):
        import gc

        from trailmark.llm.op3_sentencepiece import _Stretches

        for _ in batches:
            pass
        yield pa.record_batch([pa.array([sum(type(x) is _Stretches and x.limit == corpus_pipeline.TOKEN_CACHE for x in gc.get_objects())], pa.int64())], names=["n"])

    assert [r.n for r in spark.range(0, 8, 1, 8).mapInArrow(left, "n long").collect()] == [0] * 8


def test_quality_starts_no_workers_of_another_kind(spark, monkeypatch):
    """Rows of the driver that go through parallelize need Python workers of their own, beside those of mapInArrow."""

    def refused(*_, **__):
        raise AssertionError("rows went through a Python RDD")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refused)
    docs = spark.read.parquet(f"{D}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, D)
    assert 0 < kept.count() <= docs.count()


def test_parquet_batches_are_bounded_but_for_a_user_s_own(spark):
    name = "spark.sql.parquet.columnarReaderBatchSize"
    session = spark.newSession()
    table(session, D, "documents")
    assert session.conf.get(name) == READ_ROWS
    session.conf.set(name, "77")
    table(session, D, "documents")
    assert session.conf.get(name) == "77"
