"""Training-data pipeline: five stages over `documents`, each one of the package's operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs of the
next one. All but the last return the columns of documents.

1.  quality: documents that the co-trained classifier rejects (poor or toxic) go.
2.  near_duplicates: of every group of documents linked by shingle similarity the smallest doc_id stays.
3.  decontamination: documents with an exact benchmark window go.
4.  secrets: findings in the text are replaced by a mark, n_chars follows.
5.  tokens: the text becomes SentencePiece ids.

Null texts count as empty and stay, as do null ids; of repeated rows with any words one stays; an empty table passes
through every stage; extra columns pass all stages but the last. Columns that a stage makes for itself are its own: p_text, p_meta, p_quality,
p_toxic and keep are replaced by quality, _trailmark_row is dropped. Texts of any length pass whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm.common import ROW, checked_broadcast, save, table, with_rows
from trailmark.llm.op1_quality import classify, fit
from trailmark.llm.op3_sentencepiece import encode_ids
from trailmark.llm.op7_jaccard import jaccard_components
from trailmark.llm.op9_secrets import redact
from trailmark.llm.op10_decontaminate import contamination

#: Bytes of stretches that a task of the last stage remembers, and forgets at its end: the same Python workers serve the other stages of later runs.
TOKEN_CACHE = 48 << 20


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))
    return classify(docs, model).where("keep").select(docs.columns)


def _staying(docs: DataFrame, rows: DataFrame, tag: str) -> DataFrame:
    """docs (with ROW) whose row is in rows."""
    rows = save(rows.select(F.col("row").alias(ROW)), tag)
    return docs.join(checked_broadcast(rows, rows.count()), ROW, "left_semi").drop(ROW)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = with_rows(docs)
    found = jaccard_components(docs.select(ROW, "text"), id_col=ROW)
    return _staying(docs, found.where("row = component"), "pipeline-first")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = with_rows(docs)
    found = contamination(docs.select(ROW, "text"), table(spark, sf_dir, "benchmark", "item_id", "text"), id_col=ROW)
    return _staying(docs, found.where("n_hit = 0"), "pipeline-clean")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    texts = docs.select("doc_id", "lang", "source", "text")
    out = encode_ids(texts, public_tokenizers.path("piece_bpe_32k.model"), keep_text=False, cache_bytes=TOKEN_CACHE, forget=True)
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("tokens", tokens),
]

#: SQL can't express the classifier, nor the stages after it on what it keeps; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
