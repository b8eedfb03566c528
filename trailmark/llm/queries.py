"""Registered queries of the training-data operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from .common import table
from .op1_quality import classify, fit
from .op2_chat import conversation_replies, format_chats, read_masked, read_turns
from .op3_sentencepiece import decode_ids, encode_ids
from .op4_suffix_dedup import suffix_dedup
from .op5_token_files import read_tokens, write_tokens
from .op6_html import extract_text
from .op7_jaccard import jaccard_components
from .op8_ann import nearest
from .op9_secrets import scan_secrets
from .op10_decontaminate import contamination
from .op11_phrases import collocations
from .op12_language import identify
from .op13_alignment import align

WORD_TOKENIZER = "word_bpe_49k.json"
PIECE_MODEL = "piece_bpe_32k.model"
BYTE_TOKENIZER = "byte_bpe_50k.json"


def op1_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source", "n_chars")
    model = fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))
    return classify(docs, model).select("doc_id", "p_text", "p_meta", "p_quality", "p_toxic", "keep")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one (-1) of control strings, with digests of what the formatted text reads back as."""
    odd = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    chats = format_chats(conversation_replies(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").union(odd)))
    read = chats.select("thread", "chat", read_turns(F.col("chat")).alias("turns"), read_masked(F.col("chat"), F.col("mask")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.expr("try_cast(thread as bigint)").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("chat").cast("long").alias("formatted_chars"),
    )


_OP2_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), pieces AS (
  SELECT *, regexp_replace(replace(text, '\', '\\'), '([<\[])(/?s>|/?INST\]|</?SYS>>|/?SYS>>|\|[A-Za-z0-9_]+\|>|(?:start|end)_of_turn>)', '\1\\:\2', 'g') AS body FROM rows
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>') + length(role) + 1 + length(body) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM pieces GROUP BY conv_id
"""


def op3_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """Ids of every whole text, and the text decoded from them again."""
    model = model or public_tokenizers.path(PIECE_MODEL)
    docs = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    out = decode_ids(encode_ids(docs, model, keep_text=False), model)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.sha2("decoded", 256) == F.col("text_sha256")).alias("round_trip"),
    )


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    blocks, ids = write_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer or public_tokenizers.path(WORD_TOKENIZER))
    out = read_tokens(blocks)
    out = out.withColumn("id", F.col("row")) if ids is None else out.join(ids, "row")
    return out.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_components(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


#: All pairs of texts that share a shingle, and every text that links reach: right, but only for small tables.
_OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) c USING (doc_id)
"""


def op8_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(table(spark, sf_dir, "documents", "doc_id", "text"))
    said = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"].isin("assign", "access", "hex"))
    return out.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("secrets")).alias("spans"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return out.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "n_near",
    )


_OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS term, generate_subscripts(ws, 1) - 1 AS pos FROM d),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item, unnest(list_transform(range(1, greatest(len(ws) - 9, 1) + 1), lambda k: array_to_string(ws[k:k + 9], ' '))) AS phrase FROM i WHERE len(ws) > 0),
ph AS (SELECT DISTINCT phrase, string_split(phrase, ' ') AS ps FROM win),
terms AS (SELECT phrase, len(ps) AS n, unnest(ps) AS term, generate_subscripts(ps, 1) - 1 AS off FROM ph),
counts AS (SELECT term, count(*) AS many FROM t GROUP BY term),
ranked AS (SELECT phrase, n, term, off, row_number() OVER (PARTITION BY phrase ORDER BY coalesce(many, 0), off) AS k FROM terms LEFT JOIN counts USING (term)),
met AS (SELECT phrase, n, k, doc_id, pos - off AS start FROM ranked JOIN t USING (term) WHERE k <= 2),
said AS (SELECT m.doc_id, m.phrase, m.start, m.n FROM met m JOIN d USING (doc_id) WHERE m.k = 1 AND m.start >= 0 AND array_to_string(d.ws[m.start + 1:m.start + m.n], ' ') = m.phrase),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(start, start + n)) AS pos FROM said) GROUP BY doc_id),
of_item AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM said JOIN win USING (phrase) GROUP BY doc_id),
near AS (SELECT a.doc_id, count(DISTINCT item) AS n_near FROM met a JOIN met b ON a.phrase = b.phrase AND a.doc_id = b.doc_id AND a.k = 1 AND b.k = 2 AND a.start <> b.start AND abs(a.start - b.start) <= 3 JOIN win w ON w.phrase = a.phrase GROUP BY a.doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN of_item USING (doc_id) LEFT JOIN near USING (doc_id)
"""


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents", "text", "lang"))


_OP11_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
t AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 5) AS r(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY lang, k, phrase HAVING count(*) >= 30),
c AS (SELECT lang, phrase, k, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
parts AS (SELECT lang, phrase, a, cut, array_to_string(ws[:cut], ' ') AS lp, array_to_string(ws[cut + 1:], ' ') AS rp FROM c, range(1, 4) AS r(cut) WHERE cut < k),
cuts AS (SELECT p.lang, p.phrase, p.a, cut, x.a AS l, y.a AS r, CAST(2000000 * CAST(p.a AS HUGEINT) // (x.a + y.a) AS BIGINT) AS score FROM parts p JOIN f x ON x.lang = p.lang AND x.phrase = lp JOIN f y ON y.lang = p.lang AND y.phrase = rp),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (SELECT lang, a, array_to_string(ws[i:i + n - 1], ' ') AS phrase FROM c, range(2, 4) AS s(n), range(1, 4) AS q(i) WHERE n < k AND i + n - 1 <= k),
longer AS (SELECT lang, phrase, max(a) AS longer FROM inside GROUP BY lang, phrase),
kept AS (SELECT low.* FROM low LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < 80 * CAST(a AS HUGEINT))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN t USING (lang) QUALIFY rank <= 2000
"""


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents", "doc_id", "text", "lang")).withColumnRenamed("id", "doc_id")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = align(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path(BYTE_TOKENIZER), public_tokenizers.path(PIECE_MODEL))
    return out.withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_co_training": op1_co_training,
    "op2_chat_format": op2_chat_format,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_token_files": op5_token_files,
    "op6_html_extract": op6_html_extract,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_ann_search": op8_ann_search,
    "op9_secret_scan": op9_secret_scan,
    "op10_decontaminate": op10_decontaminate,
    "op11_collocations": op11_collocations,
    "op12_language_id": op12_language_id,
    "op13_token_alignment": op13_token_alignment,
}

ORACLES: dict[str, str] = {"op2_chat_format": _OP2_SQL, "op7_ngram_jaccard": _OP7_SQL, "op10_decontaminate": _OP10_SQL, "op11_collocations": _OP11_SQL}
