"""The registered queries: their contract columns, and those with SQL against DuckDB."""

import duckdb
import pytest

from trailmark.llm.queries import ORACLES, QUERIES

D = "/root/testdata/sf0.001"
COLUMNS = {
    "op2_chat_format": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op4_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op5_token_files": "doc_id start n_tokens ids_crc32",
    "op6_html_extract": "page_id url text n_chars",
    "op7_ngram_jaccard": "doc_id n_shingles component_id",
    "op8_ann_search": "query_id rank vec_id score",
    "op9_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op10_decontaminate": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op11_collocations": "lang rank phrase a l r n score",
    "op12_language_id": "doc_id held_out lang_pred score",
    "op13_token_alignment": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract_columns(spark, name):
    df = QUERIES[name](spark, D)
    types = dict(df.dtypes)
    assert set(COLUMNS[name].split()) <= types.keys()
    words = name == "op11_collocations"
    assert all(types[c] == ("int" if c == "rank" and not words else "double" if c == "score" and not words else "boolean" if c in ("contaminated", "held_out") else "string" if c in ("url", "text", "spans", "lang", "phrase", "lang_pred") or c.endswith("sha256") else "bigint") for c in COLUMNS[name].split())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    want = duck.execute(ORACLES[name])
    cols = [d[0] for d in want.description]
    df = QUERIES[name](spark, D)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(map(tuple, df.select(cols).collect())) == sorted(want.fetchall())
