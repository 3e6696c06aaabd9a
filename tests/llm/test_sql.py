from __future__ import annotations

import pytest
from oracle import SF, connect, rows

from framelake.llm import queries, sql

SQL = sql.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_contract_query_equals_its_sql(spark, name):
    assert rows(queries.queries()[name](spark, SF).toPandas()) == rows(connect(SF).sql(SQL[name]).df())


@pytest.mark.parametrize(("name", "columns"), [
    ("op1_topk_search", "query_id rank vec_id score"), ("op2_simhash_dedup", "doc_id fingerprint component_id"), ("op3_decontaminate", "doc_id n_words n_hit n_items items_sha256 contaminated"),
    ("op4_toxicity", "doc_id held_out score predicted"), ("op5_chat_format", "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars"), ("op6_language_id", "doc_id held_out lang_pred score"),
    ("op7_suffix_dedup", "doc_id n_bytes n_removed n_spans kept_sha256"), ("op8_byte_bpe", "doc_id n_tokens ids_sha256 decoded_sha256"), ("op9_token_files", "doc_id start n_tokens ids_crc32"), ("op10_url_filter", "page_id host path rule verdict"),
])
def test_contract_columns(spark, name, columns):
    assert queries.queries()[name](spark, SF).columns[: len(columns.split())] == columns.split()
