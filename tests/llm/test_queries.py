"""Registered queries: SQL at sf0.001 where there is SQL, schemas of the contracts everywhere."""

import pytest

from conftest import SF001
from oracle_util import compare, duck
from wattle.llm.oracle import ORACLE
from wattle.llm.queries import QUERIES

SCHEMAS = {
    "op3_source_mix": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op4_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op5_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op6_ngram_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op7_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint",
                          "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op8_url_filters": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op9_secret_scan": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op10_decontamination": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op11_prefix_trie": {"conv_id": "bigint", "depth": "bigint", "parent_conv_id": "bigint", "n_convs": "bigint", "n_children": "bigint",
                         "n_leaves": "bigint", "saved_tokens": "bigint", "ends_sha256": "string"},
    "op12_source_audit": {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"},
    "op13_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
}


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


def test_one_query_for_each_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    got = compare(QUERIES[name](spark, SF001), ORACLE[name], con)
    assert got["match"], got
    assert got["spark_rows"] > 0


@pytest.mark.parametrize("name", sorted(SCHEMAS))
def test_contract_schema(spark, name):
    got = dict(QUERIES[name](spark, SF001).dtypes)
    assert {k: got.get(k) for k in SCHEMAS[name]} == SCHEMAS[name]
