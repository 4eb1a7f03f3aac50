"""Every registered query against its DuckDB oracle at sf0.01 (the correctness gate)."""

import pytest

import __spark_entry__ as E
from conftest import SF01
from oracle_util import compare, duck

QUERIES = E.QUERIES
ORACLE = E.ORACLE


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF01)
    if name not in ORACLE:
        assert df.count() >= 0
        return
    rep = compare(df, ORACLE[name], con)
    assert rep["match"], rep
    assert rep["spark_rows"] > 0


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["cid", "n", "share", "iterations", "pos", "value"]
