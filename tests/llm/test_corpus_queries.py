"""Corpus queries run on the smallest tables; those with SQL give DuckDB's rows."""

import pytest
from oracle import compared

from emberquill.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_same_as_sql(spark, data, name):
    got, want = compared(spark, data, Q.QUERIES[name], Q.SQL[name])
    assert got == want


COLUMNS = {
    "p2_found": ["field", "row_a", "row_b"], "p4_found": ["document_id", "defect"], "p5_found": ["kind", "group_id", "pos", "item"], "p6_found": ["field", "row_id"],
    "p7_found": ["case_id", "pokemon_id", "grade"], "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_gives_rows(spark, data, name):
    df = Q.QUERIES[name](spark, data)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    assert df.count() > 0
