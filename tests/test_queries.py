"""Every core query runs on the smallest tables; those with SQL give the same rows as DuckDB."""

import pytest
from oracle import compared

from emberquill.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, data, name):
    got, want = compared(spark, data, registry.QUERIES[name], registry.SQL[name])
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_gives_rows(spark, data, name):
    df = registry.QUERIES[name](spark, data)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_partitions_do_not_matter(spark, data):
    rows = lambda: sorted(map(str, registry.QUERIES["hybrid_entities"](spark, data).collect()))
    first = rows()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert rows() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
