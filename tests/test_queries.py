"""Every query outside the llm subpackage against its SQL, on the smallest tables."""

import pytest

from linkloom.plans import registry
from tests.conftest import DATA, rows


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), duck.execute(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_gives_the_same_rows_however_the_input_is_dealt(spark, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    assert len(got) and not got.duplicated(subset=[c for c in got.columns if got[c].map(lambda v: not isinstance(v, list)).all()]).any()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        assert rows(got) == rows(registry.QUERIES[name](spark, DATA).toPandas())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(e.queries())
