"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check_oracles import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert compare(got, con.execute(SQL[name]).df()) == ""


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_flagship(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["target", "rank", "id", "similarity"]
    assert rows.where("rank = 1 AND target = id AND similarity = 1").count() == rows.select("target").distinct().count()
