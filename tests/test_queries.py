"""Every registered query against its check in SQL, at the smallest scale."""

import pytest
from compare import duck, duck_table, plan, sf_dir, spark_table, type_differences

from __spark_entry__ import entry, oracle_sql, queries
from tablelens.queries import QUERIES

SCALE = "0.001"

# Operators no query over tables may need: joins of all pairs, and Python in the data path.
SLOW_OPERATORS = (
    "CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas",
)


@pytest.fixture(scope="module")
def con():
    return duck(SCALE)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, con, name):
    df = queries()[name](spark, sf_dir(SCALE))
    if name in QUERIES:
        assert [operator for operator in SLOW_OPERATORS if operator in plan(df)] == []
    (columns, rows), types = spark_table(df)
    sql = oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    (wanted_columns, wanted), wanted_types = duck_table(con, sql)
    assert columns == wanted_columns
    assert rows == wanted
    assert type_differences(types, wanted_types) == {}


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_check_has_a_query():
    assert set(oracle_sql()) <= set(queries())
