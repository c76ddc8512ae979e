"""Every named query that has SQL, against that SQL."""

import pytest

import __spark_entry__ as contract
from tests.conftest import SMALL
from tools.check_oracle import compare, connect

QUERIES, ORACLE = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, name):
    assert compare(QUERIES[name](spark, SMALL).toArrow(), duck.execute(ORACLE[name]).to_arrow_table()) == ""


def test_entry_has_rows(spark):
    out = contract.entry(spark)
    assert out.columns == ["date", "product_id", "prediction"]
    assert out.count() > 0
