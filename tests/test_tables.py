"""Every registered query against its SQL on the smallest given tables."""

import compare
import pytest

import __spark_entry__ as driver
from coursegrid.plans import catalog, oracle

QUERIES = catalog.queries()
SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return compare.duck(folder)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(driver.queries()) and set(SQL) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(name, spark, folder, con):
    assert compare.differences(QUERIES[name](spark, folder), con, SQL[name]) is None


def test_entry(spark):
    result = driver.entry(spark)
    assert result.columns == [
        "course", "reporting_year", "total_sections", "avg_section", "full_ind", "measure",
        "measure_order", "n_students",
    ]
    assert result.count() > 0
