"""Every query of the catalog against its SQL on the smallest data set."""

import pytest
from compare import differences, sql_engine
from conftest import DATA

from hitprism.plans import catalog, oracle

SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def engine():
    return sql_engine(DATA)


def test_every_query_has_sql():
    assert set(catalog.OPERATORS) == set(SQL) == set(catalog.queries())


@pytest.mark.parametrize("name", list(catalog.OPERATORS))
def test_query_equals_sql(name, star_hits, engine):
    result = catalog.dates_as_text(catalog.OPERATORS[name](star_hits))
    assert differences(result, engine, SQL[name]) == ""


def test_view_on_tables_equals_sql(spark, engine):
    result = catalog.queries()["S1"](spark, str(DATA))
    assert differences(result, engine, SQL["S1"]) == ""
