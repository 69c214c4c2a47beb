"""Queries that have SQL, against it on the smallest data set."""

import pytest
from compare import differences, sql_engine
from conftest import DATA

from hitprism.llm.oracle import oracle_sql
from hitprism.llm.queries import queries


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_query_equals_sql(spark, name):
    assert differences(queries()[name](spark, str(DATA)), sql_engine(DATA), oracle_sql()[name]) == ""
