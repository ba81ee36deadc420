"""The operators that SQL can express, against their SQL on the same tables."""

import pytest
from oracle_check import database, rows_of, rows_of_sql

from timelode.llm import queries


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_matches_its_sql(spark, sf_dir, name):
    assert rows_of(queries.queries()[name](spark, sf_dir)) == rows_of_sql(database(sf_dir), queries.oracle_sql()[name])
