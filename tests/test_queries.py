import pytest
from oracle_check import database, rows_of, rows_of_sql

from timelode.plans import registry

ORACLE = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return database(sf_dir)


def test_every_query_has_a_twin():
    assert set(ORACLE) == set(registry.queries()) - set(registry.WITHOUT_TWIN)


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_matches_its_twin(spark, sf_dir, con, name):
    assert rows_of(registry.queries()[name](spark, sf_dir)) == rows_of_sql(con, ORACLE[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
