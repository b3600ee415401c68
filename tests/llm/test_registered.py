"""Every registered training-data query: against its SQL where it has one, and the registry itself."""

import pytest

import __spark_entry__ as E
from compare import diff, run_sql
from conftest import SF_SMALL
from scholarmetrics.llm.queries import ORACLE_SQL, QUERIES


def test_operators_and_the_pipeline():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(E.queries())
    assert set(ORACLE_SQL) <= set(E.oracle_sql())


@pytest.mark.parametrize("key", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, key):
    assert diff(QUERIES[key](spark, SF_SMALL), run_sql(SF_SMALL, ORACLE_SQL[key])) is None
