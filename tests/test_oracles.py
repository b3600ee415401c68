"""Every registered query equals its DuckDB oracle (sf0.001)."""

import pytest

import __spark_entry__ as E
from compare import diff, run_sql
from conftest import SF_SMALL

QUERIES = E._queries()  # the library's own; the training-data operators are tested in tests/llm
ORACLES = E.O.all_oracles()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, key):
    df = QUERIES[key](spark, SF_SMALL)
    msg = diff(df, run_sql(SF_SMALL, ORACLES[key]))
    assert msg is None, msg


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "rank (ns)" in df.columns
