"""Every query outside the llm subpackage against its SQL; those without SQL run."""

from __future__ import annotations

import parity
import pytest

from quillon.plans import data_queries, reference_queries

DATA = "/root/testdata/sf0.001"
QUERIES = {**reference_queries.QUERIES, **data_queries.QUERIES}
SQL = {**reference_queries.SQL, **data_queries.SQL}


@pytest.fixture(scope="module")
def duck():
    return parity.duck(DATA)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    if name in SQL:
        assert parity.compare(spark, duck, QUERIES[name], SQL[name], DATA) == ""
    else:
        assert QUERIES[name](spark, DATA).count() > 0


def test_entry_module():
    import __spark_entry__ as entry

    assert set(SQL) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
