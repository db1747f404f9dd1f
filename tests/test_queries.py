"""Every query of the bank against its SQL twin on the smallest data folder."""

from __future__ import annotations

import pytest

from lectern.plans.catalogue import ORACLES, QUERIES
from tests.oracle import rows_of, run_sql

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        assert rows_of(got) == rows_of(run_sql(ORACLES[name], SF))
    else:
        assert len(got.columns)


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())
