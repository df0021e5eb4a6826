"""Every registered query outside the training-data subpackage gives the rows of its SQL twin."""

import pytest

import __spark_entry__ as entry
from tallyfield.plans import registry
from tests.conftest import rows_of

NAMES = sorted(registry.QUERIES)


def test_every_query_has_sql():
    assert set(registry.SQL) == set(registry.QUERIES)


def test_entry_runs(spark):
    found = entry.entry(spark)
    assert found.count() > 0
    assert found.columns[:3] == ["contract_number", "contract_qty", "accepted"]


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, sf, duck, name):
    found = registry.QUERIES[name](spark, sf).toPandas()
    wanted = duck.execute(registry.SQL[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows_of(found) == rows_of(wanted)
