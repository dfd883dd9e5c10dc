"""Every query with a SQL equivalent, against DuckDB on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from conftest import SMALL
from ledgerspark.catalogue import ORACLES
from oracle import compare, duck_connection


@pytest.fixture(scope="module")
def duck():
    return duck_connection(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    assert compare(spark, duck, name, SMALL) is None


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_has_rows_and_all_columns(spark):
    table = entry(spark)
    assert table.count() == 1000
    assert {"store_name", "store_name_target_enc", "amount_percentile", "has_travel_keyword"} <= set(table.columns)
