"""Every registered report against its SQL on the smallest tables, and the driver contract."""

import sys
from pathlib import Path

import pytest
from conftest import SF

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import __spark_entry__ as entry_module
from check import compare, oracle

from jobtrail.plans import all_oracle_sql, all_queries

QUERIES, SQL = all_queries(), all_oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


def test_every_report_has_a_check():
    assert set(QUERIES) == set(SQL)


def test_the_entry_registers_every_report():
    assert QUERIES.keys() <= entry_module.queries().keys() and SQL.keys() <= entry_module.oracle_sql().keys()


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["status", "avg_ms", "p95_ms", "n"] and df.count() == 5


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_report(spark, con, name):
    result, _ = compare(spark, con, name, QUERIES[name], SQL[name], SF)
    assert result.startswith("ok"), result
