"""Every registered query of the core against its DuckDB SQL, and the driver contract."""

import pytest
from conftest import same_rows

import __spark_entry__ as entry_module
from krylark.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(name, spark, duck, sf_dir):
    left, right = same_rows(QUERIES[name](spark, sf_dir), duck, ORACLE_SQL[name])
    assert left == right


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_has_rows(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_contract(spark):
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert entry_module.entry(spark).count() > 0
