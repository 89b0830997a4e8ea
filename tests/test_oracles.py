"""Every registered query: against its SQL where there is one, else it must return rows."""

import __spark_entry__ as entry_module
import harness
import pytest

QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return harness.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, con, sf_dir):
    assert harness.compare(spark, con, sf_dir, QUERIES[name], ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_returns_rows(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_has_rows(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["step", "label", "windows", "level"]
    assert df.count() > 0
