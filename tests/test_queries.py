"""Every named query with SQL gives the SQL's rows; what the others give is tested beside their operators."""

import harness
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF = f"{harness.DATA}/sf0.001"
SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return harness.duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    assert harness.compare(queries()[name](spark, SF), con, SQL[name]) is None


@pytest.mark.parametrize("name", ["j17_sweep_attributes", "j18_sweep_disclosure"])
def test_runs(spark, name):
    assert queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry(spark).columns == ["rid", "segment", "nation", "acctbal"]


def test_every_sql_has_a_query():
    assert set(SQL) <= set(queries())
