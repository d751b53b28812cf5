"""Every registered query with oracle SQL must equal DuckDB on the test data."""

import pytest

from trustframe.plans.registry import oracle_sql, queries

from .oracle_check import compare, duck

ORACLE = oracle_sql()
QUERIES = queries()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, sf_dir, name):
    problems, n = compare(spark, con, QUERIES[name], ORACLE[name], sf_dir)
    assert not problems, f"{name}: {problems}"


@pytest.mark.parametrize("name", sorted(n for n in set(QUERIES) - set(ORACLE)
                                        if not n.startswith("op") and n != "pipeline"))
def test_rows_only_query_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert len(df.columns) > 0
    df.count()
