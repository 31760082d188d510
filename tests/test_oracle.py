"""Every registered query against its DuckDB SQL on the smallest scale
(the driver runs the same comparison at sf0.01)."""

import pytest

import __spark_entry__ as E
from oracle_harness import SMALL, compare
from shortlist.plans.registry import QUERIES

NAMES = sorted(QUERIES)


def test_every_query_has_an_oracle():
    assert all(E.oracle_sql().get(name) for name in NAMES)
    assert set(NAMES) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, name):
    r = compare(spark, SMALL, name, E.queries()[name], E.oracle_sql().get(name))
    assert r["cols_match"], r
    assert r["spark_rows"] == r["duck_rows"], r
    assert r["hash_match"], r


def test_entry_returns_rows(spark):
    df = E.entry(spark)
    assert df.count() > 0
