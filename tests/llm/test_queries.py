"""Queries with SQL against it, on the whole small tables."""

import pytest

import __spark_entry__ as E
from cardlens.llm import registry
from cardlens.plans.compare import compare

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = E.queries()[name](spark, SMALL)
    ok, msg = compare(df, duck, registry.oracle_sql()[name])
    assert ok, msg


def test_thirteen_operators_and_the_pipeline_are_registered():
    names = set(E.queries())
    for n in range(1, 14):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names
