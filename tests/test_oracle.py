"""Every registered query against its DuckDB oracle (sf0.001)."""

import pytest

import __spark_entry__ as E
from cardlens.plans import registry
from cardlens.plans.compare import compare
from conftest import SMALL

ORACLE = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    ok, msg = compare(E.queries()[name](spark, SMALL), duck, ORACLE[name])
    assert ok, msg


def test_entry_runs(spark):
    df = E.entry(spark)
    assert "total_spent" in df.columns
    assert df.count() > 0


def test_every_query_has_an_oracle():
    # tokens of a vocabulary are no SQL; tests/test_cards_and_copies.py counts them with the tokenizer itself
    assert set(registry.queries()) - set(ORACLE) == {"prompt_tokens"} and set(ORACLE) <= set(registry.queries())


DUCK_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double",
              "BOOLEAN": "boolean", "VARCHAR[]": "array<string>"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_column_types_match_oracle(spark, duck, name):
    st = {f.name: f.dataType.simpleString() for f in E.queries()[name](spark, SMALL).schema.fields}
    rel = duck.sql(ORACLE[name])
    dt = {c: DUCK_TYPES.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types)}
    assert st == dt
