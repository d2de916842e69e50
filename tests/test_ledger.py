"""The question ledger: outcomes, resuming, results."""

import json

import pytest
from pyspark.sql import functions as F

from cardlens.operators import ledger


@pytest.fixture
def folder(spark, tmp_path):
    spark.range(4).createOrReplaceTempView("ledger_t")
    return f"{tmp_path}/batch"


def outcomes(spark, folder):
    return {r["query_name"]: (r["status"], r["n_rows"], r["error_class"]) for r in ledger.status(spark, folder).collect()}


def test_a_bad_statement_leaves_the_others(spark, folder):
    statements = {"bad": "SELECT nope FROM ledger_t", "a": "SELECT id, CAST(NULL AS INT) AS n FROM ledger_t WHERE id > 1",
                  "prose": "Sure, here it is", "none": "SELECT * FROM ledger_t WHERE id > 9",
                  "late": "SELECT id / (id - 2) AS x FROM ledger_t", "gone": "SELECT * FROM no_such", "b": "SELECT count(*) AS n FROM ledger_t"}
    assert ledger.run_questions(spark, statements, folder) == list(statements)
    assert outcomes(spark, folder) == {
        "bad": ("failed", None, "missing_column"), "a": ("done", 2, None), "prose": ("failed", None, "syntax"), "none": ("done", 0, None),
        "late": ("failed", None, "other"), "gone": ("failed", None, "missing_table"), "b": ("done", 1, None)}
    got = sorted((r["query_name"], r["row_json"]) for r in ledger.results(spark, folder).collect())
    assert [(q, json.loads(j)) for q, j in got] == [("a", {"id": 2, "n": None}), ("a", {"id": 3, "n": None}), ("b", {"n": 4})]
    texts = {r["query_name"]: r["error_text"] for r in ledger.status(spark, folder).collect()}
    assert "nope" in texts["bad"] and "DIVIDE_BY_ZERO" in texts["late"] and texts["a"] is None


def test_a_second_run_does_only_what_is_missing(spark, folder):
    first = {"a": "SELECT 1 AS x", "b": "SELECT nope FROM ledger_t", "c": "SELECT 3 AS x"}
    ledger.run_questions(spark, first, folder)
    assert ledger.run_questions(spark, first, folder) == ["b"]  # a failure is tried again
    second = {**first, "b": "SELECT 2 AS x", "c": "SELECT 4 AS x", "d": "SELECT 5 AS x"}
    assert ledger.run_questions(spark, second, folder) == ["b", "c", "d"]  # another statement is another question
    assert ledger.run_questions(spark, second, folder) == []
    assert sorted(json.loads(r["row_json"])["x"] for r in ledger.results(spark, folder).collect()) == [1, 2, 4, 5]
    assert ledger.entries(spark, folder).where(F.col("query_name") == "b").count() == 3


def test_an_interrupt_ends_the_batch_and_is_resumed(spark, folder, monkeypatch):
    run = spark.sql

    def stop(sql, *args, **kw):
        if "stop" in sql:
            raise KeyboardInterrupt
        return run(sql, *args, **kw)
    statements = {"a": "SELECT 1 AS x", "b": "SELECT 'stop' AS x", "c": "SELECT 3 AS x"}
    monkeypatch.setattr(type(spark), "sql", lambda self, sql, *a, **kw: stop(sql, *a, **kw))
    with pytest.raises(KeyboardInterrupt):
        ledger.run_questions(spark, statements, folder)
    assert outcomes(spark, folder).keys() == {"a"}
    monkeypatch.setattr(type(spark), "sql", lambda self, sql, *a, **kw: run(sql, *a, **kw))
    assert ledger.run_questions(spark, statements, folder) == ["b", "c"]


def test_an_empty_folder_has_no_entries(spark, folder):
    assert ledger.status(spark, folder).collect() == [] and ledger.results(spark, folder).collect() == []
    assert ledger.run_questions(spark, {}, folder) == []
