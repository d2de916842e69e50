"""Catalogue jobs on edge cases and cross-query invariants."""

import os
import tempfile

from pyspark.sql import functions as F

from cardlens.operators import catalog, discounts, payments, spend
from cardlens.params import DEFAULT
from cardlens.sources.cards import TpchCards
from conftest import SMALL


def test_unreadable_meta_table_is_skipped(spark):
    catalog.register_meta_views(spark, SMALL)
    spark.sql("CREATE OR REPLACE TEMP VIEW meta_broken AS SELECT 1 AS only_column")
    try:
        lines, skipped = catalog.synonym_lines(spark)
        assert skipped == ["meta_broken"]
        assert set(r["table_name"] for r in lines.collect()) == {"meta_nation", "meta_region"}
    finally:
        spark.catalog.dropTempView("meta_broken")


def test_synonym_lines_drop_empty_and_null(spark):
    lines = catalog.synonym_card(spark, SMALL, DEFAULT).collect()
    assert all(r["synonyms"] for r in lines)
    assert any(r["line"] == "meta_region AMERICA (Code: 1), Synonyms: america" for r in lines)


def test_largest_of_ties_and_empty(spark):
    prof = spark.createDataFrame([("b", 5), ("a", 5), ("c", 0)], "table_name string, n_rows long")
    assert catalog.largest_of(prof).first().asDict() == {"table_name": "a", "n_rows": 5}
    empty = spark.createDataFrame([("c", 0)], "table_name string, n_rows long")
    assert catalog.largest_of(empty).first().asDict() == {"table_name": None, "n_rows": 0}


def test_profile_respects_include(spark):
    prof = catalog.table_profile(spark, SMALL, DEFAULT, include=("nation", "region"))
    assert sorted((r["table_name"], r["n_rows"]) for r in prof.collect()) == [("nation", 25), ("region", 5)]


def test_table_copy_reads_back(spark):
    target = tempfile.mkdtemp(prefix="cardlens-copy-")
    copied = catalog.table_copy(spark, SMALL, DEFAULT, target).collect()
    assert all(r["equal"] for r in copied)
    got = {r["table_name"]: r["n_rows"] for r in copied}
    want = {r["table_name"]: r["n_rows"] for r in catalog.table_profile(spark, SMALL, DEFAULT).collect()}
    assert got == want
    assert catalog.read_copy(spark, target, "lineitem").count() == want["lineitem"]


def _folder(spark):
    folder = tempfile.mkdtemp(prefix="cardlens-tables-")
    spark.range(3).select("id", F.lit("x").alias("v")).write.parquet(folder + "/alpha.parquet")
    spark.range(5).select(F.col("id").alias("k")).write.parquet(folder + "/beta.parquet")
    return folder


def test_tables_are_discovered(spark):
    import pytest
    folder = _folder(spark)
    prof = catalog.table_profile(spark, folder, DEFAULT).collect()
    assert sorted((r["table_name"], r["n_rows"]) for r in prof) == [("alpha", 3), ("beta", 5)]
    assert {r["table_name"] for r in catalog.table_copy(spark, folder, DEFAULT).collect()} == {"alpha", "beta"}
    with pytest.raises(ValueError, match="gamma"):
        catalog.table_profile(spark, folder, DEFAULT, include=("alpha", "gamma"))


def test_a_replaced_table_shows_its_new_column(spark):
    folder = _folder(spark)
    assert [r["column_name"] for r in catalog.schema_card(spark, folder, DEFAULT).where("table_name = 'beta'").collect()] == ["k"]
    spark.range(5).select(F.col("id").alias("k"), F.lit(1).alias("extra")).write.mode("overwrite").parquet(folder + "/beta.parquet")
    spark.catalog.refreshByPath(folder + "/beta.parquet")
    got = {r["column_name"] for r in catalog.schema_card(spark, folder, DEFAULT).where("table_name = 'beta'").collect()}
    assert got == {"k", "extra"}


def test_a_changed_value_in_a_copy_is_noticed(spark):
    a = spark.range(100).select("id", F.lit("x").alias("v"))
    b = a.withColumn("v", F.when(F.col("id") == 7, "y").otherwise(F.col("v")))
    got = {r["table_name"]: r["equal"] for r in catalog.compare_copies({"same": (a, a.orderBy(F.desc("id"))), "other": (a, b)}).collect()}
    assert got == {"same": True, "other": False}


def test_card_of_empty_table_and_nulls(spark):
    folder = tempfile.mkdtemp(prefix="cardlens-tables-")
    spark.createDataFrame([], "a int, b string").write.parquet(folder + "/none.parquet")
    spark.createDataFrame([(None, "z"), (2, None), (1, "q"), (1, "p")], "a int, b string").coalesce(1).write.parquet(folder + "/some.parquet")
    got = {(r["table_name"], r["column_name"]): r["samples"] for r in catalog.schema_card(spark, folder, DEFAULT).collect()}
    assert got == {("none", "a"): [], ("none", "b"): [], ("some", "a"): ["NULL", "2", "1"], ("some", "b"): ["z", "NULL", "q"]}


def test_like_pattern_is_literal_but_for_its_wildcards():
    from cardlens.sources.tables import like
    names = ["meta_a", "metaXa", "me[t]a", "other"]
    assert like("META%", names) == ["meta_a", "metaXa"] and like("me[t]_", names) == ["me[t]a"] and like("*", names) == []


def test_a_meta_table_that_fails_when_read_is_skipped(spark):
    catalog.register_meta_views(spark, SMALL)
    spark.sql("CREATE OR REPLACE TEMP VIEW meta_failing AS SELECT raise_error('unreadable') AS code, 'n' AS name, 's' AS synonyms")
    try:
        lines, skipped = catalog.synonym_lines(spark)
        assert skipped == ["meta_failing"] and lines.count() > 0
    finally:
        spark.catalog.dropTempView("meta_failing")


def test_a_cluster_without_shared_folder_is_an_error():
    import pytest
    from cardlens.session import local_scratch
    assert os.path.isdir(local_scratch("local[4]"))
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            local_scratch(master)


def test_invariants(spark):
    cards = TpchCards(spark, SMALL)
    p = DEFAULT
    total = {r["acct"]: (r["total_spent"], r["n_payments"]) for r in spend.spend_total(cards, p).collect()}
    months = spend.spend_by_month(cards, p).groupBy("acct").agg(F.sum("total_spent").alias("t")).collect()
    for r in months:
        assert abs(r["t"] - total[r["acct"]][0]) < 1e-6
    roll = spend.spend_total_and_month(cards, p).where(F.col("level") == 1).collect()
    assert {r["acct"]: r["total_spent"] for r in roll} == {k: v[0] for k, v in total.items()}
    # semi join never adds rows
    assert discounts.discounted_lines(cards, p).count() <= cards.billing(p).count()
    # payment chunks hold every line exactly once
    n = payments.payments_json(cards, p).agg(F.sum("n_payments")).first()[0]
    assert n == sum(v[1] for v in total.values())
    # remaining = limit - used
    for r in discounts.limit_remaining(cards, p).collect():
        assert abs(r["monthly_limit"] - r["used"] - r["remaining"]) < 1e-6


def test_count_rows_of_no_tables_and_of_an_empty_table(spark):
    assert catalog.count_rows(spark, {}).count() == 0
    empty = spark.range(0).select(F.lit(1).alias("x"))
    rows = catalog.count_rows(spark, {"e": empty, "r": spark.range(3)}).collect()
    assert sorted((r["table_name"], r["n_rows"]) for r in rows) == [("e", 0), ("r", 3)]
