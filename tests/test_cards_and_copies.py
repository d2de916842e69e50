"""Cards by place, token budgets and whole replacement of copies."""

import datetime as dt
import os
import uuid

import pytest
from pyspark.sql import functions as F

from cardlens.functions import tokens
from cardlens.operators import catalog, prompts
from cardlens.params import Params
from conftest import SMALL


def jobs_of(spark, fn):
    """What ``fn`` returns and the jobs it started."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = fn()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def odd_frame(spark, first, n):
    return spark.range(first, first + n, 1, 1).select(
        F.create_map(F.lit("b"), F.col("id"), F.lit("a"), F.lit(1)).alias("m"), F.col("id").alias("dotted.name"), F.encode(F.lit("é"), "UTF-8").alias("raw"),
        F.struct(F.col("id").alias("x"), F.lit("y").alias("y.z")).alias("s"), F.expr("make_interval(0, 1)").cast("string").alias("a`b"),
        F.expr("double('nan')").alias("nan"), F.lit(None).cast("string").alias("none"), F.array(F.lit(1.5)).alias("arr"))


def samples(card):
    return {r["column_name"]: r["samples"] for r in card.collect()}


def test_first_rows_come_by_place_whatever_the_types(spark, tmp_path):
    path = f"{tmp_path}/a b/odd table"  # names with blanks
    for k, (first, n) in enumerate([(0, 0), (7, 2), (100, 0), (5, 4), (1, 50)]):
        odd_frame(spark, first, n).write.parquet(f"{tmp_path}/w{k}")
    os.makedirs(path)
    for k in range(5):
        part = next(f for f in os.listdir(f"{tmp_path}/w{k}") if f.endswith(".parquet"))
        os.rename(f"{tmp_path}/w{k}/{part}", f"{path}/part-{k}.parquet")
    df = spark.read.parquet(path)
    got, n_jobs = jobs_of(spark, lambda: catalog.card_of(spark, {"odd": df}, 3))
    assert n_jobs == 0
    got = samples(got)
    assert got["dotted.name"] == ["7", "8", "5"]  # the first file with rows, then the next
    assert got["m"] == ["{b -> 7, a -> 1}", "{b -> 8, a -> 1}", "{b -> 5, a -> 1}"]
    assert got["raw"] == ["C3A9"] * 3 and got["s"][0] == "{7, y}" and got["nan"] == ["NaN"] * 3
    assert got["none"] == ["NULL"] * 3 and got["arr"] == ["1.500000"] * 3 and len(got["a`b"]) == 3
    assert len(samples(catalog.card_of(spark, {"odd": df}, 60))["raw"]) == 56


def test_only_the_first_file_is_opened(spark, tmp_path):
    spark.range(400).repartition(8).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    rows = catalog.first_rows({"t": df}, 3)["t"]
    plan = rows._jdf.queryExecution().executedPlan()
    assert rows.count() == 3
    leaves = rows._jdf.queryExecution().executedPlan().collectLeaves()
    scan = leaves.head()
    assert scan.metrics().apply("numFiles").value() <= 1 and plan is not None


def test_cards_of_empty_and_partitioned_tables(spark, tmp_path):
    spark.range(0).select(F.col("id"), F.lit("x").alias("y")).write.parquet(f"{tmp_path}/empty")
    spark.range(4).select("id", (F.col("id") % 2).alias("k")).coalesce(1).write.partitionBy("k").parquet(f"{tmp_path}/split")
    frames = {t: spark.read.parquet(f"{tmp_path}/{t}") for t in ("empty", "split")}
    got = {(r["table_name"], r["column_name"]): r["samples"] for r in catalog.card_of(spark, frames, 3).collect()}
    assert got == {("empty", "id"): [], ("empty", "y"): [], ("split", "id"): ["0", "2", "1"], ("split", "k"): ["0", "0", "1"]}
    assert catalog.card_of(spark, {}, 3).collect() == []


def test_building_a_card_only_reads_schemas(spark):
    from cardlens.sources.tables import discover_tables, read_table
    names = discover_tables(spark, SMALL)
    _, schemas = jobs_of(spark, lambda: [read_table(spark, SMALL, t) for t in names])
    card, n = jobs_of(spark, lambda: catalog.schema_card(spark, SMALL, Params()))
    assert n <= schemas and card.select("table_name").distinct().count() == len(names)


def test_words_of_a_budget_are_those_of_the_prompt(spark):
    q = spark.createDataFrame([("a", "how much\n did it  cost"), ("b", ""), ("c", None), ("d", "word " * 20000)], "q_id string, question string")
    parts = [F.lit("t(a int: 1)"), F.lit("words here"), F.lit("Request: x\nQuery: y")]
    long = prompts.budget_of(prompts.sql_prompts(q, *parts), 16384)
    short = prompts.word_budget(q, *parts, 16384)
    assert sorted(map(tuple, long.collect())) == sorted(map(tuple, short.collect()))
    assert {r["q_id"]: r["fits"] for r in short.collect()} == {"a": True, "b": True, "c": True, "d": False}


def test_tokens_of_a_vocabulary(spark):
    from tokenizers import Tokenizer
    path = tokens.public_vocabulary("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    texts = ["hello world", "", None, "  é\n\n<|endoftext|> tail", "SELECT sum(x) FROM t;" * 3000]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "q_id string, prompt string")
    got = {r["q_id"]: r for r in prompts.budget_of(df, 16384, path).collect()}
    for i, t in enumerate(texts):
        n = len(own.encode(t or "", add_special_tokens=False).ids)
        assert (got[str(i)]["n_tokens"], got[str(i)]["room"], got[str(i)]["fits"]) == (n, 16384 - n, n <= 16384)
    assert not got["4"]["fits"] and got["0"]["fits"]


def test_solved_requests_are_rows(spark):
    rows = spark.createDataFrame([(2, "second", " SELECT 2; "), (1, "first\n", "SELECT 1;"), (3, None, "SELECT 3;"), (4, "no query", " ")],
                                 "place int, request string, query string")
    text = prompts.examples_of(rows).first()["examples"]
    assert text == "Request: first\nQuery: SELECT 1;\n\nRequest: second\nQuery: SELECT 2;"
    assert prompts.examples_of(rows.limit(0)).first()["examples"] == ""
    got = prompts.prompt_table(spark, SMALL, Params(), rows).first()["prompt"]
    assert text in got and prompts.EXAMPLE_ROWS[0][0] not in got


def test_a_copy_that_fails_midway_leaves_the_old_one(spark, tmp_path):
    target = f"{tmp_path}/copies"
    old = {"a": spark.range(5), "b": spark.range(7)}
    catalog.replace_tables(spark, old, target)
    bad = spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        catalog.replace_tables(spark, {"a": spark.range(50), "b": bad}, target)
    assert {t: catalog.read_copy(spark, target, t).count() for t in old} == {"a": 5, "b": 7}
    assert len([f for f in os.listdir(target) if f.startswith("copy-")]) == 1  # nothing half-done stays
    reader = catalog.read_copy(spark, target, "a")
    catalog.replace_tables(spark, {"a": spark.range(9)}, target)
    assert reader.count() == 5 and catalog.read_copy(spark, target, "a").count() == 9
    assert catalog.read_manifest(spark, target).keys() == {"a"}
    catalog.replace_tables(spark, {"a": spark.range(10)}, target)
    assert len([f for f in os.listdir(target) if f.startswith("copy-")]) == 2  # the last two


def test_digests_of_any_type(spark):
    def frame(*entries):
        return spark.createDataFrame([(dict(e), [dict(e)], (1, dict(e)), dt.date(2024, 1, 1)) for e in entries],
                                     "m map<string,int>, l array<map<string,int>>, s struct<x:int,y:map<string,int>>, d date")
    a = frame([("x", 1), ("y", 2)], [("z", 3)])
    b = frame([("z", 3)], [("y", 2), ("x", 1)])
    c = frame([("z", 3)], [("y", 2), ("x", 4)])
    got = {r["table_name"]: r["equal"] for r in catalog.compare_copies({"same": (a, b), "other": (a, c), "none": (a.limit(0), b.limit(0))}).collect()}
    assert got == {"same": True, "other": False, "none": True}


def test_least_rows_come_from_the_whole_table(spark, tmp_path):
    rows = [(5, None, {"a": 1}), (None, "z", {"b": 1}), (1, "q", {"a": 2, "b": 1}), (1, None, None), (1, "q", {"b": 1, "a": 1}), (9, "a", {})]
    spark.createDataFrame(rows, "a int, `b.c` string, m map<string,int>").repartition(4).write.parquet(f"{tmp_path}/t.parquet")
    spark.range(0).select(F.col("id"), F.lit("x").alias("y")).write.parquet(f"{tmp_path}/none.parquet")
    card = catalog.whole_card(spark, str(tmp_path), Params())
    got = {(r["table_name"], r["column_name"]): r["samples"] for r in card.collect()}
    assert got == {("none", "id"): [], ("none", "y"): [], ("t", "a"): ["NULL", "1", "1"], ("t", "b.c"): ["z", "NULL", "q"],
                   ("t", "m"): ["{b -> 1}", "NULL", "{a -> 1, b -> 1}"]}
    many = samples(catalog.card_of(spark, {"t": spark.read.parquet(f"{tmp_path}/t.parquet")}, 60, catalog.least_rows))
    assert many["a"] == ["NULL", "1", "1", "1", "5", "9"]


@pytest.fixture(scope="module")
def turned(tmp_path_factory, spark):
    """The small tables with the rows of each file turned round, so that no least row comes first."""
    import pyarrow.parquet as pq
    out = tmp_path_factory.mktemp("turned")
    for f in os.listdir(SMALL):
        t = pq.read_table(f"{SMALL}/{f}")
        pq.write_table(t.take(list(range(t.num_rows - 1, -1, -1))), f"{out}/{f}")
    return str(out)


@pytest.mark.parametrize("name", ["schema_card", "schema_samples", "prompt_budget"])
def test_cards_do_not_depend_on_the_order_of_files(spark, duck, turned, name):
    import __spark_entry__ as E
    from cardlens.plans.compare import compare
    from cardlens.plans.registry import oracle_sql
    ok, msg = compare(E.queries()[name](spark, turned), duck, oracle_sql()[name])
    assert ok, msg


def test_texts_are_encoded_in_pieces_of_bounded_size(monkeypatch):
    import pyarrow as pa
    seen = []

    class Fake:
        def encode_batch_fast(self, texts, add_special_tokens):
            seen.append(sum(len(str(t).encode()) for t in texts))
            return [type("E", (), {"ids": str(t).split()}) for t in texts]

        encode_batch = encode_batch_fast

    monkeypatch.setattr(tokens, "_load", lambda path: Fake())
    texts = ["é " * 10_000, None, ""] * 100 + ["word " * 100_000, "last"]
    want = ([10_000, 0, 0] * 100) + [100_000, 1]
    assert tokens.count_texts("any", pa.array(texts)[1:]) == want[1:]
    assert sorted(seen)[-1] == 500_000 and sorted(seen)[-2] <= 1 << 18  # the one longer text is alone
    assert tokens.count_texts("any", pa.array([], pa.string())) == []
