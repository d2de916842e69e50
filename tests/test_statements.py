"""The statement scanner against a character-by-character walk."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from cardlens.functions.text import STATEMENT_START, extract_sql


def walk(t):
    """The statement at the start of ``t`` by its rules, one character at a time."""
    i, state = 0, ""
    while i < len(t):
        two = t[i:i + 2]
        if not state:
            if t[i:i + 3] == "```":
                return t[:i]
            if t[i] == ";":
                return t[:i + 1]
            state = two if two in ("--", "/*") else t[i] if t[i] in "'\"`" else ""
            i += 2 if state in ("--", "/*") else 1
        elif state == "/*" and two == "*/":
            state, i = "", i + 2
        else:
            if t[i] == state or (state == "--" and t[i] == "\n"):
                state = ""
            i += 1
    return t


def extract(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r["sql"] for r in df.select("i", extract_sql(F.col("t")).alias("sql")).orderBy("i").collect()]


CASES = {
    "SELECT a FROM t WHERE b LIKE '%;%' AND c = 1;": "SELECT a FROM t WHERE b LIKE '%;%' AND c = 1;",
    "Sure.\nSELECT 1 -- note; here\n + 1; and more;": "SELECT 1 -- note; here\n + 1;",
    "SELECT /* a; 'b */ 'it''s; fine' AS \"x;y\" FROM `t;u`; tail": "SELECT /* a; 'b */ 'it''s; fine' AS \"x;y\" FROM `t;u`;",
    "```sql\nSELECT a\nFROM t\n```\nThat is all.": "SELECT a\nFROM t",
    "SQLQuery: WITH x AS (SELECT ';' AS a) SELECT * FROM x; bye": "WITH x AS (SELECT ';' AS a) SELECT * FROM x;",
    "With this you get it.\nSQLQuery: SELECT 2;": "SELECT 2;",
    "with recursive \"a b\" (n) as (select 1) select n from \"a b\"": "with recursive \"a b\" (n) as (select 1) select n from \"a b\"",
    "WITH a AS MATERIALIZED (SELECT 1) SELECT * FROM a;": "WITH a AS MATERIALIZED (SELECT 1) SELECT * FROM a;",
    "SELECT 'never closed; FROM t": "SELECT 'never closed; FROM t",
    "SELECT 1 /* never closed; ": "SELECT 1 /* never closed;",
    "SELECT*FROM t;": "SELECT*FROM t;",
    "nothing to select here; with luck": "",
    "": "",
    "  \n\tselect 1": "select 1",
    "SELECT 5 - 3 / 2 - -1;x": "SELECT 5 - 3 / 2 - -1;",
}


def test_statements_come_back_whole(spark):
    assert extract(spark, list(CASES)) == list(CASES.values())


def test_null_reply_has_no_statement(spark):
    assert extract(spark, [None]) == [None]


def test_scanner_equals_a_walk_over_characters(spark):
    rnd = random.Random(19)
    parts = ["'", "''", '"', "`", "```", ";", "--", "/*", "*/", "\n", " ", "a", "x y", "-", "/", "*", "é", "(", "\\"]
    texts = ["SELECT " + "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(600)]
    got = extract(spark, texts)
    for t, sql in zip(texts, got):
        assert re.match(STATEMENT_START.replace(r"\z", r"\Z"), t)
        assert sql == walk(t).strip(" \t\n\r"), t


@pytest.mark.parametrize("piece", ["'a;b' ", "-- x; y\n", "/* ; */ ", "- / ", "word "])
def test_long_replies_take_one_pass(spark, piece):
    times = []
    for n in (20_000, 80_000):
        t = "SELECT " + piece * n + "1; rest"
        began = time.time()
        assert extract(spark, [t]) == [t[:-len(" rest")]]
        times.append(time.time() - began)
    assert times[1] < 12 * max(times[0], 0.25)
