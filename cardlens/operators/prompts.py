"""Prompt tables over stored questions and attempts.

No model is called. Questions are rows; the schema card and the synonym card
are one-row values bounded by the schema (scalar subqueries, evaluated once);
each prompt is a ``concat`` of literal template pieces and columns.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardlens.functions import tokens
from cardlens.functions.text import token_count, trim_text
from cardlens.operators.attempts import attempt_status
from cardlens.operators.catalog import least_rows, schema_text, synonym_card_text
from cardlens.params import Params
from cardlens.sources.standins import questions

DIALECT = "Spark SQL"

SQL_TEMPLATE = (
    "You turn a request about card data into {dialect}. Give exactly one query, closed by a semicolon, "
    "that yields no more than {max_rows} rows.\n\n"
    "## Schema, with the first values of each column\n{schema}\n\n"
    "## Words people use for codes\n{words}\n\n"
    "## Solved requests\n{examples}\n\n"
    "## Request\n{ask}\n\n## Query\n"
)

# The built-in solved requests: (request, query).
EXAMPLE_ROWS = (
    ("how much did account 7 spend each month of Q3 1997 at shops with 'plate' in their name",
     "SELECT substr(CAST(CAST(l_shipdate AS DATE) AS STRING), 1, 7) AS month, "
     "SUM(l_extendedprice) AS total FROM lineitem JOIN part ON l_partkey = p_partkey "
     "JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = 7 AND p_name LIKE '%plate%' "
     "AND l_shipdate >= '1997-07-01' AND l_shipdate < '1997-10-01' GROUP BY 1 ORDER BY 1;"),
    ("which five accounts paid most in 1997",
     "SELECT o_custkey, SUM(l_extendedprice) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
     "WHERE l_shipdate >= '1997-01-01' AND l_shipdate < '1998-01-01' GROUP BY o_custkey ORDER BY total DESC, o_custkey LIMIT 5;"),
)

REPAIR_TEMPLATE = (
    "The database refused the query for this request: {ask}\n\n"
    "## What it said\n{failure}\n\n"
    "## Refused query\n{statement}\n\n"
    "## Schema, with the first values of each column\n{schema}\n\n"
    "Send back a query that runs, and nothing else.\n\n## Query\n"
)

ANSWER_TEMPLATE = (
    "Someone asked: {ask}\n\n"
    "These rows came back:\n{rows}\n\n"
    "They are the outcome of:\n{statement}\n\n"
    "Tell them what the rows mean, in a sentence or two.\n"
)

_SLOT = re.compile(r"\{([a-z_]+)\}")


def fill(template: str, values: dict[str, Column | str]) -> Column:
    """Fill ``{name}`` slots; string values are inlined, columns concatenated."""
    parts: list[Column] = []
    pos = 0
    for m in _SLOT.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        v = values[m.group(1)]
        parts.append(F.lit(v) if isinstance(v, str) else F.coalesce(v, F.lit("")))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts)


def sql_prompts(questions: DataFrame, schema: Column, words: Column, examples: Column | str) -> DataFrame:
    """R1 over (q_id, question): one SQL-writing prompt per question."""
    prompt = fill(SQL_TEMPLATE, {"dialect": DIALECT, "max_rows": "1", "schema": schema, "words": words,
                                 "examples": examples, "ask": F.col("question")})
    return questions.select("q_id", prompt.alias("prompt"))


def budget_of(prompts: DataFrame, window: int, vocabulary: str | None = None) -> DataFrame:
    """R2 over (q_id, prompt): tokens, room left in the context window, and ``fits``,
    false where the prompt alone exceeds it (the reference logs and drops those).

    Tokens are words between blanks, or those of a tokenizer file (``functions.tokens``)."""
    count = token_count(F.col("prompt")) if vocabulary is None else tokens.counter(vocabulary)(F.col("prompt"))
    return _room(prompts.select("q_id", count.cast("bigint").alias("n_tokens")), window)


def _room(counts: DataFrame, window: int) -> DataFrame:
    room = F.lit(window).cast("bigint") - F.col("n_tokens")
    return counts.select("q_id", "n_tokens", room.alias("room"), (room >= 0).alias("fits"))


def word_budget(questions: DataFrame, schema: Column, words: Column, examples: Column | str, window: int) -> DataFrame:
    """R2 over (q_id, question) without building the prompts: the template's words with
    everything but the question are counted once, a question's own are added. The
    question stands between line breaks in the template, so no word runs across."""
    fixed = questions.sparkSession.range(1).select(token_count(fill(SQL_TEMPLATE, {
        "dialect": DIALECT, "max_rows": "1", "schema": schema, "words": words, "examples": examples, "ask": ""})).alias("n"))
    own = token_count(F.coalesce("question", F.lit("")))
    return _room(questions.select("q_id", (own + fixed.scalar()).cast("bigint").alias("n_tokens")), window)


def repairs_of(status: DataFrame, questions: DataFrame, schema: Column) -> DataFrame:
    """A repair prompt per failed attempt, with the attempt's own question; the
    statement slot gets the statement (the reference put the error text there)."""
    j = status.where(F.col("status") != "ok").join(questions, "q_id", "inner")
    sql = F.when(F.col("sql") != "", F.col("sql")).otherwise(F.col("reply"))
    prompt = fill(REPAIR_TEMPLATE, {"statement": sql, "failure": F.col("result_text"), "schema": schema,
                                    "ask": F.col("question")})
    return j.select("q_id", "attempt_no", prompt.alias("prompt"))


def answers_of(status: DataFrame, questions: DataFrame) -> DataFrame:
    """An answer prompt per successful attempt, with the attempt's own question."""
    j = status.where(F.col("status") == "ok").join(questions, "q_id", "inner")
    prompt = fill(ANSWER_TEMPLATE, {"ask": F.col("question"), "statement": F.col("sql"), "rows": F.col("result_text")})
    return j.select("q_id", "attempt_no", prompt.alias("prompt"))


def examples_of(examples: DataFrame) -> DataFrame:
    """Solved requests as one text, ``Request: ... Query: ...`` by their place.

    Rows (place, request, query); a row without a request or a query is left out. The
    list is written by people and bounded by the prompt it has to fit in."""
    line = F.concat(F.lit("Request: "), trim_text(F.col("request")), F.lit("\nQuery: "), trim_text(F.col("query")))
    rows = examples.where((trim_text(F.col("request")) != "") & (trim_text(F.col("query")) != ""))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))),
                                             lambda x: x["line"]), "\n\n").alias("examples"))


def example_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, r, q) for i, (r, q) in enumerate(EXAMPLE_ROWS, start=1)], "place int, request string, query string")


def prompt_table(spark: SparkSession, sf_dir: str, p: Params, examples: DataFrame | None = None) -> DataFrame:
    """R1 on the stored questions; the cards describe all tables, the solved requests
    come from ``examples`` (place, request, query) or the built-in ones."""
    return sql_prompts(questions(spark, sf_dir), schema_text(spark, sf_dir, p).scalar(), synonym_card_text(spark, sf_dir).scalar(),
                       examples_of(examples if examples is not None else example_rows(spark)).scalar())


def prompt_budget(spark: SparkSession, sf_dir: str, p: Params, vocabulary: str | None = None) -> DataFrame:
    """R2 on the stored questions, in words with the card of whole tables, or in the tokens
    of a tokenizer file over the prompts of ``prompt_table``."""
    if vocabulary is None:
        return word_budget(questions(spark, sf_dir), schema_text(spark, sf_dir, p, least_rows).scalar(),
                           synonym_card_text(spark, sf_dir).scalar(), examples_of(example_rows(spark)).scalar(), p.context_window)
    return budget_of(prompt_table(spark, sf_dir, p), p.context_window, vocabulary)


def prompt_tokens(spark: SparkSession, sf_dir: str, p: Params) -> DataFrame:
    """R2 in the tokens of a public vocabulary."""
    return prompt_budget(spark, sf_dir, p, tokens.public_vocabulary(p.vocabulary))


def repair_prompts(spark: SparkSession, sf_dir: str, p: Params) -> DataFrame:
    return repairs_of(attempt_status(spark, sf_dir, p), questions(spark, sf_dir), schema_text(spark, sf_dir, p).scalar())


def answer_prompts(spark: SparkSession, sf_dir: str, p: Params) -> DataFrame:
    return answers_of(attempt_status(spark, sf_dir, p), questions(spark, sf_dir))
