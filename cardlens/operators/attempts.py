"""Replies, extracted statements and attempt outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardlens.functions.text import (error_class, extract_sql, has_error_marker, trim_text,
                                     truncate_display)
from cardlens.params import Params
from cardlens.sources.standins import attempts, replies, reply_chunks
from cardlens.sources.tables import read_table


def cleaned(r: DataFrame) -> DataFrame:
    """C10 over (conv_id, turn, text): surrounding whitespace and line breaks removed."""
    clean = trim_text(F.col("text"))
    return r.select("conv_id", "turn", clean.alias("clean_text"),
                    F.length(clean).cast("bigint").alias("n_chars"), (clean != F.col("text")).alias("changed"))


def response_clean(spark: SparkSession, sf_dir: str, p: Params) -> DataFrame:
    return cleaned(replies(spark, sf_dir))


def extracted(a: DataFrame) -> DataFrame:
    """R3 over (q_id, attempt_no, reply): the statement inside each reply ('' when none)."""
    sql = extract_sql(F.col("reply"))
    return a.select("q_id", "attempt_no", sql.alias("sql"),
                    (sql != trim_text(F.col("reply"))).alias("had_wrapping"))


def sql_extract(spark: SparkSession, sf_dir: str, p: Params) -> DataFrame:
    return extracted(attempts(spark, sf_dir))


def status_of(a: DataFrame) -> DataFrame:
    """R4 + C11 over (q_id, attempt_no, reply, result_text)."""
    return a.select("q_id", "attempt_no", "reply", "result_text",
                    extract_sql(F.col("reply")).alias("sql"),
                    error_class(F.col("result_text")).alias("status"),
                    has_error_marker(F.col("result_text")).alias("has_error_marker"))


def attempt_status(spark: SparkSession, sf_dir: str, p: Params) -> DataFrame:
    """R4 + C11: error class of each attempt and the reference's own flag."""
    return status_of(attempts(spark, sf_dir))


def outcome_of(status: DataFrame, budget: int) -> DataFrame:
    """R5 over (q_id, attempt_no, status).

    Two aggregates and no window: the first successful attempt per question,
    then its position (attempts before it + 1) from a join back on the
    question. A question with a huge log is spread over many tasks.
    """
    st = status.select("q_id", "attempt_no", "status")
    is_ok = F.col("status") == "ok"
    per_q = st.groupBy("q_id").agg(
        F.count("*").alias("n_attempts"),
        F.min(F.when(is_ok, F.col("attempt_no"))).alias("first_ok_no"))
    before = (st.join(per_q.select("q_id", "first_ok_no"), "q_id", "inner")
                .groupBy("q_id")
                .agg(F.sum(F.when(F.col("attempt_no") < F.col("first_ok_no"), 1).otherwise(0))
                     .alias("n_before")))
    j = per_q.join(before, "q_id", "inner")
    budget = F.lit(budget).cast("bigint")
    rank = F.when(F.col("first_ok_no").isNotNull(), F.col("n_before") + 1)
    first_ok = F.when(rank <= budget, rank).cast("bigint")
    used = F.coalesce(first_ok.cast("bigint"), F.least(F.col("n_attempts"), budget))
    return j.select("q_id", "n_attempts", first_ok.alias("first_ok_attempt"),
                    used.alias("attempts_used"),
                    F.when(first_ok.isNotNull(), F.lit("ok")).otherwise(F.lit("no result")).alias("final_status"))


def attempt_outcome(spark: SparkSession, sf_dir: str, p: Params) -> DataFrame:
    """Per question, the attempt that first succeeded within the budget,
    the attempts used and the final status."""
    return outcome_of(attempt_status(spark, sf_dir, p), p.retry_budget)


def error_mix_of(status: DataFrame) -> DataFrame:
    return status.groupBy("attempt_no", "status").agg(F.count("*").alias("n_attempts"))


def error_mix(spark: SparkSession, sf_dir: str, p: Params) -> DataFrame:
    """T4: attempts per error kind and attempt number within the question."""
    return error_mix_of(attempt_status(spark, sf_dir, p))


CHUNK_CHARS = 64  # characters of a stored chunk on the test tables


def join_chunks(chunks: DataFrame) -> DataFrame:
    """R6 over (conv_id, turn, chunk_no, chunk): each reply's chunks joined in order,
    blank chunks dropped, the result trimmed. A group is one reply, which the
    model's output limit bounds."""
    c = chunks.where(trim_text(F.col("chunk")) != "")
    g = c.groupBy("conv_id", "turn").agg(F.count("*").alias("n_chunks"),
                                         F.collect_list(F.struct("chunk_no", "chunk")).alias("chunks"))
    joined = F.array_join(F.transform(F.array_sort("chunks"), lambda x: x["chunk"]), "")
    return g.select("conv_id", "turn", "n_chunks", trim_text(joined).alias("answer"))


def chunk_join(spark: SparkSession, sf_dir: str, p: Params) -> DataFrame:
    return join_chunks(reply_chunks(spark, sf_dir, CHUNK_CHARS))


def display_truncate(spark: SparkSession, sf_dir: str, p: Params) -> DataFrame:
    """Display form of each message (first n characters + '...'); the
    full length is kept beside it. Never used before an aggregate."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", F.length("text").cast("bigint").alias("n_chars"),
                    truncate_display(F.col("text"), p.display_chars).alias("display"))
