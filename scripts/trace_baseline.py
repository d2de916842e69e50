"""Recompute per-name latency statistics from a folder of stored traces.

usage: python scripts/trace_baseline.py <artifacts_root> <runs_root> [answer_trace_name]

``artifacts_root/<id>/artifacts/traces.json`` and ``runs_root/<id>/trace_info.yaml``.
Prints, per root span name, the trace-level time (execution_time_ms) and the
span-level time, both through ``spans.latency_stats``.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from cardlens.functions.text import error_class, extract_sql  # noqa: E402
from cardlens.operators.spans import episode_numbers, latency_stats  # noqa: E402
from cardlens.session import get_session  # noqa: E402
from cardlens.sources.traces import read_spans, read_trace_info, sql_attempts_from_spans, trace_index  # noqa: E402


def main() -> None:
    art, runs = sys.argv[1], sys.argv[2]
    closer = sys.argv[3] if len(sys.argv) > 3 else "ChatAnthropic"
    spark = get_session("local[4]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    spans = read_spans(spark, f"{art.rstrip('/')}/*/artifacts/traces.json")
    roots = spans.where(F.col("parent_id").isNull()).select("request_id", "name", "duration_ms")
    info = read_trace_info(spark, f"{runs.rstrip('/')}/*/trace_info.yaml")
    per_trace = roots.join(info, "request_id").select("name", F.col("execution_time_ms").cast("double").alias("ms"))
    print("trace time (execution_time_ms) by trace name, all traces")
    idx = trace_index(spark, runs).select(F.col("trace_name").alias("name"),
                                          F.col("execution_time_ms").cast("double").alias("ms"))
    latency_stats(idx, "name", "ms").orderBy("name").show(truncate=False)
    print("question episodes (T3): an answer trace closes an episode")
    tl = trace_index(spark, runs).select(
        F.col("experiment_id").alias("trace_key"), F.col("request_id").alias("span_id"),
        F.col("trace_name").alias("name"),
        F.timestamp_millis("timestamp_ms").cast("timestamp_ntz").alias("start_ts"),
        "timestamp_ms", "execution_time_ms")
    ep = episode_numbers(tl, "day", opener=None, closer=closer)
    (ep.groupBy("episode_no")
       .agg(F.count("*").alias("n_traces"),
            F.sum(F.when(F.col("name") == "sql_db_query", 1).otherwise(0)).alias("n_statements"),
            ((F.max(F.col("timestamp_ms") + F.col("execution_time_ms")) - F.min("timestamp_ms")) / 1000.0)
            .alias("elapsed_s"))
       .orderBy("episode_no").show(truncate=False))
    print("SQL attempts (R4, R5, T4): error class per stored tool output, by position in its episode")
    outs = spans.where(F.col("name") == "sql_db_query").select(
        "request_id", F.get_json_object("outputs", "$").alias("result_text"))
    att = (ep.join(outs, ep.span_id == outs.request_id, "inner")
             .select("episode_no", "start_ts", "span_id", error_class(F.col("result_text")).alias("status")))
    first = att.groupBy("episode_no").agg(F.min_by("status", F.struct("start_ts", "span_id")).alias("first_status"))
    att.groupBy("status").count().orderBy("status").show()
    first.groupBy("first_status").count().show()
    print("statements inside the text sent (R3): syntax-error replies and what they held")
    sent = sql_attempts_from_spans(spans).select(
        error_class(F.col("result_text")).alias("status"),
        F.substring("sent_text", 1, 12).alias("sent_starts"),
        F.substring(extract_sql(F.col("sent_text")), 1, 40).alias("extracted_starts"))
    sent.orderBy("status", "sent_starts").show(truncate=False)
    print("trace time (execution_time_ms) by root span name, traces with span files")
    latency_stats(per_trace, "name", "ms").orderBy("name").show(truncate=False)
    print("span time (end - start) by root span name")
    latency_stats(roots, "name", "duration_ms").orderBy("name").show(truncate=False)
    print("tokens by span name (T2)")
    (spans.where(F.col("input_tokens").isNotNull()).groupBy("name")
          .agg(F.count("*").alias("n_calls"), F.sum("input_tokens").alias("input_tokens"),
               F.sum("output_tokens").alias("output_tokens"))
          .show(truncate=False))


if __name__ == "__main__":
    main()
