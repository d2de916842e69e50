"""Trace files written by a tracking client.

Layout: ``<root>/<request_id>/artifacts/traces.json`` (one JSON document per
file: ``spans`` array, ``request``, ``response``) and, in a second tree,
``<root>/<request_id>/trace_info.yaml`` (flat ``key: value`` lines).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("context", T.StructType([
        T.StructField("span_id", T.StringType()),
        T.StructField("trace_id", T.StringType())])),
    T.StructField("parent_id", T.StringType()),
    T.StructField("start_time", T.LongType()),
    T.StructField("end_time", T.LongType()),
    T.StructField("status_code", T.StringType()),
    T.StructField("status_message", T.StringType()),
    T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
])

TRACE = T.StructType([
    T.StructField("spans", T.ArrayType(SPAN)),
    T.StructField("request", T.StringType()),
    T.StructField("response", T.StringType()),
])

# Field names of trace_info.yaml and span attribute keys of the
# trace file format.
INFO_KEYS = ("execution_time_ms", "experiment_id", "request_id", "status", "timestamp_ms")
ATTR_TYPE = "mlflow.spanType"
ATTR_INPUTS = "mlflow.spanInputs"
ATTR_OUTPUTS = "mlflow.spanOutputs"


def read_spans(spark: SparkSession, artifacts_glob: str) -> DataFrame:
    """Flat spans of trace files: one row per span with its trace folder as ``request_id``."""
    raw = (spark.read.schema(TRACE).option("multiLine", "true").json(artifacts_glob)
           .withColumn("request_id", F.regexp_extract("_metadata.file_path", r"/([0-9a-f]{32})/artifacts/", 1)))
    return flat_spans(raw)


def read_span_lines(spark: SparkSession, path: str) -> DataFrame:
    """Flat spans of nested records stored one to a line, each with its ``request_id``."""
    line = T.StructType([T.StructField("request_id", T.StringType()), *TRACE.fields])
    return flat_spans(spark.read.schema(line).json(path))


def flat_spans(raw: DataFrame) -> DataFrame:
    """One row per span of nested records (request_id, spans)."""
    sp = raw.select("request_id", F.explode("spans").alias("s"))
    attr = F.col("s.attributes")
    out_json = attr.getItem(ATTR_OUTPUTS)
    return sp.select(
        "request_id",
        F.col("s.name").alias("name"),
        F.col("s.context.span_id").alias("span_id"),
        F.col("s.context.trace_id").alias("trace_id"),
        F.col("s.parent_id").alias("parent_id"),
        F.col("s.start_time").alias("start_ns"),
        F.col("s.end_time").alias("end_ns"),
        ((F.col("s.end_time") - F.col("s.start_time")) / F.lit(1_000_000.0)).alias("duration_ms"),
        F.col("s.status_code").alias("status_code"),
        F.get_json_object(attr.getItem(ATTR_TYPE), "$").alias("span_type"),
        F.coalesce(F.get_json_object(out_json, "$.llm_output.model"),
                   F.get_json_object(out_json, "$.llm_output.model_name")).alias("model"),
        F.get_json_object(out_json, "$.llm_output.usage.input_tokens").cast("bigint").alias("input_tokens"),
        F.get_json_object(out_json, "$.llm_output.usage.output_tokens").cast("bigint").alias("output_tokens"),
        attr.getItem(ATTR_INPUTS).alias("inputs"),
        out_json.alias("outputs"),
    )


RECORD_SPANS = 500  # spans of a nested record, about


def nested_records(spans: DataFrame) -> DataFrame:
    """Spans as nested records, one or more per (key, hour); the stand-in's way to the
    stored form. Spans of a busy hour are dealt out to records by a hash of their id. A
    missing key or start leaves its place in the record's name empty; no span is lost."""
    hour = F.date_format("start_ts", "yyyyMMddHH")
    blank = lambda c: F.coalesce(c, F.lit(""))
    key = F.concat(blank(F.col("trace_key").cast("string")), F.lit("-"), blank(hour))
    s = spans.withColumn("record", key)
    n = s.groupBy("record").agg(F.count("*").alias("n"))
    s = s.join(n, "record").withColumn("block", F.pmod(F.xxhash64("span_id"), F.ceil(F.col("n") / RECORD_SPANS)))
    start = F.unix_micros(F.col("start_ts").cast("timestamp")) * 1000
    end = start + F.round(F.col("duration_ms") * 1_000_000).cast("bigint")
    output = [F.struct("input_tokens", "output_tokens").alias("usage")]
    if "model" in spans.columns:
        output.append(F.col("model"))
    usage = F.to_json(F.struct(F.struct(*output).alias("llm_output")))
    text = lambda c: F.col(c).cast("string").alias(c)
    span = F.struct(
        "name", F.struct(text("span_id"), F.col("trace_key").cast("string").alias("trace_id")).alias("context"),
        *([text("parent_id")] if "parent_id" in spans.columns else []),
        start.alias("start_time"), end.alias("end_time"), F.col("status").alias("status_code"),
        F.create_map(F.lit(ATTR_OUTPUTS), usage).alias("attributes"))
    return s.groupBy("record", "block").agg(F.collect_list(span).alias("spans")).select(
        F.concat("record", F.lit("-"), F.col("block").cast("string")).alias("request_id"), "spans")


def read_trace_info(spark: SparkSession, info_glob: str) -> DataFrame:
    """``trace_info.yaml`` files as one row each (whole-text read + regex)."""
    raw = spark.read.text(info_glob, wholetext=True)
    cols = [F.regexp_extract("value", rf"(?m)^{k}:[ \t]*'?([^'\n]*?)'?[ \t]*$", 1).alias(k) for k in INFO_KEYS]
    df = raw.select(*cols)
    return df.select(F.col("request_id"), F.col("experiment_id"), F.col("status"),
                     F.col("execution_time_ms").cast("bigint").alias("execution_time_ms"),
                     F.col("timestamp_ms").cast("bigint").alias("timestamp_ms"))


def read_traces(spark: SparkSession, artifacts_glob: str, info_glob: str) -> DataFrame:
    """Spans with their trace's timing and status joined on the request id."""
    return read_spans(spark, artifacts_glob).join(read_trace_info(spark, info_glob), "request_id", "left")


def _unrepr(c):
    """Undo the escapes of a quoted Python string literal (newlines, tabs,
    quotes, backslashes)."""
    c = F.regexp_replace(c, r"\\\\", "\u0000")
    c = F.regexp_replace(c, r"\\n", "\n")
    c = F.regexp_replace(c, r"\\t", "\t")
    c = F.regexp_replace(c, r"\\([\"'])", "$1")
    return F.regexp_replace(c, "\u0000", "\\\\")


def sql_attempts_from_spans(spans: DataFrame, tool: str = "sql_db_query") -> DataFrame:
    """The statement text sent and the text returned by each SQL tool span.

    The tool input is stored as the text of a mapping ``{'query': "..."}``;
    the statement is the quoted value with its escapes undone.
    """
    q = spans.where(F.col("name") == tool)
    raw = F.get_json_object("inputs", "$")
    quoted = F.regexp_extract(raw, r"(?s)^\{'query': (?:\"(.*)\"|'(.*)')\}$", 1)
    quoted2 = F.regexp_extract(raw, r"(?s)^\{'query': (?:\"(.*)\"|'(.*)')\}$", 2)
    stmt = _unrepr(F.when(quoted != "", quoted).otherwise(quoted2))
    return q.select("request_id", "start_ns", stmt.alias("sent_text"),
                    F.get_json_object("outputs", "$").alias("result_text"))


def read_trace_names(spark: SparkSession, tags_glob: str) -> DataFrame:
    """(request_id, trace_name) from the per-trace name tag files
    (``<root>/<request_id>/tags/<name tag>``), one whole-text file each."""
    raw = spark.read.text(tags_glob, wholetext=True)
    return raw.select(F.regexp_extract("_metadata.file_path", r"/([0-9a-f]{32})/tags/", 1).alias("request_id"),
                      F.trim(F.col("value")).alias("trace_name"))


def trace_index(spark: SparkSession, runs_root: str, name_tag: str = "mlflow.traceName") -> DataFrame:
    """Every trace with its name, status and timing, from the run folders
    alone (traces without a span artifact file included)."""
    root = runs_root.rstrip("/")
    info = read_trace_info(spark, f"{root}/*/trace_info.yaml")
    names = read_trace_names(spark, f"{root}/*/tags/{name_tag}")
    return info.join(names, "request_id", "left")
