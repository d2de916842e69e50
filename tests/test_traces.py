"""The reader of trace files and of nested span records."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from cardlens.sources import standins
from cardlens.sources.traces import read_spans, read_trace_info, read_traces, trace_index
from conftest import SMALL


# Field names and attribute keys of the trace file format.
def _write_trace(root, req, spans, info):
    d = os.path.join(root, "artifacts", req, "artifacts")
    os.makedirs(d)
    with open(os.path.join(d, "traces.json"), "w") as f:
        json.dump({"spans": spans, "request": "{}", "response": "{}"}, f)
    d2 = os.path.join(root, "runs", req)
    os.makedirs(d2)
    with open(os.path.join(d2, "trace_info.yaml"), "w") as f:
        f.write("".join(f"{k}: {v}\n" for k, v in info.items()))
    os.makedirs(os.path.join(d2, "tags"))
    with open(os.path.join(d2, "tags", "mlflow.traceName"), "w") as f:
        f.write(spans[0]["name"] if spans else "chain")


def test_trace_reader(spark):
    root = tempfile.mkdtemp(prefix="cardlens-traces-")
    r1, r2 = "a" * 32, "b" * 32
    usage = json.dumps({"llm_output": {"usage": {"input_tokens": 120, "output_tokens": 45}}})
    _write_trace(root, r1, [
        {"name": "sql_db_query", "context": {"span_id": "0x1", "trace_id": "0xa"}, "parent_id": None,
         "start_time": 1_000_000_000, "end_time": 1_006_000_000, "status_code": "OK", "status_message": "",
         "attributes": {"mlflow.spanType": '"TOOL"', "mlflow.spanInputs": '"{\'query\': \'SELECT 1\'}"',
                        "mlflow.spanOutputs": '"[(1,)]"'}, "events": []}],
        {"execution_time_ms": 6, "experiment_id": "'7'", "request_id": r1, "status": "OK",
         "timestamp_ms": 1000})
    _write_trace(root, r2, [
        {"name": "ChatModel", "context": {"span_id": "0x2", "trace_id": "0xb"}, "parent_id": None,
         "start_time": 2_000_000_000, "end_time": 4_500_000_000, "status_code": "OK", "status_message": "",
         "attributes": {"mlflow.spanType": '"CHAT_MODEL"', "mlflow.spanOutputs": usage}, "events": []}],
        {"execution_time_ms": 2500, "experiment_id": "'7'", "request_id": r2, "status": "OK",
         "timestamp_ms": 2000})
    spans = read_spans(spark, os.path.join(root, "artifacts", "*", "artifacts", "traces.json"))
    got = {r["request_id"]: r for r in spans.collect()}
    assert got[r1]["duration_ms"] == 6.0 and got[r1]["span_type"] == "TOOL"
    assert got[r2]["input_tokens"] == 120 and got[r2]["output_tokens"] == 45
    info = read_trace_info(spark, os.path.join(root, "runs", "*", "trace_info.yaml"))
    assert {r["request_id"]: r["execution_time_ms"] for r in info.collect()} == {r1: 6, r2: 2500}
    both = read_traces(spark, os.path.join(root, "artifacts", "*", "artifacts", "traces.json"),
                       os.path.join(root, "runs", "*", "trace_info.yaml"))
    assert both.where(F.col("experiment_id") == "7").count() == 2
    # a trace with run files only (no span file) still appears in the index
    d3 = os.path.join(root, "runs", "c" * 32)
    os.makedirs(os.path.join(d3, "tags"))
    with open(os.path.join(d3, "trace_info.yaml"), "w") as f:
        f.write(f"execution_time_ms: 7000\nexperiment_id: '7'\nrequest_id: {'c' * 32}\nstatus: OK\ntimestamp_ms: 3000\n")
    with open(os.path.join(d3, "tags", "mlflow.traceName"), "w") as f:
        f.write("Chain")
    idx = {r["request_id"]: (r["trace_name"], r["execution_time_ms"])
           for r in trace_index(spark, os.path.join(root, "runs")).collect()}
    assert idx == {r1: ("sql_db_query", 6), r2: ("ChatModel", 2500), "c" * 32: ("Chain", 7000)}


def test_statement_text_of_tool_spans(spark):
    from cardlens.functions.text import extract_sql
    from cardlens.sources.traces import sql_attempts_from_spans
    sent = json.dumps("{'query': \"As asked.\\n\\nSQLQuery: SELECT a\\nFROM t WHERE b = 'x';\"}")
    df = spark.createDataFrame([("r", 1, "sql_db_query", sent, json.dumps("Error: near \"As\": syntax error"))],
                               "request_id string, start_ns long, name string, inputs string, outputs string")
    r = sql_attempts_from_spans(df).select("sent_text", extract_sql(F.col("sent_text")).alias("sql")).first()
    assert r["sent_text"].startswith("As asked.\n\nSQLQuery: ")
    assert r["sql"] == "SELECT a\nFROM t WHERE b = 'x';"


def test_nested_records_are_bounded_and_whole(spark, monkeypatch):
    import cardlens.sources.traces as traces
    monkeypatch.setattr(traces, "RECORD_SPANS", 10)
    sp = standins.spans(spark, SMALL).withColumn("trace_key", F.lit(1)).withColumn(
        "start_ts", F.expr("TIMESTAMP_NTZ '2024-01-01 10:30:00'"))  # one busy hour
    rec = traces.nested_records(sp)
    sizes = [r["n"] for r in rec.select(F.size("spans").alias("n")).collect()]
    assert sum(sizes) == sp.count() and max(sizes) < 40
    path = tempfile.mkdtemp(prefix="cardlens-nested-") + "/t"
    rec.write.json(path)
    flat = traces.read_span_lines(spark, path)
    want = sp.agg(F.sum("duration_ms").alias("d"), F.sum("input_tokens").alias("i")).first()
    got = flat.agg(F.sum("duration_ms").alias("d"), F.sum("input_tokens").alias("i")).first()
    assert abs(got["d"] - want["d"]) < 1e-6 and got["i"] == want["i"]
