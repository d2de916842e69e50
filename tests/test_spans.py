"""Span jobs: two-marker episodes, trees, models and null keys against brute force."""

import datetime as dt
import json
import random
import tempfile

import pytest

import cardlens.operators.spans as spans
from cardlens.sources.traces import nested_records, read_span_lines

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "span_id long, trace_key long, name string, start_ts timestamp_ntz, duration_ms double, status string"


def brute(rows, reopen):
    want = {}
    for key in {r[1] for r in rows}:
        n, is_open = 0, False
        own = [r for r in rows if r[1] == key]
        for r in sorted(own, key=lambda r: (r[3] is not None, r[3] or T0, r[0])):
            if r[2] == "first" and (reopen or not is_open):
                n, is_open = n + 1, True
            want[r[0]] = n if is_open else None
            if r[2] == "answer":
                is_open = False
    return want


@pytest.mark.parametrize("reopen", [False, True])
@pytest.mark.parametrize("slice_spans", [3, 100_000])
def test_episodes_open_and_close_on_a_hot_key(spark, monkeypatch, reopen, slice_spans):
    monkeypatch.setattr(spans, "SLICE_SPANS", slice_spans)
    rnd = random.Random(13)
    rows = [(i, None if i % 7 == 0 else 1 if i % 5 else 2, rnd.choice(["first", "answer", "tool", "tool", None]),
             T0 + dt.timedelta(seconds=rnd.choice([60 * rnd.randint(0, 4000), rnd.randint(0, 900)])), 1.0, "OK") for i in range(900)]
    rows += [(1000 + i, 9, "answer", T0 + dt.timedelta(hours=i), 1.0, "OK") for i in range(3)]  # nothing ever opens
    got = spans.episode_numbers(spark.createDataFrame(rows, SCHEMA), "hour", "first", "answer", reopen)
    assert {r["span_id"]: r["episode_no"] for r in got.collect()} == brute(rows, reopen)


def test_a_stray_span_after_the_answer_belongs_to_no_episode(spark):
    names = ["tool", "first", "tool", "answer", "tool", "answer", "first", "first", "answer"]
    rows = [(i, 1, n, T0 + dt.timedelta(minutes=40 * i), 1.0, "OK") for i, n in enumerate(names)]
    got = spans.episode_numbers(spark.createDataFrame(rows, SCHEMA), "hour", "first", "answer")
    assert [r["episode_no"] for r in got.orderBy("span_id").collect()] == [None, 1, 1, 1, None, None, 2, 2, 2]


def test_markers_must_be_named_and_differ(spark):
    df = spark.createDataFrame([], SCHEMA)
    for opener, closer in ((None, None), ("a", "a")):
        with pytest.raises(ValueError):
            spans.episode_numbers(df, "hour", opener, closer)
    assert spans.episode_numbers(df, "hour", "a", "b").count() == 0


def test_latency_keeps_spans_without_a_name(spark):
    rows = [(i, 1, n, T0, v, "OK") for i, (n, v) in enumerate([(None, 2.0), (None, 6.0), ("a", 3.0), ("a", None)])]
    got = {r["name"]: (r["n_spans"], r["median_ms"]) for r in spans.latency_stats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {None: (2, 4.0), "a": (1, 3.0)}


def test_nested_records_keep_null_keys_and_times(spark):
    rows = [(1, None, "a", T0, 1.0, "OK"), (2, 5, "a", None, 1.0, "OK"), (3, None, None, None, None, None), (4, 5, "b", T0, 2.0, "OK")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1L AS input_tokens", "2L AS output_tokens")
    path = tempfile.mkdtemp(prefix="cardlens-null-") + "/t"
    nested_records(df).write.json(path)
    back = read_span_lines(spark, path)
    assert sorted(r["span_id"] for r in back.collect()) == ["1", "2", "3", "4"]
    assert spans.usage_of(back).agg({"n_calls": "sum"}).first()[0] == 4


def test_tokens_count_by_the_model_that_the_outputs_name(spark):
    out = lambda **kw: json.dumps({"llm_output": kw})
    usage = {"input_tokens": 5, "output_tokens": 2}
    path = tempfile.mkdtemp(prefix="cardlens-model-") + "/t.json"
    with open(path, "w") as f:
        f.write(json.dumps({"request_id": "r", "spans": [
            {"name": "chat", "attributes": {"mlflow.spanOutputs": out(model="m1", usage=usage)}},
            {"name": "chat", "attributes": {"mlflow.spanOutputs": out(model_name="m2", usage=usage)}},
            {"name": "chat", "attributes": {"mlflow.spanOutputs": out(usage=usage)}},
            {"name": "other", "attributes": {"mlflow.spanOutputs": out(model="m1", usage=usage)}},
            {"name": "tool", "attributes": {}}]}))
    got = {r["model"]: (r["n_calls"], r["input_tokens"]) for r in spans.usage_of(read_span_lines(spark, path)).collect()}
    assert got == {"m1": (2, 10), "m2": (1, 5), "chat": (1, 5), "tool": (1, None)}


TREE = "request_id long, span_id long, parent_id long, duration_ms double"


def brute_tree(rows):
    parent = {(q, s): p for q, s, p, _ in rows if s is not None}
    out = []
    for q, s, p, d in rows:
        at, depth, seen = s, 0, set()
        while at is not None and at not in seen and (q, parent.get((q, at))) in parent:
            seen.add(at)
            at, depth = parent[q, at], depth + 1
        lost = at in seen
        kids = sum(x[3] or 0 for x in rows if x[0] == q and x[2] == s and s is not None and x[1] is not None)
        out.append((q, s, None if lost else at, None if lost else depth, None if d is None else round(d - kids, 6)))
    return sorted(out, key=str)


def test_span_tree_resolves_parents_by_pointer_doubling(spark):
    rnd = random.Random(17)
    rows = [(1, i, i - 1 if i else None, 200.0 - i) for i in range(100)]  # a chain
    rows += [(2, i, rnd.randrange(i) if i else None, round(rnd.uniform(1, 9), 3)) for i in range(150)]
    rows += [(None, 1, None, 5.0), (None, 2, 1, 2.0), (None, 3, 1, 1.5), (3, 1, 99, 4.0), (3, 2, 1, 1.0)]  # null request, missing parent
    rows += [(4, 1, 3, 1.0), (4, 2, 1, 1.0), (4, 3, 2, 1.0), (4, 4, 1, 1.0), (4, 5, 5, 1.0), (5, None, None, 7.0)]  # cycles, no id
    got = spans.span_tree_of(spark.createDataFrame(rows, TREE)).collect()
    assert sorted([(r["request_id"], r["span_id"], r["root_id"], r["depth"], None if r["own_ms"] is None else round(r["own_ms"], 6)) for r in got],
                  key=str) == brute_tree(rows)
    for root in [(1, 0), (2, 0), (None, 1), (3, 1)]:
        tree = [r for r in got if (r["request_id"], r["root_id"]) == root]
        assert abs(sum(r["own_ms"] for r in tree) - next(r["total_ms"] for r in tree if r["depth"] == 0)) < 1e-6


def test_span_tree_of_no_spans(spark):
    assert spans.span_tree_of(spark.createDataFrame([], TREE)).collect() == []
