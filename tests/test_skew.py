"""Hot keys: results stay whole and exact, collected groups stay bounded.
Each job is checked against a brute-force computation in Python."""

import datetime as dt
import json
import random
import statistics

from pyspark.sql import functions as F

import fixtures as FX
from cardlens.operators import payments
from cardlens.operators.spans import episode_numbers, latency_stats
from cardlens.sources.cards import RecordCards


def test_hot_account_payment_chunks(spark):
    rnd = random.Random(7)
    rows = [("HOT", f"202304{1 + i % 3:02d}", 100 + i, "Tea", None, None, None, None) for i in range(3000)]
    rows += [("cold", "20230402", 5, "Tea", None, None, None, None)]
    rnd.shuffle(rows)
    cards = RecordCards(spark.createDataFrame(rows, FX.BILLING_SCHEMA))
    p = FX.params(payment_chunk_lines=100)
    out = payments.payments_json(cards, p).collect()
    hot = [r for r in out if r["acct"] == "HOT"]
    assert sum(r["n_payments"] for r in hot) == 3000
    assert len(hot) >= 30
    assert max(r["n_payments"] for r in hot) <= 200
    amounts = sorted(x["amount"] for r in hot for x in json.loads(r["payments"]))
    assert amounts == sorted(100 + i for i in range(3000))


def _spans(spark, rows):
    return spark.createDataFrame(rows, "span_id long, trace_key long, name string, start_ts timestamp_ntz, "
                                       "duration_ms double, status string, tokens long")


def test_latency_stats_exact_on_hot_name(spark):
    rnd = random.Random(3)
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(4001):
        name = "hot" if i < 3000 else rnd.choice(["a", "b", "c"])
        v = round(rnd.choice([rnd.uniform(0, 5), rnd.uniform(100, 5000), 2.5]), 2)
        rows.append((i, 1, name, t0, v, "OK", 1))
    got = {r["name"]: r for r in latency_stats(_spans(spark, rows)).collect()}
    for name in {r[2] for r in rows}:
        vals = [r[4] for r in rows if r[2] == name]
        g = got[name]
        assert g["n_spans"] == len(vals)
        assert g["median_ms"] == statistics.median(vals)
        assert g["min_ms"] == min(vals) and g["max_ms"] == max(vals)
        assert abs(g["sum_ms"] - sum(vals)) < 1e-6


def test_latency_stats_keep_nanoseconds(spark):
    from fractions import Fraction
    rnd = random.Random(4)
    t0 = dt.datetime(2024, 1, 1)
    tiny = [0.004, 0.004, 1.234567]
    fine = [round(rnd.uniform(100, 104), 6) for _ in range(5000)]  # one bucket holds all
    rows = [(i, 1, name, t0, v, "OK", 1) for i, (name, v) in enumerate(
        [("tiny", v) for v in tiny] + [("fine", v) for v in fine])]
    got = {r["name"]: r for r in latency_stats(_spans(spark, rows)).collect()}
    for name, vals in (("tiny", tiny), ("fine", fine)):
        assert got[name]["median_ms"] == statistics.median(vals)
        assert got[name]["sum_ms"] == float(sum(Fraction(str(v)) for v in vals))


def test_episodes_on_hot_key_match_running_count(spark):
    rnd = random.Random(5)
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(3000):
        key = 1 if i < 2000 else rnd.randint(2, 6)
        ts = t0 + dt.timedelta(minutes=rnd.randint(0, 60 * 24 * 3), seconds=rnd.randint(0, 1))
        name = rnd.choice(["signup", "click", "view", "error"])
        rows.append((i, key, name, ts, 1.0, "OK", 1))
    got = {r["span_id"]: r["episode_no"] for r in episode_numbers(_spans(spark, rows), "hour").collect()}
    want = {}
    for key in {r[1] for r in rows}:
        n = 0
        for r in sorted((r for r in rows if r[1] == key), key=lambda r: (r[3], r[0])):
            n += r[2] == "signup"
            want[r[0]] = n
    assert got == want


def test_a_busy_hour_is_cut_in_slices(spark, monkeypatch):
    import cardlens.operators.spans as S
    monkeypatch.setattr(S, "SLICE_SPANS", 50)
    rnd = random.Random(6)
    t0 = dt.datetime(2024, 1, 1, 10)
    rows = [(i, 1, rnd.choice(["signup", "click"]), t0 + dt.timedelta(seconds=rnd.randint(0, 4000)), 1.0, "OK", 1)
            for i in range(1500)]
    got = {r["span_id"]: r["episode_no"] for r in episode_numbers(_spans(spark, rows), "hour").collect()}
    want, n = {}, 0
    for r in sorted(rows, key=lambda r: (r[3], r[0])):
        n += r[2] == "signup"
        want[r[0]] = n
    assert got == want


def test_hot_join_key_is_split_by_aqe(spark):
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        hot = F.when(F.col("id") % 10 < 8, F.lit(7)).otherwise(F.col("id") % 1000)
        lines = spark.range(200000).select(hot.alias("k"), F.col("id").alias("v"))
        parts = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
        j = lines.join(parts, "k").groupBy("k").agg(F.sum("v").alias("s"))
        got = dict((r["k"], r["s"]) for r in j.collect())
        assert got[7] == sum(i for i in range(200000) if i % 10 < 8 or i % 1000 == 7)
        assert "SortMergeJoin(skew=true)" in j._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_episodes_with_closer_count_strictly_before(spark):
    rnd = random.Random(11)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, 1 + (i % 3 == 0), rnd.choice(["answer", "chain", "tool"]),
             t0 + dt.timedelta(minutes=rnd.randint(0, 3000)), 1.0, "OK", 1) for i in range(800)]
    got = {r["span_id"]: r["episode_no"]
           for r in episode_numbers(_spans(spark, rows), "hour", opener=None, closer="answer").collect()}
    want = {}
    for key in {r[1] for r in rows}:
        n = 0
        for r in sorted((r for r in rows if r[1] == key), key=lambda r: (r[3], r[0])):
            want[r[0]] = n
            n += r[2] == "answer"
    assert got == want
