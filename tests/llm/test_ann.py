import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardlens.llm import ann

ROWS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                     T.StructField("label", T.IntegerType())])


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], ROWS)


def brute(rows, k=20):
    """(query, rank) -> (vec_id, score), all candidates compared."""
    ok = {(i, tuple(np.float32(x) for x in v)) for i, v in rows
          if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, x in ok:
        if q % 20 == 0:
            near = [(-float((np.array(x, float) * np.array(v, float)).sum()), i) for i, v in ok if i != q and len(v) == len(x)]
            for r, (s, i) in enumerate(sorted(near)[:k], 1):
                out.setdefault((q, r), []).append((i, -s))
    return out


def got(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.query_id, r["rank"]), []).append((r.vec_id, r.score))
    return out


def same(a, b):
    assert a.keys() == b.keys()
    for key, hits in a.items():
        assert [h[0] for h in sorted(hits)] == [h[0] for h in sorted(b[key])], key
        assert np.allclose([h[1] for h in sorted(hits)], [h[1] for h in sorted(b[key])], rtol=1e-12, atol=1e-12)


def search(spark, rows, **kw):
    df = frame(spark, rows)
    for i, c in enumerate(["key", "class", "vector", "ids", "query", "score", "rank", "r"]):
        df = df.withColumn(c, F.lit(i))
    return ann.nearest(df.where("vec_id % 20 = 0"), df, **kw)


def test_awkward_rows_and_few_candidates_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(45)]
    rows += [(i, [0.5, 0.5, 0.0, 1.0]) for i in range(100, 160)]  # copies, three of them queries
    rows += [(200, None), (201, []), (202, [0.0, 0.0, -0.0, 0.0]), (203, [1.0, None, 0.0, 0.0]), (220, [float("nan"), 1, 1, 1]),
             (240, [float("inf"), 1, 1, 1]), (None, [1, 1, 1, 1]), (260, [1e30, -1e30, 1.0, 2.0]), (261, [-0.0, 3, 0, 0]), (262, [0.0, 3, 0, 0]),
             (300, [1.0, 2.0]), (301, [2.0, 1.0]), (280, [1.0] * 7), (20, [9.0, 9, 9, 9]), (5, [1.0, 1, 1, 1]), (5, [1.0, 1, 1, 1])]
    same(got(search(spark, rows)), brute(rows))


def test_ties_go_to_the_smaller_id_across_vectors(spark):
    rows = [(0, [1.0, 0, 0])] + [(i, [1.0, float(i % 50 + 1), 0]) for i in range(1, 100) if i % 20] + [(1000 - i, [0.0, float(i), 1]) for i in range(50)]
    same(got(search(spark, rows)), brute(rows))


@pytest.mark.parametrize("clustered", [False, True])
def test_recall_and_exact_scores(spark, clustered):
    rng = np.random.default_rng(2)
    n, dim = 3000, 24
    centres = rng.normal(size=(60, dim)) * (1 if clustered else 0)
    x = centres[rng.integers(0, 60, n)] + rng.normal(size=(n, dim)) * (0.2 if clustered else 1)
    x = x * rng.uniform(0.5, 2, size=(n, 1)) if not clustered else x
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    found = got(search(spark, rows))
    v = x.astype(np.float32).astype(float)
    hits = total = 0
    for q in range(0, n, 20):
        score = (v[q] * v).sum(axis=1)
        score[q] = -np.inf
        true = set(np.argsort(-score)[:20].tolist())
        mine = [found[q, r][0] for r in range(1, 21)]
        assert all(abs(s - score[i]) < 1e-12 for i, s in mine) and [s for _, s in mine] == sorted((s for _, s in mine), reverse=True)
        hits, total = hits + len(true & {i for i, _ in mine}), total + 20
    assert hits / total >= 0.9


def test_clustered_vectors_are_not_all_visited():
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(200, 32)), 20, axis=0) + rng.normal(size=(4000, 32)) * 0.05
    norm = np.sqrt((x * x).sum(axis=1)).max()
    near = []
    for i in range(32):
        s = x @ x[i * 40]
        near.append(ann._on_sphere(x[np.argsort(-s)[1:20]], norm))
    k, width, probes, share = ann._choose(ann._as_query(x[:32 * 40:40]), near, ann._on_sphere(x, norm), len(x), 0.95)
    keys = ann._keys(ann._probes(ann._as_query(x[:32 * 40:40]), k, width, 0, probes), 32, k, width, 0)
    own = ann._keys(np.floor(ann._cells(ann._on_sphere(x, norm), k, width, 0)), 32, k, width, 0)
    assert share >= 0.95 and np.mean([np.isin(own, keys[i]).mean() for i in range(32)]) < 0.3


def test_probe_sets_come_in_order_and_never_hold_both_steps():
    for k in (2, 5, 8):
        sets = ann.probe_sets(k, 300)
        assert len(set(sets)) == len(sets) and sets[0] == ()
        assert not any(2 * k - 1 - s in steps for steps in sets for s in steps)
    assert len(ann.probe_sets(2, 300)) == 9  # every choice of -1, 0, 1


def test_no_rows_and_no_queries(spark):
    assert search(spark, []).collect() == []
    assert search(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]).collect() == []
