"""The stored backoff model against the model in plain Python, for three orders."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_helpers import docs_of, words
from pyspark.sql import functions as F
from test_katz import END, corpus

from cardlens.llm import katz, katz_tables


class Brute:
    def __init__(self, train, order):
        self.order, self.counts, self.d, self.after = order, {}, {}, {}
        for k in range(1, order + 1):
            self.counts[k] = Counter(g for t in train for g in self.grams(t, k))
            n = Counter(self.counts[k].values())
            self.d[k] = katz.discounts(np.array([n[r] for r in range(1, katz.CUT + 2)], dtype=float))
            self.after[k] = defaultdict(dict)
            for g, c in self.counts[k].items():
                self.after[k][g[:-1]][g[-1]] = c
        self.n = sum(self.counts[1].values())

    @staticmethod
    def grams(text, k):
        s = [END] * (k - 1) + [*words(text), END]
        return [tuple(s[i:i + k]) for i in range(len(s) - k + 1)]

    def kept(self, k, c):
        return c * (self.d[k][c - 1] if c <= katz.CUT else 1.0)

    def p(self, g):
        k = len(g)
        if k == 1:
            c = self.counts[1][g]
            return self.kept(1, c) / (self.n + 1) if c else 1 - sum(self.kept(1, c) for c in self.counts[1].values()) / (self.n + 1)
        seen = self.after[k].get(g[:-1])
        if not seen:
            return self.p(g[1:])
        total = sum(seen.values()) + 1
        if g[-1] in seen:
            return self.kept(k, seen[g[-1]]) / total
        left = 1 - sum(self.kept(k, c) for c in seen.values()) / total
        return left / (1 - sum(self.p((*g[1:-1], w)) for w in seen)) * self.p(g[1:])

    def score(self, text):
        return sum(math.log10(self.p(g)) for g in self.grams(text, self.order))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_a_second_table_scored_with_the_stored_model(spark, order):
    rows = [(i, t if t is None or len(t) < 4000 else t[:900]) for i, t in corpus()][:70]
    train = [t for i, t in rows if i is None or i % 5]
    model = katz_tables.train(docs_of(spark, [r for r in rows if r[0] is None or r[0] % 5], extra=True), order)
    back = katz_tables.load(spark, model.path)
    assert back == model and model.tokens == sum(len(words(t)) + 1 for t in train)
    brute = Brute(train, order)
    out = katz_tables.score(docs_of(spark, rows, extra=True), back).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.score) for r in out)
    want = sorted((i is None, i or 0, len(words(t)) + 1, brute.score(t)) for i, t in rows)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:3] == w[:3] and abs(g[3] - w[3]) < 1e-6, (g, w)


def test_probabilities_of_the_tables_sum_to_one(spark):
    texts = ["a b a c", "a b b", "c a b", "b", "a a a a a a a"]
    model = katz_tables.train(docs_of(spark, list(enumerate(texts))), 3)
    brute = Brute(texts, 3)
    vocabulary = sorted({w for t in texts for w in words(t)}) + [END]
    for context in [("a", "b"), (END, END), ("c", "never"), ("b", "b")]:
        assert abs(sum(brute.p((*context, w)) for w in vocabulary) + brute.p((*context, "unknown word")) - 1) < 1e-9
    p = model.table(spark, "grams", 1).agg(F.sum(F.pow(F.lit(10.0), "log_p"))).first()[0]
    assert abs(p + 10 ** model.unknown - 1) < 1e-9


def test_empty_training_and_empty_tables(spark):
    model = katz_tables.train(docs_of(spark, []), 2)
    out = katz_tables.score(docs_of(spark, [(1, "a b"), (2, None)]), model).collect()
    assert sorted((r.doc_id, r.n_tokens, r.score) for r in out) == [(1, 3, 0.0), (2, 1, 0.0)]
    assert katz_tables.score(docs_of(spark, []), model).collect() == []
    with pytest.raises(ValueError):
        katz_tables.train(docs_of(spark, []), 0)


def test_the_query_agrees_with_the_tables(spark):
    """Two evaluations of one model: the query's, within groups of pairs, and by the stored tables."""
    rows = [(i, t) for i, t in corpus() if i is not None and i < 60]
    docs = docs_of(spark, rows).withColumn("held_out", F.col("doc_id") % 5 == 0)
    model = katz_tables.train(docs.where("not held_out"), 2)
    a = sorted((r.doc_id, r.score) for r in katz.score_texts(docs).collect())
    b = sorted((r.doc_id, r.score) for r in katz_tables.score(docs, model).collect())
    assert [x[0] for x in a] == [x[0] for x in b] and np.allclose([x[1] for x in a], [x[1] for x in b], atol=1e-6)
