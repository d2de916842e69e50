import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_helpers import docs_of, prose, words
from pyspark.sql import functions as F

from cardlens.llm import katz

END = "\0end"


class Brute:
    """The model in plain Python."""

    def __init__(self, train):
        seqs = [[END, *words(t), END] for t in train]
        self.uni = Counter(w for s in seqs for w in s[1:])
        self.pairs = Counter(p for s in seqs for p in zip(s, s[1:]))
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        self.d1, self.d2 = self.discounts(self.uni), self.discounts(self.pairs)
        self.unknown = 1 - sum(c * self.d1(c) for c in self.uni.values()) / (self.n + 1)
        self.after = defaultdict(dict)
        for (a, b), c in self.pairs.items():
            self.after[a][b] = c

    @staticmethod
    def discounts(counts):
        n = Counter(counts.values())
        d = katz.discounts(np.array([n[r] for r in range(1, katz.CUT + 2)], dtype=float))
        return lambda c: d[c - 1] if c <= katz.CUT else 1.0

    def p1(self, w):
        c = self.uni[w]
        return c * self.d1(c) / (self.n + 1) if c else self.unknown

    def p2(self, a, b):
        seen = self.after.get(a)
        if not seen:
            return self.p1(b)
        total = sum(seen.values()) + 1
        if b in seen:
            return seen[b] * self.d2(seen[b]) / total
        left = 1 - sum(c * self.d2(c) for c in seen.values()) / total
        return left / (1 - sum(self.p1(w) for w in seen)) * self.p1(b)

    def score(self, text):
        s = [END, *words(text), END]
        return sum(math.log10(self.p2(a, b)) for a, b in zip(s, s[1:]))

    def base(self, text):
        return sum(math.log10((self.uni[w] + 0.5) / (self.n + 0.5 * (self.v + 1))) for w in [*words(text), END])


def corpus():
    rng = random.Random(8)
    rows = [(None, "alpha beta"), (1, None), (2, ""), (3, "  \n"), (4, "Alpha BETA alpha beta alpha"), (4, "gamma"),
            (5, "unseen words only here"), (6, "w1 " * 5000)]
    for i in range(20, 140):
        # frequent words with a tail, sentences that recur
        text = " ".join(f"w{int(rng.paretovariate(0.7)) % 3000}" for _ in range(rng.choice([3, 40, 150])))
        rows.append((i, text + (" the end of it all" if i % 2 else "") + f" only{i}"))
    return rows


@pytest.mark.parametrize("heads,known,group", [(1024, 1 << 19, 1_500_000), (8, 40, 300), (4, 4, 50)])
def test_scores_equal_brute_force(spark, monkeypatch, heads, known, group):
    """Also where most words are neither in the dense table nor broadcast."""
    monkeypatch.setattr(katz, "HEADS", heads)
    monkeypatch.setattr(katz, "KNOWN", known)
    monkeypatch.setattr(katz, "GROUP_TOKENS", group)
    monkeypatch.setattr(katz, "PACK", 500)
    rows = corpus()
    docs = docs_of(spark, rows, extra=True).withColumn("held_out", F.coalesce(F.col("doc_id") % 5 == 0, F.lit(False)))
    model = Brute([t for i, t in rows if i is None or i % 5])
    out = katz.score_texts(docs).collect()
    want = sorted((i is None, i or 0, len(words(t)) + 1, sum(w in model.uni for w in [*words(t), END]),
                   round(model.base(t), 6), round(model.score(t), 6)) for i, t in rows)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in out)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:4] == w[:4] and abs(g[4] - w[4]) < 1e-5 and abs(g[5] - w[5]) < 1e-5, (g, w)
    assert {r.train_tokens for r in out} == {model.n}


def test_probabilities_sum_to_one():
    """The brute-force model's (and so the operator's): over all words and the unknown one."""
    model = Brute([t for i, t in corpus() if i is None or i % 5])
    for a in [END, "the", "w1", "only21", "never seen"]:
        seen = model.after.get(a, {})
        unseen = [w for w in model.uni if w not in seen]
        total = sum(model.p2(a, b) for b in seen) + sum(model.p2(a, b) for b in unseen) + model.p2(a, "\0unknown")
        assert abs(total - 1) < 1e-9
    assert abs(sum(map(model.p1, model.uni)) + model.unknown - 1) < 1e-12


def test_discounts_are_good_turing_where_counts_allow():
    d = katz.discounts(np.array([1000, 400, 200, 120, 80, 55], dtype=float))
    a = 6 * 55 / 1000
    assert abs(d[0] - (2 * 400 / 1000 - a) / (1 - a)) < 1e-12 and (0 < d).all() and (d < 1).all()
    assert katz.discounts(np.zeros(6)).tolist() == [0.5, 0.75, 2.5 / 3, 3.5 / 4, 0.9]


def test_without_training_and_without_rows(spark):
    docs = docs_of(spark, [(1, "a b"), (2, None)]).withColumn("held_out", F.lit(True))
    out = {r.doc_id: r for r in katz.score_texts(docs).collect()}
    assert out[1].score == 0 and out[1].base_score == 0 and out[1].n_known == 0 and out[1].train_tokens == 0
    assert katz.score_texts(docs.where("false")).count() == 0


def test_prose_of_the_corpus_scores_above_the_base(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, 3) + " once upon a time in a far away land " * 2) for i in range(50)]
    docs = docs_of(spark, rows).withColumn("held_out", F.col("doc_id") % 5 == 1)
    assert katz.score_texts(docs).where("score <= base_score").count() == 0
