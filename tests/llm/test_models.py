"""The learned operators: exact inference against brute force, and held-out accuracy."""

import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import MEDIUM, SMALL, docs_of, ids, prose

from cardlens.llm import crf, langid, toxicity
from cardlens.llm._util import table

AWKWARD = [(1, None), (2, ""), (3, " \n\t"), (4, "7 % …"), (5, "x"), (None, "words here"), (5, "again"), (6, "long line " * 30000)]


def crc(i):
    return zlib.crc32(b"" if i is None else str(i).encode())


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    e, t = rng.normal(size=9), rng.normal(size=(2, 2))
    row = np.array([0, 0, 0, 0, 1, 2, 2, 2, 2])
    got = crf.marginals(e[:, None], row, np.ones(1), t)
    for r in range(3):
        at = np.flatnonzero(row == r)
        total, good = 0.0, np.zeros(len(at))
        for y in itertools.product((0, 1), repeat=len(at)):
            w = np.exp(sum(e[i] * v for i, v in zip(at, y)) + sum(t[a, b] for a, b in zip(y, y[1:])))
            total += w
            good += w * np.array(y)
        assert np.allclose(got[at], good / total)


def test_training_raises_the_likelihood_and_learns_labels():
    rng = np.random.default_rng(2)
    row = np.repeat(np.arange(60), 5)
    y = np.repeat(rng.integers(0, 2, 60), 5)
    x = np.stack([y + rng.normal(scale=0.5, size=300), np.ones(300)], axis=1)
    w, t = crf._fit_field(x, row, y)
    p = crf.marginals(x, row, w, t)
    assert ((p > 0.5) == (y == 1)).mean() > 0.95 and t[1, 1] + t[0, 0] > t[0, 1] + t[1, 0]


def test_line_figures_see_lines_of_their_own_text():
    offs = np.array([0, 8, 8, 14])
    data = np.frombuffer(b"a b\na b\nX!\n\ny ", dtype=np.uint8)
    row, size, x = crf.line_figures(data, offs)
    assert row.tolist() == [0, 0, 2, 2] and size.tolist() == [2, 2, 2, 1]
    assert x[:, 8].tolist() == [0, 1, 0, 0] and x[2, 5] == 1


def accuracy(df, label, path):
    con = duckdb.connect()
    labels = {a: b for a, b in con.execute(f"SELECT doc_id, {label} FROM '{path}/labels.parquet'").fetchall()}
    rows = [(r.predicted, labels[r.doc_id]) for r in df.where("held_out").collect() if r.doc_id in labels]
    return sum(a == b for a, b in rows) / len(rows), len(rows)


def test_quality_of_held_out_documents(spark):
    out = crf.op3_quality(spark, MEDIUM)
    share, n = accuracy(out, "quality", MEDIUM)
    assert n > 100 and share > 0.97
    assert all(r.held_out == (crc(r.doc_id) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.collect())


def test_toxicity_of_held_out_documents(spark):
    out = toxicity.op4_toxicity(spark, MEDIUM)
    share, n = accuracy(out, "toxic", MEDIUM)
    assert n > 50 and share > 0.9
    assert all(r.held_out == (crc(r.doc_id) % 5 == 0) and 0 <= r.score <= 1 for r in out.collect())


def test_language_of_held_out_documents(spark):
    out = langid.op6_language(spark, MEDIUM).join(table(spark, MEDIUM, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    assert all(r.held_out == (crc(r.doc_id) % 4 == 2) for r in out)


@pytest.mark.parametrize("seed", [1, 2])
def test_neighbours_are_the_exact_nearest(seed):
    rng = np.random.default_rng(seed)
    n, terms = 300, 80
    idf = rng.uniform(0.5, 5, terms)
    vectors = [(np.sort(rng.choice(terms, rng.integers(1, 12), replace=False)),) for _ in range(n)]
    vectors = [(t, rng.integers(1, 5, len(t)).astype(float)) for (t,) in vectors]
    index = toxicity.Index(toxicity.Vocabulary(np.arange(terms, dtype=np.uint64)), idf, vectors, rng.integers(0, 2, n), np.arange(n))
    full = index.postings[:, :n].T.astype(np.float64)
    for t, w in index.vectors[:60]:
        at, sim = index.nearest(t, w)
        q = np.zeros(terms)
        q[t] = w
        every = full @ q
        want = np.sort(every[every > 1e-9])[::-1][:toxicity.NEIGHBOURS]
        assert np.allclose(np.sort(sim)[::-1], want, atol=1e-5)
        assert np.allclose(every[at], sim, atol=1e-5)


def test_rare_words_have_neighbours_and_a_copy_gets_its_label(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(300):
        # a tenth is toxic, by words that few or no others hold
        bad = i % 10 == 0
        rows.append((i, prose(rng, 60, 300) + (" " + " ".join("x" + "abcdefghij"[rng.randrange(10)] * rng.randrange(2, 9) for _ in range(6)) if bad else "")))
        labels.append((i, int(bad)))
    letters = str.maketrans("0123456789", "abcdefghij")
    rows = [(i, t.translate(letters)) for i, t in rows]
    rows += [(1000 + i, t) for i, t in rows if i % 10 == 0] + [(2000, "zz zzz"), (2001, rows[1][1])]
    docs = docs_of(spark, rows)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    out = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    for i in range(0, 300, 10):
        r = out[1000 + i]
        assert r.nearest_id == i and r.nearest_similarity > 0.999 and r.score > 0.5
    assert out[2000].n_neighbours == 0 and out[2001].score < 0.5
    assert len(model.index.vocabulary.hashes) == len({w for i, t in rows if i < 300 for w in t.split()})


def test_blocks_left_out_hold_no_neighbour(monkeypatch):
    rng = np.random.default_rng(4)
    n, terms = 1000, 400
    vectors = [(np.sort(rng.choice(terms, 20, replace=False)), np.ones(20)) for _ in range(n)]
    args = toxicity.Vocabulary(np.arange(terms, dtype=np.uint64)), rng.uniform(0.5, 5, terms), vectors, rng.integers(0, 2, n), np.arange(n)
    index = toxicity.Index(*args)
    few = [index.nearest(t, w, skip=i) for i, (t, w) in enumerate(index.vectors[:100])]
    monkeypatch.setattr(toxicity, "FIRST_BLOCKS", 1)
    for (a, s), (i, (t, w)) in zip(few, enumerate(index.vectors[:100])):
        b, z = index.nearest(t, w, skip=i)
        assert a.tolist() == b.tolist() and np.allclose(s, z) and i not in a


def test_codewords_differ_and_use_both_classes():
    for n in (2, 3, 4, 7, 8, 30):
        code = langid.codewords(n)
        assert (np.abs(code.sum(axis=0)) < n).all()
        gaps = [(code[a] != code[b]).sum() for a in range(n) for b in range(a)]
        assert min(gaps) >= (1 if n == 2 else 2 ** (n - 2) if n <= 7 else 8)


def docs_with_labels(spark):
    rng = random.Random(1)
    rows, labels = list(AWKWARD), []
    for i in range(100, 400):
        bad = i % 3 == 0
        text = "\n".join(prose(rng, 12) for _ in range(4))
        rows.append((i, text.upper() + "!! scum loser" if bad else text, "aa" if bad else "bb"))
        labels.append((i, 0 if bad else 1, 1 if bad else 0))
    labels += [(100, 1, None), (None, 1, 1), (10**9, None, None), (101, 1, 0)]
    return docs_of(spark, rows, extra=True), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def test_awkward_rows_and_clashing_columns(spark):
    docs, labels, rows = docs_with_labels(spark)
    everyone = sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    q = crf.score_quality(docs, crf.fit(docs, labels))
    assert ids(q) == everyone
    low = {r.doc_id: r.score for r in q.collect()}
    assert low[1] == low[2] == low[3] == min(low.values())
    t = toxicity.score_toxicity(docs, toxicity.fit(docs, labels))
    assert ids(t) == everyone
    seen = {r.doc_id: r for r in t.collect()}
    assert seen[1].n_neighbours == 0 and seen[102].score > 0.5 > seen[103].score and seen[1].score < 0.5
    lang = {r.doc_id: r for r in langid.identify(docs, langid.fit(docs)).collect()}
    assert [lang[i].lang_pred for i in (1, 2, 3, 4)] == ["und"] * 4 and lang[1].ambiguous and lang[1].score == 0


def test_models_without_labels_and_empty_tables(spark):
    docs, labels, _ = docs_with_labels(spark)
    none, empty = labels.where("false"), docs_of(spark, [])
    assert crf.score_quality(docs, crf.fit(docs, none)).where("score between 0 and 1").count() == docs.count()
    assert toxicity.score_toxicity(docs, toxicity.fit(docs, none)).where("score between 0 and 1").count() == docs.count()
    assert crf.score_quality(docs, crf.fit(docs, labels.where("quality = 1"))).where("predicted = 0").count() == 0
    assert crf.score_quality(empty, crf.fit(empty, labels)).count() == 0
    assert toxicity.score_toxicity(empty, toxicity.fit(empty, labels)).count() == 0
    unknown = langid.fit(docs.where("lang is null"))
    assert {r.lang_pred for r in langid.identify(docs, unknown).collect()} == {"und"}
    one = langid.fit(docs.where("lang = 'aa'"))
    assert {r.lang_pred for r in langid.identify(docs, one).collect()} == {"und", "aa"}
    assert langid.identify(empty, one).count() == 0


def test_letters_of_any_script():
    got = langid.has_letter(pa.array(["ж", "١٢", "日本", "…", "a", None, "ª"]))
    assert got.tolist() == [True, False, True, False, True, False, True]


def test_stages_keep_columns_and_clean_documents(spark):
    docs = table(spark, SMALL, "documents")
    for stage in (langid.keep_identified, crf.keep_good):
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()


def test_toxicity_score_equals_brute_force(spark):
    rng = random.Random(8)
    bad = ["vile", "rotten", "foul"]
    rows, labels = [(0, None), (1, ""), (2, "1 2 3"), (3, "unseen words only")], []
    for i in range(10, 130):
        toxic = i % 4 == 0
        words = [rng.choice("abcdefghijklmnop") * rng.randrange(1, 5) for _ in range(rng.choice([8, 40, 90]))]
        for _ in range(rng.randrange(1, 5) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, int(toxic)))
    docs = docs_of(spark, rows)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    terms = {i: re.findall("[A-Za-z]+", (t or "").lower()) for i, t in rows}
    sizes = {}
    for i in terms:
        sizes.setdefault(int(4 * math.log2(1 + len(terms[i]))), []).append(len(terms[i]))
    words = sum(map(sum, sizes.values()))
    known = {w for i, _ in labels for w in terms[i]}

    def weight(w):
        df, cf = sum(w in t for t in terms.values()), sum(t.count(w) for t in terms.values())
        even = sum(len(s) * (1 - math.exp(-cf * (sum(s) / len(s)) / words)) for s in sizes.values())
        return math.log((2 + len(rows)) / (1 + df)) * math.sqrt(toxicity.FLOOR + max(0, math.log((1 + even) / (1 + df))))
    weights = {w: weight(w) for w in known}

    def unit(i):
        v = {w: weights[w] for w in set(terms[i]) & known}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}
    vectors = {i: unit(i) for i in terms}
    for i in terms:
        near = sorted(((sum(x * vectors[e].get(w, 0) for w, x in vectors[i].items()), y, e) for e, y in labels), reverse=True)
        near = [n for n in near if n[0] > 0]
        z = model.theta[0]
        for k, (b, o) in zip(toxicity.VOTES, model.theta[1:].reshape(-1, 2)):
            vote = [sum(s / (1.001 - min(s, 1)) for s, y, _ in near[:k] if y == label) for label in (1, 0)]
            z += b * (vote[0] - vote[1]) / (sum(vote) + 1e-9) + o * math.log((vote[0] + 0.02) / (vote[1] + 0.02))
        assert abs(got[i].score - 1 / (1 + math.exp(-z))) < 2e-3, i  # weights are kept in single precision
        assert got[i].n_neighbours == len(near[:toxicity.NEIGHBOURS])
        assert got[i].nearest_similarity == pytest.approx(near[0][0] if near else 0, abs=1e-5)


def test_a_repeated_id_is_one_example_and_long_texts_are_bounded(spark, monkeypatch):
    rows = [(1, f"words that repeat {i}") for i in range(5000)] + [(2, "vile words"), (3, "x " * 50000 + "vile"), (4, "plain words here")]
    docs, labels = docs_of(spark, rows), spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert sorted(model.index.ids.tolist()) == [1, 2, 3, 4]
    monkeypatch.setattr(toxicity, "EXAMPLE_TOTAL", 1000)
    assert sorted(toxicity.fit(docs, labels).index.ids.tolist()) == [1, 2, 4]


def test_quality_sample_is_bounded_in_rows_and_lines(spark, monkeypatch):
    docs = docs_of(spark, [(1, f"words that repeat {i}") for i in range(5000)] + [(2, "a line\n" * 100_000), (3, "good line"), (4, None)])
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (3, 1), (4, 0), (None, 1), (9, 1)], "doc_id long, quality int")
    got = lambda rows, lines: sorted((r.quality, len(r.text)) for r in crf.sample(docs, labels, "quality", rows, lines).collect())
    assert got(10, 10**6) == [(0, 0), (1, 9), (1, len("words that repeat 0")), (1, 700_000)]
    assert got(10, 1000) == [(0, 0), (1, 9), (1, len("words that repeat 0"))]
    assert len(got(2, 10**6)) <= 2
    monkeypatch.setattr(crf, "TRAIN_LINES", 1000)
    assert crf.score_quality(docs, crf.fit(docs, labels)).count() == 5003


def test_language_scores_equal_brute_force(spark, monkeypatch):
    rng = random.Random(14)
    sounds = {"aa": "abe", "bb": "cdo", "cc": "éfu", "dd": "гхи"}
    rows = [(i, " ".join("".join(rng.choice(sounds[x]) for _ in range(rng.randrange(2, 7))) for _ in range(rng.randrange(1, 30))).capitalize(), x)
            for i, x in enumerate(rng.choice(sorted(sounds)) for _ in range(90))]
    rows += [(200, None, "aa"), (201, "", None), (202, "12 34", "bb"), (203, "x", None), (204, "abe cdo abe cdo", None)]
    docs = docs_of(spark, rows, extra=True)
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}

    def grams(text):
        b = [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in (text or "").encode()]
        code = [b[i] | b[i + 1] << 8 | b[i + 2] << 16 for i in range(len(b) - 2)]
        return [(c * 0x9E3779B1 % 2**32) >> 18 for c in code if c != 0x202020]
    langs = sorted(sounds)
    n = {x: [0.5] * langid.BUCKETS for x in langs}
    for _, t, x in rows:
        for g in grams(t) if x else []:
            n[x][g] += 1
    share = {x: [v / sum(n[x]) for v in n[x]] for x in langs}
    code = {x: [-1 if k and c >> (k - 1) & 1 else 1 for c in range(1, 8)] for k, x in enumerate(langs)}
    odds, weight = [], []
    for bit in range(7):
        mean = lambda s, g: (lambda z: sum(z) / len(z))([share[x][g] for x in langs if code[x][bit] == s])  # noqa: B023, E731
        o = [math.log(mean(1, g)) - math.log(mean(-1, g)) for g in range(langid.BUCKETS)]
        clear = sum(abs(sum(p * v for p, v in zip(share[x], o))) for x in langs) / len(langs)
        odds.append([v * langid.MARGIN / clear for v in o])
        weight.append(clear)
    weight = [w * 7 / sum(weight) for w in weight]
    for i, t, _ in rows:
        g = grams(t)
        margin = [sum(o[x] for x in g) / max(1, len(g)) for o in odds]
        loss = {x: sum(w * math.log1p(math.exp(-c * m)) for w, c, m in zip(weight, code[x], margin)) for x in langs}
        best = min(langs, key=lambda x: (loss[x], x))
        letter = any(c.isalpha() for c in t or "")
        want = 1 / sum(math.exp(loss[best] - v) for v in loss.values()) if letter else 0.0
        assert got[i].lang_pred == (best if letter else "und") and abs(got[i].score - want) < 1e-4, i
        assert got[i].ambiguous == (not letter or want < langid.AMBIGUOUS) or abs(want - langid.AMBIGUOUS) < 1e-4
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 3)
    with pytest.raises(ValueError, match="more than 3"):
        langid.fit(docs)
