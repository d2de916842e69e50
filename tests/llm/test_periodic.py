import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import WORD, docs_of, prose

from cardlens.llm import periodic


def brute(w, least=6, exponent=4):
    """Every maximal stretch of smallest period q, by trying all starts and lags."""
    out, n = [], len(w)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            e = i
            while e + q < n and w[e] == w[e + q]:
                e += 1
            length = e - i + q
            if length >= max(least, exponent * q):
                s = w[i:i + length]
                if not any(all(s[x] == s[x + p] for x in range(length - p)) for p in range(1, q)):
                    out.append((i, length, q))
            i = e + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def found(rows, **kw):
    sizes = [len(r) for r in rows]
    ptr = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    h = np.array([hash(x) % 2**63 for r in rows for x in r], dtype=np.uint64)
    runs = periodic.find_runs(h, ptr, **kw)
    return [[tuple(x[1:]) for x in runs.tolist() if x[0] == i] for i in range(len(rows))]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=70), max_size=4))
def test_runs_equal_brute_force_on_few_words(rows):
    assert found(rows) == [brute(r) for r in rows]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 9)), max_size=6), st.integers(3, 6))
def test_runs_equal_brute_force_on_loops(parts, exponent):
    row = [x for word, times in parts for x in word * times]
    assert found([row, row[::-1]], exponent=exponent, least=5) == [brute(row, 5, exponent), brute(row[::-1], 5, exponent)]


def rows():
    rng = random.Random(5)
    loop = prose(rng, 7)
    out = [None, "", " \n", "a", "a a a a a", "a a a a a a", "a b a b a b a", "a b a b a b a b", "é ü é ü é ü é ü", "A a A a A a A a"]
    out += [prose(rng, 50) + " " + " ".join([loop] * 4) + " " + prose(rng, 50), "x " * 30000, prose(rng, 300, 2), prose(rng, 400, 3)]
    out += [" ".join([prose(rng, 1500, 10**6)] * 5), "\t".join(["one two three two"] * 9), "the same line\n" * 40 + "end"]
    return list(enumerate(out)) + [(None, "b b b b b b b"), (3, "again again again"), (3, "again again again")]


def test_operator_equals_brute_force_on_awkward_rows(spark):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed)
                 for r in periodic.periodic_runs(docs_of(spark, rows(), extra=True)).collect())
    want = []
    for i, text in rows():
        w = WORD.findall(text or "")
        runs = brute(w) if len(w) < 5000 else [(0, 7500, 1500)] if "x" not in w[:1] else [(0, 30000, 1)]
        gone = {x for s, length, p in runs for x in range(s + p, s + length)}
        want.append((i is None, i or 0, len(w), runs, " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert got == sorted(want)


def test_query_digests_and_loops(spark, tmp_path):
    docs = [(i, t) for i, t in enumerate(["a b c d e f g h", None, "", *[prose(random.Random(i), 40 + i) for i in range(40)]])]
    docs_of(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in periodic.op11_periodic_runs(spark, str(tmp_path)).collect()}
    looped = 0
    for i, text in docs:
        w, h = WORD.findall(text or ""), zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[x] if x < a else w[a + (x - a) % p] for x in range(n)]
            looped += 1
        runs = brute(w)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        gone = {x for s, length, p in runs for x in range(s + p, s + length)}
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()
    assert looped


def test_empty_table_and_refused_parameters(spark):
    assert periodic.periodic_runs(docs_of(spark, [])).collect() == []
    with pytest.raises(ValueError):
        periodic.find_runs(np.zeros(3, np.uint64), np.array([0, 3]), exponent=2)
