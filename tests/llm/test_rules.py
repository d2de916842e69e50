import random

import numpy as np
from llm_helpers import WORD, docs_of, ids, prose

from cardlens.llm import rules
from cardlens.llm._text import buffers


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, g in enumerate(windows) if windows.count(g) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w))


def texts():
    rng = random.Random(2)
    out = [None, "", " \n\t", "a", "a b", "a a a a", "x y z x y z", "é ü ñ|* é ü ñ", "l1\nl1\nl2\n l1\nl1", "   x"]
    out += [prose(rng, rng.choice([10, 60, 200]), rng.choice([8, 300])) for _ in range(20)]
    out += ["\n".join([prose(rng, 12)] * 6), "w " * 20000, ("long line of words " * 5 + "\n") * 30]
    return out


def test_base_figures_equal_brute_force(spark):
    rows = list(enumerate(texts())) + [(None, "a b c"), (3, "again")]
    out = rules.cascade(docs_of(spark, rows, extra=True), list(rules.RULES))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                 for r in out.collect())
    assert got == sorted((i is None, i or 0, *brute(t)) for i, t in rows)
    assert not out.where("base_failed and kept").count()


def test_order_changes_no_verdict(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice([w, w.upper(), w + "%%", "|", "7" * 9]) if i % 2 else w for w in prose(rng, 80).replace("w", "word").translate(str.maketrans("0123456789", "abcdefghij")).split()))
            for i in range(60)]
    docs = docs_of(spark, rows)
    names = list(rules.RULES)
    a = {r.doc_id: r.kept for r in rules.cascade(docs, names).collect()}
    b = {r.doc_id: r.kept for r in rules.cascade(docs, names[::-1]).collect()}
    assert a == b == {r.doc_id: r.kept for r in rules.cascade(docs).collect()}
    assert all(a[i] for i in range(0, 60, 2)) and not all(a.values())


def test_measured_order_puts_rejection_per_cost_first(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 60, 5000).replace("w1", "W1").upper()) for i in range(40)]
    m = rules.measure_rules(docs_of(spark, rows)).collect()
    assert [r["rule"] for r in sorted(m, key=lambda r: -r["selectivity"] / (r["cost"] + 1e-9))] == [r["rule"] for r in m]
    assert {r["rule"]: r["selectivity"] for r in m}["capitals"] > 0.9


def test_empty_table(spark):
    assert ids(rules.cascade(docs_of(spark, []))) == []


def test_blocks_do_not_share_windows():
    import pyarrow as pa
    offs, data = buffers(pa.array(["a b", "c d", "a b c d"]))
    assert rules.Texts(data, offs).n_repeat_words.tolist() == [0, 0, 0]
    assert rules.Texts(data, offs).n_words.tolist() == [2, 2, 4]
    assert np.issubdtype(rules.Texts(data, offs).n_dup_lines.dtype, np.integer)
