import random

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import MEDIUM, SMALL, docs_of, ids, prose

from cardlens.llm import decontam
from cardlens.llm._util import table


def brute_align(a, b):
    """Smith-Waterman, cell by cell."""
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s = decontam.MATCH if a[i - 1] == b[j - 1] else decontam.MISMATCH
            h[i][j] = max(0, h[i - 1][j - 1] + s, h[i - 1][j] + decontam.GAP, h[i][j - 1] + decontam.GAP)
            best = max(best, h[i][j])
    return best


def test_alignment_equals_the_plain_recursion():
    rng = np.random.default_rng(1)
    a = [rng.integers(0, 6, rng.integers(1, 25)).astype(np.uint64) for _ in range(60)]
    b = [rng.integers(0, 6, rng.integers(1, 60)).astype(np.uint64) for _ in range(60)]
    score, _, _ = decontam.align(a, b)
    assert score.tolist() == [brute_align(x.tolist(), y.tolist()) for x, y in zip(a, b)]


def fixture(spark):
    rng = random.Random(3)
    items = [(i, prose(rng, 30, 100000)) for i in range(6)] + [(6, "too short to tell"), (7, None), (None, prose(rng, 20, 10**6)), (8, "")]
    words = {i: (t or "").split() for i, t in items}

    def put(w, before=200, after=200):
        return f"{prose(rng, before)} {' '.join(w)} {prose(rng, after)}"

    def edit(w, share):
        return [f"e{rng.randrange(10**6)}" if rng.random() < share else x for x in w]

    rows = [(100 + i, put(words[i])) for i in range(6)]                           # exact
    rows += [(200 + i, put(edit(words[i], 0.15))) for i in range(6)]              # edited
    rows += [(300 + i, put(words[i][:10] + ["more"] * 3 + words[i][10:])) for i in range(6)]  # grown
    rows += [(400 + i, put([w for k, w in enumerate(words[i]) if k % 7])) for i in range(6)]  # cut
    rows += [(500 + i, put(words[i][:4])) for i in range(6)]                      # a few words only
    rows += [(600 + i, prose(rng, 400)) for i in range(20)]                       # clean
    rows += [(700, put(words[0]).upper()), (701, put(words[1] + ["x"] * 40 + words[2])), (702, put(words[6])),
             (703, None), (704, ""), (None, put(words[3])), (100, "same id"), (705, put(words[None])), (706, put(words[4], 40000, 0))]
    return docs_of(spark, rows, extra=True), spark.createDataFrame(items, "item_id long, text string")


def test_planted_copies_are_found_and_clean_texts_left(spark):
    docs, bench = fixture(spark)
    out = decontam.contaminated(docs, bench).collect()
    got = {(r.doc_id, r.item_id) for r in out}
    want = {(b + i, i) for b in (100, 200, 300, 400) for i in range(6)}
    want |= {(700, 0), (701, 1), (701, 2), (None, 3), (705, None), (706, 4), (702, 6)}
    assert got == want
    exact = {r.doc_id: r for r in out if r.doc_id is not None and 100 <= r.doc_id < 106}
    assert all(r.similarity == 1 and r.first_word == 200 and r.last_word == 229 for r in exact.values())


def test_blocks_of_the_benchmark_change_nothing(spark, monkeypatch):
    docs, bench = fixture(spark)
    rows = lambda: sorted(map(str, decontam.contaminated(docs, bench).collect()))
    whole = rows()
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 200)
    assert rows() == whole


def test_an_item_in_every_document_keeps_its_seeds(spark):
    rng = random.Random(5)
    passage = prose(rng, 25, 10**6)
    docs = docs_of(spark, [(i, f"{prose(rng, 30)} {passage} {prose(rng, 30)}") for i in range(60)])
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    assert decontam.contaminated(docs, bench).count() == 60


def test_common_ngrams_are_no_seeds():
    items = decontam._items([1], ["a b c rare1 rare2 rare3 rare4"])
    df = np.full(len(items.seeds), 2)
    df[items.seeds == items.seeds[items.where[items.where[:, 2] == 0][0, 0]]] = 900
    rare = decontam._rare(items, df, 1000)
    assert sorted(rare.where[:, 2].tolist()) == [1, 2, 3, 4]


@pytest.mark.parametrize("n", [200, 10_000])
def test_hot_edited_and_partial_copies_without_a_clean_one(spark, n):
    rng = random.Random(8)
    items = [prose(rng, 50, 10**6).split() for _ in range(3)] + [prose(rng, 60, 10**6).split()]
    every4 = lambda w: [f"e{rng.randrange(10**6)}" if k % 4 == 3 else x for k, x in enumerate(w)]
    # every third word changed, but for one: a single n-gram is left
    one = lambda w: [f"e{rng.randrange(10**6)}" if k % 3 == 2 and k != 23 else x for k, x in enumerate(w)]
    copies = {i: (0, every4(items[0])) for i in range(10, 50)} | {i: (1, one(items[1])) for i in range(50, 90)}
    copies |= {i: (3, items[3][:27]) for i in range(100, 100 + n // 3)}
    # so few words of an item that no alignment reaches the threshold
    few = {i: items[2][20:24] for i in range(90, 100)}
    rows = [(i, f"{prose(rng, 20)} {' '.join(copies[i][1] if i in copies else few.get(i, []))} {prose(rng, 20)}") for i in range(n)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs_of(spark, rows), bench).collect()}
    assert got == {(i, c[0]) for i, c in copies.items()}


def test_parts_of_the_hits_change_nothing(spark, monkeypatch):
    rng = random.Random(4)
    texts = [(i, " ".join(["a b"] * 40 + [prose(rng, 30)] + ["a"] * 60)) for i in range(30)]
    items = decontam._items([1, 2, 3], ["a " * 30, "a b " * 12, texts[3][1][160:300]])
    items = decontam._marked(items, np.full(len(items.seeds), 30), 30)
    whole = list(decontam._found(pa.array([t for _, t in texts]), items, items.maybe()))
    assert {(r, i) for r, i, *_ in whole} >= {(r, i) for r in range(30) for i in (0, 1)} | {(3, 2)}
    monkeypatch.setattr(decontam, "EXPANDED", 50)
    part = list(decontam._found(pa.array([t for _, t in texts]), items, items.maybe()))
    assert [g[:4] for g in part] == [g[:4] for g in whole]


def test_empty_tables(spark):
    docs, bench = fixture(spark)
    assert decontam.contaminated(docs_of(spark, []), bench).count() == 0
    assert decontam.contaminated(docs, bench.where("false")).count() == 0


def test_stage_drops_what_the_query_finds(spark):
    docs = table(spark, SMALL, "documents")
    out = decontam.decontaminate(spark, docs, SMALL)
    found = {r.doc_id for r in decontam.contaminated(docs, table(spark, SMALL, "benchmark")).collect()}
    assert out.columns == docs.columns and found
    assert set(ids(out)) == set(ids(docs)) - found


def test_every_full_copy_in_the_documents_is_found(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, MEDIUM, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, MEDIUM, "benchmark").collect()]
    whole = {(d, i) for d, t in docs for i, x in items if x in t}
    got = {(r.doc_id, r.item_id) for r in decontam.op9_decontamination(spark, MEDIUM).collect()}
    assert whole and whole <= got


@pytest.mark.parametrize("n", [0, 1, 2])
def test_texts_shorter_than_a_seed(n):
    items = decontam._items([1], ["a b c d e f g h i j"])
    assert not list(decontam._found(pa.array([" ".join("abc"[:n])]), items, items.maybe()))


def test_short_items_match_as_whole_sequences(spark):
    items = [(1, "one two three four five six seven"), (2, "just three words"), (3, "Paris"), (4, "two words"), (5, "a a a"), (6, "  ")]
    rows = [(10, "One two three four five six seven"), (11, "x one two three four five six seven y"), (12, "one two three four five six eight"),
            (13, "here are just three words more"), (14, "just three  words"), (15, "paris"), (16, "in Paris it is"), (17, "two words"),
            (18, "two words more"), (19, "b a a a a b"), (20, "words two"), (21, ""), (22, None), (23, "just three other words")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.similarity) for r in decontam.contaminated(docs_of(spark, rows), bench).collect()}
    assert got == {(10, 1, 1.0), (11, 1, 1.0), (13, 2, 1.0), (14, 2, 1.0), (15, 3, 1.0), (17, 4, 1.0), (19, 5, 1.0)}


def test_every_third_word_changed_is_found():
    rng = random.Random(9)
    item = prose(rng, 48, 10**6).split()
    copy = [f"e{k}" if k % 3 == 2 else w for k, w in enumerate(item)]
    items = decontam._items([1], [" ".join(item)])
    got = list(decontam._found(pa.array([f"{prose(rng, 50)} {' '.join(copy)} {prose(rng, 50)}"]), items, items.maybe()))
    assert [g[:2] for g in got] == [(0, 0)] and got[0][2] >= 0.4 * 96


@pytest.mark.parametrize("seed", range(4))
def test_result_equals_aligning_every_text_with_every_item(seed):
    """Substituted words at every rate: found exactly where a full alignment reaches the threshold."""
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(12)]
    items = [" ".join(rng.choice(common) if rng.random() < 0.5 else f"r{rng.randrange(10**6)}" for _ in range(n))
             for n in (3, 5, 7, 8, 9, 12, 20, 21, 35, 60)]
    texts = []
    for _ in range(120):
        w = rng.choice(items).split()
        share = rng.choice([0, 0.1, 0.25, 0.33, 0.4, 0.45, 0.5])
        step = rng.choice([0, 2, 3, 4])
        w = [rng.choice(common) if (step and k % step == step - 1) or (not step and rng.random() < share) else x for k, x in enumerate(w)]
        around = lambda: [rng.choice(common) if rng.random() < 0.7 else f"o{rng.randrange(10**6)}" for _ in range(rng.randrange(40))]
        texts.append(" ".join(around() + w[rng.randrange(3):] + around()))
    block = decontam._items(list(range(len(items))), items)
    block = decontam._marked(block, np.zeros(len(block.seeds), np.int64) + 500, 1000) if seed % 2 else block
    got = {g[:2] for g in decontam._found(pa.array(texts), block, block.maybe())}
    hashes = decontam._items(list(range(len(texts))), texts).hashes
    want = set()
    for t, x in enumerate(hashes):
        for i, y in enumerate(block.hashes):
            if brute_align(y.tolist(), x.tolist()) >= block.least[i]:
                want.add((t, i))
    missed = want - got
    # an alignment that needs gaps may lack seeds; none without gaps does
    assert got <= want and all(no_gap(block.hashes[i], hashes[t]) < block.least[i] for t, i in missed), missed
    assert len(missed) <= 0.02 * len(want)


def no_gap(item, text):
    """The best alignment on one diagonal."""
    best = 0
    for shift in range(-len(item), len(text)):
        s = 0
        for k, w in enumerate(item.tolist()):
            if 0 <= k + shift < len(text):
                s = max(0, s + (decontam.MATCH if text[k + shift] == w else decontam.MISMATCH))
                best = max(best, s)
    return best
