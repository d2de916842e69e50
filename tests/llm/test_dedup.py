import random
import re

import pytest
from pyspark.sql import functions as F
from llm_helpers import SMALL, docs_of, ids, prose, shingles, union_find

from cardlens.llm import dedup
from cardlens.llm._graph import components


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k]
             if x and y and a is not None and b is not None and 100 * len(x & y) >= 75 * len(x | y)]
    root = union_find([i for i, _ in sets if i is not None], links)
    return sorted((i, len(s), root.get(i), root.get(i) == i if i is not None else True) for i, s in sets if i is not None)


def got(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect() if r.doc_id is not None)


def edited(rng, words, share):
    return [f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


def test_groups_equal_brute_force(spark):
    rng = random.Random(5)
    rows, n = [], 0
    for g in range(12):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([5, 40, 120, 300]))]
        for _ in range(rng.choice([1, 2, 9])):
            rows.append((n, " ".join(edited(rng, base, rng.choice([0, 0, 0.01, 0.03, 0.05])))))
            n += 1
    # a chain: each is near the next only
    words = [f"c{i}" for i in range(200)]
    for k in range(6):
        rows.append((n, " ".join(words[:200 - k * 4] + [f"t{j}" for j in range(k * 4)])))
        n += 1
    rng.shuffle(rows)
    assert got(dedup.near_duplicates(docs_of(spark, rows))) == brute(rows)


def test_large_group_of_variants_whose_links_run_through_their_base(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(150)]
    rows = [(i, " ".join(edited(rng, base, 0.02))) for i in range(300)]
    rows.append((999, " ".join(base)))
    assert got(dedup.near_duplicates(docs_of(spark, rows))) == brute(rows)


def test_blocks_find_what_hubs_miss(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"b{i}" for i in range(150)]
    rows = [(i, " ".join(edited(rng, base, 0.03))) for i in range(120)]
    monkeypatch.setattr(dedup, "BLOCK", 8)
    assert got(dedup.near_duplicates(docs_of(spark, rows))) == brute(rows)


def test_edge_rows(spark):
    text = "one two three four five six seven"
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, text), (5, text.upper()), (6, "one two"), (7, "ONE two"), (8, "one"),
            (None, text), (4, "alpha beta gamma delta epsilon"), (9, "alpha beta gamma delta epsilon"), (10, "long " * 30000)]
    out = dedup.near_duplicates(docs_of(spark, rows, extra=True))
    assert out.count() == len(rows)
    by = {r.doc_id: r for r in out.collect() if r.n_shingles != 0}
    assert by[5].component_id == 4 and not by[5].kept and by[7].component_id == 6 and by[9].component_id == 4
    assert by[8].component_id == 8 and by[10].n_shingles == 1
    assert all(r.kept and r.component_id == r.doc_id for r in out.where("n_shingles = 0").collect())
    assert out.where("doc_id is null").collect()[0].kept
    assert dedup.near_duplicates(docs_of(spark, [])).count() == 0


def test_stage_keeps_one_of_each_group(spark):
    text = "one two three four five six seven"
    docs = docs_of(spark, [(7, text), (3, text), (5, "other words here now then"), (None, text), (8, None)], extra=True)
    out = dedup.deduplicate(spark, docs, SMALL)
    assert out.columns == docs.columns
    assert ids(out) == [3, 5, 8]  # the copy without an id is a copy too


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5), (None, 3)]
    out = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {out[i] for i in range(61)} == {0} and {out[1000 + i] for i in range(200)} == {1000}


def test_signature_is_circulant_and_estimates_similarity():
    import numpy as np
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 800).astype(np.uint64)
    a, b = dedup._signature(np.unique(x[:700])), dedup._signature(np.unique(x[100:]))
    assert abs((a == b).mean() - 600 / 800) < 0.15
    assert re.fullmatch(r"\(128,\)", str(a.shape))


@pytest.mark.parametrize("n", [1, 5])
def test_signature_of_small_sets(n):
    import numpy as np
    s = np.arange(n, dtype=np.uint64)
    assert (dedup._signature(s) == dedup._signature(s.copy())).all()


def test_stage_decides_by_row_not_by_id(spark):
    rng = random.Random(12)
    same, other, third, clean = (prose(rng, 60) for _ in range(4))
    rows = [(1, same), (1, same), (2, same), (None, same), (None, same), (2, clean), (3, other), (4, other + " x"), (4, third), (5, third),
            (None, None), (None, ""), (6, ""), (6, ""), (7, None), (2**63 - 1, "short one"), (8, clean + " y")]
    for extra in ([], [(-2**63, "lowest id of all")]):  # no room for new ids at either end
        docs = docs_of(spark, rows + extra, extra=True).withColumn("node0", F.lit("kept"))
        out = dedup.deduplicate(spark, docs, "")
        assert out.columns == docs.columns
        left = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
        groups = [same, clean, other, third]
        assert all(sum((t or "").startswith(g) for _, t in left) == 1 for g in groups)
        assert sum(not t for _, t in left) == 5 and ("short one" in [t for _, t in left])
        assert len(left) == 4 + 5 + 1 + len(extra)


def test_stage_keeps_the_least_id_where_ids_are_unique(spark):
    rng = random.Random(13)
    a, b = prose(rng, 60), prose(rng, 60)
    docs = docs_of(spark, [(9, a), (4, a), (7, a + " z"), (3, b), (8, "alone here")])
    assert ids(dedup.deduplicate(spark, docs, "")) == [3, 4, 8]
