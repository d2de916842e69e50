"""The stages one after another, against plain versions on their own inputs."""

import hashlib

import numpy as np
from llm_helpers import MEDIUM, docs_of, ids, shingles, union_find
from tokenizers import Tokenizer

import corpus_pipeline
from cardlens.llm import bpe, crf, langid
from cardlens.llm._util import materialize, table


def test_stages_in_order_and_their_decisions(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "decontamination", "bpe"]
    docs, seen = table(spark, MEDIUM, "documents"), []
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        seen.append(docs)
        docs = materialize(stage(spark, docs, MEDIUM), f"test-{name}")
        assert docs.columns == columns or k == 4
    first, second, third, fourth, last = seen
    kept = langid.identify(first, langid.fit(first.where(~langid.held_out()))).where("not ambiguous")
    assert ids(second) == ids(kept)
    model = crf.fit(second, table(spark, MEDIUM, "labels").where(~crf.held_out()))
    assert ids(third) == ids(crf.score_quality(second, model).where("predicted = 1"))
    rows = [(r.doc_id, shingles(r.text)) for r in third.select("doc_id", "text").collect()]
    links = [(a, b) for i, (a, x) in enumerate(rows) for b, y in rows[:i]
             if x and y and min(len(x), len(y)) * 4 >= max(len(x), len(y)) * 3 and 100 * len(x & y) >= 75 * len(x | y)]
    root = union_find([i for i, _ in rows], links)
    assert ids(fourth) == sorted(i for i in root if root[i] == i)
    items = [r.text for r in table(spark, MEDIUM, "benchmark").collect()]
    texts = {r.doc_id: r.text for r in fourth.select("doc_id", "text").collect()}
    whole = {i for i, t in texts.items() if any(x in t for x in items)}
    gone = set(texts) - set(ids(last))
    assert whole <= gone and len(gone) <= len(whole) + 0.01 * len(texts)
    tok = Tokenizer.from_file(bpe.VOCABULARY)
    want = {}
    for r in last.select("doc_id", "text").collect():
        got = tok.encode(r.text, add_special_tokens=False).ids
        want[r.doc_id] = (len(got), hashlib.sha256(np.array(got, dtype="<u4").tobytes()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256) for r in docs.collect()} == want


def test_run_returns_the_last_stage(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0


def test_stages_on_awkward_rows_and_empty_tables(spark):
    text = " ".join(f"word{i % 90} and thing{i}" for i in range(80))
    rows = [(1, None, None), (2, "", "en"), (3, " \n", None), (4, "7", "fr"), (None, text + " x"), (5, text), (5, text),
            (6, text.replace("thing7 ", "other "), None), (7, "long line " * 40000), (8, "é")]
    for docs in (docs_of(spark, rows, extra=True), docs_of(spark, [], extra=True)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "/root/testdata/sf0.001")
            got = ids(out)
            assert set(got) <= {None, 1, 2, 3, 4, 5, 6, 7, 8}
            if name != "bpe":
                assert out.columns == docs.columns
            if docs.isEmpty():
                assert got == []
            elif name == "near_duplicates":
                assert got == [1, 2, 3, 4, 6, 7, 8]  # one row of the four alike, the one whose id is its own
            elif name in ("decontamination", "bpe"):
                assert got == ids(docs)
