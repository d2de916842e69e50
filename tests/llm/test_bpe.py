import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import docs_of, ids, prose
from tokenizers import Tokenizer

from cardlens.llm import bpe

TOK = Tokenizer.from_file(bpe.VOCABULARY)


def want(text):
    got = TOK.encode(text or "", add_special_tokens=False).ids
    back = TOK.decode(got, skip_special_tokens=False)
    return (len(got), hashlib.sha256(np.array(got, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def by_tree(text, leaf):
    return bpe.tree([bpe.encode_piece(text[i:i + leaf]) for i in range(0, max(1, len(text)), leaf)]).ids.tolist()


def hard_texts():
    rng = random.Random(6)
    out = ["a" * 5000, "ab" * 3001, "lo" * 4000 + "l", "the" * 2000, "!" * 3000, "é" * 1500, "é" * 900, "日本" * 700,
           "x" * 100 + " " * 3000 + "y" * 100, "<|startoftext|>" * 200, "it's we'll don't " * 300, "'" * 999 + "s" * 999,
           "1234567890" * 300, "ΑΣΣ Σ" * 400, "à́" * 500, "🙂🙃" * 600, " \n\t 　" * 300,
           prose(rng, 2000), "".join(rng.choice("aeiourstln") for _ in range(9000))]
    return out


@pytest.mark.parametrize("window", [2, 64])
@pytest.mark.parametrize("leaf", [97, 1024])
def test_trees_of_leaves_equal_the_library(monkeypatch, window, leaf):
    monkeypatch.setattr(bpe, "WINDOW_CHARS", window)
    for text in hard_texts():
        assert by_tree(text, leaf) == TOK.encode(text, add_special_tokens=False).ids, text[:30]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aabcdefs'!. \n1<|>éÉ́ßΣ日🙂‍"), max_size=120), st.integers(1, 40))
def test_any_cut_equals_the_library(text, leaf):
    assert by_tree(text, leaf) == TOK.encode(text, add_special_tokens=False).ids


def test_rows_equal_the_library(spark):
    rng = random.Random(7)
    texts = [None, "", "  ", "Hello, World", "<|endoftext|> x", "naïve café", prose(rng, 500), *hard_texts()]
    rows = list(enumerate(texts)) + [(None, "no id"), (3, "again")]
    docs = docs_of(spark, rows, extra=True)
    expect = sorted((i is None, i or 0, *want(t)) for i, t in rows)
    for kw in ({}, {"long_chars": 300, "leaf_chars": 128}, {"long_chars": 0, "leaf_chars": 1000}):
        got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256)
                     for r in bpe.encode(docs, **kw).collect())
        assert got == expect, kw
    back = bpe.encode(docs, with_ids=True).where("doc_id = 3 and n_tokens > 1").collect()[0]
    assert back.ids == TOK.encode("Hello, World", add_special_tokens=False).ids


def test_empty_table(spark):
    assert ids(bpe.encode(docs_of(spark, []))) == []


def test_other_vocabularies_are_encoded_whole(spark):
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    assert bpe._apart(bpe.VOCABULARY) and not bpe._apart(path)
    texts = ["Hello  world,\n it's naïve", "", "  x "]
    out = {r.doc_id: r for r in bpe.encode(docs_of(spark, list(enumerate(texts))), path, with_ids=True).collect()}
    for i, text in enumerate(texts):
        ids = tok.encode(text, add_special_tokens=False).ids
        assert out[i].ids == ids
        assert out[i].decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_word_cache_starts_anew_when_full(monkeypatch):
    import pyarrow as pa
    from cardlens.llm._text import buffers
    monkeypatch.setattr(bpe, "CACHED_WORDS", 50)
    w = bpe.Words(bpe.VOCABULARY)
    rng = random.Random(3)
    for _ in range(6):
        texts = [prose(rng, 30, 1000), "", "a\x0bb\x0cc\x1cd <|endoftext|>e", prose(rng, 5)]
        offs, data = buffers(pa.array(texts))
        ids, bounds = w.encode(data, offs)
        got = [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
        assert got == [TOK.encode(t, add_special_tokens=False).ids for t in texts]


def test_cutting_a_text_takes_time_in_proportion_to_it():
    import time

    import pyarrow as pa
    took = []
    for n in (8_000_000, 16_000_000):
        text = "abcdéfg " * (n // 8)
        batch = pa.RecordBatch.from_pydict({"doc_id": [7], "text": [text], "place": [3]})
        began = time.perf_counter()
        rows = [(p, d, k, len(t)) for b in bpe.cut_leaves(iter([batch]), 4096) for p, d, k, t in zip(*(c.to_pylist() for c in b.columns))]
        took.append(time.perf_counter() - began)
        assert [r[2] for r in rows] == list(range(-(-n // 4096))) and sum(r[3] for r in rows) == n and {r[:2] for r in rows} == {(3, 7)}
    assert took[1] < 3 * took[0]


def test_leaves_of_a_text_are_its_whole_text():
    import pyarrow as pa
    text = "ab é\U0001f600" * 1000 + "z"
    batch = pa.RecordBatch.from_pydict({"place": [1, 2], "doc_id": pa.array([None, 2], pa.int64()), "text": [text, "x"]})
    got = [(p, t) for b in bpe.cut_leaves(iter([batch]), 7) for p, t in zip(b["place"].to_pylist(), b["leaf"].to_pylist())]
    assert "".join(t for p, t in got if p == 1) == text and [t for p, t in got if p == 2] == ["x"]
