"""BPE encoding and decoding of whole texts with a public vocabulary.

Texts of ordinary length are encoded word by word: the vocabulary's tokens never span
white space, so each distinct word is encoded once by a task and its ids are gathered
wherever it stands. (With a vocabulary of another kind the texts are encoded in
batches.) A long text is cut into leaves that
are encoded in parallel as rows of their own; neighbouring leaves are then joined in
a tree. At each join a window around the cut is encoded again and grown until it
agrees with both sides: it starts with a token that the left side has at that place
and, behind the cut, reaches a token that the right side has at the same place.
Pairs of neighbouring tokens that occur in an encoding stay neighbours whatever
stands around them, so everything outside the window is exact as it is.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardlens.llm._text import blocks, buffers, row_ptr, words
from cardlens.llm._util import prepare, shuffle_partitions, table

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LONG_CHARS = 1 << 16  # a text beyond this length is cut into leaves
LEAF_CHARS = 1 << 14
LEAVES = 32             # leaves of a batch
WINDOW_CHARS = 64     # first reach of a window on either side of a cut
CACHED_WORDS = 500_000  # words whose ids a task keeps

_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


@lru_cache(maxsize=2)
def _longest_special(path: str) -> int:
    """Characters of the longest special token: a window has to hold one that the cut splits."""
    return max((len(t.content) for t in _tokenizer(path).get_added_tokens_decoder().values()), default=0)


@lru_cache(maxsize=2)
def _apart(path: str) -> bool:
    """Whether words between ASCII white space are encoded on their own: the first split
    keeps matches of a pattern that white space is no part of."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    first = (made.get("pre_tokenizer") or {}).get("pretokenizers", [None])[0] or {}
    if first.get("type") != "Split" or first.get("behavior") != "Removed" or not first.get("invert"):
        return False
    pattern = first.get("pattern", {}).get("Regex", "")
    found = "".join(m[0] for m in regex.finditer(pattern, "a \t\n\x0b\x0c\r ' 1 ! é s"))
    return bool(pattern) and not regex.search(r"\s", found)


class Words:
    """The ids of words seen so far, and of texts made of them."""

    def __init__(self, path: str):
        self.tok = _tokenizer(path)
        self.clear()
        # without a decoder, decoding joins the tokens by blanks
        self.joined = self.tok.decoder is None
        names = [self.tok.id_to_token(i) or "" for i in range(self.tok.get_vocab_size())]
        name = [(x + " ").encode() for x in names]
        self.name_size = np.array([len(x) for x in name])
        self.name_end = np.cumsum(self.name_size)
        self.names = np.frombuffer(b"".join(name), dtype=np.uint8)

    def clear(self):
        self.at: dict[int, int] = {}
        self.flat, self.used = np.zeros(1 << 16, dtype=np.uint32), 0
        self.first, self.size = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int64)

    def _add(self, hashes: list[int], texts: list[str]) -> None:
        """Encode new words, many as one text, and keep each word's ids."""
        e = self.tok.encode(" ".join(texts), add_special_tokens=False)
        ids, k, m = np.array(e.ids, dtype=np.uint32), len(self.at), len(texts)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, max(2 * len(self.flat), self.used + len(ids)))
        if k + m > len(self.size):
            self.first, self.size = (np.resize(x, 2 * (k + m)) for x in (self.first, self.size))
        start = np.cumsum([0] + [len(x) + 1 for x in texts])
        begin = np.array([o[0] for o in e.offsets], dtype=np.int64)
        cut = np.searchsorted(begin, start)
        self.flat[self.used:self.used + len(ids)] = ids
        self.first[k:k + m], self.size[k:k + m] = self.used + cut[:-1], np.diff(cut)
        self.at.update(zip(hashes, range(k, k + m)))
        self.used += len(ids)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): the tokens of text i are ``ids[bounds[i]:bounds[i + 1]]``."""
        h, row, start, end = words(data, offs, lower=False)
        u, one, back = np.unique(h, return_index=True, return_inverse=True)
        keys = u.tolist()
        if len(self.at) + len(keys) > CACHED_WORDS:
            self.clear()
        new = [i for i, k in enumerate(keys) if k not in self.at]
        for i in range(0, len(new), 2000):
            some = new[i:i + 2000]
            self._add([keys[k] for k in some], [data[start[one[k]]:end[one[k]]].tobytes().decode() for k in some])
        at = np.array([self.at[k] for k in keys], dtype=np.int64)
        size = self.size[at][back] if len(at) else np.zeros(0, np.int64)
        through = np.cumsum(size)
        first = (self.first[at][back] if len(at) else size) - (through - size)
        ids = self.flat[np.repeat(first, size) + np.arange(through[-1] if len(size) else 0)]
        return ids, np.concatenate(([0], through))[row_ptr(row, len(offs) - 1)]

    def decode(self, ids: np.ndarray) -> bytes:
        if not self.joined:
            return self.tok.decode(ids.tolist(), skip_special_tokens=False).encode()
        size = self.name_size[ids]
        through = np.cumsum(size)
        src = np.repeat(self.name_end[ids] - through, size) + np.arange(through[-1] if len(ids) else 0)
        return self.names[src][:-1].tobytes()


@lru_cache(maxsize=2)
def _words(path: str) -> Words:
    return Words(path)


@dataclass
class Piece:
    """A stretch of text with its tokens: ids and their character spans."""

    text: str
    ids: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def cut(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.ids[a:b], self.start[a:b], self.end[a:b]


def encode_piece(text: str, path: str = VOCABULARY) -> Piece:
    got = _tokenizer(path).encode(text, add_special_tokens=False)
    span = np.array(got.offsets, dtype=np.int64).reshape(-1, 2)
    return Piece(text, np.array(got.ids, dtype=np.uint32), span[:, 0], span[:, 1])


def _clean(p: Piece) -> np.ndarray:
    """Whether each token starts where the one before has ended (bytes of one
    character can be several tokens with the same span)."""
    out = np.ones(len(p.ids), dtype=bool)
    out[1:] = p.start[1:] >= p.end[:-1]
    return out


def join(left: Piece, right: Piece, path: str = VOCABULARY) -> Piece:
    """The encoding of ``left.text + right.text`` from the encodings of both."""
    text, cut = left.text + right.text, len(left.text)
    if not left.text or not right.text:
        return right if not left.text else left
    clean_l, clean_r = np.flatnonzero(_clean(left)), np.flatnonzero(_clean(right))
    reach = max(WINDOW_CHARS, _longest_special(path))
    while True:
        # the window starts with a token of the left side and ends before one of the right
        k = np.searchsorted(left.start[clean_l], cut - reach, side="right") - 1
        a = int(clean_l[k]) if k >= 0 else 0
        lo = int(left.start[a]) if k >= 0 else 0
        m = np.searchsorted(right.start[clean_r], reach)
        hi = cut + int(right.start[clean_r[m]]) if m < len(clean_r) else len(text)
        mid = encode_piece(text[lo:hi], path)
        mid.start, mid.end = mid.start + lo, mid.end + lo
        ok_left = lo == 0 or (len(mid.ids) > 0 and mid.ids[0] == left.ids[a] and mid.start[0] == left.start[a]
                              and mid.end[0] == left.end[a] and left.end[a] < cut)
        if lo == 0:
            a = 0
        ok_right, b, c = hi == len(text), len(mid.ids), len(right.ids)
        if not ok_right:
            # the last token of the window that the right side has too, but for the window's own end
            own = {(int(s) + cut, int(e) + cut, int(i)): n for n, (i, s, e) in enumerate(
                zip(*right.cut(0, int(clean_r[m]))))}
            clean_m = _clean(mid)
            for n in range(len(mid.ids) - 2, -1, -1):
                at = own.get((int(mid.start[n]), int(mid.end[n]), int(mid.ids[n])))
                if at is not None and clean_m[n + 1] and clean_m[n] and mid.end[n] < hi and mid.start[n] > cut:
                    if at + 1 < len(right.ids) and right.start[at + 1] >= right.end[at]:
                        ok_right, b, c = True, n + 1, at + 1
                        break
        if ok_left and ok_right:
            parts = [left.cut(0, a), mid.cut(0, b), right.cut(c, len(right.ids))]
            parts[2] = (parts[2][0], parts[2][1] + cut, parts[2][2] + cut)
            return Piece(text, *(np.concatenate(x) for x in zip(*parts)))
        reach *= 2


def tree(pieces: list[Piece], path: str = VOCABULARY) -> Piece:
    """Joins neighbours until one piece is left."""
    while len(pieces) > 1:
        pieces = [join(pieces[i], pieces[i + 1], path) if i + 1 < len(pieces) else pieces[i]
                  for i in range(0, len(pieces), 2)]
    return pieces[0]


def decode(ids: np.ndarray, path: str = VOCABULARY) -> str:
    return _words(path).decode(ids).decode()


def _digest(ids: np.ndarray, path: str) -> tuple[int, str, str]:
    return (len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
            hashlib.sha256(_words(path).decode(ids)).hexdigest())


def cut_leaves(batches: Iterator[pa.RecordBatch], leaf_chars: int) -> Iterator[pa.RecordBatch]:
    """Each text as leaves of ``leaf_chars`` code points, cut in one pass over it."""
    names = ["place", "doc_id", "nth", "leaf"]
    for batch in batches:
        for place, doc_id, text in zip(*(batch.column(c) for c in ("place", "doc_id", "text")), strict=True):
            text = text.as_py()
            for first in range(0, len(text), LEAVES * leaf_chars):
                leaf = [text[i:i + leaf_chars] for i in range(first, min(first + LEAVES * leaf_chars, len(text)), leaf_chars)]
                nth = np.arange(len(leaf), dtype=np.int32) + first // leaf_chars
                yield pa.RecordBatch.from_arrays([pa.array([place.as_py()] * len(leaf), pa.int64()), pa.array([doc_id.as_py()] * len(leaf), pa.int64()),
                                                  pa.array(nth), pa.array(leaf, pa.string())], names=names)


def encode(docs: DataFrame, path: str = VOCABULARY, long_chars: int = LONG_CHARS, leaf_chars: int = LEAF_CHARS,
           with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and the ids, if asked for) of every row.

    Only ``doc_id`` and ``text`` are read. A null text is the empty text, which has no
    tokens and decodes to the empty text. Null and repeated ids come back as they are;
    an empty table gives none. ``path`` must name the vocabulary file on every executor.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = _SCHEMA + (", ids array<int>" if with_ids else "")

    def batch_of(doc_id: list, ids: list[np.ndarray]) -> pa.RecordBatch:
        made = [_digest(x, path) for x in ids]
        cols = [pa.array(doc_id, pa.int64()), pa.array([m[0] for m in made], pa.int64()),
                pa.array([m[1] for m in made], pa.string()), pa.array([m[2] for m in made], pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            cols.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(cols, names=names)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, apart = _tokenizer(path), _apart(path)
        for batch in batches:
            offs, data = buffers(batch.column("text"))
            for i, j in blocks(offs):
                part = batch.slice(i, j - i)
                if apart:
                    ids, bounds = _words(path).encode(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
                    rows = np.split(ids, bounds[1:-1])
                else:
                    got = tok.encode_batch_fast(part.column("text").to_pylist(), add_special_tokens=False)
                    rows = [np.array(e.ids, dtype=np.uint32) for e in got]
                yield batch_of(part.column("doc_id").to_pylist(), rows)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [encode_piece(t, path) for t in batch.column("leaf").to_pylist()]
            cols = [batch.column(c) for c in ("place", "doc_id", "nth", "leaf")]
            cols.append(pa.array([p.ids.tobytes() for p in made], pa.binary()))
            cols.append(pa.array([np.concatenate((p.start, p.end)).astype(np.int32).tobytes() for p in made], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=["place", "doc_id", "nth", "leaf", "tokens", "spans"])

    def grow(rows: pa.Table) -> pa.Table:
        pieces = []
        for r in rows.sort_by("nth").to_pylist():
            span = np.frombuffer(r["spans"], dtype=np.int32).astype(np.int64).reshape(2, -1)
            pieces.append(Piece(r["leaf"], np.frombuffer(r["tokens"], dtype=np.uint32), span[0], span[1]))
        return pa.Table.from_batches([batch_of(rows.column("doc_id").slice(0, 1).to_pylist(), [tree(pieces, path).ids])])

    size = F.char_length("text")
    long = (docs.where(size > long_chars).withColumn("place", F.monotonically_increasing_id())
            .mapInArrow(lambda batches: cut_leaves(batches, leaf_chars), "place long, doc_id long, nth int, leaf string")
            .repartition(shuffle_partitions(spark), "place", "nth")
            .mapInArrow(leaves, "place long, doc_id long, nth int, leaf string, tokens binary, spans binary")
            .groupBy("place").applyInArrow(grow, schema))
    return docs.where(size <= long_chars).mapInArrow(short, schema).unionByName(long)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the whole ``documents`` table."""
    return encode(table(spark, sf_dir, "documents"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the token digests of every document that is left."""
    return encode(docs)
