"""Token counts by a tokenizer file (R2)."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

PIECE_BYTES = 1 << 18  # texts encoded at once; an encoding takes many times its text


def public_vocabulary(name: str) -> str:
    """The place of a vocabulary file that an installed package brings on every node."""
    import public_tokenizers
    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def _load(path: str):
    """A file's tokenizer, read once a worker; truncation and padding are off. It starts
    no threads of its own: every core has a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    t.encode_special_tokens = True  # their strings in a prompt are ordinary text
    return t


def pieces(texts: pa.Array) -> Iterator[list[str]]:
    """The texts in their order, in lists of at most ``PIECE_BYTES`` or of one longer text;
    null is empty. Only one list at a time is taken out of Arrow's memory."""
    start = held = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > start and held + n > PIECE_BYTES:
            yield [t or "" for t in texts.slice(start, i - start).to_pylist()]
            start, held = i, 0
        held += n
    if start < len(texts):
        yield [t or "" for t in texts.slice(start).to_pylist()]


def count_texts(path: str, texts: pa.Array) -> list[int]:
    """Tokens of each text, special ones not added."""
    out: list[int] = []
    for piece in pieces(texts):
        out += [len(e.ids) for e in _load(path).encode_batch_fast(piece, add_special_tokens=False)]
    return out


def counter(path: str) -> Callable[[Column], Column]:
    """A function of a text column that counts its tokens in Arrow batches; null has none.

    A worker holds one batch (bounded by Spark in rows and bytes), one piece of it as text
    and that piece's encodings, however many rows it is given.
    ``path`` must name the file on every node (an installed package's, or a mounted one)."""
    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array(count_texts(path, texts), pa.int64())
    return lambda c: count(c)
