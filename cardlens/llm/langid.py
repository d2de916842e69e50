"""Language identification by error-correcting output codes.

Every learned language gets a codeword of +1 and -1; for each bit of the code one
binary classifier tells the languages with +1 from those with -1 by the hashed
letter trigrams of a text (log odds of class-balanced trigram shares, counted over
all training rows). Decoding takes the codeword with the least weighted logistic
loss over the bits and flags texts between two codewords.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardlens.llm._text import blocks, buffers
from cardlens.llm._util import id_crc, prepare, table

BUCKETS = 1 << 14
MARGIN = 4.0      # a text that is as clear as the training texts has this margin on each bit
AMBIGUOUS = 0.5   # share of the best codeword below which a text is flagged
UNKNOWN = "und"
MOST_LANGUAGES = 500  # learned; their counts are held by the driver and every task

# letters of ASCII lower-cased, bytes of other characters kept, all else a blank
_FOLD = np.full(256, 32, dtype=np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_LATIN = np.zeros(256, dtype=np.int64)
_LATIN[65:91] = _LATIN[97:123] = 1


def _trigrams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every trigram of bytes inside a text, but those of blanks only."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    x = _FOLD[data]
    code = x[:-2] | (x[1:-1] << np.uint32(8)) | (x[2:] << np.uint32(16))
    use = (row[2:] == row[:-2]) & (code != 0x202020)
    bucket = (code[use] * np.uint32(0x9E3779B1)) >> np.uint32(32 - 14)
    return row[:-2][use], bucket.astype(np.int64)


def codewords(n: int) -> np.ndarray:
    """One row of +1 and -1 per class: all splits for up to 7 classes, else the
    best of 64 drawn codes of ten bits for each doubling of the classes."""
    if n <= 7:
        bits = np.arange(1, 2 ** (n - 1)) if n > 1 else np.zeros(0, np.int64)
        # bit k of column c; class 0 is always +1, so no column is another's inverse
        return np.array([[-1 if k and c >> (k - 1) & 1 else 1 for c in bits] for k in range(n)], dtype=np.float64).reshape(n, -1)
    size, best, far = int(np.ceil(10 * np.log2(n))), None, -1
    rng = np.random.Generator(np.random.PCG64(n))
    for _ in range(64):
        code = rng.choice([-1.0, 1.0], size=(n, size))
        code[0, np.abs(code.sum(axis=0)) == n] *= -1  # every bit needs both classes
        gap = ((size - code @ code.T) / 2 + size * np.eye(n)).min()
        if gap > far:
            best, far = code, gap
    return best


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray     # languages x bits
    odds: np.ndarray     # buckets x bits, scaled log odds
    weight: np.ndarray   # of each bit

    def margins(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Margins of every text on every bit, and whether it has a trigram."""
        offs, data = buffers(column)
        out, seen = np.zeros((len(offs) - 1, self.code.shape[1])), np.zeros(len(offs) - 1, bool)
        for i, j in blocks(offs):
            row, bucket = _trigrams(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
            for a in range(0, j - i, 64):
                b = min(j - i, a + 64)
                lo, hi = np.searchsorted(row, [a, b])
                count = np.bincount((row[lo:hi] - a) * BUCKETS + bucket[lo:hi], minlength=(b - a) * BUCKETS)
                count = count.reshape(b - a, BUCKETS).astype(np.float32)
                n = count.sum(axis=1)
                seen[i + a:i + b] = n > 0
                out[i + a:i + b] = (count @ self.odds) / np.maximum(n, 1)[:, None]
        return out, seen

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, ambiguous) of every text."""
        n = len(column)
        letters = has_letter(column)
        if not self.langs:
            return [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
        margin, seen = self.margins(column)
        loss = np.stack([(np.logaddexp(0, -c * margin) * self.weight).sum(axis=1) for c in self.code], axis=1)
        loss -= loss.min(axis=1, keepdims=True)
        share = np.exp(-loss)
        share /= share.sum(axis=1, keepdims=True)
        at = share.argmax(axis=1)
        score = np.where(letters, share[np.arange(n), at], 0.0)
        return ([self.langs[k] if ok else UNKNOWN for k, ok in zip(at, letters)], score,
                ~letters | (score < AMBIGUOUS))


def has_letter(column: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script."""
    offs, data = buffers(column)
    total = np.concatenate(([0], np.cumsum(_LATIN[data])))
    out = total[offs[1:]] > total[offs[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offs) > 0)):
        out[i] = any(ch.isalpha() for ch in bytes(data[offs[i]:offs[i + 1]]).decode("utf-8", "replace"))
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}

    def emit():
        for lang, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "bucket": at.astype(np.int32), "n": c[at]})
        total.clear()

    for batch in batches:
        langs = batch.column("lang").to_pylist()
        offs, data = buffers(batch.column("text"))
        for i, j in blocks(offs):
            row, bucket = _trigrams(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
            part = langs[i:j]
            names = sorted(set(part))
            kind = np.array([names.index(x) for x in part], dtype=np.int64)
            for k, name in enumerate(names):
                c = np.bincount(bucket[kind[row] == k], minlength=BUCKETS)
                total[name] = total[name] + c if name in total else c
        if len(total) > 500:
            yield from emit()
    yield from emit()


def fit(docs: DataFrame) -> Model:
    """The model of all rows of ``docs`` (text, lang) with a language.

    The driver receives the trigram counts: ``BUCKETS`` numbers a language. More than
    ``MOST_LANGUAGES`` values of ``lang`` are an error, raised before anything is counted.
    """
    rows = docs.where("lang is not null").select(F.col("text").cast("string").alias("text"),
                                                 F.col("lang").cast("string").alias("lang"))
    if rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"lang has more than {MOST_LANGUAGES} values")
    counts = (rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket")
              .agg(F.sum("n").alias("n")).toArrow())
    langs = sorted(set(counts.column("lang").to_pylist()))
    if not langs:
        return Model([], np.zeros((0, 0)), np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    n = np.zeros((len(langs), BUCKETS))
    place = {x: k for k, x in enumerate(langs)}
    kind = np.array([place[x] for x in counts.column("lang").to_pylist()], dtype=np.int64)
    n[kind, counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    share = (n + 0.5) / (n + 0.5).sum(axis=1, keepdims=True)
    code = codewords(len(langs))
    odds = np.empty((BUCKETS, code.shape[1]))
    for b in range(code.shape[1]):
        odds[:, b] = np.log(share[code[:, b] > 0].mean(axis=0)) - np.log(share[code[:, b] < 0].mean(axis=0))
    clear = np.abs(share @ odds).mean(axis=0)  # mean margin of the languages on each bit
    odds *= MARGIN / np.maximum(clear, 1e-9)
    weight = clear / clear.mean() if len(clear) else clear
    return Model(langs, code, odds.astype(np.float32), weight)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of every row of ``docs`` (doc_id, text).

    Null texts and texts without a letter are ``und`` with score 0 and ambiguous.
    Null and repeated ids come back as they are; an empty table gives none. With no
    language learned every text is ``und``; with one, every text with a letter has it.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, vague = model.predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                                              pa.array(vague, pa.bool_())], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def held_out():
    return id_crc() % 4 == 2


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of the whole ``documents`` table, learned from the rows not held out."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: drop documents without a language (no letter, or between two)."""
    prepare(spark)
    model = fit(docs.where(~held_out()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, vague = model.predict(batch.column("text"))
            yield batch.filter(pa.array(~vague))

    return docs.mapInArrow(run, docs.schema)
