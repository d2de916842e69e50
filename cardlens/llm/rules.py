"""Rule-based quality filter as a short-circuit cascade.

Base figures of every text are counted once from vectorised word bounds. The
cascade's rules each derive what they need themselves and only for the texts that
every earlier rule kept. On a sample of the documents each rule's cost (seconds a
text) and selectivity (share rejected) are measured; rules then run by rejection
per cost, the cheapest way to a rejection first. The order changes the time, never
the verdict: a text is kept when no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardlens.llm._text import (U64, blocks, buffers, combine, hash_spans, mix, row_ptr, word_bounds)
from cardlens.llm._util import prepare, table

SAMPLE_ROWS = 2000  # documents on which costs and selectivities are measured, about

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True


class Texts:
    """A block of texts with what the base figures have already found."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data, self.offs, self.n = data, offs, len(offs) - 1
        self.start, self.end, self.row = word_bounds(data, offs)
        self.hash = hash_spans(data, self.start, self.end, lower=False)
        self.n_words = np.bincount(self.row, minlength=self.n)
        self.ptr = row_ptr(self.row, self.n)
        lead = (data & 0xC0) != 0x80  # the first byte of each code point
        before = np.concatenate(([0], np.cumsum(lead)))
        self.word_chars = np.bincount(self.row, weights=before[self.end] - before[self.start],
                                      minlength=self.n).astype(np.int64)
        self.n_symbols = self.count(_SYMBOL)
        self.n_dup_lines = self._dup_lines()
        self.n_repeat_words = self._repeat_words()
        self.base_failed = (self.n_words < 50) | (100 * self.n_repeat_words > 50 * self.n_words)

    def count(self, marked: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """Bytes in ``marked`` of each text (of ``rows``)."""
        if rows is None:
            total = np.concatenate(([0], np.cumsum(marked[self.data])))
            return total[self.offs[1:]] - total[self.offs[:-1]]
        return np.array([np.count_nonzero(marked[self.data[self.offs[r]:self.offs[r + 1]]]) for r in rows], dtype=np.int64)

    def _dup_lines(self) -> np.ndarray:
        """Lines with a word that equal an earlier line of their text."""
        out = np.zeros(self.n, dtype=np.int64)
        if not len(self.start):
            return out
        breaks = np.flatnonzero(self.data == 10)
        first = np.unique(np.concatenate((breaks + 1, self.offs[:-1])))
        first = first[first < len(self.data)]
        last = np.empty_like(first)
        last[:-1] = first[1:]
        last[-1] = len(self.data)
        last -= self.data[last - 1] == 10
        has = np.searchsorted(self.start, last) > np.searchsorted(self.start, first)
        first, last = first[has], last[has]
        row = np.searchsorted(self.offs, first, side="right") - 1
        key = mix(hash_spans(self.data, first, last, lower=False) + row.astype(np.uint64) * U64(0x9E3779B97F4A7C15))
        _, seen = np.unique(key, return_index=True)
        again = np.ones(len(key), dtype=bool)
        again[seen] = False
        np.add.at(out, row[again], 1)
        return out

    def _repeat_words(self) -> np.ndarray:
        """Words inside a three-word window that occurs twice or more in the text."""
        if len(self.hash) < 3:
            return np.zeros(self.n, dtype=np.int64)
        at = np.flatnonzero(self.row[2:] == self.row[:-2])  # windows inside one text
        key = mix(combine(self.hash, 3)[at] + self.row[at].astype(np.uint64) * U64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        same = key[order]
        equal = np.zeros(len(same) + 1, dtype=bool)
        equal[1:-1] = same[1:] == same[:-1]
        twice = np.zeros(len(self.hash) - 2, dtype=bool)
        twice[at[order[equal[1:] | equal[:-1]]]] = True
        covered = np.zeros(len(self.hash), dtype=bool)
        for k in range(3):
            covered[k:len(covered) - 2 + k] |= twice
        return np.bincount(self.row[covered], minlength=self.n)


# Each rule: rows -> True where the text is rejected. All compare whole numbers.
def _symbols(t: Texts, rows: np.ndarray) -> np.ndarray:
    """More than one symbol in ten words."""
    return 10 * t.n_symbols[rows] > t.n_words[rows]


def _dup_lines(t: Texts, rows: np.ndarray) -> np.ndarray:
    """Repeated lines are over 30 for 1,000 words."""
    return 1000 * t.n_dup_lines[rows] > 30 * t.n_words[rows]


def _word_length(t: Texts, rows: np.ndarray) -> np.ndarray:
    """The mean word is shorter than 2 or longer than 14 code points."""
    return (t.word_chars[rows] < 2 * t.n_words[rows]) | (t.word_chars[rows] > 14 * t.n_words[rows])


def _capitals(t: Texts, rows: np.ndarray) -> np.ndarray:
    """Over 40 of 100 letters A-Z, a-z are capitals."""
    return 100 * t.count(_UPPER, rows) > 40 * t.count(_LETTER, rows)


def _digits(t: Texts, rows: np.ndarray) -> np.ndarray:
    """More digits than letters A-Z, a-z."""
    return t.count(_DIGIT, rows) > t.count(_LETTER, rows)


def _few_words(t: Texts, rows: np.ndarray) -> np.ndarray:
    """Fewer than 15 distinct words for 100 words, in a text of under 1,000 words."""
    distinct = np.array([len(np.unique(t.hash[t.ptr[r]:t.ptr[r + 1]])) for r in rows], dtype=np.int64)
    return (t.n_words[rows] < 1000) & (100 * distinct < 15 * t.n_words[rows])


RULES: dict[str, Callable[[Texts, np.ndarray], np.ndarray]] = {
    "symbols": _symbols, "dup_lines": _dup_lines, "word_length": _word_length,
    "capitals": _capitals, "digits": _digits, "few_words": _few_words}


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seconds, rejected, texts = dict.fromkeys(RULES, 0.0), dict.fromkeys(RULES, 0), 0
    for batch in batches:
        offs, data = buffers(batch.column("text"))
        for i, j in blocks(offs):
            t = Texts(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
            rows = np.flatnonzero(~t.base_failed)
            texts += len(rows)
            for name, rule in RULES.items():
                began = time.perf_counter()
                rejected[name] += int(np.count_nonzero(rule(t, rows)))
                seconds[name] += time.perf_counter() - began
    yield pa.RecordBatch.from_pydict({"rule": list(RULES), "seconds": list(seconds.values()),
                                      "rejected": list(rejected.values()), "texts": [texts] * len(RULES)})


def measure_rules(docs: DataFrame) -> DataFrame:
    """Cost and selectivity of each rule on a sample: rule, cost, selectivity, best first.

    The sample takes about ``SAMPLE_ROWS`` rows by a hash of the id, at any size.
    """
    n = docs.count()
    if n > SAMPLE_ROWS:
        docs = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(-(-n // SAMPLE_ROWS))) == 0)
    seen = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(
        _measure, "rule string, seconds double, rejected long, texts long")
    return (seen.groupBy("rule").agg(
        (F.sum("seconds") / F.greatest(F.sum("texts"), F.lit(1))).alias("cost"),
        ((F.sum("rejected") + 0.5) / (F.sum("texts") + 1.0)).alias("selectivity"))
        .orderBy((F.col("selectivity") / (F.col("cost") + 1e-9)).desc(), "rule"))


def cascade(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """doc_id, the base figures, base_failed and kept of every row of ``docs``.

    Other columns are not read. A null text counts as empty: it has no words, fails
    the base and is not kept. Null and repeated ids come back as they are; an empty
    table gives none. ``order`` is measured on a sample where it is not given.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if order is None:
        order = [r["rule"] for r in measure_rules(docs).collect()]  # one row a rule
    rules = [RULES[name] for name in order or RULES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offs, data = buffers(batch.column("text"))
            for i, j in blocks(offs):
                t = Texts(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
                alive = np.flatnonzero(~t.base_failed)
                for rule in rules:
                    if not len(alive):
                        break
                    alive = alive[~rule(t, alive)]
                kept = np.zeros(t.n, dtype=bool)
                kept[alive] = True
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(i, j - i), "n_words": t.n_words, "word_chars": t.word_chars,
                    "n_symbols": t.n_symbols, "n_dup_lines": t.n_dup_lines, "n_repeat_words": t.n_repeat_words,
                    "base_failed": t.base_failed, "kept": kept})

    return docs.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                                "n_repeat_words long, base_failed boolean, kept boolean")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade over the whole ``documents`` table."""
    return cascade(table(spark, sf_dir, "documents"))


ORACLE = """
WITH toks AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
wins AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM toks WHERE len(w) >= 3),
keys AS (SELECT r, i, array_to_string(w[i:i+2], ' ') AS g FROM wins),
twice AS (SELECT r, i FROM keys QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (SELECT r, count(DISTINCT p) AS c FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS l FROM toks),
dups AS (SELECT r, sum(n - 1) AS c FROM (
  SELECT r, l, count(*) AS n FROM lines WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY r, l) GROUP BY r),
base AS (
  SELECT doc_id, w, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         coalesce(dups.c, 0)::BIGINT AS n_dup_lines, coalesce(covered.c, 0)::BIGINT AS n_repeat_words,
         len(regexp_extract_all(t, '[A-Z]')) AS caps, len(regexp_extract_all(t, '[A-Za-z]')) AS letters,
         len(regexp_extract_all(t, '[0-9]')) AS digits
  FROM toks LEFT JOIN dups USING (r) LEFT JOIN covered USING (r)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (10 * n_symbols > n_words) AND NOT (1000 * n_dup_lines > 30 * n_words)
       AND NOT (word_chars < 2 * n_words OR word_chars > 14 * n_words) AND NOT (100 * caps > 40 * letters)
       AND NOT (digits > letters) AND NOT (n_words < 1000 AND 100 * len(list_distinct(w)) < 15 * n_words) AS kept
FROM judged
"""
