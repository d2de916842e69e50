"""Periodic runs of words by seeding and extending diagonals.

A run is a maximal stretch of words with smallest period q whose length is at least
``exponent`` * q and ``least`` words. Compared with itself shifted by q, such a stretch
agrees on at least max(least - q, (exponent - 1) * q) words in a row: the guaranteed
overlap of lag q. Lags are taken in classes [Q, 2Q); k, the least guaranteed overlap of
a class, is the length of its seeds. Every k-gram of a text is indexed and each
occurrence is paired with the next one of the same document. That pair is enough: a
k-gram inside a run is at least q words long, so it recurs in the run only at whole
multiples of q, and the next occurrence is the one at lag q. Pairs whose lag is of the
class seed a diagonal. Seeds of one lag are taken by position, a table of the furthest
word covered by each lag suppresses those that an earlier one already led through, and
the others are extended word by word in both directions.

A gram occurring once has no longer gram that occurs twice, so only positions that
repeat stay for the next class: the work is one sort of a text's words plus sorts of
what repeats, for O(log n) classes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardlens.llm._text import U64, blocks, buffers, mix, row_ptr, words
from cardlens.llm._util import prepare, table

LEAST_WORDS = 6
EXPONENT = 4

_C = [U64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class _Grams:
    """Hashes of all k-grams: two overlapping windows of the largest power of two in k."""

    def __init__(self, word: np.ndarray):
        self.levels = [word]

    def of(self, k: int) -> np.ndarray:
        j = k.bit_length() - 1
        while len(self.levels) <= j:
            step, h = 1 << (len(self.levels) - 1), self.levels[-1]
            self.levels.append(mix(h[:-step] * _C[0] + h[step:] * _C[1]))
        h, n = self.levels[j], max(len(self.levels[0]) - k + 1, 0)
        shift = k - (1 << j)
        return mix(h[:n] * _C[2] + h[shift:shift + n] * _C[3])


def _extend(w: np.ndarray, i: int, q: int, lo: int, hi: int) -> tuple[int, int]:
    """Bounds of the agreement of w with itself shifted by q around position i."""
    a, step = i, 16
    while a > lo:
        b = max(lo, a - step)
        differs = np.flatnonzero(w[b:a] != w[b + q:a + q])
        if len(differs):
            a = b + int(differs[-1]) + 1
            break
        a, step = b, step * 2
    e, step = i, 16
    while e + q < hi:
        b = min(hi - q, e + step)
        differs = np.flatnonzero(w[e:b] != w[e + q:b + q])
        if len(differs):
            e += int(differs[0])
            break
        e, step = b, step * 2
    return a, e


def find_runs(word: np.ndarray, ptr: np.ndarray, least: int = LEAST_WORDS, exponent: int = EXPONENT
              ) -> np.ndarray:
    """(row, start, length, period) of every run, by row, start and period.

    ``word`` holds the word hashes of all rows, row r at ptr[r]:ptr[r+1].
    """
    if exponent < 3 or least < 2:
        raise ValueError("runs need an exponent of 3 or more and two words or more")
    sizes = np.diff(ptr)
    row = np.repeat(np.arange(len(sizes)), sizes)
    end = ptr[1:][row]
    grams = _Grams(mix(word + row.astype(np.uint64) * _C[4]))  # grams of two rows never agree
    alive, last_k, lag = np.arange(len(word)), 0, 1
    covered: dict[int, int] = {}
    found: list[tuple[int, int, int, int]] = []
    while len(sizes) and sizes.max() >= max(least, exponent * lag):
        k = max(least - 1, exponent - 1) if lag == 1 else (exponent - 1) * lag
        if k < last_k:
            alive = np.arange(len(word))
        last_k = k
        alive = alive[(sizes[row[alive]] >= exponent * lag) & (alive + k <= end[alive])]
        if len(alive) < 2:
            break
        key = grams.of(k)[alive]
        order = np.argsort(key, kind="stable")  # occurrences of a gram by position
        same = key[order[1:]] == key[order[:-1]]
        a, b = alive[order[:-1][same]], alive[order[1:][same]]
        alive = np.union1d(a, b)
        q = b - a
        seed = (q >= lag) & (q < 2 * lag)
        a, q = a[seed], q[seed]
        order = np.lexsort((a, q))
        a, q = a[order], q[order]
        # seeds one word apart on a lag lead through each other; the first of them stands
        head = np.ones(len(a), dtype=bool)
        head[1:] = (q[1:] != q[:-1]) | (a[1:] != a[:-1] + 1)
        first = np.flatnonzero(head)
        chain = np.diff(np.append(first, len(a)))
        first = first[chain - 1 + k + q[first] >= np.maximum(least, exponent * q[first])]
        for i, p in zip(a[first].tolist(), q[first].tolist(), strict=True):
            if i < covered.get(p, 0):
                continue
            r = int(row[i])
            lo, stop = _extend(word, i, p, int(ptr[r]), int(ptr[r + 1]))
            covered[p] = stop
            length = stop - lo + p
            if length >= max(least, exponent * p):
                found.append((r, lo - int(ptr[r]), length, p))
        lag *= 2
    runs = np.array(found, dtype=np.int64).reshape(-1, 4)
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def periodic_runs(docs: DataFrame, least: int = LEAST_WORDS, exponent: int = EXPONENT) -> DataFrame:
    """doc_id, n_words, runs and collapsed of every row of ``docs``.

    ``runs`` lists (start, length, period) by start and period, words counted from 0;
    ``collapsed`` joins with one space the words that no run contains after its first
    ``period`` words. Only ``doc_id`` and ``text`` are read, clashing columns do not
    matter. A null text counts as empty: no words, no runs, an empty collapsed text.
    Null and repeated ids come back row by row; an empty table gives none. A text is
    worked on as a whole, in memory in proportion to its length.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offs, data = buffers(batch.column("text"))
            for i, j in blocks(offs):
                part = data[offs[i]:offs[j]]
                cut = offs[i:j + 1] - offs[i]
                h, row, _, _ = words(part, cut, lower=False)
                ptr = row_ptr(row, j - i)
                runs = find_runs(h, ptr, least, exponent)
                at = np.searchsorted(runs[:, 0], np.arange(j - i + 1))
                texts = []
                for r in range(j - i):
                    kept = part[cut[r]:cut[r + 1]].tobytes().split()
                    if at[r] < at[r + 1]:
                        drops = np.zeros(len(kept) + 1, dtype=np.int64)
                        for _, s, length, p in runs[at[r]:at[r + 1]].tolist():
                            drops[s + p] += 1
                            drops[s + length] -= 1
                        kept = [kept[x] for x in np.flatnonzero(np.cumsum(drops[:-1]) == 0)]
                    texts.append(b" ".join(kept).decode("utf-8"))
                spans = pa.StructArray.from_arrays([pa.array(runs[:, c].copy()) for c in (1, 2, 3)], ["start", "length", "period"])
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(i, j - i), "n_words": np.diff(ptr).astype(np.int64),
                    "runs": pa.ListArray.from_arrays(pa.array(at, pa.int32()), spans).cast(kind),
                    "collapsed": pa.array(texts, pa.string())})

    return docs.mapInArrow(run, "doc_id long, n_words long, "
                                "runs array<struct<start: long, length: long, period: long>>, collapsed string")


def _loops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The query's texts: one id in ten ends in a loop that its checksum fixes."""
    for batch in batches:
        out = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            h = zlib.crc32(b"" if doc is None else str(doc).encode())
            own = text.as_buffer().to_pybytes().split() if h % 10 == 0 and text.is_valid else []
            if own:
                g, n = h // 10, len(own)
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                text = pa.scalar(b" ".join(own[:a] + [own[a + (i - a) % p] for i in range(a, n)]).decode("utf-8"))
            out.append(text)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t.as_py() for t in out], pa.string())], ["doc_id", "text"])


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every whole ``documents`` text, after the loops that the ids call for.

    A null id counts as the empty text in the checksum.
    """
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = periodic_runs(docs.mapInArrow(_loops, "doc_id long, text string"))
    best = found.withColumn("best", F.expr(
        "array_max(transform(runs, r -> named_struct('length', r.length, 'start', -r.start, 'period', -r.period)))"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div -best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))


# Runs by another way: a run of period q covers four multiples of q in a row, at which
# the words agree; the lags found so are compared over the whole text.
ORACLE = """
WITH RECURSIVE step AS (
  SELECT range AS k, range::BIGINT AS c, 0 AS n FROM range(256)
  UNION ALL SELECT k, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM step WHERE n < 8),
tab AS (SELECT list(c ORDER BY k) AS l FROM step WHERE n = 8),
toks AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id::VARCHAR, '') AS id,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sums AS MATERIALIZED (
  SELECT r, doc_id, w, len(w) AS n, xor(list_reduce(list_prepend(4294967295::BIGINT,
           [ord(substr(id, i + 1, 1))::BIGINT FOR i IN range(length(id))]),
           lambda a, b: xor(a >> 8, l[xor(a & 255, b) + 1])), 4294967295)::BIGINT AS h FROM toks, tab),
cuts AS MATERIALIZED (SELECT *, h // 10 AS g, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM sums),
own AS MATERIALIZED (SELECT r, unnest(range(n)) AS i, unnest(w) AS x FROM cuts),
src AS MATERIALIZED (
  SELECT r, i, CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END AS k
  FROM own JOIN (SELECT r, n, h, g, a FROM cuts) USING (r)),
pos AS MATERIALIZED (SELECT src.r, src.i, own.x FROM src JOIN own ON own.r = src.r AND own.i = src.k),
sizes AS (SELECT r, n FROM cuts WHERE n >= 6),
lags AS MATERIALIZED (SELECT r, n, unnest(range(1, n // 4 + 1)) AS q FROM sizes),
marks AS MATERIALIZED (SELECT r, q, unnest(range(0, (n - 1) // q - 2)) * q AS i FROM lags),
m1 AS MATERIALIZED (SELECT m.r, m.q, m.i, p.x FROM marks m JOIN pos p ON p.r = m.r AND p.i = m.i),
m2 AS MATERIALIZED (SELECT m.* FROM m1 m JOIN pos p ON p.r = m.r AND p.i = m.i + m.q AND p.x = m.x),
m3 AS MATERIALIZED (SELECT m.* FROM m2 m JOIN pos p ON p.r = m.r AND p.i = m.i + 2 * m.q AND p.x = m.x),
m4 AS MATERIALIZED (SELECT DISTINCT m.r, m.q FROM m3 m JOIN pos p ON p.r = m.r AND p.i = m.i + 3 * m.q AND p.x = m.x),
agree AS MATERIALIZED (
  SELECT m.r, m.q, p.i, p.i - row_number() OVER (PARTITION BY m.r, m.q ORDER BY p.i) AS grp
  FROM m4 m JOIN pos p ON p.r = m.r JOIN pos s ON s.r = m.r AND s.i = p.i + m.q AND s.x = p.x),
stretch AS MATERIALIZED (SELECT r, q, min(i) AS s, count(*) + q AS len FROM agree GROUP BY r, q, grp),
long AS MATERIALIZED (SELECT * FROM stretch WHERE len >= 6 AND len >= 4 * q),
runs AS MATERIALIZED (SELECT * FROM long a WHERE NOT EXISTS (
  SELECT 1 FROM long b WHERE b.r = a.r AND b.q < a.q AND a.q % b.q = 0 AND b.s <= a.s AND b.s + b.len >= a.s + a.len)),
per AS MATERIALIZED (SELECT r, count(*) AS c, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS t,
               min({'a': -len, 'b': s, 'c': q}) AS best FROM runs GROUP BY r),
gone AS MATERIALIZED (SELECT DISTINCT r, unnest(range(s + q, s + len)) AS i FROM runs),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS t FROM pos ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(c, 0)::BIGINT AS n_runs, best.b::BIGINT AS start, (-best.a)::BIGINT AS length,
       best.c::BIGINT AS period, (1000 * -best.a // best.c)::BIGINT AS exponent_milli,
       sha256(coalesce(per.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM cuts LEFT JOIN per USING (r) LEFT JOIN kept USING (r)
"""
