"""Benchmark decontamination: n-gram seeds, rare ones first, then Smith-Waterman alignment.

The benchmark is the stated query set; it is used in blocks of bounded size, each
broadcast to one scan over all documents. A first scan counts in how many documents
each n-gram of a block occurs. An n-gram is a rare seed if few documents hold it, in
the corpus or measured against the other n-grams of its item. A second scan joins the
documents' words to all n-grams; around every hit lies a window as long as the item,
with room for insertions. Windows of rare seeds are aligned with the item word by
word; those of common n-grams only if the words they share with the item could reach
the threshold, which no alignment exceeds. So rarity saves work and loses no copy,
however many documents hold it.

A copy in which every third word is another has no such n-gram. An alignment without
gaps that reaches the threshold T of an item of n words agrees with it in at least
(2 T - n) / 3 - 1 pairs of neighbouring words, all on one diagonal. So pairs are seeds
too: a diagonal with as many of them goes on to the same test of shared words and
alignment. All but two of the pairs may be spared; the commonest are.

Items of three to seven words are found where their whole word sequence occurs, items of
one or two words where they are the whole text. No text is shuffled or collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardlens.llm._text import blocks, buffers, combine, words
from cardlens.llm._util import prepare, table

SEED = 3               # words of a seed
RARE_SHARE = 0.001     # a seed is rare in at most so many of all documents,
RARE_FACTOR = 4        # or in so many times the median of its item's n-grams
MATCH, MISMATCH, GAP = 2, -1, -1
SIMILARITY = 0.4       # best score over the score of the whole item, at least
LEAST_SCORE = 16       # eight matching words; a shorter item must occur as a whole
BLOCK_BYTES = 4 << 20  # benchmark text broadcast at a time
EXPANDED = 1 << 20     # pairs of a hit and a place, or words of windows, at a time
_FILTER_BITS = 22


@dataclass
class Items:
    """One block of benchmark items."""

    ids: list
    hashes: list[np.ndarray]  # words of each item
    seeds: np.ndarray         # sorted distinct hashes of their n-grams
    where: np.ndarray         # (seed, item, place) of every n-gram, by seed
    first: np.ndarray         # bounds of each seed's rows in ``where``
    rare: np.ndarray          # of each row of ``where``: a rare seed of its item

    @cached_property
    def least(self) -> np.ndarray:
        """The score that an alignment with each item must reach."""
        n = np.array([len(h) for h in self.hashes], dtype=np.int64)
        return np.where(MATCH * n < LEAST_SCORE, MATCH * n, np.maximum(LEAST_SCORE, SIMILARITY * MATCH * n))

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(sorted pair hashes, bounds of their rows, item, place, pairs needed by each item)."""
        n = np.array([len(h) for h in self.hashes], dtype=np.int64)
        sure = np.maximum(1, np.ceil((2 * self.least - n) / 3 - 1 - 1e-9).astype(np.int64))
        grams = [combine(h, 2) if len(h) * MATCH >= LEAST_SCORE else h[:0] for h in self.hashes]
        flat = np.concatenate([*grams, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([*(np.arange(len(g)) for g in grams), np.zeros(0, np.int64)])
        _, at, times = np.unique(flat, return_inverse=True, return_counts=True)
        # the pairs that most items share are spared
        order = np.lexsort((place, -times[at], item))
        nth = np.arange(len(order)) - np.searchsorted(item[order], item[order])
        spare = np.maximum(sure - 2, 0)
        keep = order[nth >= spare[item[order]]]
        hashes, at = np.unique(flat[keep], return_inverse=True)
        by = np.argsort(at, kind="stable")
        return hashes, np.searchsorted(at[by], np.arange(len(hashes) + 1)), item[keep][by], place[keep][by], sure - spare

    @cached_property
    def maybe_pairs(self) -> np.ndarray:
        return _table(self.pairs[0])

    @cached_property
    def held(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct words; sorted item * words + word of each item's words; how often."""
        flat = np.concatenate([*self.hashes, np.zeros(0, np.uint64)])
        vocabulary, word = np.unique(flat, return_inverse=True)
        item = np.repeat(np.arange(len(self.hashes)), [len(h) for h in self.hashes])
        return vocabulary, *np.unique(item * len(vocabulary) + word, return_counts=True)

    def maybe(self) -> np.ndarray:
        """A table that is True at the low bits of every seed."""
        return _table(self.seeds)


def _table(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << _FILTER_BITS, dtype=bool)
    out[(hashes & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
    return out


def _among(grams: np.ndarray, hashes: np.ndarray, maybe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the grams that are among the sorted hashes, which of them)."""
    at = np.flatnonzero(maybe[(grams & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)])
    which = np.searchsorted(hashes, grams[at])
    which[which == len(hashes)] = 0
    real = hashes[which] == grams[at] if len(hashes) else np.zeros(len(at), bool)
    return at[real], which[real]


def _items(ids: list, texts: list) -> Items:
    hashes = []
    for text in texts:
        offs, data = buffers(pa.array([text or ""]))
        hashes.append(words(data, offs)[0])
    grams = [combine(h, min(SEED, len(h))) if len(h) else h for h in hashes]
    flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
    item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else item
    return _index(ids, hashes, flat, item, place)


def _index(ids, hashes, flat, item, place) -> Items:
    seeds, at = np.unique(flat, return_inverse=True)
    order = np.argsort(at, kind="stable")
    where = np.stack([at[order], item[order], place[order]], axis=1) if len(flat) else np.zeros((0, 3), np.int64)
    return Items(ids, hashes, seeds, where, np.searchsorted(where[:, 0], np.arange(len(seeds) + 1)), np.ones(len(where), bool))


def _rare(items: Items, df: np.ndarray, n_docs: int) -> Items:
    """The items with their rare seeds only."""
    seen = df[items.where[:, 0]]
    middle = np.zeros(len(items.ids))
    for i in np.unique(items.where[:, 1]):
        middle[i] = np.median(seen[items.where[:, 1] == i])
    keep = seen <= np.maximum(RARE_SHARE * n_docs, RARE_FACTOR * middle[items.where[:, 1]])
    part = items.where[keep]
    return _index(items.ids, items.hashes, items.seeds[part[:, 0]], part[:, 1], part[:, 2])


def _marked(items: Items, df: np.ndarray, n_docs: int) -> Items:
    """The items with all n-grams, the rare seeds marked."""
    rare, wide = _rare(items, df, n_docs).where, max(map(len, items.hashes), default=0) + 1
    return replace(items, rare=np.isin(items.where[:, 1] * wide + items.where[:, 2], rare[:, 1] * wide + rare[:, 2]))


def _hits(data: np.ndarray, offs: np.ndarray, items: Items, maybe: np.ndarray):
    """(word hashes, row of each word, row pointers, hit rows, hit places, hit seeds) of a block of texts."""
    h, row, _, _ = words(data, offs)
    ptr = np.searchsorted(row, np.arange(len(offs)))
    at, seed = _among(combine(h, SEED), items.seeds, maybe)
    own = row[at] == row[at + SEED - 1]
    at, seed = at[own], seed[own]
    for n in range(1, SEED):  # texts of so few words, as a whole
        short = ptr[:-1][np.diff(ptr) == n]
        if len(short):
            few, which = _among(combine(h, n)[short], items.seeds, maybe)
            at, seed = np.concatenate((at, short[few])), np.concatenate((seed, which))
    return h, row, ptr, row[at], at - ptr[row[at]], seed


def align(item: list[np.ndarray], window: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of each pair of word-hash sequences: score, and the place
    of its last word in the item and in the window. All pairs advance row by row."""
    n, tall, wide = len(item), max(map(len, item)), max(map(len, window))
    a = np.zeros((n, tall), dtype=np.uint64)
    b = np.zeros((n, wide), dtype=np.uint64)
    in_a, in_b = np.zeros((n, tall), bool), np.zeros((n, wide), bool)
    for k in range(n):
        a[k, :len(item[k])], in_a[k, :len(item[k])] = item[k], True
        b[k, :len(window[k])], in_b[k, :len(window[k])] = window[k], True
    ramp = np.arange(wide + 1, dtype=np.int32) * -GAP
    prev = np.zeros((n, wide + 1), dtype=np.int32)
    best, end_a, end_b = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(tall):
        cell = np.where((b == a[:, i:i + 1]) & in_b & in_a[:, i:i + 1], MATCH, MISMATCH)
        now = np.zeros_like(prev)
        now[:, 1:] = np.maximum(prev[:, :-1] + cell, prev[:, 1:] + GAP)
        np.maximum(now, 0, out=now)
        now = np.maximum.accumulate(now + ramp, axis=1) - ramp  # gaps along the window
        top = now.argmax(axis=1)
        score = now[np.arange(n), top]
        better = score > best
        best[better], end_a[better], end_b[better] = score[better], i, top[better] - 1
        prev = now
    return best, end_a, end_b


def _parts(size: np.ndarray) -> Iterator[slice]:
    """Consecutive ranges of bounded sum (a larger one is a range of its own)."""
    end, i = np.cumsum(size), 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(end, end[i] - size[i] + EXPANDED, side="right")))
        yield slice(i, j)
        i = j


def _around(rows, places, seeds, ptr, items: Items) -> tuple[np.ndarray, ...]:
    """(row, item, first word, past last word, rare) of the windows around hits.

    Hits on diagonals that differ by less than the room share a window."""
    count = items.first[seeds + 1] - items.first[seeds]
    hit = np.repeat(np.arange(len(seeds)), count)
    at = np.arange(len(hit)) - np.repeat(np.cumsum(count) - count, count) + items.first[seeds][hit]
    row, item, shift, rare = rows[hit], items.where[at, 1], places[hit] - items.where[at, 2], items.rare[at]
    size = np.array([len(h) for h in items.hashes], dtype=np.int64)[item]
    room = size // 4 + 5
    near = shift // room
    order = np.lexsort((~rare, near, item, row))
    key = np.stack((row, item, near))[:, order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
    at = order[new]  # the first of its window: with a rare seed, if any has one
    row, item, size, room, near = row[at], item[at], size[at], room[at], near[at]
    return (row, item, np.maximum((near - 1) * room, 0),
            np.minimum((near + 2) * room + size, ptr[row + 1] - ptr[row]), rare[at])


def _reaches(row, item, lo, hi, h, ptr, items: Items) -> np.ndarray:
    """Whether the windows share words enough with their items: an alignment scores
    ``MATCH`` for each of them at most."""
    if not len(row):
        return np.zeros(0, bool)
    vocabulary, held, times = items.held
    word = np.searchsorted(vocabulary, h)
    word[word == len(vocabulary)] = 0
    known = np.flatnonzero(vocabulary[word] == h)
    word = word[known]
    a, b = np.searchsorted(known, ptr[row] + lo), np.searchsorted(known, ptr[row] + hi)
    least = items.least[item]
    out = MATCH * (b - a) >= least
    open_ = np.flatnonzero(out)
    for part in _parts((b - a)[open_]):
        of = open_[part]
        n = (b - a)[of]
        window = np.repeat(np.arange(len(of)), n)
        key = item[of][window] * len(vocabulary) + word[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + a[of][window]]
        at = np.searchsorted(held, key)
        at[at == len(held)] = 0
        real = held[at] == key
        pair, n = np.unique(window[real] * len(held) + at[real], return_counts=True)
        shared = np.bincount(pair // len(held), weights=np.minimum(n, times[pair % len(held)]), minlength=len(of))
        out[of] = MATCH * shared >= least[of]
    return out


def _windows(h, rows, places, seeds, ptr, items: Items) -> list[tuple[int, int, int, int]]:
    """(row, item, first word, past last word) around the hits, merged where they overlap."""
    out: list[list[int]] = []
    for part in _parts(items.first[seeds + 1] - items.first[seeds]):
        row, item, lo, hi, keep = _around(rows[part], places[part], seeds[part], ptr, items)
        common = np.flatnonzero(~keep)
        if len(common):
            keep[common] = _reaches(row[common], item[common], lo[common], hi[common], h, ptr, items)
        for r, i, a, b in zip(row[keep].tolist(), item[keep].tolist(), lo[keep].tolist(), hi[keep].tolist()):
            last = out[-1] if out else None
            if last and last[0] == r and last[1] == i and last[2] <= a <= (last[2] + last[3]) // 2:
                last[3] = max(last[3], b)
            else:
                out.append([r, i, a, b])
    return [tuple(x) for x in out]


def _pair_windows(h, row, ptr, items: Items) -> list[tuple[int, int, int, int]]:
    """Windows around diagonals with enough pairs of an item, if they can reach the threshold."""
    hashes, first, of, place, need = items.pairs
    at, which = _among(combine(h, 2), hashes, items.maybe_pairs)
    own = row[at] == row[at + 1]
    at, which = at[own], which[own]
    count = first[which + 1] - first[which]
    size = np.array([len(x) for x in items.hashes], dtype=np.int64)
    room = size // 4 + 5
    out: list[tuple[int, int, int, int]] = []
    # the hits of a text stay together
    per_row = np.bincount(row[at], weights=count, minlength=len(ptr) - 1).astype(np.int64)
    bound = np.searchsorted(row[at], np.arange(len(ptr)))
    for part in _parts(per_row):
        a, b = bound[part.start], bound[part.stop]
        n = count[a:b]
        if not n.sum():
            continue
        hit = np.repeat(np.arange(a, b), n)
        to = np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n) + first[which[hit]]
        r, i = row[at[hit]], of[to]
        near = (at[hit] - ptr[r] - place[to]) // room[i]
        low, span = int(near.min()) - 1, int(near.max() - near.min()) + 4
        key, found = np.unique(((r - part.start) * len(size) + i) * span + near - low, return_counts=True)
        # copies with a few words more or less lie on neighbouring diagonals
        enough = found.copy()
        for step in (-1, 1):
            k = np.minimum(np.searchsorted(key, key + step), len(key) - 1)
            enough += np.where(key[k] == key + step, found[k], 0)
        key = key[enough >= need[key // span % len(size)]]
        r, i, near = key // span // len(size) + part.start, key // span % len(size), key % span + low
        lo, hi = np.maximum((near - 1) * room[i], 0), np.minimum((near + 2) * room[i] + size[i], ptr[r + 1] - ptr[r])
        keep = _reaches(r, i, lo, hi, h, ptr, items)
        out += zip(r[keep].tolist(), i[keep].tolist(), lo[keep].tolist(), hi[keep].tolist())
    return out


def _found(column: pa.Array, items: Items, maybe: np.ndarray) -> Iterator[tuple[int, int, int, float, int, int]]:
    """(row, item, score, similarity, first word, last word): the best alignment of
    every row and item that reaches the threshold."""
    offs, data = buffers(column)
    for i, j in blocks(offs):
        h, row, ptr, rows, places, seeds = _hits(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i], items, maybe)
        spans = _windows(h, rows, places, seeds, ptr, items)
        have: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for r, t, a, b in spans:
            have.setdefault((r, t), []).append((a, b))
        spans += [w for w in _pair_windows(h, row, ptr, items)
                  if not any(a <= w[2] and w[3] <= b for a, b in have.get(w[:2], ()))]
        spans.sort(key=lambda s: s[3] - s[2])  # alike lengths go together
        best: dict[tuple[int, int], tuple] = {}
        k = 0
        while k < len(spans):
            # a group of pairs of bounded area
            m, area = k, 0
            while m < len(spans) and (m == k or area * (m - k + 1) <= 1 << 20) and m - k < 256:
                area = max(area, spans[m][3] - spans[m][2])
                m += 1
            part = spans[k:m]
            k = m
            item = [items.hashes[s[1]] for s in part]
            window = [h[ptr[s[0]] + s[2]:ptr[s[0]] + s[3]] for s in part]
            score, end_a, end_b = align(item, window)
            for p, s in enumerate(part):
                whole = MATCH * len(item[p])
                if score[p] < items.least[s[1]]:
                    continue
                back, _, far = align([item[p][end_a[p]::-1]], [window[p][end_b[p]::-1]])
                got = (i + s[0], s[1], int(score[p]), float(score[p] / whole),
                       int(s[2] + end_b[p] - far[0]), int(s[2] + end_b[p]))
                old = best.get(got[:2])
                if old is None or (-got[2], got[4]) < (-old[2], old[4]):
                    best[got[:2]] = got
        yield from sorted(best.values())


def _seeded(docs: DataFrame, benchmark: DataFrame) -> Iterator[Items]:
    """The benchmark in blocks, each with its rare seeds marked, counted over all documents."""
    benchmark = benchmark.select(F.col("item_id").cast("long").alias("item_id"),
                                 F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = benchmark.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    parts = int(size // BLOCK_BYTES) + 1
    n_docs = docs.count()
    texts = docs.select(F.col("text").cast("string").alias("text"))
    for part in range(parts):
        block = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        rows = block.orderBy("item_id", "text").collect()  # about BLOCK_BYTES of text
        items = _items([r["item_id"] for r in rows], [r["text"] for r in rows])

        def count(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            df, maybe = np.zeros(len(items.seeds), dtype=np.int64), items.maybe()
            for batch in batches:
                offs, data = buffers(batch.column("text"))
                for i, j in blocks(offs):
                    _, _, _, rows, _, seeds = _hits(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i], items, maybe)
                    pair = np.unique(rows * len(items.seeds) + seeds)
                    df += np.bincount(pair % max(1, len(items.seeds)), minlength=len(df))
            at = np.flatnonzero(df)
            yield pa.RecordBatch.from_pydict({"seed": at, "df": df[at]})

        df = np.zeros(len(items.seeds), dtype=np.int64)
        for r in texts.mapInArrow(count, "seed long, df long").groupBy("seed").agg(F.sum("df").alias("df")).collect():
            df[r["seed"]] = r["df"]  # at most one row a seed of the block
        yield _marked(items, df, n_docs)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, similarity, first_word, last_word of every document row
    that holds a copy, edited or not, of a benchmark row: its best alignment.

    Only ``doc_id``, ``text``, ``item_id`` and ``text`` are read. Null and empty texts
    match nothing; an item of one or two words matches texts that consist of it, one of
    three to seven its verbatim occurrences. Null and repeated ids come back as they are. An empty table on either side gives no rows.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for items in _seeded(docs, benchmark):
        def match(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            maybe = items.maybe()
            for batch in batches:
                got = list(_found(batch.column("text"), items, maybe))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(pa.array([g[0] for g in got], pa.int64())),
                    pa.array([items.ids[g[1]] for g in got], pa.int64()),
                    pa.array([g[2] for g in got], pa.int64()), pa.array([g[3] for g in got], pa.float64()),
                    pa.array([g[4] for g in got], pa.int64()), pa.array([g[5] for g in got], pa.int64())],
                    names=["doc_id", "item_id", "score", "similarity", "first_word", "last_word"])

        part = docs.mapInArrow(match, "doc_id long, item_id long, score long, similarity double, "
                                      "first_word long, last_word long")
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: drop the documents that hold a copy of a benchmark item."""
    prepare(spark)
    out = docs
    for items in _seeded(docs, table(spark, sf_dir, "benchmark")):
        def clean(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            maybe = items.maybe()
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[g[0] for g in _found(batch.column("text"), items, maybe)]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(clean, docs.schema)
    return out


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of all ``benchmark`` items in the whole ``documents`` table."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
