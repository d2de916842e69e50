"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

The examples are a bounded sample of labelled documents. All their terms count (a term
that no example holds is no part of the space). A term of a text weighs its inverse
document frequency times the root of its burstiness, whatever its count: how much rarer
the documents that hold it are than they would be if its occurrences were strewn evenly
over all words of the corpus. Both are taken over all documents and look at no label. The
examples' unit vectors lie in a sparse inverted index whose postings are grouped into
blocks of examples, each with its largest weight: a block is scored only while its
upper bound reaches the k-th best similarity so far, so the neighbours are exact.

The votes of the nearest 5, 15, 50 and 100 examples, each weighted by its similarity as
odds (a copy outweighs all weak neighbours), are turned into a score by a logistic curve
fitted leaving each example out of its own votes. Nothing else enters the score. The
nearest example and its similarity are given as evidence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardlens.llm._text import SEPARATOR, blocks, buffers, hash_spans, word_bounds
from cardlens.llm._util import id_crc, prepare, table

EXAMPLES = 1500       # labelled documents of each label in the index, at most
EXAMPLE_TOTAL = 64_000_000  # bytes of all their texts together, at most
VOTES = (5, 15, 50, 100)  # neighbours that vote
NEIGHBOURS = VOTES[-1]
FLOOR = 0.05          # burstiness of a term that is strewn evenly
BLOCK = 64            # examples of a block
FIRST_BLOCKS = 8      # blocks scored before the bounds rule others out

# words of this operator: runs of ASCII letters and of bytes of other characters
_BREAK = SEPARATOR.copy()
_BREAK[:128] = True
_BREAK[65:91] = _BREAK[97:123] = False


def _terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word."""
    start, end, row = word_bounds(data, offs, _BREAK)
    return row, hash_spans(data, start, end, lower=True)


@dataclass
class Vocabulary:
    hashes: np.ndarray  # sorted

    def __post_init__(self):
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[(self.hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def counts(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, count) of the vocabulary's terms in every text, by row."""
        row, h = _terms(data, offs)
        at = np.flatnonzero(self.maybe[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        term = np.searchsorted(self.hashes, h[at])
        term[term == len(self.hashes)] = 0
        real = self.hashes[term] == h[at] if len(self.hashes) else np.zeros(len(at), bool)
        pair, n = np.unique(row[at][real] * max(1, len(self.hashes)) + term[real], return_counts=True)
        return pair // max(1, len(self.hashes)), pair % max(1, len(self.hashes)), n


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of all ranges one after another, size of each range)."""
    n = end - start
    return np.arange(n.sum()) + np.repeat(start - np.cumsum(n) + n, n), n


class Index:
    """Postings of every term over the examples, in blocks with their largest weight.

    ``idf`` is each term's weight. A cell holds a term's postings in one block of examples; empty cells take no room."""

    def __init__(self, vocabulary: Vocabulary, idf: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]],
                 labels: np.ndarray, ids: np.ndarray):
        # alike examples share a block: by label, then by their heaviest term
        top = [int(t[np.argmax(n * idf[t])]) if len(t) else -1 for t, n in vectors]
        by = np.lexsort((ids, top, labels))
        self.vocabulary, self.idf, self.by = vocabulary, idf, by
        self.labels, self.ids = labels[by], ids[by]
        self.vectors = [self._unit(*vectors[i]) for i in by]
        self.n_blocks = max(1, -(-len(by) // BLOCK))
        term = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in self.vectors)])
        example = np.repeat(np.arange(len(by)), [len(t) for t, _ in self.vectors])
        order = np.lexsort((example, term))
        self.example = example[order].astype(np.int32)
        self.weight = np.concatenate([np.zeros(0, np.float32), *(w for _, w in self.vectors)])[order]
        cell, start = np.unique(term[order] * self.n_blocks + self.example // BLOCK, return_index=True)
        self.block = (cell % self.n_blocks).astype(np.int32)
        self.start = np.append(start, len(order))  # bounds of each cell's postings
        self.cell = np.searchsorted(cell, np.arange(len(idf) + 1) * self.n_blocks)  # bounds of each term's cells
        self.largest = np.maximum.reduceat(self.weight, start) if len(order) else self.weight
        self.held_by = np.bincount(term, minlength=len(idf))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"vectors": None}  # tasks read the postings only

    @property
    def postings(self) -> np.ndarray:
        """All weights, a row a term and a column an example (for small indexes only)."""
        out = np.zeros((len(self.idf), len(self.ids)), dtype=np.float32)
        for i, (t, w) in enumerate(self.vectors):
            out[t, i] = w
        return out

    def _unit(self, term: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = self.idf[term] if len(term) else np.zeros(0)
        size = np.sqrt((w * w).sum())
        return term, (w / size if size else w).astype(np.float32)

    def nearest(self, term: np.ndarray, w: np.ndarray, skip: int = -1, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """(examples, similarities) of the ``k`` nearest with a term in common, best first."""
        cell, n = _ranges(self.cell[term], self.cell[term + 1])
        block, weight = self.block[cell], np.repeat(w.astype(np.float64), n)
        bound = np.bincount(block, weights=weight * self.largest[cell], minlength=self.n_blocks)
        order = np.argsort(-bound, kind="stable")
        at, sim, least, i, m = np.zeros(0, np.int64), np.zeros(0), 0.0, 0, FIRST_BLOCKS
        while i < len(order):
            # the next blocks by their bounds; no later one can hold a nearer example than the last that may
            now = np.zeros(self.n_blocks, dtype=bool)
            now[order[i:i + m]] = (bound[order[i:i + m]] > 0) & (bound[order[i:i + m]] * 1.00001 >= least)
            if not now.any():
                break
            mine = now[block]
            post, n = _ranges(self.start[cell[mine]], self.start[cell[mine] + 1])
            s = np.bincount(self.example[post], weights=np.repeat(weight[mine], n) * self.weight[post], minlength=len(self.ids))
            if skip >= 0:
                s[skip] = 0
            new = np.flatnonzero(s > 0)
            at, sim = np.concatenate((at, new)), np.concatenate((sim, s[new]))
            best = np.lexsort((at, -sim))[:k]
            at, sim = at[best], sim[best]
            if len(at) == k:
                least = float(sim.min())
            i, m = i + m, 2 * m
        return at, sim

    def without(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The vector of example ``i`` as it would be if it were none: without its own terms."""
        t, w = self.vectors[i]
        shared = self.held_by[t] > 1
        size = np.sqrt((w[shared].astype(np.float64) ** 2).sum())
        return t[shared], w[shared] / size if size else w[shared]

    def votes(self, at: np.ndarray, sim: np.ndarray) -> np.ndarray:
        """(toxic, other) weight among the nearest of each number in VOTES; best first."""
        sim = sim.astype(np.float64)
        w = sim / (1.001 - np.minimum(sim, 1))
        toxic = self.labels[at] == 1
        return np.array([x for k in VOTES for x in (w[:k][toxic[:k]].sum(), w[:k][~toxic[:k]].sum())])

    def own_votes(self) -> np.ndarray:
        """The votes on every example, in the order given, as if it were none."""
        out = np.zeros((len(self.by), 2 * len(VOTES)))
        for i, j in enumerate(self.by.tolist()):
            out[j] = self.votes(*self.nearest(*self.without(i), skip=i))
        return out


def _evidence(votes: np.ndarray) -> np.ndarray:
    """What the logistic curve sees: a constant, and of each vote the balance and the log odds."""
    out = [np.ones(len(votes))]
    for a, b in zip(votes.T[::2], votes.T[1::2], strict=True):
        out += [(a - b) / (a + b + 1e-9), np.log((a + 0.02) / (b + 0.02))]
    return np.stack(out, axis=1)


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(x)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton steps with a weak prior."""
    theta, prior = np.zeros(x.shape[1]), 0.1
    for _ in range(60):
        p = _sigmoid(x @ theta)
        g = x.T @ (weight * (y - p)) - prior * theta
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + prior * np.eye(x.shape[1])
        d = np.linalg.solve(h, g)
        theta = theta + d * min(1.0, 2.0 / (np.abs(d).max() + 1e-9))
    return theta


@dataclass
class Model:
    index: Index | None
    theta: np.ndarray

    def score(self, column: pa.Array):
        """(score, nearest example, its similarity, neighbours) of every text."""
        offs, data = buffers(column)
        n = len(offs) - 1
        votes, nearest, sim, count = np.zeros((n, 2 * len(VOTES))), [None] * n, np.zeros(n), np.zeros(n, np.int64)
        if self.index is not None:
            for i, j in blocks(offs):
                row, term, c = self.index.vocabulary.counts(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
                ptr = np.searchsorted(row, np.arange(j - i + 1))
                for r in range(j - i):
                    if ptr[r] == ptr[r + 1]:
                        continue
                    at, s = self.index.nearest(*self.index._unit(term[ptr[r]:ptr[r + 1]], c[ptr[r]:ptr[r + 1]]))
                    if len(at):
                        votes[i + r] = self.index.votes(at, s)
                        nearest[i + r], sim[i + r], count[i + r] = int(self.index.ids[at[0]]), min(float(s[0]), 1.0), len(at)
        return _sigmoid(_evidence(votes) @ self.theta), nearest, sim, count


def _example_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offs, data = buffers(batch.column("text"))
        term, count = [], []
        for i in range(batch.num_rows):
            t, n = np.unique(_terms(data[offs[i]:offs[i + 1]], offs[i:i + 2] - offs[i])[1], return_counts=True)
            term.append(t.tobytes())
            count.append(n.astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(term, pa.binary()),
                                          pa.array(count, pa.binary())], names=["doc_id", "toxic", "term", "count"])


LENGTHS = 4  # classes of text length to a doubling


def term_weights(df: np.ndarray, cf: np.ndarray, lengths: dict[int, tuple[int, int]]) -> np.ndarray:
    """IDF times the root of burstiness of each term, from its documents ``df``, its
    occurrences ``cf`` and the texts by class of length (class -> texts, words)."""
    n, words = sum(c for c, _ in lengths.values()), max(1, sum(w for _, w in lengths.values()))
    even = np.zeros(len(df))  # documents that would hold the term if its occurrences were strewn evenly
    for c, w in lengths.values():
        even += c * (1 - np.exp(-cf * (w / c) / words))
    burst = np.maximum(np.log((1 + even) / (1 + df)), 0)
    return np.log((2 + n) / (1 + df)) * np.sqrt(FLOOR + burst)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of at most ``EXAMPLES`` documents of each label of ``labels``
    (doc_id, toxic), with frequencies over all of ``docs``.

    Examples are taken in the order of a hash of the id, as long as their texts fit into
    ``EXAMPLE_TOTAL`` bytes together; of texts that share an id the least counts. The
    driver receives their terms and two numbers a term. Without both labels every
    text gets the share of label 1 among the labels."""
    known = (labels.where("doc_id is not null and toxic is not null").groupBy("doc_id")
             .agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    share = known.agg(F.avg("toxic").alias("p")).first()["p"]
    share = min(max(0.5 if share is None else float(share), 0.001), 0.999)
    none = Model(None, np.array([np.log(share / (1 - share))] + [0.0] * 2 * len(VOTES)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = [known.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES) for v in (0, 1)]
    # at most 2 * EXAMPLES ids, and one text for each
    sampled = texts.join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sizes = sampled.select("doc_id", "toxic", F.octet_length("text").alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    chosen, total = [], 0
    for r in sizes:
        if total + r["size"] <= EXAMPLE_TOTAL:
            chosen.append(r["doc_id"])
            total += r["size"]
    got = (sampled.where(F.col("doc_id").isin(chosen))
           .mapInArrow(_example_terms, "doc_id long, toxic int, term binary, count binary").toArrow().to_pylist())
    got.sort(key=lambda r: r["doc_id"])
    y = np.array([r["toxic"] for r in got], dtype=np.int64)
    if len(set(y.tolist())) < 2:
        return none
    terms = [np.frombuffer(r["term"], np.uint64) for r in got]
    vocabulary = Vocabulary(np.unique(np.concatenate(terms)))
    if not len(vocabulary.hashes):
        return none

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, cf, lengths = np.zeros(len(vocabulary.hashes), dtype=np.int64), np.zeros(len(vocabulary.hashes), dtype=np.int64), {}
        for batch in batches:
            offs, data = buffers(batch.column("text"))
            for i, j in blocks(offs):
                part, cut = data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
                _, term, n = vocabulary.counts(part, cut)
                df += np.bincount(term, minlength=len(df))
                cf += np.bincount(term, weights=n, minlength=len(cf)).astype(np.int64)
                size = np.bincount(word_bounds(part, cut, _BREAK)[2], minlength=j - i)
                for k, w in zip((LENGTHS * np.log2(1 + size)).astype(int).tolist(), size.tolist(), strict=True):
                    c = lengths.setdefault(k, [0, 0])
                    c[0] += 1
                    c[1] += w
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({
            "term": np.append(at, [-1 - k for k in lengths]).astype(np.int64), "df": np.append(df[at], [c for c, _ in lengths.values()]).astype(np.int64),
            "cf": np.append(cf[at], [w for _, w in lengths.values()]).astype(np.int64)})

    # one row a term, and (numbered below 0) one a class of length
    counted = texts.select("text").mapInArrow(frequency, "term long, df long, cf long").groupBy("term").agg(
        F.sum("df").alias("df"), F.sum("cf").alias("cf")).toArrow()
    term, counts = counted["term"].to_numpy(), np.stack([counted["df"].to_numpy(), counted["cf"].to_numpy()], axis=1)
    figures = np.zeros((len(vocabulary.hashes), 2))
    figures[term[term >= 0]] = counts[term >= 0]
    lengths = {int(-1 - t): (int(c), int(w)) for t, (c, w) in zip(term[term < 0], counts[term < 0], strict=True)}
    weights = term_weights(figures[:, 0], figures[:, 1], lengths)
    vectors = []
    for r, t in zip(got, terms, strict=True):
        at = np.searchsorted(vocabulary.hashes, t)
        vectors.append((at, np.frombuffer(r["count"], np.int32).astype(np.float64)))
    index = Index(vocabulary, weights, vectors, y, np.array([r["doc_id"] for r in got], dtype=np.int64))
    # the sample holds the labels in other shares than the corpus: weigh them back
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum())) * len(y)
    return Model(index, _logistic(_evidence(index.own_votes()), y, weight))


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted, nearest_id, nearest_similarity, n_neighbours of every row.

    Only ``doc_id`` and ``text`` are read. A null or empty text, or one without a term
    of the examples, has no neighbours and gets the score of that case. Null and repeated
    ids come back as they are; an empty table gives none."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, nearest, sim, n = model.score(batch.column("text"))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "score": score, "predicted": (score >= 0.5).astype(np.int32),
                "nearest_id": pa.array(nearest, pa.int64()), "nearest_similarity": sim, "n_neighbours": n})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, score double, predicted int, nearest_id long, nearest_similarity double, n_neighbours long")


def held_out():
    return id_crc() % 5 == 0


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of the whole ``documents`` table, learned from labels not held out."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return score_toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted",
                                              "nearest_id", "nearest_similarity", "n_neighbours")
