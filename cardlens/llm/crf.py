"""Document quality by a linear-chain conditional random field over its lines.

Every line with a word is a node labelled good (1) or bad (0). A node sees figures of
its line and of the lines before and after it; edges weigh the four label pairs. The
field is trained on a bounded sample of labelled documents, each line carrying its
document's label. Forward-backward marginals of the lines, weighted by their lengths,
make the document's share of good text; a logistic curve fitted on the same sample
turns the share into a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardlens.llm._text import U64, blocks, buffers, hash_spans, mix, word_bounds
from cardlens.llm._util import id_crc, prepare, table

TRAIN_DOCS = 4000         # labelled documents the field is fitted on, at most
TRAIN_LINES = 2_000_000   # and lines of all of them together, at most
STEPS, RATE, L2 = 200, 0.1, 1e-4

_CLASSES = np.zeros((5, 256), dtype=bool)  # symbols, capitals, letters, digits, exclamation marks
_CLASSES[0, list(b"#*$%&|<>")] = True
_CLASSES[1, 65:91] = True
_CLASSES[2, 65:91] = _CLASSES[2, 97:123] = True
_CLASSES[3, 48:58] = True
_CLASSES[4, 33] = True
OWN = 9  # figures of a line


def line_figures(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, length, figures) of every line with a word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0), np.zeros((0, OWN))
    first = np.unique(np.concatenate((np.flatnonzero(data == 10) + 1, offs[:-1])))
    first = first[first < len(data)]
    last = np.append(first[1:], len(data))
    last = last - (data[last - 1] == 10)
    start, end, word_row = word_bounds(data, offs)
    a, b = np.searchsorted(start, first), np.searchsorted(start, last)
    has = b > a
    first, last, a, b = first[has], last[has], a[has], b[has]
    row = np.searchsorted(offs, first, side="right") - 1
    n = (b - a).astype(np.float64)
    h = hash_spans(data, start, end, lower=True)
    line = np.repeat(np.arange(len(a)), b - a)  # every word is in a line with a word
    # distinct (line, word) pairs by line
    order = np.lexsort((h, line))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (line[order][1:] != line[order][:-1])
    distinct = np.bincount(line[order][new], minlength=len(a))
    twin = np.zeros(len(h), dtype=bool)
    twin[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    twins = np.bincount(line[twin], minlength=len(a))
    size = np.add.reduceat(np.append(end - start, 0), a)[:len(a)].astype(np.float64) if len(a) else n
    totals = []
    for mark in _CLASSES:
        c = np.concatenate(([0], np.cumsum(mark[data])))
        totals.append((c[last] - c[first]).astype(np.float64))
    symbols, capitals, letters, digits, marks = totals
    key = mix(hash_spans(data, first, last, lower=False) + row.astype(np.uint64) * U64(0x9E3779B97F4A7C15))
    _, seen = np.unique(key, return_index=True)
    again = np.ones(len(key))
    again[seen] = 0
    x = np.stack([np.log1p(n) / 5, np.minimum(size / n / 10, 2), np.minimum(symbols / n, 1.5), capitals / (letters + 1),
                  np.minimum(digits / n, 2), np.minimum(marks / n, 1.5), 1 - distinct / n, twins / n, again], axis=1)
    return row, size, x


def _with_neighbours(row: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Own figures, those of the line before and after in the same text, and a constant."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    same = (row[1:] == row[:-1])[:, None]
    before[1:] = x[:-1] * same
    after[:-1] = x[1:] * same
    alone = np.ones((len(x), 3))
    alone[1:, 1] = ~same[:, 0]
    alone[:-1, 2] = ~same[:, 0]
    return np.concatenate((x, before, after, alone), axis=1)


def _order(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first line, lines) of every text with lines, the longest text first."""
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(row)))
    by = np.argsort(-n, kind="stable")
    return first[by], n[by]


def _messages(e: np.ndarray, t: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log odds of label 1 at every line, all texts side by side.

    ``e`` are the lines' own log odds, ``t[i, j]`` the weight of label j after i."""
    fore, back = e.copy(), np.zeros_like(e)
    live = np.searchsorted(-n, -np.arange(1, (n[0] if len(n) else 0) + 1), side="right")  # texts with so many lines
    for k in range(1, len(live)):
        at = first[:live[k]] + k
        x = fore[at - 1]
        fore[at] += np.logaddexp(t[0, 1], t[1, 1] + x) - np.logaddexp(t[0, 0], t[1, 0] + x)
    for k in range(len(live) - 1, 0, -1):
        at = first[:live[k]] + k
        y = e[at] + back[at]
        back[at - 1] = np.logaddexp(t[1, 0], t[1, 1] + y) - np.logaddexp(t[0, 0], t[0, 1] + y)
    return fore, back


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(x)))


def marginals(x: np.ndarray, row: np.ndarray, weights: np.ndarray, t: np.ndarray) -> np.ndarray:
    """P(good) of every line by forward-backward."""
    e = x @ weights
    fore, back = _messages(e, t, *_order(row))
    return _sigmoid(fore + back)


@dataclass
class Model:
    weights: np.ndarray
    t: np.ndarray
    curve: tuple[float, float]  # slope and place of the final logistic curve

    def shares(self, column: pa.Array) -> np.ndarray:
        """Length-weighted share of good lines of every text; 0 without words."""
        offs, data = buffers(column)
        out = np.zeros(len(offs) - 1)
        for i, j in blocks(offs):
            row, size, x = line_figures(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
            if len(row):
                good = marginals(_with_neighbours(row, x), row, self.weights, self.t)
                total = np.bincount(row, weights=size, minlength=j - i)
                out[i:j] = np.bincount(row, weights=size * good, minlength=j - i) / np.maximum(total, 1)
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        return _sigmoid(self.curve[0] * _logit(self.shares(column)) + self.curve[1])


def _logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _fit_field(x: np.ndarray, row: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the field by gradient ascent (Adam) on the conditional likelihood."""
    first, n = _order(row)
    inner = np.flatnonzero(row[1:] == row[:-1])  # edges: line and the next
    # every document counts alike, however many lines it has
    lines = np.bincount(row)
    w_line = 1.0 / lines[row]
    docs = max(1, len(n))
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[inner], y[inner + 1]), w_line[inner])
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        weights, t = theta[:-4], theta[-4:].reshape(2, 2)
        e = x @ weights
        fore, back = _messages(e, t, first, n)
        p = _sigmoid(fore + back)
        grad_w = x.T @ (w_line * (y - p))
        a, b = fore[inner], (e + back)[inner + 1]
        edge = np.stack([np.full_like(a, t[0, 0]), t[0, 1] + b, t[1, 0] + a, t[1, 1] + a + b])
        edge = np.exp(edge - edge.max(axis=0))
        edge /= edge.sum(axis=0)
        grad_t = seen - (edge * w_line[inner]).sum(axis=1).reshape(2, 2)
        grad = np.concatenate((grad_w, grad_t.ravel())) / docs - L2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        theta = theta + RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and place of the logistic curve of y over x (Newton steps, weak prior)."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * x + b)
        w = p * (1 - p)
        g = np.array([np.sum((y - p) * x) - 0.01 * a, np.sum(y - p) - 0.01 * b])
        h = np.array([[np.sum(w * x * x) + 0.01, np.sum(w * x)], [np.sum(w * x), np.sum(w) + 0.01]])
        d = np.linalg.solve(h, g)
        d *= min(1.0, 2.0 / (np.abs(d).max() + 1e-9))
        a, b = a + d[0], b + d[1]
    return float(a), float(b)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The figures of one document's lines, as bytes."""
    for batch in batches:
        offs, data = buffers(batch.column("text"))
        size, x = [], []
        for i in range(batch.num_rows):
            _, s, f = line_figures(data[offs[i]:offs[i + 1]], offs[i:i + 2] - offs[i])
            size.append(s.astype(np.float32).tobytes())
            x.append(f.astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(size, pa.binary()), pa.array(x, pa.binary())],
                                         names=["quality", "size", "x"])


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, lines: int) -> DataFrame:
    """(label, text) of at most ``rows`` labelled documents, taken by a hash of the id as
    long as all of them together have no more than ``lines`` lines.

    The ids are few enough to be broadcast; of labels that share an id the largest
    counts, of texts the least, so an id is one example however many rows repeat it."""
    ids = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id")
           .agg(F.max(F.col(label).cast("int")).alias(label))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", label).agg(F.min("text").alias("text"))
    sizes = found.select("doc_id", (F.regexp_count("text", F.lit("\n")) + 1).alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    chosen, total = [], 0
    for r in sizes:  # at most ``rows``
        if total + r["n"] <= lines:
            chosen.append(r["doc_id"])
            total += r["n"]
    return found.where(F.col("doc_id").isin(chosen)).select(label, "text")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of at most ``TRAIN_DOCS`` documents of ``labels`` (doc_id, quality).

    The driver receives their lines' figures, 40 bytes a line of at most ``TRAIN_LINES``. Without both labels the
    score is the share of the label there is (0.5 without any)."""
    rows = sample(docs, labels, "quality", TRAIN_DOCS, TRAIN_LINES)
    got = rows.mapInArrow(_lines, "quality int, size binary, x binary").toArrow().to_pylist()
    y = np.array([r["quality"] for r in got], dtype=np.int64)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(3 * OWN + 3), np.zeros((2, 2)), (0.0, float(np.sign(y.sum() - 0.5) * 3) if len(y) else 0.0))
    x = [np.frombuffer(r["x"], np.float32).reshape(-1, OWN).astype(np.float64) for r in got]
    size = [np.frombuffer(r["size"], np.float32).astype(np.float64) for r in got]
    n = np.array([len(s) for s in size])
    row = np.repeat(np.arange(len(got)), n)
    full = _with_neighbours(row, np.concatenate(x))
    weights, t = _fit_field(full, row, y[row])
    good = marginals(full, row, weights, t)
    size = np.concatenate(size)
    share = np.bincount(row, weights=size * good, minlength=len(got)) / np.maximum(np.bincount(row, weights=size, minlength=len(got)), 1)
    return Model(weights, t, fit_curve(_logit(share), y))


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of every row of ``docs`` (doc_id, text).

    A null or empty text has no good line and gets the lowest score. Null and repeated
    ids come back as they are; an empty table gives none."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.scores(batch.column("text"))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": score,
                                              "predicted": (score >= 0.5).astype(np.int32)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, score double, predicted int")


def held_out():
    return id_crc() % 3 == 1


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of the whole ``documents`` table, learned from labels not held out."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return score_quality(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: drop the documents predicted to be of label 0."""
    prepare(spark)
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch.column("text")) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
