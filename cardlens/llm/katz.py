"""Language-model scores by a Katz backoff model of words.

P(w | v) is the Good-Turing discounted count of the pair over c(v) + 1 where the pair
was seen in training, else alpha(v) * P(w); P(w) likewise backs off to one unknown
word. alpha(v) shares what the seen pairs of v leave exactly among the unseen words.
The pseudo-count in the denominator leaves every context something to share. Before
the first word stands the end of a text.

Everything is counted over all training texts. Words go to count tables; the most
frequent ones, as many as fit a fixed bound, are broadcast with their counts and
numbered. Pairs of the ``HEADS`` most frequent words are counted in one dense table
of fixed size, so no other pair can hold more than a 1/HEADS-th of all tokens. All
other pairs are dealt out once, packed, by a hash of their rarer part: each group
counts its pairs and returns partial sums per text, statistics per context, and, for
held-out texts only, which contexts backed off. There are groups in proportion to the
tokens, but one group holds all pairs after one word (or of a head and a word), so the
largest grows with the word of rank HEADS + 1. The model is not kept; ``katz_tables`` stores it, in any order up to
five, and scores further texts. Discounts need the counts of counts of all pairs; partial sums stay linear in
them, so that the pairs need not be dealt out again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardlens.llm._text import U64, blocks, buffers, mix, row_ptr, words
from cardlens.llm._util import batch_rows, drop, id_crc, materialize, prepare, shuffle_partitions, table

HEADS = 1024         # words of the dense pair table
KNOWN = 1 << 19      # words broadcast with their counts, at most
CUT = 5              # counts up to this one are discounted
GROUP_TOKENS = 1_500_000
PACK = 400_000       # pairs packed at a time

_END = U64(0x2545F4914F6CDD1D)   # the hash that stands for the end of a text
_COLD = U64(1 << 63)             # marks a word that is not broadcast


def discounts(n: np.ndarray) -> np.ndarray:
    """Katz's discount ratios for counts 1 to ``CUT`` from counts of counts 1 to ``CUT`` + 1.

    Where they are too few for Good-Turing (a ratio outside 0 to 1), half a count is taken."""
    d = np.array([(r - 0.5) / r for r in range(1, CUT + 1)])
    if n[0] > 0:
        a = (CUT + 1) * n[CUT] / n[0]
        for r in range(1, CUT + 1):
            if n[r - 1] > 0 and a < 1:
                x = ((r + 1) * n[r] / n[r - 1] / r - a) / (1 - a)
                if 0 < x < 1:
                    d[r - 1] = x
    return d


def _discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Counts after discounting."""
    c = np.asarray(c)
    low = np.append(np.append(0.0, d), 1.0)[np.minimum(c, CUT + 1).astype(np.int64)]
    return c * low


@dataclass
class Words:
    """Counts of words: totals, and the frequent ones by number (0 is the end)."""

    tokens: int
    distinct: int
    d: np.ndarray        # unigram discounts
    unknown: float       # P of the unknown word
    hashes: np.ndarray   # of the numbered words, sorted
    number: np.ndarray   # their numbers, in the same order
    count: np.ndarray    # by number

    def __post_init__(self):
        self.p = self.unigram(self.count)
        self.log_p = np.log10(self.p)
        self.log_c = np.log10(self.count + 1.0)
        self.base = np.log10((self.count + 0.5) / self.scale)

    @property
    def scale(self) -> float:
        return self.tokens + 0.5 * (self.distinct + 1)

    def unigram(self, c: np.ndarray) -> np.ndarray:
        c = np.asarray(c)
        return np.where(c > 0, _discounted(c, self.d) / (self.tokens + 1.0), self.unknown)

    def codes(self, h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == h, self.number[at].astype(np.uint64), h | _COLD)


def _tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past last row, hashes, row of each) of blocks of texts, ends included."""
    offs, data = buffers(column)
    for i, j in blocks(offs):
        h, row, _, _ = words(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
        h &= ~_COLD
        ptr = row_ptr(row, j - i)
        end = ptr[1:] + np.arange(j - i)
        tok = np.empty(len(h) + j - i, dtype=np.uint64)
        inner = np.ones(len(tok), dtype=bool)
        inner[end] = False
        tok[end], tok[inner] = _END, h
        yield i, j, tok, np.repeat(np.arange(j - i), np.diff(ptr) + 1)


def _merge(keys: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    u, at = np.unique(np.concatenate(keys), return_inverse=True)
    return u, np.bincount(at, weights=np.concatenate(sums), minlength=len(u)).astype(np.int64)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, sums, size = [], [], 0
    out = lambda u, n: pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(n)], names=["h", "c"])
    for batch in batches:
        for _, _, tok, _ in _tokens(batch.column("text")):
            u, n = np.unique(tok, return_counts=True)
            keys.append(u), sums.append(n)
            size += len(u)
            if size > 1_500_000:
                u, n = _merge(keys, sums)
                keys, sums, size = [u], [n], len(u)
                if size > 1_000_000:
                    yield out(u, n)
                    keys, sums, size = [], [], 0
    if keys:
        yield out(*_merge(keys, sums))


def count_words(train: DataFrame) -> Words:
    """The word counts of all ``train`` texts. The driver receives totals, how many words
    have each count, and at most ``KNOWN`` words."""
    counts = materialize(train.select("text").mapInArrow(_count_words, "h long, c long")
                         .groupBy("h").agg(F.sum("c").alias("c")), "words")
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"),
                       *[F.count_if(F.col("c") == r).alias(f"n{r}") for r in range(1, CUT + 2)]).first()
    n, v = int(total["n"] or 0), int(total["v"])
    d = discounts(np.array([total[f"n{r}"] for r in range(1, CUT + 2)], dtype=np.float64))
    # the least count from which on no more than KNOWN words exist
    at_least = counts.select(F.least("c", F.lit(1 << 20)).alias("c")).groupBy("c").agg(F.count("*").alias("n")).toArrow()
    c, m = at_least.column("c").to_numpy(), at_least.column("n").to_numpy()
    by = np.argsort(-c)
    fits = np.cumsum(m[by]) <= KNOWN
    least = int(c[by][fits].min()) if fits.any() else (1 << 62)
    end = int(_END.astype(np.int64))
    known = counts.where((F.col("c") >= least) | (F.col("h") == end)).toArrow()
    h, c = known.column("h").to_numpy().astype(np.uint64), known.column("c").to_numpy()
    drop(counts)
    by = np.lexsort((h, -c, h != _END))
    h, c = h[by], c[by]
    if not len(h) or h[0] != _END:
        h, c = np.append(_END, h), np.append(0, c)
    order = np.argsort(h)
    # the sum of all discounted counts: what count r loses is r * (1 - d) for each word
    lost = sum(total[f"n{r}"] * r * (1 - d[r - 1]) for r in range(1, CUT + 1))
    return Words(n, v, d, 1 - (n - lost) / (n + 1.0), h[order], order.astype(np.uint32), c)


def _count_heads(train: DataFrame, heads) -> np.ndarray:
    """Counts of all pairs of heads (row: the first word) in the ``train`` texts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm, pending, size = heads.value, [], 0
        total = np.zeros(HEADS * HEADS, dtype=np.int64)
        for batch in batches:
            for _, _, tok, _ in _tokens(batch.column("text")):
                code = lm.codes(tok)
                prev = np.append(U64(0), code[:-1])
                both = (code < U64(HEADS)) & (prev < U64(HEADS))
                pending.append((prev[both] * U64(HEADS) + code[both]).astype(np.int64))
                size += len(pending[-1])
                if size > 500_000:
                    total += np.bincount(np.concatenate(pending), minlength=len(total))
                    pending, size = [], 0
        if pending:
            total += np.bincount(np.concatenate(pending), minlength=len(total))
        at = np.flatnonzero(total)
        for i in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_pydict({"pair": at[i:i + 100_000], "c": total[at[i:i + 100_000]]})

    got = (train.select("text").mapInArrow(count, "pair long, c long").groupBy("pair")
           .agg(F.sum("c").alias("c")).toArrow())  # at most HEADS * HEADS rows
    out = np.zeros(HEADS * HEADS, dtype=np.int64)
    out[got.column("pair").to_numpy()] = got.column("c").to_numpy()
    return out.reshape(HEADS, HEADS)


# kind 0: a text; 1: part of a text's sums; 2: a context's statistics; 3: a context that
# a held-out text uses (n1: denominators, n2: back-offs that are still to be added)
_K = [f"k{r}" for r in range(1, CUT + 2)]
_PARTS = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("rid", pa.int64()), ("a", pa.float64()), ("b", pa.float64()),
                    ("n1", pa.int64()), ("n2", pa.int64()), *[(k, pa.int32()) for k in _K],
                    ("doc_id", pa.int64()), ("held_out", pa.bool_())])
_PARTS_SQL = ("kind int, key long, rid long, a double, b double, n1 long, n2 long, "
              + ", ".join(f"{k} int" for k in _K) + ", doc_id long, held_out boolean")


def _parts(kind: int, n: int, **cols) -> pa.RecordBatch:
    made = []
    for f in _PARTS:
        x = cols.get(f.name)
        if f.name == "kind":
            made.append(pa.array(np.full(n, kind, np.int32)))
        elif x is None:
            made.append(pa.nulls(n, f.type) if f.name in ("doc_id", "held_out", "key", "rid") else pa.array(np.zeros(n), f.type))
        else:
            made.append(x if isinstance(x, pa.Array) else pa.array(x).cast(f.type))
    return pa.RecordBatch.from_arrays(made, schema=_PARTS)


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(a.tobytes() for a in arrays))


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = len(raw) // 32
    u = np.frombuffer(raw, dtype=np.uint64)
    return u[:n], u[n:2 * n], u[2 * n:3 * n], u[3 * n:]


def _deal(docs: DataFrame, lm, heads, groups: int) -> DataFrame:
    """Scan of all texts: what is known at once, and all other pairs packed by group."""
    schema = pa.schema([("p", pa.int32()), *_PARTS, ("pairs", pa.binary())])

    def extend(p: np.ndarray, parts: pa.RecordBatch, pairs: list | None = None) -> pa.RecordBatch:
        cols = [pa.array(p.astype(np.int32)), *parts.columns, pa.array(pairs, pa.binary()) if pairs else pa.nulls(len(p), pa.binary())]
        return pa.RecordBatch.from_arrays(cols, schema=schema)

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        w1, w2, rid, n = (np.concatenate(x) for x in zip(*held))
        # by the unknown word; else by both words if the first is a head; else by the first
        key = np.where(w2 >= _COLD, mix(w2), np.where(w1 < U64(HEADS), mix(mix(w1 + U64(1)) + w2), mix(w1 ^ U64(0x94D049BB133111EB))))
        p = (key % U64(groups)).astype(np.int64)
        order = np.lexsort((rid, p))
        p, w1, w2, rid, n = p[order], w1[order], w2[order], rid[order], n[order]
        cut = np.append(np.flatnonzero(np.append(True, p[1:] != p[:-1])), len(p))
        at = p[cut[:-1]]
        blobs = [_pack(w1[a:b], w2[a:b], rid[a:b], n[a:b]) for a, b in zip(cut[:-1], cut[1:])]
        yield extend(at, _parts(4, len(at)), blobs)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, dense = lm.value, heads.value
        held, size = [], 0
        for batch in batches:
            rid_all, out_all = batch.column("rid").to_numpy(), batch.column("held_out").to_numpy(zero_copy_only=False)
            for i, j, tok, row in _tokens(batch.column("text")):
                m = j - i
                rid, out = rid_all[i:j], out_all[i:j]
                code = known.codes(tok)
                prev = np.append(U64(0), code[:-1])
                hot = code < _COLD
                total = lambda at, w=None: np.bincount(row[at], weights=w, minlength=m)
                c = known.count[code[hot].astype(np.int64)]
                base = total(hot, known.base[code[hot].astype(np.int64)])
                n_known = total(hot, (c > 0).astype(np.float64)).astype(np.int64)
                both = np.flatnonzero((code < U64(HEADS)) & (prev < U64(HEADS)))
                v, w = prev[both].astype(np.int64), code[both].astype(np.int64)
                c12 = dense[v, w]
                seen = c12 > 0
                score = total(both, np.where(seen, np.log10(np.maximum(c12, 1)) - known.log_c[v], known.log_p[w]))
                ks = {k: total(both[c12 == r]) for r, k in enumerate(_K[:CUT], 1)}
                p = (rid.astype(np.uint64) % U64(groups)).astype(np.int64)
                yield extend(p, _parts(0, m, rid=rid, a=score, b=base, n1=n_known, n2=np.bincount(row, minlength=m),
                                       doc_id=batch.column("doc_id").slice(i, m), held_out=pa.array(out), **ks))
                off = both[~seen]
                if len(off):
                    pair, n = np.unique(row[off] * HEADS + prev[off].astype(np.int64), return_counts=True)
                    yield extend(p[pair // HEADS], _parts(3, len(pair), key=pair % HEADS, rid=rid[pair // HEADS], n2=n))
                rest = np.ones(len(tok), dtype=bool)
                rest[both] = False
                w1, w2, r = prev[rest], code[rest], row[rest]
                # equal pairs of a text once, with their number
                _, first, n = np.unique(mix(mix(w1 + U64(1)) + w2) + r.astype(np.uint64) * U64(0x9E3779B97F4A7C15),
                                        return_index=True, return_counts=True)
                held.append((w1[first], w2[first], rid[r[first]].astype(np.uint64) * U64(2) + out[r[first]].astype(np.uint64),
                             n.astype(np.uint64)))
                size += len(first)
                if size > PACK:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    return docs.mapInArrow(scan, "p int, " + _PARTS_SQL + ", pairs binary")


def _score_group(known: Words, w1, w2, tag, n) -> tuple[tuple, tuple, tuple]:
    """Counts of one group of pairs: parts of texts, of contexts, and open back-offs."""
    rid, out, n = (tag >> U64(1)).astype(np.int64), (tag & U64(1)) == 1, n.astype(np.int64)
    train = np.where(out, 0, n)
    key = mix(mix(w1 + U64(1)) + w2)
    order = np.argsort(key)
    new = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
    kind = np.empty(len(key), dtype=np.int64)
    kind[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(key))))
    one = order[new]  # a row of each kind of pair
    c12 = np.bincount(kind, weights=train, minlength=len(new)).astype(np.int64)
    cold1, cold2 = w1 >= _COLD, w2 >= _COLD
    at2 = np.where(cold2, 0, w2).astype(np.int64)
    p, log_p = known.p[at2], known.log_p[at2]
    c = c12[kind]
    a, b, n_known = np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n))
    if cold2.any():
        at = np.flatnonzero(cold2)
        _, inv = np.unique(w2[at], return_inverse=True)
        c2 = np.bincount(inv, weights=train[at])[inv]
        p[at] = known.unigram(c2)
        log_p[at] = np.log10(p[at])
        b[at] = n[at] * np.log10((c2 + 0.5) / known.scale)
        n_known[at] = n[at] * (c2 > 0)
        # the word as the context of what follows it: in training texts that pair was seen
        a[at] -= train[at] * np.log10(c2 + 1)
    seen = c > 0
    a += n * np.where(seen, np.log10(np.maximum(c, 1)), log_p)
    at1 = np.where(cold1, 0, w1).astype(np.int64)
    a -= n * np.where(seen & ~cold1, known.log_c[at1], 0.0)
    text, inv = np.unique(rid, return_inverse=True)
    add = lambda w: np.bincount(inv, weights=w, minlength=len(text))
    texts = (text, add(a), add(b), add(n_known), *[add(n * (c == r)) for r in range(1, CUT + 1)])
    real = c12 > 0
    context, inv = np.unique(w1[one][real], return_inverse=True)
    cc = c12[real]
    put = lambda w: np.bincount(inv, weights=w, minlength=len(context))
    contexts = (context, put(p[one][real]), put(cc), put(cc * (cc > CUT)), *[put(cc == r) for r in range(1, CUT + 2)])
    ask = ~seen | (out & cold1)
    return texts, contexts, (w1[ask], rid[ask], np.where(seen, n, 0)[ask], np.where(seen, 0, n)[ask])


def _sum_up(rows: list[tuple]) -> tuple[np.ndarray, ...]:
    key, inv = np.unique(np.concatenate([r[0] for r in rows]), return_inverse=True)
    return key, *[np.bincount(inv, weights=np.concatenate([r[i] for r in rows]), minlength=len(key)) for i in range(1, len(rows[0]))]


def _score_groups(dealt: DataFrame, lm, partitions: int) -> DataFrame:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lm.value
        texts, contexts, held, group = [], [], [], None

        def text_rows(r):
            return _parts(1, len(r[0]), rid=r[0], a=r[1], b=r[2], n1=r[3].astype(np.int64),
                          **{k: x.astype(np.int64) for k, x in zip(_K, r[4:])})

        def context_rows(r):
            return _parts(2, len(r[0]), key=r[0].astype(np.int64), b=r[1], n1=r[2].astype(np.int64), n2=r[3].astype(np.int64),
                          **{k: x.astype(np.int64) for k, x in zip(_K, r[4:])})

        def finish() -> Iterator[pa.RecordBatch]:
            t, c, (key, rid, n1, n2) = _score_group(known, *(np.concatenate(x) for x in zip(*map(_unpack, held))))
            if len(key):
                yield _parts(3, len(key), key=key.astype(np.int64), rid=rid, n1=n1, n2=n2)
            for kept, got, rows in ((texts, t, text_rows), (contexts, c, context_rows)):
                kept.append(got)
                if sum(len(x[0]) for x in kept) > 800_000:
                    merged = _sum_up(kept)
                    kept[:] = [merged]
                    if len(merged[0]) > 500_000:
                        kept.clear()
                        yield rows(merged)

        for batch in batches:
            blob = batch.column("pairs").is_valid()
            other = batch.filter(pa.array(~blob.to_numpy(zero_copy_only=False)))
            if other.num_rows:
                yield other.select(_PARTS.names)
            mine = batch.filter(blob)
            for p, pairs in zip(mine.column("p").to_pylist(), mine.column("pairs").to_pylist()):
                if p != group and held:
                    yield from finish()
                    held = []
                group = p
                held.append(pairs)
        if held:
            yield from finish()
        if texts:
            yield text_rows(_sum_up(texts))
        if contexts:
            yield context_rows(_sum_up(contexts))

    return dealt.repartition(partitions, "p").sortWithinPartitions("p").mapInArrow(score, _PARTS_SQL)


def _backoff(c, high, p, k, d) -> np.ndarray:
    """log10 alpha of contexts with ``c`` tokens after them, of which ``high`` in pairs
    beyond the cut, ``k[r]`` pairs of count r + 1, and seen words of total P ``p``."""
    mass = high + sum(k[r] * (r + 1) * d[r] for r in range(CUT))
    return np.where(c > 0, np.log10(1 - mass / (c + 1.0)) - np.log10(np.maximum(1 - p, 1e-12)), 0.0)


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    ``docs`` has doc_id, text and held_out (not learned from); other columns are not
    read. A null or empty text is one token, its end. Null and repeated ids come back as
    they are, each row scored alone; an empty table gives none. Without training texts
    every word is the unknown word, of probability 1.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       "held_out", F.monotonically_increasing_id().alias("rid"))
    train = docs.where(~F.col("held_out"))
    known = count_words(train)
    lm = spark.sparkContext.broadcast(known)
    top = np.isin(known.number, np.arange(HEADS))
    few = Words(known.tokens, known.distinct, known.d, known.unknown, known.hashes[top], known.number[top], known.count[:HEADS])
    dense = _count_heads(train, spark.sparkContext.broadcast(few))
    heads = spark.sparkContext.broadcast(dense)
    partitions = shuffle_partitions(spark)
    groups = max(partitions, int(known.tokens * 1.3 // GROUP_TOKENS) + 1)
    parts = materialize(_score_groups(_deal(docs, lm, heads, groups), lm, partitions), "parts")

    sums = [F.sum(F.col(k)).alias(k) for k in _K]
    stats = parts.where("kind = 2")
    total = stats.agg(*sums).first()
    counts = np.array([int(total[k] or 0) + int((dense == r).sum()) for r, k in enumerate(_K, 1)], dtype=np.float64)
    d = discounts(counts)
    by_context = stats.groupBy("key").agg(F.sum("b").alias("p"), F.sum("n1").alias("c"), F.sum("n2").alias("high"), *sums)
    # contexts that are numbered words: at most KNOWN rows
    size = len(known.count)
    c, high, p, k = np.zeros(size), np.zeros(size), np.zeros(size), np.zeros((CUT, size))
    m = min(HEADS, size)
    c[:m], high[:m] = dense.sum(axis=1)[:m], (dense * (dense > CUT)).sum(axis=1)[:m]
    p[:m] = ((dense > 0)[:m, :m] * known.p[None, :m]).sum(axis=1)
    for r in range(CUT):
        k[r, :m] = (dense == r + 1).sum(axis=1)[:m]
    got = by_context.where("key >= 0").toArrow()
    at = got.column("key").to_numpy()
    c[at] += got.column("c").to_numpy()
    high[at] += got.column("high").to_numpy()
    p[at] += got.column("p").to_numpy()
    for r in range(CUT):
        k[r, at] += got.column(_K[r]).to_numpy()
    alpha = spark.sparkContext.broadcast((np.log10(c + 1), _backoff(c, high, p, k, d)))

    def known_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_c, log_alpha = alpha.value
        for batch in batches:
            at, n1, n2 = (batch.column(x).to_numpy() for x in ("key", "n1", "n2"))
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(n2 * log_alpha[at] - n1 * log_c[at])], names=["rid", "a"])

    asked = parts.where("kind = 3").select("key", "rid", "n1", "n2")
    mass = F.col("high") + sum(F.col(_K[r]) * F.lit(float((r + 1) * d[r])) for r in range(CUT))
    cold = by_context.where("key < 0").select(
        "key", F.log10(F.col("c") + 1.0).alias("log_c"),
        (F.log10(1 - mass / (F.col("c") + 1.0)) - F.log10(F.greatest(1 - F.col("p"), F.lit(1e-12)))).alias("log_alpha"))
    rare = asked.where("key < 0").join(cold, "key").select(
        "rid", (F.col("n2") * F.col("log_alpha") - F.col("n1") * F.col("log_c")).alias("a"))
    with batch_rows(spark, 50_000):
        often = materialize(asked.where("key >= 0").mapInArrow(known_contexts, "rid long, a double")
                            .groupBy("rid").agg(F.sum("a").alias("a")), "opened")
    opened = often.unionByName(rare)
    none = [F.lit(0.0).alias("b"), F.lit(0).cast("long").alias("n1"), F.lit(0).cast("long").alias("n2"),
            F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out")]
    cut = F.col("a") + sum(F.col(_K[r]) * F.lit(float(np.log10(d[r]))) for r in range(CUT))
    text_parts = parts.where("kind < 2").select(
        "rid", cut.alias("a"), "b", "n1", F.when(F.col("kind") == 0, F.col("n2")).otherwise(0).alias("n2"), "doc_id", "held_out")
    return (text_parts.unionByName(opened.select("rid", "a", *none)).groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n2").alias("n_tokens"),
        F.sum("n1").alias("n_known"), F.sum("b").alias("base_score"), F.sum("a").alias("score"))
        .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(known.tokens).cast("long").alias("train_tokens"),
                "base_score", "score"))


def op7_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    return score_texts(docs.withColumn("held_out", id_crc() % 5 == 1))
