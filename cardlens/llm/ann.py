"""Largest inner products by multiprobe p-stable hashing.

Largest inner product becomes least distance on the unit sphere: vectors are divided by
the largest norm M and get one more coordinate sqrt(1 - |x|^2); a query is scaled to
norm one and gets 0 there. A table hashes a vector by K functions floor((a.x + b) / W)
with Gaussian a. A query visits its own bucket and then perturbed ones: the 2K steps to
a neighbouring cell are ranked by the distance to that cell's border, and sets of
steps are taken by their expected sum of squared distances, the least (likeliest) first.
Bucket contents and probing queries are packed in blocks, so a bucket of any size is
compared with its queries block by block, all of it, and a pair of blocks returns no
more than the best of each query. What scores below as many rows of a bounded sample as a query
can need is dropped at once. Candidates of all tables are merged and ranked by their
exact inner product.

K, W and the number of probes follow from a bounded sample: ``SAMPLE_QUERIES`` queries
are compared with every row once, and the cheapest setting is taken by which their true
neighbours are visited with at least the share ``TARGET``. Equal vectors are searched
once: a class of copies of any size counts as one vector with as many of its least ids as
a query can need, and equal queries share their search.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardlens.llm._text import U64, mix
from cardlens.llm._util import batch_rows, materialize, prepare, shuffle_partitions, table

NEIGHBOURS = 20
QUERY_STEP = 20        # rows whose id this divides are queries
TABLES = 4
SAMPLE_QUERIES = 64    # queries on which the setting is fitted
SAMPLE_ROWS = 4096     # rows on which the size of the visited buckets is estimated, about
TARGET = 0.95          # share of the sample's true neighbours that the probes must visit
SETTINGS = [(k, w) for w in (3.0, 1.0, 0.3) for k in (2, 4, 6, 8, 10, 12, 16, 20)]
MOST_PROBES = 256      # a setting that needs more probes a table is not taken
PROBE_COST = 100       # one probe of a bucket costs as much as so many inner products
BLOCK = 512            # vectors of a block of a bucket, queries of a block of probes


@lru_cache(maxsize=64)
def _functions(dim: int, k: int, width: float, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, mixers) of a table's functions over ``dim`` + 1 coordinates."""
    rng = np.random.Generator(np.random.PCG64([20240229, dim, k, int(width * 1000), t]))
    return rng.normal(size=(dim + 1, k)), rng.uniform(0, width, size=k), rng.integers(1, 2**63, size=k, dtype=np.uint64) | U64(1)


@lru_cache(maxsize=64)
def probe_sets(k: int, most: int) -> list[tuple[int, ...]]:
    """The first ``most`` sets of ranked steps by expected sum of squares, the empty one first.

    Steps are numbered by rank; ranks j and 2k - 1 - j are the two steps of one function
    and never go together.
    """
    cost = [j * (j + 1) / (4 * (k + 1) * (k + 2)) for j in range(1, k + 1)]
    cost += [1 - j / (k + 1) + j * (j + 1) / (4 * (k + 1) * (k + 2)) for j in range(k, 0, -1)]
    out: list[tuple[int, ...]] = [()]
    heap = [(cost[0], (0,))]
    while heap and len(out) < most:
        total, steps = heapq.heappop(heap)
        if not any(2 * k - 1 - s in steps for s in steps):
            out.append(steps)
        last = steps[-1]
        if last + 1 < 2 * k:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], steps[:-1] + (last + 1,)))
            heapq.heappush(heap, (total + cost[last + 1], steps + (last + 1,)))
    return out


def _cells(x: np.ndarray, k: int, width: float, t: int) -> np.ndarray:
    """(a.x + b) / W of each row (already on the sphere) under each function of a table."""
    a, b, _ = _functions(x.shape[1] - 1, k, width, t)
    return (x @ a + b) / width


def _keys(cells: np.ndarray, dim: int, k: int, width: float, t: int) -> np.ndarray:
    """64-bit keys of buckets given by their K whole numbers."""
    mixers = _functions(dim, k, width, t)[2]
    h = (cells.astype(np.int64).astype(np.uint64) * mixers).sum(axis=-1, dtype=np.uint64)
    return mix(h + U64(t * 0x9E3779B97F4A7C15 + dim & 2**64 - 1)).astype(np.int64)


def _probes(x: np.ndarray, k: int, width: float, t: int, n: int) -> np.ndarray:
    """Cells (row, probe, function) that each row visits in a table, likeliest first."""
    f = _cells(x, k, width, t)
    own = np.floor(f)
    below = f - own
    rank = np.argsort(np.concatenate([below, 1 - below], axis=1), axis=1, kind="stable")
    sets = probe_sets(k, n)
    chosen = np.zeros((len(sets), 2 * k))
    for i, steps in enumerate(sets):
        chosen[i, list(steps)] = 1
    step = np.concatenate([-np.eye(k), np.eye(k)])[rank]  # row, rank, function
    return own[:, None, :] + np.einsum("pr,xrf->xpf", chosen, step)


def _on_sphere(v: np.ndarray, norm: float) -> np.ndarray:
    """Stored vectors on the unit sphere of one more dimension."""
    v = v / norm
    rest = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", v, v)))
    return np.concatenate([v, rest[:, None]], axis=1)


def _as_query(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    v = v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]
    return np.concatenate([v, np.zeros((len(v), 1))], axis=1)


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each dimension among packed vectors."""
    sizes = np.array([len(b) // 8 for b in column.to_pylist()])
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield rows, np.frombuffer(b"".join(column.take(pa.array(rows)).to_pylist()), dtype="<f8").reshape(len(rows), dim)


def best_of(q: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the ``k`` largest inner products of each query, ties kept.

    Scores are sums over each pair alone, the same whatever block the pair meets in.
    """
    rough = q @ v.T
    if rough.shape[1] > k:
        least = np.partition(rough, rough.shape[1] - k, axis=1)[:, rough.shape[1] - k]
        room = 1e-12 * np.abs(q).max(axis=1) * np.abs(v).max() * v.shape[1]
        least = np.where(np.isfinite(least - room), least - room, -np.inf)
        a, b = np.nonzero(~(rough < least[:, None]))
    else:
        a, b = (x.ravel() for x in np.indices(rough.shape))
    return a, b, (q[a] * v[b]).sum(axis=1)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of one key as blocks of at most ``BLOCK`` vectors."""
    key, ids, vectors, floors = None, [], [], []

    def block() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"key": pa.array([key], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64())),
                                           "vectors": pa.array([b"".join(vectors)], pa.binary()),
                                           "floors": pa.array([floors], pa.list_(pa.float64()))})

    for batch in batches:
        for k, i, v, f in zip(*(batch.column(c).to_pylist() for c in ("key", "class", "vector", "floor")), strict=True):
            if ids and (k != key or len(ids) == BLOCK or len(v) != len(vectors[0])):
                yield block()
                ids, vectors, floors = [], [], []
            key = k
            ids.append(i)
            vectors.append(v)
            floors.append(f)
    if ids:
        yield block()


def _blocks(df: DataFrame, spread: str) -> DataFrame:
    """key, ids, vectors, floors: the rows of each key in blocks; ranges split a hot key."""
    n = shuffle_partitions(df.sparkSession)
    if "floor" not in df.columns:
        df = df.withColumn("floor", F.lit(float("-inf")))
    return df.repartitionByRange(n, "key", spread).sortWithinPartitions("key", spread).mapInArrow(
        _pack, "key long, ids array<long>, vectors binary, floors array<double>")


def _vectors(df: DataFrame) -> DataFrame:
    """vec_id and the packed vector of the rows that take part, equal rows once."""
    v = F.col("embedding").cast("array<double>")
    whole = F.size(v) > 0
    for test in (F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.exists(v, lambda x: x != 0)):
        whole = whole & test

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("v")
            flat = col.flatten().to_numpy(zero_copy_only=False) + 0.0  # -0.0 becomes 0.0
            ends = np.concatenate(([0], np.cumsum(np.diff(col.offsets.to_numpy()))))
            raw = flat.astype("<f8").tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(
                [raw[8 * a:8 * b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["vec_id", "vector"])

    with batch_rows(df.sparkSession, 2000):
        rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
            F.col("vec_id").isNotNull() & F.coalesce(whole, F.lit(False)))
        return materialize(rows.mapInArrow(pack, "vec_id long, vector binary").distinct(), "vectors")


def _merge(best: DataFrame, wide: int) -> DataFrame:
    """The ``wide`` best candidates of each query over all blocks and tables."""
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "class")
    return best.distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= wide).drop("r")


def _choose(queries: np.ndarray, near: list[np.ndarray], rows: np.ndarray, n: int, target: float
            ) -> tuple[int, float, int, float]:
    """(K, W, probes a table, share of the sample's neighbours visited), the cheapest."""
    fitted = []
    for k, width in SETTINGS:
        dim = queries.shape[1] - 1
        first = [np.full(len(x), 1 << 30) for x in near]
        seen = np.zeros(MOST_PROBES)  # vectors met by each probe, all tables
        for t in range(TABLES):
            keys = _keys(_probes(queries, k, width, t, MOST_PROBES), dim, k, width, t)
            held, counts = np.unique(_keys(np.floor(_cells(rows, k, width, t)), dim, k, width, t), return_counts=True)
            at = np.minimum(np.searchsorted(held, keys), len(held) - 1)
            met = np.where(held[at] == keys, counts[at], 0).mean(axis=0)
            seen[:len(met)] += met
            for i, x in enumerate(near):
                if len(x):
                    own = _keys(np.floor(_cells(x, k, width, t)), dim, k, width, t)
                    hit = own[:, None] == keys[i][None, :]
                    first[i] = np.minimum(first[i], np.where(hit.any(axis=1), hit.argmax(axis=1), 1 << 30))
        ranks = np.sort(np.concatenate(first))
        if not len(ranks):
            return SETTINGS[0][0], SETTINGS[0][1], 1, 1.0
        need = int(ranks[min(len(ranks) - 1, math.ceil(target * len(ranks)) - 1)]) + 1
        reached = need <= MOST_PROBES
        probes = min(need, len(probe_sets(k, MOST_PROBES)))
        cost = TABLES * probes * PROBE_COST + seen[:probes].sum() * n / max(1, len(rows))
        fitted.append((not reached, cost if reached else -float((ranks < probes).mean()), k, width, probes, float((ranks < probes).mean())))
    return min(fitted)[2:]


def nearest(queries: DataFrame, rows: DataFrame, k: int = NEIGHBOURS, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest inner products among ``rows``.

    Both have vec_id and embedding; other columns are not read. Rows without an id or
    with a vector that is null, empty, zero or holds a null or non-finite component take
    no part. Equal rows (id and vector) count once; an id on several vectors is one
    query and one candidate for each. A row is no candidate of a query with its id. Only
    vectors of the query's dimension are candidates. Ties go to the smaller vec_id. No
    queries or no rows: no result. A query whose probed buckets hold fewer than k
    candidates while more exist is compared with all rows, in blocks.
    """
    spark = rows.sparkSession
    prepare(spark)
    stored, asked = _vectors(rows), _vectors(queries)
    norm = _norm(stored)
    if norm is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # ids that a query may have to pass over: its own, on as many vectors as it has
    wide = k + (asked.groupBy("vec_id").count().agg(F.max("count")).first()[0] or 0)
    least = (stored.withColumn("r", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("r") <= wide)
             .groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
             .withColumn("least", F.element_at("ids", 1)))
    # classes are numbered in the order of their least ids, so that ties go by the number
    least = (least.repartitionByRange(shuffle_partitions(spark), "least", "vector").sortWithinPartitions("least", "vector")
             .select("vector", "ids", F.monotonically_increasing_id().alias("class")))
    least = materialize(least, "classes")
    ask = materialize(asked.select("vector").distinct().withColumn("class", F.monotonically_increasing_id()), "asked")

    sample = ask.orderBy(F.xxhash64("vector"), "vector").limit(SAMPLE_QUERIES).collect()  # at most SAMPLE_QUERIES vectors
    n = least.count()
    (functions, width, visits, _), seen = _fit(spark, least, [bytes(r["vector"]) for r in sample], n, norm, k, target)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, m in _matrices(batch.column("vector")) if batch.num_rows else ():
                x = _on_sphere(m, norm)
                for t in range(TABLES):
                    keys = _keys(np.floor(_cells(x, functions, width, t)), m.shape[1], functions, width, t)
                    own = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(keys), own.column("class"), own.column("vector")], ["key", "class", "vector"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, m in _matrices(batch.column("vector")) if batch.num_rows else ():
                for i in range(0, len(at), 64):
                    x = _as_query(m[i:i + 64])
                    floor = _floors(m[i:i + 64], seen, wide)
                    for t in range(TABLES):
                        keys = _keys(_probes(x, functions, width, t, visits), m.shape[1], functions, width, t)
                        own = batch.take(pa.array(np.repeat(at[i:i + 64], keys.shape[1])))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys.ravel()), own.column("class"), own.column("vector"), pa.array(np.repeat(floor, keys.shape[1]))],
                            ["key", "class", "vector", "floor"])

    packed = "key long, class long, vector binary"
    with batch_rows(spark, 500):
        buckets = materialize(_blocks(least.select("class", "vector").mapInArrow(index, packed), "class"), "buckets")
        probing = materialize(_blocks(ask.mapInArrow(visit, packed + ", floor double"), "class"), "probes")
    pairs = probing.select("key", F.col("ids").alias("qids"), F.col("vectors").alias("queries"), "floors").join(buckets.drop("floors"), "key")
    found = materialize(_merge(_compare(pairs, wide), wide), "found")

    # queries that met too few candidates see every row of their dimension
    total = least.groupBy(F.length("vector").alias("bytes")).agg(F.sum(F.size("ids")).alias("there"))
    sizes = found.join(least.select("class", F.size("ids").alias("c")), "class").groupBy("query").agg(F.sum("c").alias("c"))
    short = (ask.withColumn("bytes", F.length("vector")).join(total, "bytes").join(sizes, F.col("class") == F.col("query"), "left")
             .where(F.coalesce("c", F.lit(0)) < F.least(F.col("there"), F.lit(wide))).select("bytes", "class", "vector"))
    short = materialize(short, "short")
    if not short.isEmpty():
        whole = _blocks(least.select(F.length("vector").cast("long").alias("key"), "class", "vector"), "class")
        few = _blocks(short.select(F.col("bytes").cast("long").alias("key"), "class", "vector"), "class")
        pairs = few.select("key", F.col("ids").alias("qids"), F.col("vectors").alias("queries"), "floors").join(whole.drop("floors"), "key")
        found = materialize(_merge(found.unionByName(_compare(pairs, wide)), wide), "found")

    # classes become ids again, each query without its own
    ids = found.join(least.select("class", "ids"), "class").select("query", "score", F.explode("ids").alias("vec_id"))
    names = asked.join(ask, "vector").select(F.col("vec_id").alias("query_id"), F.col("class").alias("query"))
    top = ids.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")))
    top = materialize(top.where(F.col("r") <= wide).drop("r"), "top")
    order = Window.partitionBy("query", "query_id").orderBy(F.col("score").desc(), "vec_id")
    return (names.join(top, "query").where("vec_id != query_id").withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def _norm(stored: DataFrame) -> float | None:
    """The largest norm."""
    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, m in _matrices(batch.column("vector")) if batch.num_rows else ():
                big = np.abs(m).max()
                yield pa.RecordBatch.from_pydict({"norm": [float(big * np.sqrt(np.einsum("ij,ij->i", m / big, m / big).max()))]})
    return stored.mapInArrow(norms, "norm double").agg(F.max("norm")).first()[0]


def _fit(spark: SparkSession, least: DataFrame, sample: list[bytes], n: int, norm: float, k: int, target: float
         ) -> tuple[tuple[int, float, int, float], np.ndarray]:
    """(the setting for these rows from the sample queries' true neighbours, a sample of rows)."""
    dims = sorted({len(v) for v in sample}, key=lambda d: -sum(len(v) == d for v in sample))
    if not dims:
        return (SETTINGS[0][0], SETTINGS[0][1], 1, 1.0), np.zeros((0, 1))
    sample = [v for v in sample if len(v) == dims[0]]  # most of them; other dimensions follow the same setting
    q = np.frombuffer(b"".join(sample), dtype="<f8").reshape(len(sample), -1)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, m in _matrices(batch.column("vector")) if batch.num_rows else ():
                if m.shape[1] == q.shape[1]:
                    a, b, s = best_of(q, m, k + 1)
                    own = batch.take(pa.array(at[b]))
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(s), own.column("class"), own.column("vector")],
                                                     ["query", "score", "class", "vector"])

    with batch_rows(spark, 5000):
        best = _merge(least.select("class", "vector").mapInArrow(exact, "query long, score double, class long, vector binary"), k + 1).collect()
    near = [[r["vector"] for r in best if r["query"] == i and bytes(r["vector"]) != v] for i, v in enumerate(sample)]
    share = min(1.0, SAMPLE_ROWS / max(1, n))
    picked = least.where((F.length("vector") == len(sample[0])) & (F.pmod(F.xxhash64("vector", F.lit(7)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1))
    some = [r["vector"] for r in picked.select("vector").limit(2 * SAMPLE_ROWS).collect()]
    matrix = lambda vs: np.frombuffer(b"".join(bytes(v) for v in vs), dtype="<f8").reshape(len(vs), -1)
    seen = matrix(some) if some else np.zeros((0, q.shape[1]))
    return _choose(_as_query(q), [_on_sphere(matrix(x), norm) if x else np.zeros((0, q.shape[1] + 1)) for x in near],
                   _on_sphere(seen if some else q, norm), n, target), seen


def _floors(q: np.ndarray, seen: np.ndarray, wide: int) -> np.ndarray:
    """A score that ``wide`` rows of the sample reach: nothing below is among the best ``wide``."""
    if seen.shape[1] != q.shape[1] or len(seen) < wide:
        return np.full(len(q), -np.inf)
    s = q @ seen.T
    floor = np.partition(s, s.shape[1] - wide, axis=1)[:, s.shape[1] - wide]
    floor = floor - 1e-12 * np.abs(q).max(axis=1) * np.abs(seen).max() * q.shape[1]
    return np.where(np.isfinite(floor), floor, -np.inf)


def _compare(pairs: DataFrame, wide: int) -> DataFrame:
    """query, class, score: the ``wide`` best of each pair of blocks, merged within a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def shrink() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            a, b, s = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((b, -s, a))
            a, b, s = a[order], b[order], s[order]
            new = np.ones(len(a), dtype=bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (s[1:] != s[:-1])
            a, b, s = a[new], b[new], s[new]
            start = np.searchsorted(a, a)
            keep = np.arange(len(a)) - start < wide
            return a[keep], b[keep], s[keep]

        size = 0
        for batch in batches:
            for qids, queries, floors, ids, vectors in zip(*(batch.column(c).to_pylist() for c in ("qids", "queries", "floors", "ids", "vectors")), strict=True):
                q = np.frombuffer(queries, dtype="<f8").reshape(len(qids), -1)
                v = np.frombuffer(vectors, dtype="<f8").reshape(len(ids), -1)
                if q.shape[1] != v.shape[1]:
                    continue  # keys of two dimensions may agree by chance
                a, b, s = best_of(q, v, wide)
                up = ~(s < np.asarray(floors)[a])
                a, b, s = a[up], b[up], s[up]
                held.append((np.asarray(qids)[a], np.asarray(ids)[b], s))
                size += len(a)
                if size > 2_000_000:
                    held[:] = [shrink()]
                    size = len(held[0][0])
                    if size > 1_000_000:  # many queries: hand them on
                        yield _scores(*held.pop())
                        size = 0
        if held:
            yield _scores(*shrink())

    with batch_rows(pairs.sparkSession, 16):
        return materialize(pairs.select("qids", "queries", "floors", "ids", "vectors").mapInArrow(run, "query long, class long, score double"), "scores")


def _scores(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s)], ["query", "class", "score"])


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every row of ``embeddings`` whose id 20 divides, among all rows."""
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows.where(F.col("vec_id") % QUERY_STEP == 0), rows)
