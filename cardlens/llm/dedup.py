"""Near-duplicate documents by circulant MinHash, banding and exact verification.

Two permutations of a universe of 2**32 values make the whole signature: the first
scatters the shingles, the second is applied at every circular shift of its input,
so coordinate k is min over the set of pi((sigma(x) - k) mod 2**32). Documents
with equal shingle sets fall into one class (combined map-side, so a group of
copies of any size is one row per task); only class representatives are banded.

A bucket (equal band) of any size is handled without listing its pairs: each
document is verified against one hub, the member with the largest sum of bucket
sizes over its bands. After the components of these links, buckets whose members
are still in more than one component are finished: members outside the
bucket's largest component are compared with all its members, block by block: first on the
low bytes of the signatures, which drops pairs with under ``LEAST_MATCHES`` equal bytes
(an estimate: it loses a pair at similarity 0.75 with odds of 1.6e-7 if coordinates are
independent, below the banding's 5e-6), then those left on their full shingle sets. Blocks are split by a hash
and bounded in members and shingles; a comparison of two blocks returns one row per
member, or one link per document and component, at most.

A set or a bucket may hold a third of all documents. What is aggregated per set or
bucket is therefore written before it is joined back: the join then reads plain
shuffles, whose hot partition AQE splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardlens.llm._graph import components
from cardlens.llm._text import U64, mix, shingle_sets
from cardlens.llm._util import batch_rows, drop, materialize, prepare, table

SHINGLE = 5          # words of a shingle
BANDS, ROWS = 32, 4  # 1 - (1 - 0.75**4)**32 = 0.999995 of the links at the threshold share a band
PERCENT = 75         # 100 * intersection >= PERCENT * union
BLOCK = 256          # members of a comparison block
BLOCK_SHINGLES = 200_000  # and their shingles, about
# Matching low bytes (of 128) below which a pair is not compared on its sets: 5.3
# standard deviations under the mean at similarity 0.75.
LEAST_MATCHES = 70

_SHIFTS = np.arange(BANDS * ROWS, dtype=np.uint32)[:, None]


def _signature(s: np.ndarray) -> np.ndarray:
    """All coordinates of the circulant signature of one set of 64-bit hashes."""
    sigma = (mix(s ^ U64(0x5851F42D4C957F2D)) >> U64(32)).astype(np.uint32)
    out = np.full(len(_SHIFTS), 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(sigma), 512):
        x = sigma[i:i + 512][None, :] - _SHIFTS
        t = x >> np.uint32(16)
        x ^= t
        x *= np.uint32(0x85EBCA6B)
        np.right_shift(x, np.uint32(13), out=t)
        x ^= t
        x *= np.uint32(0xC2B2AE35)
        np.minimum(out, x.min(axis=1), out=out)
    return out


def _band_keys(sig: np.ndarray) -> np.ndarray:
    v = sig.reshape(BANDS, ROWS).astype(np.uint64)
    acc = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        acc = mix(acc * U64(0x9E3779B97F4A7C15) + v[:, r])
    return acc.astype(np.int64)


_FEATURES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()),
    T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()),
    T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("low", T.BinaryType())])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, d1, d2, bands, low = [], [], [], [], []
        for s in shingle_sets(batch.column("text"), SHINGLE):
            n.append(len(s))
            if len(s):
                sig = _signature(s)
                d1.append(int(mix(s).sum().astype(np.int64)))
                d2.append(int(np.bitwise_xor.reduce(mix(s + U64(0x632BE59BD9B4E019))).astype(np.int64)))
                bands.append(_band_keys(sig))
                low.append(sig.astype(np.uint8).tobytes())
            else:
                d1.append(None), d2.append(None), bands.append(None), low.append(None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
             pa.array(bands, pa.list_(pa.int64())), pa.array(low, pa.binary())],
            names=[f.name for f in _FEATURES])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the pairs whose full shingle sets reach the threshold."""
    for batch in batches:
        keep = np.zeros(batch.num_rows, dtype=bool)
        # a hub's text repeats over consecutive rows of a sorted join
        hub = batch.column("hub_text").dictionary_encode()
        hubs = list(shingle_sets(hub.dictionary, SHINGLE))
        at = hub.indices.fill_null(-1).to_numpy()
        for i, s in enumerate(shingle_sets(batch.column("text"), SHINGLE)):
            h = hubs[at[i]] if at[i] >= 0 else s[:0]
            both = len(np.intersect1d(s, h, assume_unique=True))
            keep[i] = both > 0 and 100 * both >= PERCENT * (len(s) + len(h) - both)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a hub, b) whose documents are near-duplicates.

    Two sort-merge joins attach the texts, the hub's last, so that AQE splits a
    hub with very many partners.
    """
    left = texts.select(F.col("doc_id").alias("b"), "text")
    right = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("hub_text"))
    return (pairs.join(left, "b").join(right, "a").select("a", "b", "text", "hub_text")
            .mapInArrow(_verify, "a long, b long"))


def _near_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of two blocks with a partner in another component that their signatures
    do not rule out."""
    for batch in batches:
        for key, rest, members in zip(batch.column("key"), batch.column("rest"), batch.column("members")):
            x, y = rest.as_py(), members.as_py()
            low = np.frombuffer(b"".join(m["low"] for m in y), dtype=np.uint8).reshape(len(y), -1)
            doc, comp = np.array([m["doc"] for m in y]), np.array([m["comp"] for m in y])
            found, near = [], np.zeros(len(y), dtype=bool)
            for m in x:
                hit = (comp != m["comp"]) & ((low == np.frombuffer(m["low"], dtype=np.uint8)).sum(axis=1) >= LEAST_MATCHES)
                if hit.any():
                    found.append(m["doc"])
                    near |= hit
            found = np.unique(np.concatenate((np.array(found, dtype=np.int64), doc[near])))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), key.as_py())), pa.array(found)], names=["key", "doc"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [x.tobytes() for x in shingle_sets(batch.column("text"), SHINGLE)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], names=["doc", "shingles"])


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between two blocks across components: for each document of the first, the
    least partner in each other component."""
    for batch in batches:
        for rest, members in zip(batch.column("rest"), batch.column("members")):
            x, y = rest.as_py(), members.as_py()
            sets = [np.frombuffer(m["shingles"], dtype=np.uint64) for m in y]
            size = np.array([len(v) for v in sets])
            every = np.concatenate(sets)
            by = np.argsort(every)
            every, owner = every[by], np.repeat(np.arange(len(y)), size)[by]
            doc, comp = np.array([m["doc"] for m in y]), np.array([m["comp"] for m in y])
            a, b = [], []
            for m in x:
                mine = np.frombuffer(m["shingles"], dtype=np.uint64)
                lo = np.searchsorted(every, mine)
                n = np.searchsorted(every, mine, side="right") - lo
                at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                both = np.bincount(owner[at], minlength=len(y))
                hit = np.flatnonzero((100 * both >= PERCENT * (len(mine) + size - both)) & (comp != m["comp"]))
                for c in np.unique(comp[hit]):
                    a.append(m["doc"])
                    b.append(int(doc[hit][comp[hit] == c].min()))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _compared(open_: DataFrame, what: str, compare, schema: str) -> DataFrame:
    """The distinct results of comparing the members outside their bucket's main component
    with all members, block by block; ``what`` is the column that is compared."""
    packed = F.collect_list(F.struct("doc", "comp", what))
    members = open_.groupBy("key", "block").agg(packed.alias("members"))
    rest = open_.where("comp != main").groupBy("key", F.col("block").alias("rest_block")).agg(packed.alias("rest"))
    with batch_rows(open_.sparkSession, 8):  # a row holds two blocks
        return materialize(rest.join(members, "key").select("key", "rest", "members").mapInArrow(
            compare, schema).distinct(), "compared")


def _rest_links(buckets: DataFrame, comps: DataFrame, low: DataFrame, texts: DataFrame) -> DataFrame:
    """Links of buckets that still hold several components."""
    member = buckets.join(comps.select(F.col("node").alias("doc"), "component"), "doc", "left").select(
        "key", "doc", "parts", F.coalesce("component", "doc").alias("comp"))
    sizes = member.groupBy("key", "comp").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("key").agg(F.count("*").alias("kinds"), F.max_by("comp", F.struct("n", "comp")).alias("main")).where("kinds > 1")
    mixed = materialize(mixed.select("key", "main"), "mixed")
    block = F.pmod(F.xxhash64("doc"), "parts").alias("block")
    open_ = materialize(member.join(mixed, "key").join(low.select(F.col("doc_id").alias("doc"), "low"), "doc").select(
        "key", "doc", "comp", "main", "low", block), "open")
    near = _compared(open_, "low", _near_members, "key long, doc long")
    left = materialize(open_.drop("low").join(near, ["key", "doc"], "left_semi"), "left")
    sets = texts.join(left.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(
        _sets, "doc long, shingles binary")
    full = materialize(left.join(sets, "doc"), "sets")
    links = _compared(full, "shingles", _block_links, "a long, b long")
    for done in (mixed, open_, near, left, full):
        drop(done)
    return links


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read. Null and
    empty texts have an empty set, are linked with nothing and kept. Rows without
    an id are kept, with a null component. Rows that repeat an id are one node of
    the graph with the links of each of their texts. An empty table gives none.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    feats = materialize(docs.mapInArrow(_features, _FEATURES), "features")
    real = feats.where("n_shingles > 0 and doc_id is not null")
    same = ["d1", "d2", "n_shingles"]
    classes = materialize(real.groupBy(same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")), "classes")
    copies = materialize(real.select("doc_id", *same).join(classes.where("rows > 1"), same)
                         .select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).where("a != b"), "copies")
    # copies of another document leave the banding; a row that repeats an id but is no copy stays
    reps = materialize(real.join(classes.select(F.col("rep").alias("doc_id"), *same), ["doc_id", *same], "left_semi")
                       .select("doc_id", "n_shingles", "bands", "low"), "reps")
    keyed = reps.select(F.explode("bands").alias("key"), F.col("doc_id").alias("doc"), "n_shingles")
    # a row that repeats an id with other texts counts its buckets once
    keyed = keyed.groupBy("key", "doc").agg(F.max("n_shingles").alias("n"))
    full = keyed.groupBy("key").agg(F.count("*").alias("size"), F.ceil(F.greatest(
        F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).alias("parts")).where("size > 1")
    full = materialize(full, "full")
    buckets = materialize(keyed.select("key", "doc").join(full, "key"), "buckets")
    score = buckets.groupBy("doc").agg(F.sum("size").alias("score"))
    hubs = (buckets.join(score, "doc").groupBy("key")
            .agg(F.max_by("doc", F.struct("score", -F.col("doc"))).alias("hub"), F.max("score").alias("score")))
    hubs = materialize(hubs, "hubs")
    star = (buckets.join(hubs, "key").where("hub != doc").groupBy("doc")
            .agg(F.max_by("hub", F.struct("score", -F.col("hub"))).alias("hub"))
            .select(F.col("hub").alias("a"), F.col("doc").alias("b")))
    texts = materialize(docs.join(buckets.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi"), "texts")
    links = materialize(_linked(star, texts), "links")
    more = _rest_links(buckets, components(links), reps.select("doc_id", "low"), texts)
    comps = components(links.unionByName(more).unionByName(copies))
    for done in (classes, full, hubs, reps, buckets, texts):
        drop(done)
    return (feats.select("doc_id", "n_shingles").join(comps, F.col("doc_id") == F.col("node"), "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups over the whole ``documents`` table."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: keep one row of each near-duplicate group.

    Rows are told apart even where they share an id or have none: each of these becomes
    a node of its own, so equal texts without an id or under one id are one group of
    which one row stays, and a row goes for its own text only. A row whose id is its own
    stays before one whose id is not. Null and empty texts are linked with nothing and stay.
    """
    prepare(spark)
    ids = docs.select(F.col("doc_id").cast("long").alias("id"))
    again = materialize(ids.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id is null").select("id"), "again")
    if again.isEmpty():
        gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
        return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    # a new id for each such row, out of the way of the others
    low, high = ids.agg(F.min("id"), F.max("id")).first()
    room = 1 << 61
    base = 0 if high is None else high + 1 if high < room else low - room if low >= -room else None
    own = F.col("doc_id").cast("long")
    rest = docs.join(again, own.eqNullSafe(F.col("id")), "left_anti") if base is not None else docs.where("false")
    odd = docs.join(again, own.eqNullSafe(F.col("id")), "left_semi") if base is not None else docs
    node = next(f"node{k}" for k in range(len(docs.columns) + 1) if f"node{k}" not in docs.columns)
    odd = materialize(odd.withColumn(node, F.monotonically_increasing_id() + F.lit(base or 0)), "odd")
    nodes = rest.select(own.alias("doc_id"), "text").unionByName(odd.select(F.col(node).alias("doc_id"), "text"))
    gone = materialize(near_duplicates(nodes).where("not kept").select(F.col("doc_id").alias("gone")), "gone")
    return (rest.join(gone, own == F.col("gone"), "left_anti").select(docs.columns)
            .unionByName(odd.join(gone, F.col(node) == F.col("gone"), "left_anti").select(docs.columns)))


# Words of every text, lower-cased in A-Z only; shingles as texts joined by blanks.
_SQL_SHINGLES = """
docs AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
toks AS (SELECT doc_id, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM docs),
grams AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]
                             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM toks)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes sa ON sa.doc_id = a JOIN sizes sb ON sb.doc_id = b
          WHERE 100 * common >= 75 * (sa.n + sb.n - common)),
arcs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
"""

ORACLE = "WITH RECURSIVE" + _SQL_SHINGLES + """
reach AS (SELECT doc_id AS node, doc_id AS far FROM sizes
          UNION SELECT reach.node, arcs.b FROM reach JOIN arcs ON arcs.a = reach.far),
least AS (SELECT node, min(far) AS c FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(l.c, d.doc_id) AS component_id,
       coalesce(l.c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.node = d.doc_id
"""
