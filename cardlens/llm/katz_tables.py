"""A Katz backoff model as stored tables: trained once, joined to any texts.

Order by order from 1 to the model's, ``grams_k`` holds the log10 probability of every
seen n-gram of k words (Good-Turing discounted count over the count of its context plus
one) and ``alphas_k`` the log10 backoff weight of every context of k words, which shares
exactly what its seen words leave among the unseen ones. The tables are written below one
folder, partitioned by a hash of their key, with the model's totals beside them.

A text's tokens are n-grams of the highest order, equal ones of a text counted. They are
joined to the highest table; those not found go on with the weight of their context
(one, if it was never seen) to the next lower order, down to single words and the
unknown word. Every join is on the whole n-gram, so a frequent context is spread over
its words, and a frequent n-gram is one row on the table's side, which lets AQE split
the texts' side. Nothing of the tables passes the driver but totals.

Words are lower-cased in A-Z; every text ends in one end token, and the end stands
before the first word, as often as the order needs. An n-gram is kept as the 64-bit hashes of its words, so
two words with one hash would be one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardlens.llm._util import materialize, prepare, scratch_path, shuffle_partitions
from cardlens.llm.katz import _END, CUT, _tokens, discounts

W = ["w1", "w2", "w3", "w4", "w5"]


@dataclass
class Model:
    """A stored model: its folder, order and totals."""

    path: str
    order: int
    tokens: int
    distinct: int
    unknown: float  # log10 P of the unknown word

    def table(self, spark: SparkSession, name: str, k: int) -> DataFrame:
        value = "log_p double" if name == "grams" else "log_alpha double"
        return spark.read.schema(", ".join(f"{w} long" for w in W[:k]) + ", " + value).parquet(f"{self.path}/{name}_{k}")


def _grams(order: int):
    """A scan of (rid, text) that returns each text's n-grams of ``order`` with their number."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = batch.column("rid").to_numpy()
            for i, _, tok, row in _tokens(batch.column("text")):
                cols, prev = [tok], tok
                first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                for _ in range(order - 1):
                    prev = np.append(_END, prev[:-1])
                    prev[first] = _END
                    cols.append(prev)
                grams = np.stack([row.astype(np.uint64), *cols[::-1]], axis=1)
                grams, n = np.unique(grams, axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid[i + grams[:, 0].astype(np.int64)]), *(pa.array(grams[:, 1 + k].astype(np.int64)) for k in range(order)), pa.array(n)],
                    names=["rid", *W[:order], "n"])
    return scan


def _token_grams(docs: DataFrame, order: int) -> DataFrame:
    schema = "rid long, " + ", ".join(f"{w} long" for w in W[:order]) + ", n long"
    return docs.mapInArrow(_grams(order), schema)


def _ratio(c: Column, d: np.ndarray) -> Column:
    """Discount ratio of a count."""
    out = F.lit(1.0)
    for r, x in enumerate(d, 1):
        out = F.when(c == r, float(x)).otherwise(out)
    return out


def train(docs: DataFrame, order: int = 3, path: str | None = None) -> Model:
    """Count all texts of ``docs`` and store the model; only ``text`` is read.

    A null or empty text is its end alone. Without texts the unknown word has all
    probability. Every table is written before the next order reads it, so a lost
    executor costs a re-read.
    """
    if not 1 <= order <= len(W):
        raise ValueError(f"orders 1 to {len(W)}")
    spark = docs.sparkSession
    prepare(spark)
    path = path or scratch_path(spark, "katz")
    n_parts = shuffle_partitions(spark)
    texts = docs.select(F.monotonically_increasing_id().alias("rid"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    top = _token_grams(texts, order).groupBy(*W[:order]).agg(F.sum("n").alias("c"))
    counts = {order: materialize(top, "counts")}
    for k in range(order - 1, 0, -1):
        # an n-gram's count is that of its last words after any first word
        lower = counts[k + 1].groupBy(*[F.col(W[i + 1]).alias(W[i]) for i in range(k)]).agg(F.sum("c").alias("c"))
        counts[k] = materialize(lower, "counts")
    tokens = distinct = 0
    unknown = 0.0
    for k in range(1, order + 1):
        keys = W[:k]
        total = counts[k].agg(F.sum("c").alias("n"), F.count("*").alias("v"),
                              *[F.count_if(F.col("c") == r).alias(f"n{r}") for r in range(1, CUT + 2)]).first()
        d = discounts(np.array([total[f"n{r}"] for r in range(1, CUT + 2)], dtype=np.float64))
        discounted = counts[k].withColumn("dc", F.col("c") * _ratio(F.col("c"), d))
        if k == 1:
            tokens, distinct = int(total["n"] or 0), int(total["v"])
            seen = discounted.agg(F.sum("dc")).first()[0] or 0.0
            unknown = float(np.log10(1 - seen / (tokens + 1.0)))
            grams = discounted.select("w1", F.log10(F.col("dc") / F.lit(tokens + 1.0)).alias("log_p"))
        else:
            context = W[:k - 1]
            # the lower-order probability of each seen word, to be taken from its context's unseen ones
            low = spark.read.parquet(f"{path}/grams_{k - 1}").select(
                *[F.col(W[i]).alias(f"x{i + 1}") for i in range(k - 1)], F.col("log_p").alias("low"))
            same = [F.col(W[i + 1]) == F.col(f"x{i + 1}") for i in range(k - 1)]
            on = same[0]
            for s in same[1:]:
                on = on & s
            j = discounted.join(low, on)  # every seen n-gram's shorter one is seen
            stats = materialize(j.groupBy(*context).agg(F.sum("c").alias("total"), F.sum("dc").alias("mass"),
                                                        F.sum(F.pow(F.lit(10.0), "low")).alias("covered")), "contexts")
            alphas = stats.select(*context, (F.log10(1 - F.col("mass") / (F.col("total") + 1.0))
                                             - F.log10(F.greatest(1 - F.col("covered"), F.lit(1e-12)))).alias("log_alpha"))
            alphas.repartition(n_parts, *context).write.parquet(f"{path}/alphas_{k - 1}")
            grams = discounted.join(stats.select(*context, "total"), context).select(
                *keys, F.log10(F.col("dc") / (F.col("total") + 1.0)).alias("log_p"))
        grams.repartition(n_parts, *keys).write.parquet(f"{path}/grams_{k}")
    info = {"order": order, "tokens": tokens, "distinct": distinct, "unknown": unknown}
    spark.createDataFrame([(json.dumps(info),)], "value string").coalesce(1).write.text(f"{path}/model")
    return Model(path, order, tokens, distinct, unknown)


def load(spark: SparkSession, path: str) -> Model:
    """A model that ``train`` has stored."""
    return Model(path=path, **json.loads(spark.read.text(f"{path}/model").first()["value"]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, score (log10 P of the text) of every row under a stored model.

    Only ``doc_id`` and ``text`` are read. A null or empty text is its end alone; null
    and repeated ids come back as they are, each row scored alone; an empty table gives
    none.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = materialize(docs, "texts")  # the numbers of the rows stand
    open_ = _token_grams(docs.select("rid", "text"), model.order).withColumn("a", F.lit(0.0))
    done = None
    for k in range(model.order, 0, -1):
        keys = W[:k]
        j = open_.join(model.table(spark, "grams", k), keys, "left")
        if k == 1:
            j = j.withColumn("log_p", F.coalesce("log_p", F.lit(model.unknown)))
            closed = j
        else:
            j = materialize(j, "open")
            closed = j.where("log_p is not null")
            lost = j.where("log_p is null").join(model.table(spark, "alphas", k - 1), keys[:-1], "left")
            open_ = lost.select("rid", *[F.col(W[i + 1]).alias(W[i]) for i in range(k - 1)], "n",
                                (F.col("a") + F.coalesce("log_alpha", F.lit(0.0))).alias("a"))
        part = closed.select("rid", "n", (F.col("n") * (F.col("a") + F.col("log_p"))).alias("s"))
        done = part if done is None else done.unionByName(part)
    sums = done.groupBy("rid").agg(F.sum("n").alias("n_tokens"), F.sum("s").alias("score"))
    return docs.select("rid", "doc_id").join(sums, "rid").select("doc_id", "n_tokens", "score")
