"""Contiguous shards of nearly equal bytes by global prefix sums.

Documents are dealt out in the order of their id over range partitions. Only each
partition's totals (rows, bytes) are summed over the partitions; the running sum
inside a partition plus the total of all before it is the global prefix. The
prefix is cut at equal targets, so a shard is one contiguous run of the order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardlens.llm._util import materialize, prepare, shuffle_partitions, table

SHARDS = 24
OVERHEAD = 8  # bytes a document costs besides its text


def byte_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs``.

    Only ``doc_id`` and ``text`` are read. Order: id (null first), then size, CRC and
    the row's place in its input, so equal rows and a repeated id spread over
    partitions too. A document belongs to the shard in which its middle byte falls:
    no shard is off the equal share by more than one document at either end, and a
    document longer than a share leaves its neighbours empty. A null text is 0 bytes
    with CRC 0; an empty table gives no rows. The law is ``bytes``, so
    ``grown_shard`` is null.
    """
    spark = docs.sparkSession
    prepare(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("place"))
    order = ["doc_id", "size", "text_crc32", "place"]
    # written once: the partitions' limits come from a sample and must not move again
    dealt = materialize(sized.repartitionByRange(shuffle_partitions(spark), *order)
                        .withColumn("part", F.spark_partition_id()), "dealt")
    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    # one row a partition
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    starts = totals.select("part", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
                           F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"),
                           F.sum("bytes").over(whole).alias("total"))
    inside = Window.partitionBy("part").orderBy(*order)
    run = (dealt.withColumn("through", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
           .withColumn("nth", F.row_number().over(inside) - 1)
           .join(F.broadcast(starts), "part")
           .withColumn("middle2", 2 * (F.col("bytes_before") + F.col("through")) - F.col("size"))
           .withColumn("shard", F.least(F.floor(F.col("middle2").cast("decimal(38,0)") * shards
                                                / (2 * F.col("total")).cast("decimal(20,0)")).cast("int"),
                                        F.lit(shards - 1)))
           .withColumn("at", F.col("rows_before") + F.col("nth")))
    run = materialize(run.select("doc_id", "size", "text_crc32", "shard", "at"), "run")
    first = run.groupBy("shard").agg(F.min("at").alias("first"))  # one row a shard
    return run.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("at") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards of the whole ``documents`` table."""
    return byte_shards(table(spark, sf_dir, "documents"))


# CRC-32 of a text's bytes by its table; the bytes come from the hex form.
ORACLE = """
WITH RECURSIVE step AS (
  SELECT range AS k, range::BIGINT AS c, 0 AS n FROM range(256)
  UNION ALL SELECT k, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM step WHERE n < 8),
tab AS (SELECT list(c ORDER BY k) AS l FROM step WHERE n = 8),
texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sums AS (
  SELECT doc_id, (length(h) // 2 + 8)::BIGINT AS size,
         xor(list_reduce(list_prepend(4294967295::BIGINT,
               [('0x' || substr(h, 2 * i + 1, 2))::BIGINT FOR i IN range(length(h) // 2)]),
               lambda a, b: xor(a >> 8, l[xor(a & 255, b) + 1])), 4294967295)::BIGINT AS text_crc32
  FROM texts, tab),
run AS (SELECT *, sum(size) OVER (ORDER BY doc_id, size, text_crc32 ROWS UNBOUNDED PRECEDING) AS through,
               sum(size) OVER () AS total FROM sums),
cut AS (SELECT *, least(((2 * through - size) * 24) // (2 * total), 23)::INTEGER AS shard FROM run)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       (row_number() OVER (PARTITION BY shard ORDER BY doc_id, size, text_crc32) - 1)::BIGINT AS slot,
       NULL::INTEGER AS grown_shard
FROM cut
"""
