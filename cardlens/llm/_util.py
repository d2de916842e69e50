"""Session settings, scratch tables and small column helpers of the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardlens.session import ensure_checkpoint_dir, remove_dir, shared_dir

_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot key's join partition even when the next step is keyed alike
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # whole texts travel to Python in small batches, whatever their length
    "spark.sql.execution.arrow.maxRecordsPerBatch": "200",
}


def prepare(spark: SparkSession) -> None:
    """Settings every operator of this folder relies on, and the shared folder."""
    for k, v in _CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Rows of an Arrow batch for what runs inside: few of large rows, many of small ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, _CONF[key])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return shared_dir(spark, name)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation. The
    files stay until ``drop`` or ``session.clear_shared``, because the frames derived
    from them are lazy.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cardlens_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the files of a materialised table that no later frame reads."""
    path = getattr(df, "_cardlens_path", None)
    if path:
        remove_dir(df.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(col: str = "doc_id") -> Column:
    """crc32 of the id as text (unsigned); a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
