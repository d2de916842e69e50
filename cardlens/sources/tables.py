"""Parquet tables, the view registry and the catalogue."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# The tables of the test data.
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Full-table scan (S4); Catalyst prunes columns and pushes filters."""
    return spark.read.parquet(table_path(sf_dir, name))


def discover_tables(spark: SparkSession, sf_dir: str) -> list[str]:
    """Names of all parquet tables in a folder, listed through Hadoop's file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = [f.getPath().getName() for f in found]
    return sorted(n.removesuffix(".parquet") for n in names if n.endswith(".parquet"))


def chosen_tables(spark: SparkSession, sf_dir: str, include: tuple[str, ...] | list[str] | None = None) -> list[str]:
    """All tables of the folder, or the included ones (S2); an unknown name is an error."""
    names = discover_tables(spark, sf_dir)
    unknown = sorted(set(include or ()) - set(names))
    if unknown:
        raise ValueError(f"no table named {', '.join(unknown)} in {sf_dir}")
    return [n for n in names if include is None or n in include]


def register_views(spark: SparkSession, sf_dir: str,
                   include: tuple[str, ...] | list[str] | None = None) -> list[str]:
    """Register one temp view per table; ``include`` restricts the set."""
    names = chosen_tables(spark, sf_dir, include)
    for name in names:
        read_table(spark, sf_dir, name).createOrReplaceTempView(name)
    return names


def like(pattern: str, names: list[str]) -> list[str]:
    """The names matching a case-insensitive LIKE pattern (S3): only % and _ are special."""
    rx = re.compile("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern),
                    re.IGNORECASE | re.DOTALL)
    return [n for n in names if rx.fullmatch(n)]


def list_tables(spark: SparkSession, pattern: str | None = None) -> list[str]:
    """Catalogue listing (S1), optionally by a case-insensitive LIKE pattern (S3)."""
    names = sorted(t.name for t in spark.catalog.listTables())
    return names if pattern is None else like(pattern, names)


def read_jdbc(spark: SparkSession, url: str, table: str, *, partition_column: str | None = None,
              lower: int | None = None, upper: int | None = None, num_partitions: int | None = None,
              properties: dict | None = None) -> DataFrame:
    """S4 for database tables: a partitioned JDBC read (one query per range of
    ``partition_column``), so no single task pulls the whole table.

    Not exercised here: no database is reachable from this environment.
    """
    if partition_column is None:
        return spark.read.jdbc(url, table, properties=properties or {})
    return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower, upperBound=upper,
                           numPartitions=num_partitions or 8, properties=properties or {})
