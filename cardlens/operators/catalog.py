"""Catalogue, profile, copy and metadata-card jobs.

Row counts of all tables are one job: the union of the tables' column-free
scans (parquet reads only footers for them) is counted per table name, with a
zero row per name so an empty table still reports 0. Tables are discovered in the
data folder, not listed here. Schemas are read from the tables' metadata, never from collected rows.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardlens.params import Params
from cardlens.session import remove_dir, shared_dir
from cardlens.sources.standins import meta_tables
from cardlens.sources.tables import chosen_tables, discover_tables, list_tables, read_table, register_views


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def count_rows(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows) for named frames in one aggregation: partial counts
    per scan task, one small shuffle of per-task counts, and a zero row per
    name so an empty frame still reports 0."""
    if not frames:
        return spark.range(0).select(F.lit(None).cast("string").alias("table_name"),
                                     F.lit(0).cast("bigint").alias("n_rows"))
    zero = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(t).alias("table_name"), F.lit(0).alias("w")) for t in frames])))
    scans = [df.select(F.lit(t).alias("table_name"), F.lit(1).alias("w")) for t, df in frames.items()]
    return (_union([zero] + scans).groupBy("table_name")
            .agg(F.sum("w").cast("bigint").alias("n_rows")))


def profile_views(spark: SparkSession, names: list[str]) -> DataFrame:
    """``count(*)`` of every catalogue table."""
    return count_rows(spark, {t: spark.table(t) for t in names})


def table_profile(spark: SparkSession, sf_dir: str, p: Params,
                  include: tuple[str, ...] | None = None) -> DataFrame:
    """P1 + S1/S2: register the folder's tables (only the included ones when
    ``include`` is given) and count every one of them."""
    return profile_views(spark, register_views(spark, sf_dir, include))


def largest_of(prof: DataFrame) -> DataFrame:
    """P2 over a (table_name, n_rows) profile."""
    prof = prof.where(F.col("n_rows") > 0).withColumn("fallback", F.lit(0))
    none = prof.sparkSession.range(1).select(
        F.lit(None).cast("string").alias("table_name"), F.lit(0).cast("bigint").alias("n_rows"),
        F.lit(1).alias("fallback"))
    return (prof.unionByName(none)
                .orderBy("fallback", F.col("n_rows").desc(), "table_name")
                .limit(1).select("table_name", "n_rows"))


def largest_table(spark: SparkSession, sf_dir: str, p: Params) -> DataFrame:
    """The table with most rows; ties go to the first name; a catalogue with
    no non-empty table gives (NULL, 0) as the reference's strict ``>`` does."""
    return largest_of(table_profile(spark, sf_dir, p))


SAMPLE_ROWS = 3     # first rows of a table on its card
SAMPLE_CHARS = 60   # display cut of a value (C13)
Picker = Callable[[dict[str, DataFrame], int], dict[str, DataFrame]]  # n rows of each table, numbered by _nth


def column(name: str) -> Column:
    """A column by its whole name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def value_text(c: Column, kind: T.DataType) -> Column:
    """A value as text that is the same in other engines; cut for display."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        c = F.coalesce(c.cast("double").try_cast("decimal(38,6)").cast("string"), c.cast("string"))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    elif isinstance(kind, T.ArrayType):
        c = F.array_join(F.transform(F.slice(c, 1, 4), lambda x: value_text(x, kind.elementType)), ",")
    elif isinstance(kind, T.BinaryType):
        c = F.hex(F.substring(c, 1, SAMPLE_CHARS))
    else:  # maps and structs too have a text form
        c = c.cast("string")
    return F.coalesce(F.substring(c, 1, SAMPLE_CHARS), F.lit("NULL"))


def first_files(df: DataFrame, n: int) -> list[tuple[str, int]]:
    """(file, rows before it) of the first files, by name, that hold ``n`` rows together.

    Only the footers of these files are read, on the driver; no job runs.
    """
    spark = df.sparkSession
    conf = spark._jsc.hadoopConfiguration()
    parquet = spark._jvm.org.apache.parquet.hadoop
    out, before = [], 0
    for file in sorted(df.inputFiles()):
        if before >= n:
            break
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(file))
        reader = parquet.ParquetFileReader.open(parquet.util.HadoopInputFile.fromPath(path, conf))
        rows = reader.getRecordCount()
        reader.close()
        if rows:
            out.append((file, before))
            before += rows
    return out


def first_rows(frames: dict[str, DataFrame], n: int) -> dict[str, DataFrame]:
    """The first ``n`` rows of each parquet table by their place, with the place (from 0)
    as ``_nth``: rows of the first file by name, then of the next one if it is short.

    A row is picked by its file and row index, so nothing else of the table is scanned
    and any type of column will do. An empty table gives no rows. Building runs no job.
    """
    out = {}
    for t, df in frames.items():
        parts = []
        for file, before in first_files(df, n):
            # the file is picked when the scan lists its files, so no other is opened
            # (a local file's name has one slash or three there)
            here = df.where(F.col("_metadata.file_path").isin(file, re.sub("^file:///", "file:/", file))
                            & (F.col("_metadata.row_index") < n - before))
            parts.append(here.select("*", (F.col("_metadata.row_index") + before).cast("int").alias("_nth")))
        out[t] = _union(parts) if parts else df.limit(0).withColumn("_nth", F.lit(0))
    return out


def order_form(c: Column, kind: T.DataType) -> Column:
    """A value in a form that can be sorted; only maps and variants have none of their own."""
    return sorted_form(c, kind) if re.search("map<|variant", kind.simpleString()) else c


def least_rows(frames: dict[str, DataFrame], n: int) -> dict[str, DataFrame]:
    """The least ``n`` rows of each table in the order of all its columns, nulls first,
    with the place (from 0) as ``_nth``; of any frame, not only of parquet files.

    Every table is scanned whole, once. A task keeps its own ``n`` least rows and only
    these are merged, so memory and shuffle do not grow with the table. Building runs no job.
    """
    out = {}
    for t, df in frames.items():
        keys = [order_form(column(f.name), f.dataType).asc_nulls_first() for f in df.schema.fields]
        least = df.orderBy(*keys).limit(n)
        out[t] = least.select("*", (F.row_number().over(Window.orderBy(*keys)) - 1).alias("_nth"))  # of n rows
    return out


def schema_card(spark: SparkSession, sf_dir: str, p: Params, n: int = SAMPLE_ROWS,
                include: tuple[str, ...] | None = None, pick: Picker = first_rows) -> DataFrame:
    """Table, ordinal, column, type and the column's values in the table's first ``n`` rows,
    by their place (``first_rows``) or by the order of all columns (``least_rows``).

    Every table of the folder has a line per column, an empty one without samples."""
    frames = {t: read_table(spark, sf_dir, t) for t in chosen_tables(spark, sf_dir, include)}
    return card_of(spark, frames, n, pick)


def whole_card(spark: SparkSession, sf_dir: str, p: Params) -> DataFrame:
    """P3 from whole tables: the card's values are those of the least rows by all columns."""
    return schema_card(spark, sf_dir, p, pick=least_rows)


def card_of(spark: SparkSession, frames: dict[str, DataFrame], n: int = SAMPLE_ROWS,
            pick: Picker = first_rows) -> DataFrame:
    """P3 over parquet tables by name."""
    cells = []
    for t, rows in pick(frames, n).items():
        columns = [F.struct(F.lit(i).alias("ordinal"), value_text(column(f.name), f.dataType).alias("v"))
                   for i, f in enumerate(frames[t].schema.fields, start=1)]
        cells.append(rows.select(F.lit(t).alias("table_name"), "_nth", F.inline(F.array(*columns))))
    names = spark.createDataFrame(
        [(t, i, f.name, f.dataType.simpleString()) for t, df in frames.items()
         for i, f in enumerate(df.schema.fields, start=1)],
        "table_name string, ordinal int, column_name string, data_type string")
    if not cells:
        return names.withColumn("samples", F.array().cast("array<string>"))
    samples = (_union(cells).groupBy("table_name", "ordinal")
               .agg(F.transform(F.array_sort(F.collect_list(F.struct("_nth", "v"))), lambda x: x["v"]).alias("samples")))
    return names.join(samples, ["table_name", "ordinal"], "left").select(
        "table_name", "ordinal", "column_name", "data_type",
        F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))


def schema_samples(spark: SparkSession, sf_dir: str, p: Params) -> DataFrame:
    """P3 samples: one row per column and sampled value of the whole card, by its place."""
    card = whole_card(spark, sf_dir, p)
    return card.select("table_name", "column_name", F.posexplode("samples").alias("place", "value"))


def schema_text(spark: SparkSession, sf_dir: str, p: Params, pick: Picker = first_rows) -> DataFrame:
    """The whole card as one text, a line per table: ``table(column type: a | b | c, ...)``.

    Its size is bounded by the schema: SAMPLE_ROWS values of SAMPLE_CHARS a column."""
    card = schema_card(spark, sf_dir, p, pick=pick)
    item = F.concat(F.col("column_name"), F.lit(" "), F.col("data_type"), F.lit(": "), F.array_join("samples", " | "))
    per_table = card.groupBy("table_name").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("ordinal", item.alias("item")))), lambda x: x["item"]), ", ").alias("items"))
    lines = per_table.select("table_name", F.concat("table_name", F.lit("("), "items", F.lit(")")).alias("line"))
    return lines.agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("table_name", "line"))), lambda x: x["line"]), "\n").alias("card"))


def register_meta_views(spark: SparkSession, sf_dir: str) -> list[str]:
    names = []
    for name, df in meta_tables(spark, sf_dir).items():
        df.createOrReplaceTempView(name)
        names.append(name)
    return names


def synonym_lines(spark: SparkSession, tables: list[str] | None = None) -> tuple[DataFrame | None, list[str]]:
    """P4 + P5 over catalogue tables named like ``%meta%`` (S3).

    A table that cannot be analysed, or not be read to its end, is skipped and
    reported; the rest are combined. Returns (lines, skipped). Dictionaries
    describe columns: reading each once more before it is used is cheap.
    """
    names = tables if tables is not None else list_tables(spark, "%meta%")
    frames, skipped = [], []
    for name in names:
        try:
            df = spark.table(name)
            cols = df.columns[:3]
            if len(cols) < 3:
                raise ValueError("needs code, name and synonyms columns")
            df = df.select(F.lit(name).alias("table_name"),
                           F.col(cols[0]).cast("string").alias("code"),
                           F.col(cols[1]).cast("string").alias("name"),
                           F.col(cols[2]).cast("string").alias("synonyms"))
            df.agg(F.count("code"), F.count("name"), F.count("synonyms")).collect()
            frames.append(df)
        except Exception:  # noqa: BLE001 - the reference prints and continues
            skipped.append(name)
    if not frames:
        return None, skipped
    lines = _union(frames).where(F.col("synonyms").isNotNull() & (F.length("synonyms") > 0))
    text = lambda c: F.coalesce(c, F.lit(""))  # noqa: E731 - a missing code or name leaves its place empty
    lines = lines.withColumn("line", F.concat(
        F.col("table_name"), F.lit(" "), text("name"), F.lit(" (Code: "), text("code"), F.lit("), Synonyms: "), F.col("synonyms")))
    return lines, skipped


def synonym_card(spark: SparkSession, sf_dir: str, p: Params) -> DataFrame:
    """One line per dictionary entry that has synonyms."""
    register_meta_views(spark, sf_dir)
    lines, _ = synonym_lines(spark)
    return lines


def synonym_card_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The card as one text, lines ordered by (table, code).

    Dictionary tables describe columns, so the card is bounded by the schema,
    not by data volume; it is the one-row side of the prompt job.
    """
    register_meta_views(spark, sf_dir)
    lines, _ = synonym_lines(spark)
    return lines.agg(F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("table_name", "code", "line"))),
                    lambda x: x["line"]), "\n").alias("synonyms"))


def sorted_form(c: Column, kind: T.DataType) -> Column:
    """A value in a form that can be hashed and is equal for equal values: maps become
    their entries by key, at any depth; what has no hash becomes its text."""
    if isinstance(kind, T.MapType):
        return F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(
            sorted_form(e["key"], kind.keyType).alias("key"), sorted_form(e["value"], kind.valueType).alias("value"))))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: sorted_form(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[sorted_form(c.getField(f.name), f.dataType).alias(f"f{i}")
                                                for i, f in enumerate(kind.fields)]))
    return c.cast("string") if isinstance(kind, (T.VariantType, T.DayTimeIntervalType, T.YearMonthIntervalType)) else c


def _digest(df: DataFrame) -> Column:
    """One value per column whatever the order of rows: sums of the values' hashes."""
    return F.array(*[F.coalesce(F.sum(F.xxhash64(sorted_form(column(f.name), f.dataType)).cast("decimal(20,0)")),
                                F.lit(0).cast("decimal(30,0)")).cast("string") for f in df.schema.fields])


def compare_copies(frames: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(table_name, n_rows, n_columns, equal) of pairs of a table and its copy: rows are
    counted in the copy; equal if counts, columns and the hash sums of every column agree."""
    sides = []
    for t, pair in frames.items():
        for side, df in enumerate(pair):
            sides.append(df.agg(F.count("*").alias("n"), _digest(df).alias("digest")).select(
                F.lit(t).alias("table_name"), F.lit(side).alias("side"), "n",
                F.concat(F.lit(",".join(df.columns)), F.lit(" "), F.col("n").cast("string"), F.lit(" "),
                         F.array_join("digest", ",")).alias("all")))
    widths = F.create_map(*[F.lit(x) for t, (_, copy) in frames.items() for x in (t, len(copy.columns))])
    return (_union(sides).groupBy("table_name").agg(
        F.max(F.when(F.col("side") == 1, F.col("n"))).alias("n_rows"), F.size(F.collect_set("all")).alias("kinds"))
        .select("table_name", "n_rows", F.element_at(widths, F.col("table_name")).alias("n_columns"),
                (F.col("kinds") == 1).alias("equal")))


MANIFEST = "current.json"


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def read_manifest(spark: SparkSession, target: str) -> dict[str, str]:
    """Table name -> folder of the current copy below ``target``; empty without one."""
    fs, jpath = _fs(spark, f"{target.rstrip('/')}/{MANIFEST}")
    if not fs.exists(jpath):
        return {}
    return json.loads("\n".join(r["value"] for r in spark.read.text(jpath.toString()).collect()))  # a name a table


def read_copy(spark: SparkSession, target: str, table: str) -> DataFrame:
    """A table of the current copy; the frame keeps reading it after a later swap."""
    return spark.read.parquet(f"{target.rstrip('/')}/{read_manifest(spark, target)[table]}")


def _swap(spark: SparkSession, target: str, manifest: dict[str, str]) -> None:
    """Put the manifest in place by one rename over the old one."""
    fs, at = _fs(spark, f"{target}/{MANIFEST}")
    jvm = spark._jvm
    staged = jvm.org.apache.hadoop.fs.Path(f"{target}/.{uuid.uuid4().hex}.json")
    out = fs.create(staged)
    out.write(bytearray(json.dumps(manifest), "utf-8"))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(staged.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(staged, at, options)


def replace_tables(spark: SparkSession, frames: dict[str, DataFrame], target: str) -> dict[str, DataFrame]:
    """Copy named frames into ``target``, replacing what it held as a whole.

    Every table is first written to a new folder of this copy. Only when all are there
    does one rename swap the manifest, so a reader sees the old tables or the new ones,
    never a mixture, and a copy that fails midway changes nothing. Folders of the copies
    before the last one are removed; the last one stays for frames still reading it.
    One partitioned read and write a table, one after another; no row passes the driver.
    """
    target = target.rstrip("/")
    old = read_manifest(spark, target)
    copy = f"copy-{uuid.uuid4().hex}"
    try:
        for t, df in frames.items():
            df.write.parquet(f"{target}/{copy}/{t}")
    except Exception:
        remove_dir(spark, f"{target}/{copy}")
        raise
    _swap(spark, target, {t: f"{copy}/{t}" for t in frames})
    keep = {copy, *(folder.split("/")[0] for folder in old.values())}
    fs, jpath = _fs(spark, target)
    for f in fs.listStatus(jpath):
        if f.getPath().getName().startswith("copy-") and f.getPath().getName() not in keep:
            fs.delete(f.getPath(), True)
    return {t: spark.read.schema(df.schema).parquet(f"{target}/{copy}/{t}") for t, df in frames.items()}


def table_copy(spark: SparkSession, sf_dir: str, p: Params, target: str | None = None) -> DataFrame:
    """S4 + S5: copy every table of the folder, replacing the target as a whole, and
    compare the copies with their sources, column by column.

    The target defaults to a new sub-folder of the shared folder.
    """
    frames = {t: read_table(spark, sf_dir, t) for t in discover_tables(spark, sf_dir)}
    copies = replace_tables(spark, frames, target or shared_dir(spark, "table_copy"))
    return compare_copies({t: (frames[t], copies[t]) for t in frames})


def table_copy_jdbc(df: DataFrame, url: str, table: str, properties: dict | None = None,
                    num_partitions: int | None = None) -> None:
    """JDBC variant of S5 (not exercised here: no database is reachable)."""
    w = df if num_partitions is None else df.repartition(num_partitions)
    w.write.mode("overwrite").jdbc(url, table, properties=properties or {})


# The statements of the named-statement job (S6, S7), one per
# demo question shape, in portable SQL over the test tables.
NAMED_SQL = {
    "card_breakdown": """SELECT o_custkey AS acct, p_brand AS card_name,
  CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS total_amount
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1997-07-01' AND DATE '1997-10-31'
GROUP BY o_custkey, p_brand""",
    "merchant_months": """SELECT o_custkey AS acct, substr(CAST(CAST(l_shipdate AS DATE) AS STRING), 1, 7) AS month,
  CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS total_amount
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1997-07-01' AND DATE '1997-09-30'
  AND lower(p_name) LIKE '%plate%'
GROUP BY o_custkey, substr(CAST(CAST(l_shipdate AS DATE) AS STRING), 1, 7)""",
    "signups_by_campaign": """SELECT TRY_CAST(substr(props, 7, length(props) - 7) AS BIGINT) AS cmp_id, COUNT(*) AS n_applications
FROM events WHERE event_type = 'signup'
GROUP BY TRY_CAST(substr(props, 7, length(props) - 7) AS BIGINT)""",
    "orders_by_status": """SELECT o_orderstatus AS status, COUNT(*) AS n_orders,
  CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS total
FROM orders GROUP BY o_orderstatus""",
}


def run_named_sql(spark: SparkSession, sf_dir: str, p: Params,
                  statements: dict[str, str] | None = None) -> DataFrame:
    """S6 + S7: run caller-supplied SQL over the registered views, in order,
    and tag each result row with the statement name (rows as JSON text)."""
    register_views(spark, sf_dir)
    stmts = statements or NAMED_SQL
    frames = [spark.sql(sql).select(F.lit(name).alias("query_name"),
                                    F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row_json"))
              for name, sql in stmts.items()]
    return _union(frames)
