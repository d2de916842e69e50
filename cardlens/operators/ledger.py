"""A batch of questions with a written status for each, resumed after a failure.

Below the batch's folder, ``results/<entry>`` holds a question's rows as JSON text and
``ledger`` one small file an entry, written when the question has ended. A question is
looked up by its name and a digest of its statement: only those whose last entry is
``done`` for this very statement are left out of the next run. A result without an entry
(the driver went away in between) is not read and is run again.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardlens.operators.catalog import NAMED_SQL
from cardlens.params import Params
from cardlens.session import remove_dir, shared_dir
from cardlens.sources.tables import register_views

ENTRY = ("query_name string, statement_digest string, status string, n_rows long, error_class string, "
         "error_text string, result string, written timestamp")

ERROR_CHARS = 2000  # of an error's text

# Spark's error conditions by the classes of the attempts.
CONDITIONS = {"PARSE_SYNTAX_ERROR": "syntax", "PARSE_EMPTY_STATEMENT": "syntax",
              "UNRESOLVED_COLUMN": "missing_column", "TABLE_OR_VIEW_NOT_FOUND": "missing_table"}


def _digest(statement: str) -> str:
    return hashlib.sha256(statement.encode()).hexdigest()


def error_class(error: Exception) -> str:
    """R4 for an error that Spark raised itself."""
    condition = error.getCondition() if isinstance(error, PySparkException) else None
    return CONDITIONS.get((condition or "").split(".")[0], "other")


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """Every entry written so far, in no order."""
    path = f"{folder.rstrip('/')}/ledger"
    return spark.read.schema(ENTRY).json(path) if _exists(spark, path) else spark.createDataFrame([], ENTRY)


def status(spark: SparkSession, folder: str) -> DataFrame:
    """The last entry of each question."""
    last = Window.partitionBy("query_name").orderBy(F.col("written").desc(), F.col("result").desc_nulls_last())
    return entries(spark, folder).withColumn("r", F.row_number().over(last)).where("r = 1").drop("r")


def run_questions(spark: SparkSession, statements: dict[str, str], folder: str) -> list[str]:
    """Run those of the named statements that ``folder`` has no result for; their names.

    One statement after another, each a Spark job over the registered views whose rows
    go straight to the folder. An error ends its own statement only: class and text are
    written to the ledger and the rest go on. What is not an error of the statement,
    such as an interrupt or a lost driver, ends the batch; the next run resumes it. The
    driver holds the statements and one entry for each.
    """
    folder = folder.rstrip("/")
    done = {(r["query_name"], r["statement_digest"]) for r in status(spark, folder).where("status = 'done'").collect()}
    ran = []
    for name, sql in statements.items():
        digest = _digest(sql)
        if (name, digest) in done:
            continue
        result = f"results/{uuid.uuid4().hex}"
        try:
            rows = spark.sql(sql).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row_json"))
            rows.write.parquet(f"{folder}/{result}")
            n = spark.read.schema("row_json string").parquet(f"{folder}/{result}").count()  # footers only
            entry = (name, digest, "done", n, None, None, result)
        except Exception as e:  # noqa: BLE001 - whatever a statement raises is its outcome
            if _exists(spark, f"{folder}/{result}"):
                remove_dir(spark, f"{folder}/{result}")
            entry = (name, digest, "failed", None, error_class(e), str(e)[:ERROR_CHARS], None)
        row = spark.createDataFrame([entry], ENTRY.rsplit(",", 1)[0]).withColumn("written", F.current_timestamp())
        row.coalesce(1).write.mode("append").json(f"{folder}/ledger")
        ran.append(name)
    return ran


def results(spark: SparkSession, folder: str) -> DataFrame:
    """(query_name, row_json) of all questions whose last entry is done."""
    out = spark.createDataFrame([], "query_name string, row_json string")
    for r in status(spark, folder).where("status = 'done'").collect():  # an entry a question
        out = out.unionByName(spark.read.schema("row_json string").parquet(f"{folder.rstrip('/')}/{r['result']}")
                              .select(F.lit(r["query_name"]).alias("query_name"), "row_json"))
    return out


# Statements that fail, each in a way that the logs hold.
FAILING_SQL = {
    "missing_column": "SELECT l_missing FROM lineitem",
    "missing_table": "SELECT * FROM no_such_table",
    "prose": "Here is the query: SELECT count(*) FROM lineitem",
}


def question_ledger(spark: SparkSession, sf_dir: str, p: Params, folder: str | None = None) -> DataFrame:
    """The named statements and three that fail, with the status of each."""
    register_views(spark, sf_dir)
    folder = folder or shared_dir(spark, "questions")
    run_questions(spark, {**FAILING_SQL, **NAMED_SQL}, folder)
    return status(spark, folder).select("query_name", "status", "n_rows", "error_class")
