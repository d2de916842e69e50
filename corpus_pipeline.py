"""The corpus pipeline: five stages over ``documents``, each written and read again.

Every stage takes (spark, docs, sf_dir), works on all documents that the stage before
has kept, and returns a frame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cardlens.llm import bpe, crf, decontam, dedup, langid
from cardlens.llm._util import materialize, prepare, table

STAGES = [
    ("language", langid.keep_identified),
    ("quality", crf.keep_good),
    ("near_duplicates", dedup.deduplicate),
    ("decontamination", decontam.decontaminate),
    ("bpe", bpe.encode_stage),
]

# Learned models and a public vocabulary decide: SQL cannot express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` table."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
