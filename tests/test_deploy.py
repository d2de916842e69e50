"""The package reaches Python workers that cannot see the driver's folder."""

import os
import subprocess
import sys
import zipfile
from io import BytesIO

from cardlens.session import package_zip, ship_package
from conftest import ROOT

CODE = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as E
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
print("rows", E.queries()["prompt_tokens"](spark, "/root/testdata/sf0.001").count())

def inside(batches):
    import cardlens.functions.tokens as t
    for b in batches:
        yield b.set_column(0, "at", __import__("pyarrow").array([t.__file__] * b.num_rows))
print("from", spark.range(1).mapInArrow(inside, "at string").first()[0])
"""


def test_workers_run_the_package_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CODE.format(root=ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "rows 20" in out.stdout or "rows " in out.stdout, out.stderr[-2000:]
    assert ".zip/cardlens/functions/tokens.py" in out.stdout


def test_the_zip_holds_every_module_and_is_added_once(spark):
    data = package_zip()
    names = zipfile.ZipFile(BytesIO(data)).namelist()
    assert "cardlens/session.py" in names and "cardlens/operators/spans.py" in names and data == package_zip()
    ship_package(spark)
    before = len(spark.sparkContext._python_includes)
    ship_package(spark)
    assert len(spark.sparkContext._python_includes) == before


def test_the_caller_can_clear_what_jobs_have_written(spark):
    from cardlens.operators import catalog, spans
    from cardlens.params import Params
    from cardlens.session import clear_shared, ensure_checkpoint_dir
    from conftest import SMALL
    clear_shared(spark)
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    catalog.table_copy(spark, SMALL, Params()).collect()
    spans.span_tree(spark, SMALL, Params()).collect()
    spans.token_usage(spark, SMALL, Params()).collect()
    assert set(os.listdir(folder)) - before
    assert clear_shared(spark) >= 3 and set(os.listdir(folder)) == before
    assert clear_shared(spark) == 0
