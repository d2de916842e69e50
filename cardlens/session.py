"""Session construction and shared-folder helpers."""

from __future__ import annotations

import hashlib
import io
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings every cardlens job relies on. AQE re-plans joins from runtime sizes
# (a shuffle side that turns out small becomes a broadcast; that is the size
# check), splits skewed join partitions and coalesces small shuffle outputs.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot key's join partition even when the next aggregate is keyed
    # the same way (one extra shuffle of partial results beats one straggler)
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "cardlens", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    apply_conf(spark)
    ensure_checkpoint_dir(spark)
    return spark


def apply_conf(spark: SparkSession) -> None:
    """Apply the runtime-settable part of BASE_CONF to an existing session."""
    for k, v in BASE_CONF.items():
        if k in ("spark.ui.enabled", "spark.ui.showConsoleProgress"):
            continue
        try:
            spark.conf.set(k, v)
        except Exception:  # static conf on a running session
            pass


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` names a folder that driver and executors share and is
    used as is. Only a local master may go without it: there a scratch folder is
    created. On a cluster a missing setting is an error, as executors would not see
    the driver's own folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = local_scratch(sc.master)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def local_scratch(master: str) -> str:
    """A scratch folder for a local master; an error for any other."""
    if not re.fullmatch(r"local(\[[^\]]*\])?", master or ""):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="cardlens-ckpt-")


_written: dict[str, set[str]] = {}  # application -> folders of tables that it has written


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new sub-folder of the shared checkpoint folder for written tables."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


def clear_shared(spark: SparkSession) -> int:
    """Delete every table that the jobs of this session have written to the shared
    folder; how many there were. For the caller, once the results are read: frames that
    the jobs returned read these tables, so none of them can be used afterwards."""
    paths = _written.pop(spark.sparkContext.applicationId, set())
    for path in paths:
        remove_dir(spark, path)
    return len(paths)


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    _written.get(spark.sparkContext.applicationId, set()).discard(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def package_zip() -> bytes:
    """This package's modules as a zip file, the same bytes for the same modules."""
    root = os.path.dirname(os.path.abspath(__file__))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                with open(path, "rb") as f:
                    z.writestr(zipfile.ZipInfo(os.path.relpath(path, os.path.dirname(root))), f.read())
    return out.getvalue()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once a session and version.

    The zip file is written to the shared folder and added to the session's files, so
    jobs with Python in them run whatever folder the driver was started in.
    """
    data = package_zip()
    name = f"cardlens-{hashlib.sha256(data).hexdigest()[:16]}.zip"
    sc = spark.sparkContext
    if name in getattr(sc, "_python_includes", ()):
        return
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}")
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(jpath, True)
    out.write(bytearray(data))
    out.close()
    sc.addPyFile(fs.makeQualified(jpath).toString())
