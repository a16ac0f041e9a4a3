"""Cutting lineage through tables written to the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_runs: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`; a temporary one of our own only where that is unset and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="lexiloom-")
        atexit.register(shutil.rmtree, _own["dir"], True)
    return "file://" + _own["dir"]


def run_folder(spark: SparkSession) -> str:
    """Where this application's tables lie; deleted by `release`, at the latest when the driver ends."""
    path = f"{shared_folder(spark)}/lexiloom/{spark.sparkContext.applicationId}"
    if path not in _runs:
        if not _runs:
            atexit.register(_release_all)
        _runs[path] = spark
    return path


def release(spark: SparkSession) -> None:
    """Deletes the tables written by this application. Frames that still read them can't be computed any more."""
    path = run_folder(spark)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    _runs.pop(path, None)


def _release_all() -> None:
    for spark in list(_runs.values()):
        try:
            release(spark)
        except Exception:  # the session has been stopped: its folder is left to whoever owns the shared one
            pass


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Writes `df` once to the shared folder and returns a reader of that table.

    Unlike `checkpoint()` the plan is computed a single time, and the files outlive any lost executor.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
