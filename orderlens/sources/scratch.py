"""Tables that a query writes once and reads again, below one folder of the application in the shared checkpoint folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_shipped: set[str] = set()          # applications whose workers have the package


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where a local master names none, one of its own is set.

    On any other master a missing setting is an error: executors would not see the driver's folders.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared and spark.sparkContext.master.startswith("local["):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="orderlens-"))
        shared = spark.sparkContext.getCheckpointDir()
    if not shared:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    return shared.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """Where this application's tables lie."""
    return f"{shared_folder(spark)}/orderlens-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read from there: it is computed once, and a lost executor costs a reread."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_run(spark: SparkSession) -> bool:
    """Remove all tables of this application, once its results are written; false if there were none.

    The shipped package goes with them: it is shipped again by the next ``ship_package``.
    """
    _shipped.discard(spark.sparkContext.applicationId)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of ``spark``, once for an application.

    A zip of its source goes to the shared folder and from there to every
    worker, so it need not be installed on the cluster or be on its path.
    Where the driver itself has it from a zip, it is taken to be shipped.
    """
    context = spark.sparkContext
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if context.applicationId in _shipped or not os.path.isdir(package):
        return
    target = f"{run_folder(spark)}/package/orderlens.zip"
    with tempfile.TemporaryDirectory() as local:             # on the driver only, until the zip is copied
        kept = shutil.copytree(package, f"{local}/source/orderlens", ignore=shutil.ignore_patterns("__pycache__"))
        archive = shutil.make_archive(f"{local}/orderlens", "zip", os.path.dirname(kept), "orderlens")
        hadoop = context._jvm.org.apache.hadoop.fs
        path = hadoop.Path(target)
        path.getFileSystem(context._jsc.hadoopConfiguration()).copyFromLocalFile(False, True, hadoop.Path(f"file://{archive}"), path)
    context.addPyFile(target)
    _shipped.add(context.applicationId)
