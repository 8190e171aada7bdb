"""Tables that several parts of a plan read, written once."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}


def _folder(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, which all executors share; deleted when the driver ends.

    Only a local session that names none (as in tests) gets a temporary folder.
    """
    context = spark.sparkContext
    app = context.applicationId
    if app not in _folders:
        found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
        if not found:
            if context.master.partition("[")[0] != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            made = tempfile.mkdtemp(prefix="chronoreel-")
            atexit.register(shutil.rmtree, made, ignore_errors=True)
            found = f"file://{made}"
        _folders[app] = f"{found.rstrip('/')}/chronoreel/{app}-plans"
        path = context._jvm.org.apache.hadoop.fs.Path(_folders[app])
        files = path.getFileSystem(context._jsc.hadoopConfiguration())

        def remove() -> None:
            with contextlib.suppress(Exception):  # the JVM may have gone first
                files.delete(path, True)

        atexit.register(remove)
    return _folders[app]


def written_once(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: what is built on it does not compute it again."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh_folder(spark: SparkSession) -> str:
    """A path of its own in the shared folder, with its file system named, for writers outside Spark too."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{_folder(spark)}/{uuid.uuid4().hex}")
    full = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"file://{full.removeprefix('file:')}" if full.startswith("file:/") and not full.startswith("file://") else full
