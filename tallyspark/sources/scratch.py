"""Tables written in the folder that driver and executors share, so that what is computed once stays as it was."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Only a session in one local process may go without: it gets a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="tallyspark-")
    return _own[context.applicationId]


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the driver's process ends, be its session stopped by then or not."""
    path = f"{shared_dir(spark)}/tallyspark/{label}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # outlives the session

    def remove() -> None:
        with contextlib.suppress(Exception):
            files.delete(at, True)

    atexit.register(remove)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder, which outlives any executor."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
