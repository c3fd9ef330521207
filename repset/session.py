"""Session and scratch-storage helpers shared by the whole library."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """URI of the folder that every executor sees.

    It is ``spark.checkpoint.dir``; a private folder is made only where that is unset and the
    session runs inside one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="repset-"))
        atexit.register(shutil.rmtree, _LOCAL[0], True)
    return f"file://{_LOCAL[0]}"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh URI below the shared folder."""
    return f"{shared_folder(spark)}/repset-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: the lineage ends there, and a lost
    executor costs no recomputation. Returns the table and its URI (for ``drop``)."""
    uri = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri), uri


def drop(spark: SparkSession, *uris: str) -> None:
    """Remove scratch tables."""
    jvm = spark.sparkContext._jvm
    for uri in uris:
        path = jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
