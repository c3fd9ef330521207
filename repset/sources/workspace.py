"""A folder of named tables, its settings and its messages."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Workspace:
    """Tables by name below one URI. A table is replaced unless ``overwrite`` is off; asking for one that isn't there gives None."""

    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.uri = spark, uri.rstrip("/")

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.uri}/tables/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def has(self, name: str) -> bool:
        path, fs = self._path(f"{name}/_SUCCESS")
        return fs.exists(path)

    def store(self, name: str, table: DataFrame, overwrite: bool = True, mark: str | None = None) -> DataFrame:
        """Write a table; ``mark`` tells what it was made from. The old mark goes before the table is touched."""
        path, fs = self._path(f"../marks/{name}")
        if overwrite:
            fs.delete(path, True)
        table.write.mode("overwrite" if overwrite else "error").parquet(f"{self.uri}/tables/{name}")
        if mark is not None:
            self.spark.createDataFrame([(mark,)], "value string").write.mode("overwrite").text(f"{self.uri}/marks/{name}")
        return self.get(name)

    def mark(self, name: str) -> str | None:
        path, fs = self._path(f"../marks/{name}/_SUCCESS")
        return self.spark.read.text(f"{self.uri}/marks/{name}").first()[0] if fs.exists(path) else None

    def get(self, name: str) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.uri}/tables/{name}") if self.has(name) else None

    def export(self, name: str) -> str:
        """The table as CSV below ``csv/``; returns its folder."""
        out = f"{self.uri}/csv/{name}"
        self.get(name).write.mode("overwrite").option("header", True).csv(out)
        return out

    def store_arguments(self, values: dict) -> None:
        self.spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").write.mode("overwrite").text(f"{self.uri}/arguments")

    def arguments(self) -> dict:
        return json.loads(self.spark.read.text(f"{self.uri}/arguments").first()[0])

    def store_warnings(self, messages: DataFrame) -> None:
        """One line each."""
        messages.select(F.col("message")).write.mode("overwrite").text(f"{self.uri}/warnings")
