"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _test_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tidemark-tables-")


def _folder(spark: SparkSession) -> str:
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return _test_folder()  # all tasks run in this process
    raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")


class Table:
    """``df`` written once and read from there; ``drop`` deletes the files, at the latest the end of the session does."""

    def __init__(self, df: DataFrame, name: str) -> None:
        spark = df.sparkSession
        path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self._place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        self._system = self._place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._system.deleteOnExit(self._place)
        self.rows = spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        self._system.delete(self._place, True)
