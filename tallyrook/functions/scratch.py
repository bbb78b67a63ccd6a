"""Durable intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class Scratch:
    """Tables written to the folder in spark.checkpoint.dir, which all executors share.

    A written table cuts the lineage, survives lost executors and carries its size, so that
    Spark's own threshold decides later joins. Where the setting is absent, a temporary folder takes
    its place on a local master, as in tests; on a cluster that is an error, since executors do not
    share it. Steps drop the tables that nothing reads any more, and the rest goes when the driver
    ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="scratch-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.base = f"{base.rstrip('/')}/tables-{uuid.uuid4().hex}"
        self.count = 0
        self.paths: dict[int, str] = {}
        atexit.register(self.end)

    def end(self) -> None:
        """Removes all of them, when nothing that reads them is left to run."""
        with contextlib.suppress(Exception):  # the session may have ended before
            self.drop(self.base)

    def save(self, df: DataFrame) -> DataFrame:
        path = self.write(df)
        saved = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(saved)] = path
        return saved

    def write(self, df: DataFrame) -> str:
        self.count += 1
        path = f"{self.base}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        return path

    def read(self, path: str) -> DataFrame:
        return self.spark.read.parquet(path)

    def drop(self, path: str) -> None:
        """Removes a table that no later step reads."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def forget(self, *saved: DataFrame) -> None:
        """Removes saved tables that no later step reads, not even one that is yet to run."""
        for df in saved:
            self.drop(self.paths.pop(id(df)))
