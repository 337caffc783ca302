"""Intermediate tables under ``spark.checkpoint.dir``, the folder that all executors of a cluster share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Scratch:
    """A folder of tables that outlive lost executors."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
            base = held.get() if held.isDefined() else None
        if not base:  # only where the session names no folder, as in tests
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="lociform-")
            spark.sparkContext.setCheckpointDir(base)
        self.folder = f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
