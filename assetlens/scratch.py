"""Tables in the folder that all executors share: they cut lineage and survive lost executors.

The folder is the one that spark.checkpoint.dir names, else the context's checkpoint folder. Where neither is set a local
session makes one of its own below /tmp; on a cluster that would be a folder of each machine, so there it is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        made = spark._jsc.sc().getCheckpointDir()
        root = made.get() if made.isDefined() else spark.conf.get("assetlens.scratch", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("assetlens.scratch", root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that new_folder() named."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Writes df once and reads it back. The table stays until its folder is removed."""
    spark = df.sparkSession
    path = folder or new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, tasks: int = 0) -> DataFrame:
    """The rows dealt out evenly over so many tasks, else four per core and at least 32. A file is cut no finer than its row groups, so one task may have all rows of a compact one."""
    return df.repartition(tasks or max(32, 4 * df.sparkSession.sparkContext.defaultParallelism))


class Scratch:
    """The tables of one job, in a folder of their own: drop() one once it has been used up, close() removes all."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, new_folder(spark, name)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def written(self, df: DataFrame, name: str) -> DataFrame:
        return written(df, name, self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, self.path(name))

    def close(self) -> None:
        remove(self.spark, self.root)
