"""Intermediate tables in the folder that all executors share.

Iterative operators cut their lineage by writing Parquet below ``spark.checkpoint.dir``, or below the
warehouse, which executors share too, where a session names no such folder.  A lost executor then costs a
re-read, never a recomputation of the whole chain.  Shuffle files go once a table is written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders that this process has made, in order.
MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/veilframe-scratch"


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class Scratch:
    """Named tables of one operator run; ``drop`` frees those that later steps no longer need, the driver's end the rest."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        path, store = _path(spark, self.root)
        store.mkdirs(path)
        store.deleteOnExit(path)
        MADE.append(self.root)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path, conf = f"{self.root}/{name}", self.spark.conf
        before = conf.get(CLEANUP)
        conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, f"{self.root}/{name}")


def _delete(spark: SparkSession, name: str) -> None:
    path, store = _path(spark, name)
    store.delete(path, True)


def release(spark: SparkSession, since: int) -> None:
    """Frees the folders made since ``len(MADE)`` was ``since``; only once no result that reads them is wanted any more."""
    for root in MADE[since:]:
        _delete(spark, root)
    del MADE[since:]
