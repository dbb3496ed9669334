"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session may lack it and then gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="larder-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def spread(table: DataFrame) -> DataFrame:
    """The rows of a scan, dealt to all cores if it has splits for half of them or fewer: for work that costs far more than
    moving the rows.

    Spark cuts a scan into splits of 4 MB or more and about as many as cores, so only tables below some 2 MB a core are
    moved, which may be one row group that one task would read.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() * 2 <= cores else table


class Scratch:
    """Intermediate tables of one operator run, removed when the driver ends, or before by drop().

    A written table cuts the lineage: a lost executor costs a reread, not a recomputation, and every later step sees the
    same rows.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(self._remove_all)

    def _remove(self, path: str) -> None:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)

    def _remove_all(self) -> None:
        try:
            self._remove(self.root)
        except Exception:  # the session has ended
            pass

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        self._remove(self.path(name))
