"""Snapshots that arrive as files: each store's products are replaced when a newer document comes in."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.sources.snapshots import SNAPSHOT, merged_products, raw_products


def newest(documents: DataFrame) -> DataFrame:
    """Of each store the document with the latest ``generatedAt`` (ISO text); of equally late ones any, but one."""
    latest = documents.groupBy("store").agg(F.max_by(F.struct(*documents.columns), F.coalesce("generatedAt", F.lit(""))).alias("d"))
    return latest.select("d.*")


def watch_snapshots(spark: SparkSession, incoming: str, target: str, checkpoint: str, stores: list[str]):
    """A stream that merges the newest document of each store and replaces the store's products below ``target``.

    A document that is older than what the store has is passed over, whenever it arrives. ``generatedAt`` is kept with
    the products; a document without it counts as oldest.
    """

    def replace(batch: DataFrame, _: int) -> None:
        latest = newest(batch.where("store is not null")).withColumn("generatedAt", F.coalesce("generatedAt", F.lit("")))
        try:
            held = spark.read.parquet(target).groupBy("store").agg(F.max("generatedAt").alias("held"))
        except AnalysisException:  # nothing is there yet
            held = spark.createDataFrame([], "store string, held string")
        fresh = latest.join(held, "store", "left").where(F.col("held").isNull() | (F.col("generatedAt") >= F.col("held")))
        # which stores change is settled before their partitions are replaced
        dates = spark.createDataFrame([(r.store, r.generatedAt) for r in fresh.select("store", "generatedAt").collect()], "store string, generatedAt string")
        raw = raw_products(latest.join(F.broadcast(dates.select("store")), "store", "left_semi"))
        merged = merged_products(raw, stores).drop("order").join(F.broadcast(dates), "store")
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("store").parquet(target)

    stream = spark.readStream.schema(SNAPSHOT).option("multiLine", True).json(incoming)
    return stream.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
