"""What the operators of this subpackage share: tables in the shared folder, batch sizes, joins with hot keys, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.sources.storage import Scratch as Workspace
from larder.sources.storage import spread

__all__ = ["Workspace", "bounded_batches", "join_by_key", "keyed_vectors", "read", "spread"]

#: A key is hot with a SHARE-th of all rows or more, so there are at most SHARE hot keys, whatever the rows.
SHARE = 4096
#: Texts are long: an Arrow batch of the session's default size would take 64 MB in the JVM and again in Python.
BATCH_BYTES, DEFAULT_BYTES = "2m", "67108864b"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES, unless the session has a size of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == DEFAULT_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def join_by_key(rows: DataFrame, table: DataFrame, on: list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) with a table that has one row a key and in column ``n`` how many rows hold it.

    ``total`` is the number of rows. Hot keys are broadcast, at most SHARE rows of the table, so that no task gets all
    rows of a key; the others are joined by shuffle. Both sides are read twice and should be written tables. Rows with
    a null in the key meet nothing. Column ``n`` is not returned.
    """
    hot, cold = table.where(F.col(n) * SHARE >= total).drop(n), table.where(F.col(n) * SHARE < total).drop(n)
    keyed = rows.dropna(subset=on)
    found = keyed.join(F.broadcast(hot), on)
    others = keyed.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on, how)
    found = found.unionByName(others)
    if how == "left":
        added = [f for f in table.drop(n).schema.fields if f.name not in on]
        none = rows.where(" or ".join(f"`{c}` is null" for c in on)).withColumns({f.name: F.lit(None).cast(f.dataType) for f in added})
        found = found.unionByName(none)
    return found


def keyed_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec array<double>) of the usable vectors, one row per id.

    Left out: null ids, null or empty vectors, vectors with a null or non-finite component. Of rows that
    repeat an id the smallest vector counts.
    """
    vec = F.col(vec_col).cast("array<double>")
    usable = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return (
        df.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec"))
        .where(F.col("vec_id").isNotNull() & (F.size("vec") > 0) & F.coalesce(usable, F.lit(False)))
        .groupBy("vec_id")
        .agg(F.min("vec").alias("vec"))
    )
