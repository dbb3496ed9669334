"""Product tables: schema, files, and a catalogue derived from an order database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.operators.ordering import numbered

_TEXT = {f: T.StringType() for f in ("id", "store", "title", "cat", "path", "unit", "brand", "img", "url")}
_NUMBER = {f: T.DoubleType() for f in ("price", "oldPrice", "weight", "volume", "kcal", "protein", "fat", "carbs")}
FIELDS = ("ord", "id", "store", "title", "cat", "path", "price", "oldPrice", "weight", "volume", "unit", "kcal", "protein", "fat", "carbs", "brand", "img", "url", "inStock")
PRODUCT = T.StructType([T.StructField(f, {**_TEXT, **_NUMBER, "ord": T.LongType(), "inStock": T.BooleanType()}[f]) for f in FIELDS])

#: One offer for each part and parity of its suppliers, by fixed arithmetic; the same text runs in Spark and DuckDB.
PRODUCTS_SQL = """
SELECT CAST(k * 2 + s AS BIGINT) AS ord,
  CASE WHEN s = 0 THEN 'north' ELSE 'south' END || '-' || CAST(k AS STRING) AS id,
  CASE WHEN s = 0 THEN 'north' ELSE 'south' END AS store,
  p_name || CASE WHEN s = 1 THEN ' молода' ELSE '' END || CASE WHEN k % 12 = 5 THEN ' ' || CAST(k % 9 AS STRING) || ',' || CAST(k % 7 AS STRING) || '%' ELSE '' END
    || CASE WHEN k % 14 = 3 THEN ' 4х' ELSE ' ' END || CAST(p_size * 10 AS STRING) || 'г' AS title,
  CASE WHEN k % 25 = 0 THEN 'pets' ELSE lower(p_type) END AS cat,
  p_type || ' / ' || p_brand AS path,
  CASE WHEN k % 41 = 0 THEN NULL ELSE CAST(floor(p_retailprice * (100 + ((k * 7 + s * 13) % 160)) + 0.5) AS DOUBLE) / 100 END AS price,
  CASE WHEN k % 41 <> 0 AND md >= 0.095 THEN CAST(floor(p_retailprice * (120 + ((k * 7 + s * 13) % 160)) + 0.5) AS DOUBLE) / 100 END AS oldPrice,
  CASE WHEN p_size % 10 IN (0, 5) THEN NULL ELSE CAST(p_size * 10 AS DOUBLE) END AS weight,
  CASE WHEN p_size % 10 = 5 THEN CAST(p_size * 10 AS DOUBLE) END AS volume,
  CASE WHEN p_size % 10 = 0 THEN 'kg' ELSE 'pcs' END AS unit,
  CASE WHEN k % 29 = 0 THEN NULL ELSE CAST(k * 37 % 4000 AS DOUBLE) / 10 END AS kcal,
  CASE WHEN k % 17 = 0 THEN NULL ELSE CAST(k * 7 % 300 AS DOUBLE) / 10 END AS protein,
  CASE WHEN k % 19 = 0 THEN NULL ELSE CAST(k * 11 % 200 AS DOUBLE) / 10 END AS fat,
  CASE WHEN k % 23 = 0 THEN NULL ELSE CAST(k * 13 % 600 AS DOUBLE) / 10 END AS carbs,
  CASE WHEN k % 20 = 0 THEN NULL WHEN k % 20 = 1 THEN 'Без ТМ' ELSE p_brand END AS brand,
  CASE WHEN k % 6 = 0 THEN NULL ELSE 'https://images.example/' || CAST(k AS STRING) || '.jpg' END AS img,
  'https://shop.example/' || CAST(k AS STRING) AS url,
  (k * 3 + s) % 5 <> 0 AS inStock
FROM (SELECT l_partkey AS k, l_suppkey % 2 AS s, max(l_discount) AS md FROM lineitem GROUP BY l_partkey, l_suppkey % 2) o
JOIN part ON p_partkey = k
"""


def derived_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue over part and lineitem; both are read by column, nothing is registered in the session."""
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_suppkey", "l_discount")
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return spark.sql(PRODUCTS_SQL.replace("FROM lineitem", "FROM {lineitem}").replace("JOIN part", "JOIN {part}"), lineitem=lineitem, part=part)


def read_products(spark: SparkSession, path: str) -> DataFrame:
    """A written product table; JSON by extension, Parquet otherwise. Columns the files lack are null."""
    reader = spark.read.schema(PRODUCT)
    return reader.json(path) if path.endswith((".json", ".jsonl")) else reader.parquet(path)


def write_snapshot(products: DataFrame, categories: DataFrame, meta: DataFrame, path: str) -> None:
    """The three tables of a snapshot, each overwritten as a whole."""
    products.write.mode("overwrite").partitionBy("store").parquet(f"{path}/products")
    categories.write.mode("overwrite").json(f"{path}/categories")
    meta.write.mode("overwrite").json(f"{path}/meta")


def pending_details(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Ids without a cached detail; a cached miss counts as known."""
    return wanted.join(cache.select("id"), "id", "left_anti")


def merged_details(cache: DataFrame, fetched: DataFrame) -> DataFrame:
    """The cache with newly fetched rows (id, nutrition; null for a miss); these replace older ones."""
    return cache.join(fetched.select("id"), "id", "left_anti").unionByName(fetched)


def with_order(df: DataFrame, *by: str) -> DataFrame:
    """Number rows from 0 in the order of ``by``."""
    return numbered(df, [F.col(c) for c in by], "ord", 0)
