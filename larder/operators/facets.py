"""Counts, facets and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.metrics import NUTRIENTS


def category_hits(filtered: DataFrame) -> DataFrame:
    """(cat, hits) over rows filtered by all but the category."""
    return filtered.groupBy("cat").agg(F.count("*").alias("hits"))


def category_blocks(hits: DataFrame, categories: DataFrame) -> DataFrame:
    """Visible categories with hits, most first; equal counts in the order of the categories (cat_ord)."""
    joined = categories.join(hits, categories["id"] == hits["cat"]).where("hits > 0")
    return joined.select("id", "title", "hits", "cat_ord").orderBy(F.desc("hits"), "cat_ord")


def category_summary(products: DataFrame) -> DataFrame:
    """(cat, count, counts by store, img): the image of the stocked product with the shortest title, the first if equal."""
    by_store = products.groupBy("cat", "store").agg(
        F.count("*").alias("n"),
        F.min(F.when(F.col("inStock") & (F.col("img") != ""), F.struct(F.length("title").alias("size"), "ord", "img"))).alias("best"),
    )
    return by_store.groupBy("cat").agg(
        F.sum("n").alias("count"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("store", "n")))).alias("counts"),  # one entry a store
        F.min("best")["img"].alias("img"),
    )


def ordered_categories(summary: DataFrame, dimension: DataFrame) -> DataFrame:
    """Categories of the dimension (id, title, cat_ord) that occur, most products first, then by cat_ord."""
    joined = dimension.join(summary, dimension["id"] == summary["cat"]).drop("cat")
    return joined.orderBy(F.desc("count"), "cat_ord")


def snapshot_stats(products: DataFrame) -> DataFrame:
    """Counters of each store and, with a null store, of all."""
    known = [F.count(n).alias(f"with{n.capitalize()}") for n in NUTRIENTS]
    full = F.count(F.when(F.col("kcal").isNotNull() & F.col("protein").isNotNull() & F.col("fat").isNotNull() & F.col("carbs").isNotNull(), 1))
    counters = [F.count("id").alias("totalKept"), *known, full.alias("full4"), F.count("oldPrice").alias("withDiscount")]
    return products.rollup("store").agg(*counters)


def total_seen(snapshots: DataFrame) -> DataFrame:
    return snapshots.agg(F.coalesce(F.sum(F.coalesce("totalSeen", F.lit(0))), F.lit(0)).alias("totalSeen"))


def matches_anything(df: DataFrame) -> bool:
    return not df.limit(1).isEmpty()
