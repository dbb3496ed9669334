"""Order of a result. Every order ends with ``ord``, the position in the catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.metrics import NUTRIENTS, nutrient_value, price_per_100g, price_per_protein, protein_per_kcal, sort_keys
from larder.sources.storage import Scratch

#: Keys that start ascending; all others start descending.
ASCENDING = ("title", "pricePer100", "pricePerProtein")


def sort_columns(key: str, direction: str, basis: str = "100g") -> list[Column]:
    down = direction == "desc"
    if key == "title":
        title = F.collate("title", "uk")
        return [title.desc() if down else title.asc(), F.col("ord")]
    value = {
        "price": lambda: F.col("price"), "pricePer100": price_per_100g, "pricePerProtein": price_per_protein, "proteinPerKcal": protein_per_kcal,
        **{n: lambda n=n: nutrient_value(n, basis) for n in NUTRIENTS},
    }[key]()
    return [sort_keys(value, down), F.col("ord")]


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of the ordered rows: a distributed top-k, no full sort."""
    return df.orderBy(*order).offset(offset).limit(limit) if offset else df.orderBy(*order).limit(limit)


def next_sort(key: str, current: tuple[str, str]) -> tuple[str, str]:
    """Choosing the current key again turns it round."""
    if key == current[0]:
        return key, "asc" if current[1] == "desc" else "desc"
    return key, "asc" if key in ASCENDING else "desc"


def numbered(df: DataFrame, order: list[Column], name: str, start: int = 1, columns: Sequence[str] | None = None) -> DataFrame:
    """Number all rows in order: they are written in sorted ranges, and only the ranges' sizes reach the driver. Of a row
    only ``columns`` (all, if not given) and its place are written; nothing else but the order's own columns is shuffled.

    The order must leave no ties for the numbers to be the same each time. The result is a written table's rows.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__row", F.monotonically_increasing_id())
    rows = Scratch(spark, "order").write(dealt.select(*(columns or df.columns), "__row"), "ranges")
    part, local = F.shiftright("__row", 33), F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))  # as that function builds its ids
    sizes = sorted(tuple(r) for r in rows.groupBy(part.alias("p")).count().collect())
    firsts, at = [], start
    for p, n in sizes:
        firsts.append((p, at))
        at += n
    firsts = spark.createDataFrame(firsts, "__part long, __first long")  # one row a range
    return rows.withColumn("__part", part).join(F.broadcast(firsts), "__part").withColumn(name, F.col("__first") + local).drop("__part", "__first", "__row")


def ranked(df: DataFrame, order: list[Column], columns: Sequence[str] | None = None) -> DataFrame:
    """All rows, or ``columns`` of them, with their place from 1. For a page of them, page() is cheaper."""
    return numbered(df, order, "rank", columns=columns)
