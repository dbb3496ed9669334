"""Category trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.sources.storage import Scratch

UNKNOWN = ("other", "Інше")


def category_paths(nodes: DataFrame) -> DataFrame:
    """(id, path, top_id, top_title) of a parent-pointer table (id, parent_id, title); roots have no or an unknown parent.

    Pointer doubling: in each round an open node joins what the node above its path has climbed so far, so a path of d
    nodes takes about log2(d) rounds, each one join over a written table. A path ends at a root, or before the first node
    that it has already (a cycle). A path with a node without a title is null.
    """
    scratch = Scratch(nodes.sparkSession, "paths")
    base = nodes.select("id", "parent_id", "title")
    parents = base.select(F.col("id").alias("up"))
    # climbed: the nodes from the own one upwards; up: the one above them
    climbed = F.array(F.struct("id", "title")).alias("climbed")
    walk = scratch.write(base.join(parents, (base["parent_id"] == parents["up"]) & (base["parent_id"] != base["id"]), "left").select("id", "up", climbed), "walk-0")
    turn = 0
    while not (open_ := walk.where("up is not null")).isEmpty():
        above = walk.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("climbed").alias("over"))
        met = F.arrays_overlap(F.col("over.id"), F.col("climbed.id"))
        again = F.array_min(F.transform(F.array_intersect(F.col("over.id"), F.col("climbed.id")), lambda x: F.array_position(F.col("over.id"), x)))
        longer = open_.join(above, "up").select(
            "id", F.when(~met, F.col("next")).alias("up"), F.concat("climbed", F.when(met, F.slice("over", F.lit(1), (again - 1).cast("int"))).otherwise(F.col("over"))).alias("climbed")
        )
        turn += 1
        walk = scratch.write(walk.where("up is null").unionByName(longer), f"walk-{turn}")
    top, titles = F.element_at("climbed", -1), F.reverse(F.col("climbed.title"))
    path = F.when(~F.exists(titles, lambda t: t.isNull()), F.array_join(titles, " / "))
    return walk.select("id", path.alias("path"), top["id"].alias("top_id"), top["title"].alias("top_title"))


def resolve_category(products: DataFrame, paths: DataFrame, first: str, second: str, scanned: str) -> DataFrame:
    """Path and top of the product's category, of its parent category, or of the section that was scanned; else unknown."""
    one, two, three = (paths.select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", "path", "top_id", "top_title")]) for p in ("a", "b", "c"))
    joined = products.join(one, F.col(first) == F.col("a_id"), "left").join(two, F.col(second) == F.col("b_id"), "left").join(three, F.col(scanned) == F.col("c_id"), "left")
    pick = lambda c, default: F.coalesce(f"a_{c}", f"b_{c}", f"c_{c}", F.lit(default)).alias(c)
    return joined.select(*products.columns, pick("path", UNKNOWN[1]), pick("top_id", UNKNOWN[0]), pick("top_title", UNKNOWN[1]))
