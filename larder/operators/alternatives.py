"""Products of the same kind with more protein for the energy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.functions.metrics import price_per_protein, protein_per_kcal
from larder.functions.text import tokens_col
from larder.sources.storage import Scratch

MIN_KCAL, DENSITY_GAIN = 15, 1.2
# Words that name no food, as they are (tokens are folded, so those with і never fit), and stems of
# descriptors.
STOPWORDS = ["та", "і", "з", "зі", "для", "без", "у", "в", "на"]
DESCRIPTOR = "^(молод|свіж|червон|зелен|жовт|чорн|велик|дрібн|добірн|мит|охолодж|заморож|сушен|варен|відбірн|преміум|premium)"
SIZE_TOKEN = r"^\d+(?:[.,]\d+)?(?:г|кг|мл|л|шт|%)?$"


def food_tokens() -> Column:
    """Distinct, sorted title tokens that name the food."""
    plain = F.array_except(tokens_col(F.col("title")), F.coalesce(tokens_col(F.col("brand")), F.array().cast("array<string>")))
    left = F.array_except(plain, F.array(*map(F.lit, STOPWORDS)))
    return F.array_sort(F.filter(left, lambda t: ~t.rlike(SIZE_TOKEN) & ~t.rlike(DESCRIPTOR)))


def _rows(products: DataFrame) -> DataFrame:
    return products.select("ord", "id", "store", "cat", "kcal", "inStock", food_tokens().alias("toks"), protein_per_kcal().alias("density"), price_per_protein().alias("ppp"))


def _sources(products: DataFrame) -> DataFrame:
    return _rows(products).where("density is not null and kcal is not null and size(toks) > 0")


def _candidates(products: DataFrame, store: str) -> DataFrame:
    rows = _rows(products).where(F.col("inStock") & (F.col("kcal") >= MIN_KCAL) & F.col("density").isNotNull() & (F.size("toks") > 0))
    return rows if store == "all" else rows.where(F.col("store") == store)


def alternatives(products: DataFrame, store: str = "all", limit: int = 5, sources: DataFrame | None = None) -> DataFrame:
    """(source_id, rank, id, shared, density, cheaper): up to ``limit`` alternatives of each product (or of ``sources``).

    An alternative is another product of the category, in stock, with enough energy, a density at least 1.2 times the
    source's, and a common food token; more common tokens come first, then density, then catalogue order.

    Rows with the same tokens are a kind. They share their count of common tokens with any other kind, so of each kind only
    the ``limit`` + 1 densest candidates can be listed (one of them may be the source), and of all kinds that share as
    many tokens with a kind as well. Kinds meet by token, as numbers; rows meet what is left of that.
    """
    scratch = Scratch(products.sparkSession, "alternatives")
    best = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("d"), "o"))
    wanted = _sources(products if sources is None else sources)
    heads = _candidates(products, store).select("cat", "toks", F.col("ord").alias("o"), F.col("id").alias("alt"), F.col("density").alias("d"), F.col("ppp").alias("p"))
    heads = scratch.write(heads.withColumn("place", best("cat", "toks")).where(F.col("place") <= limit + 1).drop("place"), "heads")
    kinds = wanted.select("cat", "toks").unionByName(heads.select("cat", "toks")).distinct()
    kinds = scratch.write(kinds.withColumn("kind", F.monotonically_increasing_id()), "kinds")
    wanted = scratch.write(wanted.join(kinds, ["cat", "toks"]).select("kind", "id", "density", "ppp"), "wanted")
    heads = heads.join(kinds, ["cat", "toks"]).select(F.col("kind").alias("other"), "o", "alt", "d", "p")
    tokens = kinds.select("kind", "cat", F.explode("toks").alias("t"))
    pairs = tokens.join(tokens.select(F.col("kind").alias("other"), "cat", "t"), ["cat", "t"]).groupBy("kind", "other").agg(F.count("*").alias("shared"))
    offered = pairs.join(heads, "other").withColumn("place", best("kind", "shared")).where(F.col("place") <= limit + 1)
    met = wanted.join(offered, "kind").where((F.col("alt") != F.col("id")) & (F.col("d") >= F.col("density") * DENSITY_GAIN))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("shared"), F.desc("d"), "o"))
    cheaper = F.when(F.col("p").isNotNull() & F.col("ppp").isNotNull(), F.col("p") <= F.col("ppp"))
    out = met.withColumn("rank", rank).where(F.col("rank") <= limit)
    return out.select(F.col("id").alias("source_id"), F.col("rank").cast("long").alias("rank"), F.col("alt").alias("id"), "shared", F.col("d").alias("density"), cheaper.alias("cheaper"))


def have_alternatives(products: DataFrame, stores: list[str]) -> DataFrame:
    """(store, id) of the products with an alternative in each of ``stores`` (``all``: in any store), from one pass over
    the catalogue: of each store, category and token only the two densest candidates matter."""
    candidates = _candidates(products, "all").select("cat", "id", "density", "store", "toks")
    offered = F.filter(F.array(F.col("store"), F.lit("all")), lambda s: s.isin(stores))
    probes = candidates.select("cat", "id", "density", F.explode("toks").alias("t"), offered.alias("stores")).select("cat", "id", "density", "t", F.explode("stores").alias("store"))
    # of equally dense ones any may be first: the other is as dense
    seen = F.struct("density", "id")
    best = probes.groupBy("store", "cat", "t").agg(F.max(seen).alias("first"))
    rest = probes.join(best, ["store", "cat", "t"]).where(F.col("id") != F.col("first.id")).groupBy("store", "cat", "t").agg(F.max("density").alias("second"))
    tops = best.join(rest, ["store", "cat", "t"], "left").select("store", "cat", "t", F.col("first.id").alias("top"), F.col("first.density").alias("most"), "second")
    wanted = _sources(products).select("cat", "id", "density", F.explode("toks").alias("t"))
    most = F.when(F.col("top") == F.col("id"), F.col("second")).otherwise(F.col("most"))
    return wanted.join(tops, ["cat", "t"]).where(most >= F.col("density") * DENSITY_GAIN).select("store", "id").distinct()


def has_alternative(products: DataFrame, store: str = "all") -> DataFrame:
    """(id) of the products with an alternative in a store."""
    return have_alternatives(products, [store]).select("id")


def keep_alternatives(products: DataFrame, stores: list[str], path: str) -> None:
    """Write has_alternative() of each of ``stores``, and of ``all``, below ``path``, a partition a store, so that later
    requests only read ids. Stores that are there already are replaced, others stay. The catalogue is read once."""
    found = Scratch(products.sparkSession, "kept").write(have_alternatives(products, [*stores, "all"]), "found")
    for store in dict.fromkeys([*stores, "all"]):
        found.where(F.col("store") == store).select("id").write.mode("overwrite").parquet(f"{path}/store={store}")


def kept_alternatives(spark: SparkSession, path: str, store: str = "all") -> DataFrame:
    """(id) as kept for a store; no rows for a store that is not there."""
    return spark.read.schema("id string, store string").parquet(path).where(F.col("store") == store).select("id")
