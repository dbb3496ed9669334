"""The same item in several stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.metrics import js_round, pack_size, price_per_100g
from larder.functions.text import fold, fold_col, tokens_col
from larder.operators.components import connected_components
from larder.sources.storage import Scratch

SIMILAR, MAX_RATIO = 0.6, 2.0
# Brands that are none, and words that say nothing about an item.
BRANDLESS = ["без тм", "no name", "noname", "без бренду", "власна марка"]
STOPWORDS = ["та", "і", "з", "зі", "для", "the", "auchan", "ашан", "сільпо", "silpo"]
SIZE_TOKEN = r"^\d+(?:[.,]\d+)?(?:г|кг|мл|л|шт|%)?$"


def real_brand(brand: Column) -> Column:
    folded = fold_col(brand)
    return F.when((brand != "") & ~folded.isin([fold(b) for b in BRANDLESS]), folded)


def size_key() -> Column:
    return F.when(F.col("unit").isin("kg", "l"), "bulk").otherwise(F.concat(F.lit("g"), js_round(pack_size()).cast("string")))


def percent_key(title: Column) -> Column:
    found = F.regexp_extract_all(title, F.lit(r"[0-9]+(?:[.,][0-9]+)?[\s\x{00A0}]*%"), F.lit(0))
    plain = F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, r"[\s\x{00A0}%]", ""), r"^([^,]*),", "$1."))
    return F.array_join(F.array_sort(plain), ",")


def pack_count(title: Column) -> Column:
    digits = [F.nullif(F.regexp_extract(title, p, 1), F.lit("")) for p in (r"([0-9]+)[\s\x{00A0}]*шт", r"([0-9]+)[\s\x{00A0}]*[*xх×]", r"[*xх×][\s\x{00A0}]*([0-9]+)")]
    return F.coalesce(F.concat(F.lit("n"), F.coalesce(*digits)), F.lit(""))


def identity_tokens() -> Column:
    """Distinct title tokens without brand, stop words and sizes."""
    plain = F.array_except(tokens_col(F.col("title")), F.coalesce(tokens_col(F.col("brand")), F.array().cast("array<string>")))
    stop = F.array(*[F.lit(fold(w)) for w in STOPWORDS])
    return F.filter(F.array_except(plain, stop), lambda t: ~t.rlike(SIZE_TOKEN))


def matching_keys(products: DataFrame) -> DataFrame:
    """(ord, id, store, b, size, pct, cnt, toks, per100) of branded products of known size."""
    keyed = products.select(
        "ord", "id", "store", real_brand(F.col("brand")).alias("b"), size_key().alias("size"), percent_key(F.col("title")).alias("pct"),
        pack_count(F.col("title")).alias("cnt"), identity_tokens().alias("toks"), price_per_100g().alias("per100"),
    )
    return keyed.where("b is not null and size is not null")


KEYS = ["b", "size", "pct", "cnt"]


#: A token with a HOT-th of all token places or more comes last in the order, so there are at most HOT of them.
HOT = 256
#: Rows of a key that share a token and meet in one cell.
CELL = 2048


#: Rows of a kind in one block; blocks are paired whole, so a pair of them is at most its square of links.
BLOCK = 256
#: Links that a task expands, about.
LINKS = 1 << 24


def similar_pairs(keyed: DataFrame) -> DataFrame:
    """(src, dst) of rows with equal keys whose tokens overlap enough, src before dst, in buckets of several stores.

    Kinds meet, each two once; their links are expanded to rows by pairs of blocks, without a comparison.
    """
    scratch = Scratch(keyed.sparkSession, "pairs")
    keyed = scratch.write(_sorted_tokens(keyed), "keyed")
    kinds = scratch.write(_kinds(keyed), "kinds")
    met = scratch.write(_met(kinds, scratch).distinct(), "met")
    links = met.unionByName(kinds.where("n > 1").select(F.col("kind").alias("src"), F.col("kind").alias("dst")))
    ends = met.select(F.col("src").alias("kind")).unionByName(met.select(F.col("dst").alias("kind"))).distinct()
    linked = kinds.join(ends.withColumn("met", F.lit(True)), "kind", "left").where("met or n > 1")
    rows = _of_kind(keyed, linked.select("h", *KEYS, "toks", "kind", F.ceil(F.col("n") / BLOCK).alias("parts")))
    blocks = rows.groupBy("kind", F.pmod(F.xxhash64("ord"), "parts").alias("part")).agg(F.collect_list("ord").alias("ords"))  # some BLOCK
    blocks = scratch.write(blocks, "blocks")
    x, y = (blocks.select(F.col("kind").alias(end), F.col("part").alias(f"{end}_part"), F.col("ords").alias(f"{end}_ords")) for end in ("src", "dst"))
    pairs = links.join(x, "src").join(y, "dst").where("src <> dst or src_part <= dst_part")
    work = links.join(kinds.select(F.col("kind").alias("src"), F.col("n").alias("x")), "src").join(kinds.select(F.col("kind").alias("dst"), F.col("n").alias("y")), "dst")
    total = work.agg(F.sum(F.col("x") * F.col("y"))).first()[0] or 0
    tasks = max(keyed.sparkSession.sparkContext.defaultParallelism, min(total // LINKS + 1, 1 << 14))
    dealt = pairs.repartition(tasks, "src", "dst", "src_part", "dst_part")
    expanded = dealt.withColumn("within", F.expr("src = dst and src_part = dst_part")).select("within", F.explode("src_ords").alias("x"), "dst_ords").select("within", "x", F.explode("dst_ords").alias("y"))
    return expanded.where("not within or x < y").select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"))


def _sorted_tokens(keyed: DataFrame) -> DataFrame:
    """Rows with their tokens in order, and column ``h``, a hash of all that makes a kind."""
    return keyed.withColumn("toks", F.array_sort("toks")).withColumn("h", F.xxhash64(*KEYS, "toks"))


def _kinds(keyed: DataFrame) -> DataFrame:
    """(kind, h, keys, toks, n): the rows with equal keys and tokens as one, in buckets of several stores; kind is their
    smallest ord, n their number. Copies of a product are as similar as can be, so only kinds are compared."""
    by = ["h", *KEYS, "toks"]
    stores = keyed.groupBy(*by, "store").agg(F.min("ord").alias("kind"), F.count("*").alias("n"))
    kinds = stores.groupBy(*by).agg(F.min("kind").alias("kind"), F.sum("n").alias("n"))
    wide = stores.groupBy(*KEYS).agg(F.min("store").alias("lo"), F.max("store").alias("hi")).where("lo < hi").select(*KEYS)
    return kinds.where(F.size("toks") > 0).join(wide, KEYS, "left_semi").select("kind", *by, "n")


def _of_kind(keyed: DataFrame, kinds: DataFrame) -> DataFrame:
    """The rows of ``keyed`` with the columns of their kind."""
    return keyed.join(kinds, ["h", *KEYS, "toks"])


def _ordered_tokens(rows: DataFrame) -> DataFrame:
    """Rows with their tokens in an order that all rows share: by hash, the frequent ones last."""
    held = rows.select(F.explode("toks").alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    places = rows.agg(F.sum(F.size("toks")).alias("n")).first()["n"] or 0
    hot = held.where(F.col("n") * HOT >= places).orderBy("n", "t").collect()  # at most HOT
    if not hot:
        rank = lambda t: F.lit(0)
    else:
        late = F.array(*[F.lit(r.t) for r in hot])
        rank = lambda t: F.array_position(late, t)
    ordered = F.array_sort(F.transform("toks", lambda t: F.struct(rank(t).alias("late"), F.xxhash64(t).alias("h"), t.alias("t"))))
    return rows.withColumn("toks", F.transform(ordered, lambda x: x["t"]))


def _met(kinds: DataFrame, scratch: Scratch) -> DataFrame:
    """(src, dst) of similar kinds, src before dst, once for each token that the two meet by.

    Prefix filter: with a common order of tokens, two sets that overlap enough share one of the first
    n - ceil(0.6 n) + 1 tokens, so rows meet by key and such a token instead of all in their bucket; their sizes and the
    tokens left behind the shared one rule most out before sets are compared. The rows of a key and token are dealt into
    parts of some CELL rows, and meet in one cell for each two parts: a crowded key is the work of many tasks.
    """
    rows = kinds.select(F.col("kind").alias("ord"), F.struct(*KEYS).alias("key"), F.xxhash64(*KEYS).alias("bucket"), "toks")
    rows = _ordered_tokens(rows)
    n = F.size("toks")
    first = F.slice("toks", F.lit(1), n - F.ceil(n * SIMILAR - 1e-9).cast("int") + 1)
    probes = scratch.write(rows.select("ord", "bucket", "key", "toks", F.posexplode(first).alias("at", "t")), "probes")
    crowds = probes.groupBy("bucket", "t").agg(F.count("*").alias("n")).where(F.col("n") > CELL).select("bucket", "t", F.ceil(F.col("n") / CELL).cast("int").alias("parts"))
    dealt = probes.join(crowds, ["bucket", "t"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("ord"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cell = [F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high")]
    dealt = dealt.select("bucket", "t", *cell, "part", "key", "ord", "toks", F.size("toks").alias("size"), "at")
    left, right = dealt.where("part = low").alias("x"), dealt.where("part = high").alias("y")
    once = (F.col("x.low") < F.col("x.high")) | (F.col("x.ord") < F.col("y.ord"))
    # what two sets can share at most: this token and what either has behind it
    most = F.least(F.col("x.size") - F.col("x.at"), F.col("y.size") - F.col("y.at")) + F.least("x.at", "y.at")
    may = most >= F.ceil((F.col("x.size") + F.col("y.size")) * (SIMILAR / (1 + SIMILAR)) - 1e-9)
    same_cell = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("bucket", "t", "low", "high", "key")]
    met = left.join(right, [*same_cell, once, may])
    shared = F.size(F.array_intersect("x.toks", "y.toks"))
    met = met.where(shared / (F.col("x.size") + F.col("y.size") - shared) >= SIMILAR)
    return met.select(F.least("x.ord", "y.ord").alias("src"), F.greatest("x.ord", "y.ord").alias("dst"))


def item_clusters(products: DataFrame) -> DataFrame:
    """(ord, id, store, per100, component) of all rows linked to another; rows without a price link too. Kinds are compared,
    not rows. Tasks fold the links that they find; what is left goes through connected_components()."""
    scratch = Scratch(products.sparkSession, "crossstore")
    keyed = scratch.write(_sorted_tokens(matching_keys(products)), "keyed")
    kinds = scratch.write(_kinds(keyed), "kinds")
    classes = connected_components(_met(kinds, scratch), scratch.write, scratch.drop).withColumnRenamed("node", "kind")
    # a kind of several rows is linked in itself
    linked = kinds.join(classes, "kind", "left").where("component is not null or n > 1")
    linked = linked.select("h", *KEYS, "toks", F.coalesce("component", "kind").alias("component"))
    return scratch.write(_of_kind(keyed, linked).select("ord", "id", "store", "per100", "component"), "clusters")


def compare_stores(clusters: DataFrame) -> DataFrame:
    """(id, otherStore, otherId, deltaPct, isCheapest): each priced row against the cheapest of any other store.

    Clusters need two priced stores and prices within a factor of two. Equal prices go to the store seen first.
    """
    priced = clusters.where("per100 is not null")
    spread = priced.groupBy("component").agg(F.min("store").alias("a"), F.max("store").alias("z"), F.min("per100").alias("lo"), F.max("per100").alias("hi"))
    fair = spread.where((F.col("a") < F.col("z")) & (F.col("lo") > 0) & (F.col("hi") / F.col("lo") <= MAX_RATIO)).select("component")
    priced = priced.join(fair, "component", "left_semi")
    best = priced.groupBy("component", "store").agg(F.min(F.struct("per100", "ord", "id")).alias("best"), F.min("ord").alias("seen"))
    offers = best.groupBy("component").agg(F.collect_list(F.struct(F.col("best.per100").alias("per100"), "seen", "store", F.col("best.id").alias("id"))).alias("offers"))  # one a store
    others = priced.join(offers, "component").withColumn("other", F.array_min(F.filter("offers", lambda o: o["store"] != F.col("store"))))
    mine, theirs = F.col("per100"), F.col("other.per100")
    cheapest = mine <= theirs
    delta = F.when(cheapest, F.lit(0).cast("long")).otherwise(js_round((mine - theirs) / theirs * 100))
    return others.select("id", F.col("other.store").alias("otherStore"), F.col("other.id").alias("otherId"), delta.alias("deltaPct"), cheapest.alias("isCheapest"))


def price_class() -> Column:
    """cheapest, level (below one percent) or dearer."""
    return F.when(F.col("isCheapest"), "cheapest").when(F.col("deltaPct") < 1, "level").otherwise("dearer")


def side_by_side(products: DataFrame, compared: DataFrame) -> DataFrame:
    """Each compared product with its counterpart."""
    mine = products.select("id", "title", "store", price_per_100g().alias("per100"))
    other = mine.select(F.col("id").alias("otherId"), F.col("title").alias("otherTitle"), F.col("per100").alias("otherPer100"))
    return compared.join(mine, "id").join(other, "otherId", "left").withColumn("lowest", F.least("per100", "otherPer100"))
