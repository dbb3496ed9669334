"""Registered queries over raw store data, each with SQL that computes the same rows from the same numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import metrics, parsing, text
from larder.operators import alternatives, categories, crossstore, facets
from larder.sources import catalog as source
from larder.sources import snapshots, versions
from larder.sources.catalog import PRODUCTS_SQL, derived_products
from larder.sources.storage import Scratch


def _part(spark, sf_dir, **columns: str):
    """Columns made of p_partkey (k) by SQL that both engines know."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"), "p_name")
    return part.select("k", *[F.expr(e).alias(c) for c, e in columns.items()])


K = "(SELECT p_partkey AS k, p_name FROM part)"
R1 = "floor(({}) * 10 + 0.5) / 10"
KJ = "floor(({}) / 4.184 * 10 + 0.5) / 10"

_FACTS = """CASE k % 5 WHEN 0 THEN CAST(k % 900 AS STRING) || '.50ккал' WHEN 1 THEN CAST(k % 90 AS STRING) || ',95г' WHEN 2 THEN CAST(k * 7 % 4000 AS STRING) || ' кДж'
  WHEN 3 THEN 'немає' ELSE CAST(k % 500 AS STRING) || ',' || CAST(k % 10 AS STRING) || '/' || CAST(k % 2000 AS STRING) || ' ккал / kJ' END"""


def parse_numbers(spark, sf_dir):
    n = parsing.first_number(F.col("t"))
    return _part(spark, sf_dir, t=_FACTS).select("k", n.alias("number"), parsing.energy_kcal(F.col("t")).alias("energy"), parsing.repaired_kcal(n).alias("repaired"))


PARSE_NUMBERS_SQL = f"""
WITH n AS (SELECT k, CASE k % 5 WHEN 0 THEN k % 900 + 0.5 WHEN 1 THEN CAST(CAST(k % 90 AS STRING) || '.95' AS DOUBLE) WHEN 2 THEN CAST(k * 7 % 4000 AS DOUBLE)
  WHEN 4 THEN CAST(CAST(k % 500 AS STRING) || '.' || CAST(k % 10 AS STRING) AS DOUBLE) END AS number FROM {K})
SELECT k, number, CASE WHEN k % 5 = 2 THEN {KJ.format('number')} ELSE number END AS energy, CASE WHEN number > 950 THEN {KJ.format('number')} ELSE number END AS repaired FROM n
"""


def parse_nutrition(spark, sf_dir):
    attribute = lambda key, title, code: f"struct(struct('{key}' AS key) AS attribute, struct({title} AS title, {code} AS key) AS value)"
    listed = [attribute("calorie", "CAST(k * 7 % 4000 AS STRING)", "'0'"), attribute("proteins", "CAST(NULL AS STRING)", "CAST(k % 90 AS STRING) || ',5г'"), attribute("other", "'7'", "'7'")]
    fats = f"CASE WHEN k % 3 = 0 THEN array() ELSE array({attribute('fats', 'CAST(k % 50 AS STRING)', 'CAST(NULL AS STRING)')}) END"
    groups = f"array(struct('other' AS key, array({', '.join(listed[:1])}) AS attributes), struct(CASE WHEN k % 7 = 0 THEN 'else' ELSE 'nutrient' END AS key, concat(array({', '.join(listed)}), {fats}) AS attributes))"
    n = _part(spark, sf_dir, g=groups).select("k", parsing.nutrition(F.col("g")).alias("n"))
    return n.select("k", F.col("n").isNotNull().alias("known"), "n.*")


PARSE_NUTRITION_SQL = f"""
SELECT k, k % 7 <> 0 AS known, CASE WHEN k % 7 <> 0 THEN CASE WHEN k * 7 % 4000 > 950 THEN {KJ.format('k * 7 % 4000')} ELSE k * 7 % 4000 END END AS kcal,
  CASE WHEN k % 7 <> 0 THEN k % 90 + 0.5 END AS protein, CASE WHEN k % 7 <> 0 AND k % 3 <> 0 THEN CAST(k % 50 AS DOUBLE) END AS fat, CAST(NULL AS DOUBLE) AS carbs FROM {K}
"""

_SIZE = """CASE k % 7 WHEN 0 THEN CAST(k % 9 + 1 AS STRING) || 'х' || CAST(k % 50 * 5 + 5 AS STRING) || 'г' WHEN 1 THEN CAST(k % 9 + 1 AS STRING) || ' X ' || CAST(k % 50 * 5 + 5 AS STRING) || ' мл'
  WHEN 2 THEN CAST(k % 9 AS STRING) || ',5 л' WHEN 3 THEN CAST(k % 3 AS STRING) || 'кг' WHEN 4 THEN CAST(k % 400 AS STRING) || ' Г' WHEN 5 THEN 'шт' END"""


def parse_sizes(spark, sf_dir):
    return _part(spark, sf_dir, t=_SIZE, loose="CASE WHEN k % 13 = 0 THEN NULL ELSE k % 11 = 0 END").select("k", parsing.parse_size(F.col("t"), F.col("loose")).alias("s")).select("k", "s.*")


PARSE_SIZES_SQL = f"""
SELECT k, CASE WHEN loose THEN 'kg' ELSE 'pcs' END AS unit, CASE WHEN NOT loose AND w > 0 THEN w END AS weight, CASE WHEN NOT loose AND v > 0 THEN v END AS volume
FROM (SELECT k, k % 13 <> 0 AND k % 11 = 0 AS loose, CAST(CASE k % 7 WHEN 0 THEN (k % 9 + 1) * (k % 50 * 5 + 5) WHEN 3 THEN k % 3 * 1000 WHEN 4 THEN k % 400 END AS DOUBLE) AS w,
  CAST(CASE k % 7 WHEN 1 THEN (k % 9 + 1) * (k % 50 * 5 + 5) WHEN 2 THEN (k % 9 + 0.5) * 1000 END AS DOUBLE) AS v FROM {K})
"""


def parse_fields(spark, sf_dir):
    """Slugs, links, kopecks, discounts, stock, images and rounded numbers of a store's own rows."""
    rows = _part(
        spark, sf_dir, slug="CASE WHEN k % 9 = 0 THEN '' WHEN k % 9 = 1 THEN NULL ELSE replace(lower(p_name), ' ', '-') || '-' || CAST(k AS STRING) END", price="CAST(k % 5 - 1 AS DOUBLE)",
        old="CAST(k % 7 AS DOUBLE)", active="CASE WHEN k % 4 = 0 THEN NULL ELSE k % 4 = 1 END", stock="CASE WHEN k % 6 = 0 THEN NULL ELSE k % 3 END", raw="(k * 13 % 997) / 40.0D",
        img="CASE k % 4 WHEN 0 THEN map('s200x200', '', 'main', 'm' || CAST(k AS STRING)) WHEN 1 THEN map('z', 'x', 'y', 'http://y/' || CAST(k AS STRING)) WHEN 3 THEN map('main', 'm', 's350x350', 's') END",
    )
    c = F.col
    return rows.select(
        "k", parsing.slug_key(c("slug")).alias("slug_key"), parsing.product_link("https://shop.example/", c("slug")).alias("link"), parsing.from_kopecks(c("k") * 37).alias("kopecks"),
        parsing.discount_price(c("old"), c("price"), c("active")).alias("discount"), parsing.discount_price(c("old"), c("price")).alias("above"), parsing.usable_price(c("price")).alias("usable"),
        parsing.in_stock_flag(c("active")).alias("flagged"), parsing.in_stock_count(c("stock")).alias("counted"), parsing.pick_image(c("img")).alias("image"), metrics.js_round(c("raw"), 1).alias("rounded"),
    )


PARSE_FIELDS_SQL = f"""
SELECT k, CASE WHEN k % 9 = 0 THEN '' WHEN k % 9 > 1 THEN replace(lower(p_name), ' ', '-') END AS slug_key, CASE WHEN k % 9 > 1 THEN 'https://shop.example/' || replace(lower(p_name), ' ', '-') || '-' || k END AS link,
  k * 37 / 100 AS kopecks, CASE WHEN k % 4 = 1 AND k % 7 > k % 5 - 1 THEN CAST(k % 7 AS DOUBLE) END AS discount, CASE WHEN k % 7 > k % 5 - 1 THEN CAST(k % 7 AS DOUBLE) END AS above,
  CASE WHEN k % 5 > 1 THEN CAST(k % 5 - 1 AS DOUBLE) END AS usable, k % 4 < 2 AS flagged, k % 6 <> 0 AND k % 3 > 0 AS counted,
  CASE k % 4 WHEN 0 THEN 'm' || k WHEN 1 THEN 'http://y/' || k WHEN 3 THEN 's' END AS image, {R1.format('(k * 13 % 997) / 40.0')} AS rounded FROM {K}
"""


def display_labels(spark, sf_dir):
    rows = _part(spark, sf_dir, x="CASE WHEN k % 17 = 0 THEN NULL WHEN k % 17 = 1 THEN -1.0D ELSE (k * 1237 % 9000000) / 8.0D END")
    return rows.select("k", metrics.display_number(F.col("x"), 0).alias("whole"), metrics.display_number(F.col("x"), 1).alias("tenths"), metrics.display_price(F.col("x")).alias("price"))


def _shown(digits: int) -> str:
    unit = 10**digits
    n = f"CAST(floor(x * {unit} + 0.5) AS BIGINT)"
    text = f"replace(format('{{:,}}', {n} // {unit}), ',', chr(160))"
    return text + (f" || CASE WHEN {n} % {unit} > 0 THEN ',' || rtrim(lpad(CAST({n} % {unit} AS VARCHAR), {digits}, '0'), '0') ELSE '' END" if digits else "")


DISPLAY_SQL = f"""
SELECT k, CASE WHEN x >= 0 THEN {_shown(0)} ELSE '—' END AS whole, CASE WHEN x >= 0 THEN {_shown(1)} ELSE '—' END AS tenths, CASE WHEN x >= 0 THEN {_shown(2)} || chr(160) || '₴' ELSE '—' END AS price
FROM (SELECT k, CASE WHEN k % 17 = 0 THEN NULL WHEN k % 17 = 1 THEN -1.0 ELSE (k * 1237 % 9000000) / 8 END AS x FROM {K})
"""

# raw snapshots: ids that repeat or lack, tops that are not mapped, unusable prices, rows without any nutrient
_RAW = """ord AS pos, CASE WHEN ord % 31 = 0 THEN NULL ELSE store || '-' || CAST(CAST(floor(ord / 4) AS BIGINT) AS STRING) END AS id, {top} AS top_id,
  CASE WHEN ord % 13 = 0 THEN -price ELSE price END AS price, oldPrice, CASE WHEN ord % 37 < 5 THEN NULL ELSE kcal + 0.25 END AS kcal, CASE WHEN ord % 37 < 5 THEN NULL ELSE protein END AS protein,
  CASE WHEN ord % 37 < 5 THEN NULL ELSE fat END AS fat, CASE WHEN ord % 37 < 5 THEN NULL ELSE carbs END AS carbs"""
_TOPS = [top for top, _ in snapshots.TOP_TO_UNIFIED[::5]] + ["nowhere", "elsewhere"]
_TOP = "CASE ord % {n} {whens} END".format(n=len(_TOPS) + 1, whens=" ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TOPS)))
_AS_IS = ("store", "title", "path", "weight", "volume", "unit", "brand", "img", "url", "inStock")
_RAW_SQL = f"raw AS (SELECT {', '.join(_AS_IS)}, {_RAW.format(top=_TOP)} FROM ({PRODUCTS_SQL}) p)"
_UNIFIED_SQL = "unified AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in snapshots.TOP_TO_UNIFIED) + ") AS t(top_id, cat))"


def _raw(spark, sf_dir):
    columns = [x.strip() for x in _RAW.format(top=_TOP).split(" AS pos,")]
    rest = "struct(" + columns[1] + ")"
    p = derived_products(spark, sf_dir)
    rows = p.select(*_AS_IS, F.col("ord").alias("pos"), F.expr(rest).alias("r")).select(*_AS_IS, "pos", "r.*")
    return rows.withColumn("top", F.struct(F.col("top_id").alias("id"), F.lit("t").alias("title"))).drop("top_id")


def raw_merge(spark, sf_dir):
    first = snapshots.first_by(snapshots.with_any_nutrient(_raw(spark, sf_dir)), "id", "pos")
    return snapshots.merged_products(first, ["south", "north"]).withColumn("place", F.col("order.pos")).drop("order")


RAW_MERGE_SQL = f"""
WITH {_RAW_SQL}, {_UNIFIED_SQL}, first AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS n FROM raw WHERE id IS NOT NULL AND coalesce(kcal, protein, fat, carbs) IS NOT NULL)
SELECT f.pos AS place, {', '.join('f.' + c for c in _AS_IS)}, f.id, coalesce(u.cat, 'other') AS cat, CASE WHEN f.price > 0 THEN f.price END AS price,
  CASE WHEN f.price > 0 AND f.oldPrice > f.price THEN f.oldPrice END AS oldPrice, {', '.join(R1.format(n) + ' AS ' + n for n in metrics.NUTRIENTS)}
FROM first f LEFT JOIN unified u ON f.top_id = u.top_id WHERE n = 1
"""


def unmapped_sections(spark, sf_dir):
    return snapshots.unmapped_tops(_raw(spark, sf_dir))


UNMAPPED_SQL = f"WITH {_RAW_SQL}, {_UNIFIED_SQL} SELECT r.top_id AS top, count(*) AS n FROM raw r LEFT JOIN unified u ON r.top_id = u.top_id WHERE u.cat IS NULL GROUP BY r.top_id"


def snapshot_documents(spark, sf_dir):
    """Raw products written as JSON documents, read again, checked for both stores and flattened; a broken document is
    passed over."""
    scratch = Scratch(spark, "documents")
    # a document holds at most 500 products
    raw = _raw(spark, sf_dir).select("store", F.floor(F.col("pos") / 500).alias("part"), F.struct(*[F.col(f.split()[0]) for f in snapshots.RAW_PRODUCT.split(", ")]).alias("p"))
    documents = raw.groupBy("store", "part").agg(F.collect_list("p").alias("products")).select("store", F.lit("2026-01-01").alias("generatedAt"), F.size("products").cast("long").alias("totalSeen"), "products")
    documents.write.option("maxRecordsPerFile", 1).json(scratch.path("in"))
    spark.createDataFrame([("{",)], "value string").write.mode("append").text(scratch.path("in"))
    found = snapshots.require_stores(snapshots.read_snapshots(spark, scratch.path("in")), ["north", "south"])
    seen = facets.total_seen(found).select(F.lit("all").alias("store"), F.col("totalSeen").alias("rows"), F.lit(0).cast("long").alias("ids"), F.lit(None).cast("double").alias("kcal"))
    kept = snapshots.raw_products(found).groupBy("store").agg(F.count("*").alias("rows"), F.count("id").alias("ids"), F.max("kcal").alias("kcal"))
    return kept.unionByName(seen)


DOCUMENTS_SQL = f"WITH {_RAW_SQL} SELECT store, count(*) AS rows, count(id) AS ids, max(kcal) AS kcal FROM raw GROUP BY store UNION ALL SELECT 'all', count(*), 0, NULL FROM raw"


def snapshot_files(spark, sf_dir):
    """The three tables of a snapshot, written and read again."""
    path = Scratch(spark, "snapshot").path("out")
    p = derived_products(spark, sf_dir)
    source.write_snapshot(p, facets.category_summary(p), facets.snapshot_stats(p), path)
    products = source.read_products(spark, f"{path}/products")
    categories_ = spark.read.schema("cat string, count long").json(f"{path}/categories").select(F.concat(F.lit("category "), "cat").alias("id"), F.col("count").alias("n"), F.lit(None).cast("double").alias("price"))
    meta = spark.read.schema("store string, totalKept long").json(f"{path}/meta").select(F.concat(F.lit("meta "), F.coalesce("store", F.lit("all"))).alias("id"), F.col("totalKept").alias("n"), F.lit(None).cast("double").alias("price"))
    return products.select("id", F.col("ord").alias("n"), "price").unionByName(categories_).unionByName(meta)


SNAPSHOT_FILES_SQL = f"""
WITH p AS ({PRODUCTS_SQL}) SELECT id, ord AS n, price FROM p UNION ALL SELECT 'category ' || cat, count(*), NULL FROM p GROUP BY cat
UNION ALL SELECT 'meta ' || coalesce(store, 'all'), count(*), NULL FROM p GROUP BY GROUPING SETS ((store), ())
"""


def detail_cache(spark, sf_dir):
    """What is still to fetch, and the cache with what came."""
    ids = _part(spark, sf_dir, id="CAST(k AS STRING)", fat="CASE WHEN k % 4 = 0 THEN NULL ELSE CAST(k % 50 AS DOUBLE) END")
    cache = ids.where("k % 3 = 0").select("id", "fat")
    pending = source.pending_details(ids.select("id"), cache)
    fetched = ids.where("k % 5 = 0").select("id", (F.col("fat") + 100).alias("fat"))
    merged = source.merged_details(cache, fetched)
    return pending.select("id", F.lit("pending").alias("state"), F.lit(None).cast("double").alias("fat")).unionByName(merged.select("id", F.lit("cached").alias("state"), "fat"))


DETAIL_CACHE_SQL = f"""
SELECT CAST(k AS STRING) AS id, 'pending' AS state, CAST(NULL AS DOUBLE) AS fat FROM {K} WHERE k % 3 <> 0
UNION ALL SELECT CAST(k AS STRING), 'cached', CASE WHEN k % 4 <> 0 THEN k % 50 + CASE WHEN k % 5 = 0 THEN 100 ELSE 0 END END FROM {K} WHERE k % 3 = 0 OR k % 5 = 0
"""


def snapshot_versions(spark, sf_dir):
    """The three tables of a catalogue, after an older version and beside one that its writer left half-way."""
    path = Scratch(spark, "versions").path("out")
    p = derived_products(spark, sf_dir)

    def tables(rows):
        return {"products": rows.select("id", "ord", "price"), "categories": facets.category_summary(rows).select("cat", "count"), "meta": facets.snapshot_stats(rows).select("store", "totalKept")}

    versions.write_version(tables(p.where("store = 'north'")), path)
    versions.write_version(tables(p), path)
    started = versions.Versions(spark, path)
    tables(p.limit(0))["products"].write.parquet(f"{path}/{started.folder()}/products")
    got = versions.read_version(spark, path)
    categories_ = got["categories"].select(F.concat(F.lit("category "), "cat").alias("id"), F.col("count").alias("n"), F.lit(None).cast("double").alias("price"))
    meta = got["meta"].select(F.concat(F.lit("meta "), F.coalesce("store", F.lit("all"))).alias("id"), F.col("totalKept").alias("n"), F.lit(None).cast("double").alias("price"))
    return got["products"].select("id", F.col("ord").alias("n"), "price").unionByName(categories_).unionByName(meta)


#: Flushes of the cache below; part k is fetched in the flushes k % 7 and k % 5.
FLUSHES = 7


def detail_runs(spark, sf_dir):
    """A cache after several flushes and merges: what is known, and what is still missing of all parts."""
    cache = versions.DetailCache(spark, Scratch(spark, "details").path("cache"), "double")
    ids = _part(spark, sf_dir, id="CAST(k AS STRING)")
    for i in range(FLUSHES):
        fetched = ids.where(f"(k % 7 = {i} OR k % 5 = {i}) AND k % 11 <> 0")
        cache.flush(fetched.select("id", F.expr(f"CASE WHEN (k + {i}) % 4 <> 0 THEN CAST(k * 10 + {i} AS DOUBLE) END").alias("detail")))
    known = cache.rows().select("id", F.lit("cached").alias("state"), "detail")
    return known.unionByName(cache.missing(ids.select("id")).select("id", F.lit("missing").alias("state"), F.lit(None).cast("double").alias("detail")))


DETAIL_RUNS_SQL = f"""
SELECT CAST(k AS STRING) AS id, CASE WHEN k % 11 = 0 THEN 'missing' ELSE 'cached' END AS state,
  CASE WHEN k % 11 <> 0 AND (k + greatest(k % 7, k % 5)) % 4 <> 0 THEN CAST(k * 10 + greatest(k % 7, k % 5) AS DOUBLE) END AS detail FROM {K}
"""


def _tree(spark, sf_dir):
    region = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.expr("'r' || r_regionkey AS id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("title"))
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.expr("'n' || n_nationkey AS id"), F.expr("'r' || n_regionkey AS parent_id"), F.col("n_name").alias("title"))
    return categories.category_paths(region.unionByName(nation))


def category_resolution(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    own = "'n' || c_nationkey"
    asked = c.selectExpr("c_custkey", f"CASE WHEN c_custkey % 4 = 0 THEN {own} ELSE '?' END AS one", f"CASE WHEN c_custkey % 4 = 1 THEN {own} END AS two", "CASE WHEN c_custkey % 4 < 3 THEN 'r' || c_custkey % 5 END AS three")
    return categories.resolve_category(asked, _tree(spark, sf_dir), "one", "two", "three").select("c_custkey", "path", "top_id", "top_title")


RESOLUTION_SQL = """
SELECT c_custkey, CASE WHEN c_custkey % 4 < 2 THEN r.r_name || ' / ' || n_name WHEN c_custkey % 4 = 2 THEN s.r_name ELSE 'Інше' END AS path,
  CASE WHEN c_custkey % 4 < 2 THEN 'r' || r.r_regionkey WHEN c_custkey % 4 = 2 THEN 'r' || s.r_regionkey ELSE 'other' END AS top_id,
  CASE WHEN c_custkey % 4 < 2 THEN r.r_name WHEN c_custkey % 4 = 2 THEN s.r_name ELSE 'Інше' END AS top_title
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region r ON r.r_regionkey = n_regionkey JOIN region s ON s.r_regionkey = c_custkey % 5
"""


def deep_paths(spark, sf_dir):
    """A tree of 25 levels, and cycles of 7: each part below the one 40 before it."""
    node = _part(spark, sf_dir, id="CAST(k AS STRING)", parent_id="CASE WHEN k % 1000 > 40 THEN CAST(k - 40 AS STRING) WHEN k % 1000 = 0 THEN CAST(k AS STRING) END", title="'t' || CAST(k % 1000 AS STRING)")
    return categories.category_paths(node.select("id", "parent_id", "title")).select("id", "path", "top_id")


DEEP_PATHS_SQL = f"""
WITH RECURSIVE t AS (SELECT CAST(k AS STRING) AS id, k AS top, 't' || k % 1000 AS path FROM {K}
  UNION ALL SELECT id, top - 40, 't' || (top - 40) % 1000 || ' / ' || path FROM t WHERE top % 1000 > 40)
SELECT id, path, CAST(top AS STRING) AS top_id FROM t WHERE top % 1000 <= 40
"""


def category_order(spark, sf_dir):
    summary = facets.category_summary(derived_products(spark, sf_dir))
    dimension = summary.select(F.col("cat").alias("id"), F.upper("cat").alias("title"), F.length("cat").alias("cat_ord"), F.col("cat").alias("c")).drop("c")
    gone = spark.createDataFrame([("none", "NONE", 1)], "id string, title string, cat_ord int")
    return facets.ordered_categories(summary, dimension.unionByName(gone)).select("id", "title", "count", "cat_ord")


CATEGORY_ORDER_SQL = f"SELECT cat AS id, upper(cat) AS title, count(*) AS count, CAST(length(cat) AS INTEGER) AS cat_ord FROM ({PRODUCTS_SQL}) p GROUP BY cat"


def listing_pages(spark, sf_dir):
    """Fetched pages of a store with three products a page, some pages missing, short or fetched twice."""
    item = """named_struct('ean', CASE WHEN k % 29 = 0 THEN '1' ELSE CAST(k AS STRING) END, 'title', p_name, 'category_id', CASE WHEN k % 2 = 0 THEN 'n' || k % 25 ELSE '?' END, 'parent_category_id', 'r' || k % 7, 'price', CAST(k * 3 AS DOUBLE),
      'discount', named_struct('status', k % 3 = 0, 'old_price', CAST(k * 4 AS DOUBLE)), 'weight', 100.0D, 'volume', CAST(NULL AS DOUBLE), 'unit', 'pcs',
      'nutrition_facts', named_struct('ingredient_energy', CASE WHEN k % 11 = 0 THEN NULL ELSE CAST(k % 900 AS STRING) || ' ккал' END, 'ingredient_protein', CASE WHEN k % 11 = 0 THEN '' ELSE '1,5г' END,
        'ingredient_fat', CAST(NULL AS STRING), 'ingredient_carbohydrates', CAST(NULL AS STRING)),
      'producer', named_struct('trademark', CASE WHEN k % 2 = 0 THEN '' ELSE 'T' END), 'img', map('main', 'm' || k), 'web_url', 'u' || k, 'in_stock', CASE WHEN k % 5 = 0 THEN NULL ELSE k % 5 <> 1 END)"""
    rows = _part(spark, sf_dir, item=item, section="'r' || k % 5", n="CAST(floor(k / 5) AS INT)")
    pages = rows.groupBy("section", F.floor(F.col("n") / 3).cast("int").alias("p")).agg(F.array_sort(F.collect_list(F.struct("n", "item")), lambda a, b: a["n"] - b["n"]).alias("items"))
    pages = pages.select("section", F.substring("section", 2, 1).cast("int").alias("section_ord"), (F.col("p") + 1).alias("page"), F.transform("items", lambda x: x["item"]).alias("results"))
    pages = pages.where(~((F.col("section") == "r3") & (F.col("page") == 6)))  # nothing behind it counts
    short = F.when((F.col("section") == "r2") & (F.col("page") == 4), F.slice("results", 1, 2)).otherwise(F.col("results"))
    pages = pages.withColumn("results", short)
    pages = pages.unionByName(pages.where("page = 2"))
    got = snapshots.listed_products(snapshots.listed_items(pages, 3), _tree(spark, sf_dir))
    return got.select("id", "title", "path", F.col("top.id").alias("top"), "price", "oldPrice", "kcal", "protein", "brand", "img", "url", "inStock", F.col("order.page").alias("page"))


LISTING_SQL = """
WITH items AS (SELECT p_partkey AS k, p_name, p_partkey % 5 AS s, CAST(floor(p_partkey / 5) AS INTEGER) AS n FROM part),
placed AS (SELECT *, CAST(floor(n / 3) AS INTEGER) + 1 AS page, row_number() OVER (PARTITION BY s, CAST(floor(n / 3) AS INTEGER) ORDER BY n) AS pos FROM items),
lengths AS (SELECT s, page, max(pos) AS size FROM placed GROUP BY s, page),
ends AS (SELECT s, min(page) AS last FROM lengths WHERE size < 3 OR (s = 2 AND page = 4) GROUP BY s),
listed AS (SELECT p.* FROM placed p LEFT JOIN ends e ON p.s = e.s WHERE p.page <= coalesce(e.last, 1000000000) AND NOT (p.s = 3 AND p.page >= 6) AND NOT (p.s = 2 AND p.page = 4 AND pos > 2)),
coded AS (SELECT *, CASE WHEN k % 29 = 0 THEN '1' ELSE CAST(k AS VARCHAR) END AS id FROM listed WHERE k % 11 <> 0),
first AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s, page, pos) AS turn FROM coded)
SELECT id, p_name AS title, CASE WHEN k % 2 = 0 THEN r.r_name || ' / ' || n_name ELSE coalesce(q.r_name, o.r_name) END AS path, CASE WHEN k % 2 = 0 THEN 'r' || r.r_regionkey ELSE 'r' || coalesce(q.r_regionkey, o.r_regionkey) END AS top,
  k * 3 / 100 AS price, CASE WHEN k % 3 = 0 THEN k * 4 / 100 END AS oldPrice, CAST(k % 900 AS DOUBLE) AS kcal, 1.5 AS protein, CASE WHEN k % 2 = 1 THEN 'T' END AS brand, 'm' || k AS img, 'u' || k AS url,
  k % 5 <> 1 AS inStock, page
FROM first JOIN nation ON n_nationkey = k % 25 JOIN region r ON r.r_regionkey = n_regionkey LEFT JOIN region q ON q.r_regionkey = k % 7 JOIN region o ON o.r_regionkey = s WHERE turn = 1
"""


def kept_alternatives(spark, sf_dir):
    """The ids with an alternative, kept for each store and read for one."""
    path = Scratch(spark, "kept").path("alternatives")
    alternatives.keep_alternatives(derived_products(spark, sf_dir), ["north", "south"], path)
    return alternatives.kept_alternatives(spark, path, "south")


def pair_lookup(spark, sf_dir):
    p = derived_products(spark, sf_dir)
    compared = crossstore.compare_stores(crossstore.item_clusters(p))
    return crossstore.side_by_side(p, compared).select("id", "title", "per100", "otherId", "otherTitle", "otherPer100", "lowest", "deltaPct")


#: Titles as stores write them, beside those of the tables.
WRITTEN = ["Чипси Lay's зі сметаною 133г", "М'ясо ' Lay's", "ʼ ' джакобс щука", "Їжа ЄҐ ьъ подъезд", "Йогурт Активіа 2,7%"]


def surface_tokens(spark, sf_dir):
    written = spark.createDataFrame([(t,) for t in WRITTEN], "t string").unionByName(derived_products(spark, sf_dir).select(F.concat_ws(" ", "title", "brand").alias("t")))
    words = written.select(F.explode(text.surface_col(F.col("t"))).alias("w")).select("w.folded", "w.surface").distinct()
    return words.select("folded", "surface", text.latin_col(F.col("folded")).alias("latin"), F.col("folded").rlike("[а-я]").alias("cyrillic"))


def _latin_sql(folded: str) -> str:
    out = f"replace({folded}, 'дж', 'j')"
    for cyrillic, latin in text.LATIN.items():
        out = f"replace({out}, '{cyrillic}', '{latin}')"
    return out


_QUOTED = text.SURFACE_TOKEN.replace("'", "''")
_FOLDED = "translate(lower(s), '{}', '{}')".format((text.FOLDED_FROM + text.DROPPED).replace("'", "''"), text.FOLDED_TO)
SURFACE_SQL = f"""
WITH t AS (SELECT title || coalesce(' ' || brand, '') AS t FROM ({PRODUCTS_SQL}) p UNION ALL SELECT * FROM (VALUES {', '.join("('" + w.replace("'", "''") + "')" for w in WRITTEN)}) v(t)),
w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(t), '{_QUOTED}')) AS s FROM t), f AS (SELECT s, {_FOLDED} AS folded FROM w)
SELECT folded, s AS surface, {_latin_sql('folded')} AS latin, regexp_matches(folded, '[а-я]') AS cyrillic FROM f WHERE folded <> ''
"""


def queries_sql(with_alternatives, with_pairs) -> dict:
    """name: (query, SQL); the arguments build on SQL of larder.plans.queries."""
    return {
        "parse_numbers": (parse_numbers, PARSE_NUMBERS_SQL), "parse_nutrition": (parse_nutrition, PARSE_NUTRITION_SQL), "parse_sizes": (parse_sizes, PARSE_SIZES_SQL), "parse_fields": (parse_fields, PARSE_FIELDS_SQL),
        "display_labels": (display_labels, DISPLAY_SQL), "raw_merge": (raw_merge, RAW_MERGE_SQL), "unmapped_sections": (unmapped_sections, UNMAPPED_SQL), "snapshot_documents": (snapshot_documents, DOCUMENTS_SQL),
        "snapshot_files": (snapshot_files, SNAPSHOT_FILES_SQL), "detail_cache": (detail_cache, DETAIL_CACHE_SQL), "snapshot_versions": (snapshot_versions, SNAPSHOT_FILES_SQL), "detail_runs": (detail_runs, DETAIL_RUNS_SQL), "category_resolution": (category_resolution, RESOLUTION_SQL), "deep_paths": (deep_paths, DEEP_PATHS_SQL),
        "category_order": (category_order, CATEGORY_ORDER_SQL), "listing_pages": (listing_pages, LISTING_SQL), "surface_tokens": (surface_tokens, SURFACE_SQL),
        "kept_alternatives": (kept_alternatives, with_alternatives("SELECT DISTINCT s.id FROM s JOIN c ON s.cat = c.cat AND s.id <> c.id AND c.store = 'south' AND c.density >= s.density * 1.2 WHERE list_has_any(s.toks, c.toks)")),
        "pair_lookup": (pair_lookup, with_pairs("SELECT f.id, a.title, a.per100, f.otherId, b.title AS otherTitle, b.per100 AS otherPer100, least(a.per100, b.per100) AS lowest, f.deltaPct FROM final f JOIN p a ON a.id = f.id JOIN p b ON b.id = f.otherId")),
    }
