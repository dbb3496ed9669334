"""Registered queries over the derived catalogue, each with SQL that must give the same rows."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from larder.functions import metrics
from larder.functions.text import fold, tokens_col
from larder.operators import alternatives, categories, crossstore, facets, filters, ordering, search
from larder.plans import catalog, raw_queries, search_queries
from larder.plans.expressions import FOLD, TOKENS
from larder.plans.request import PRESETS, CatalogQuery
from larder.sources.catalog import PRODUCTS_SQL, derived_products
from larder.sources.snapshots import first_by
from larder.sources.storage import spread

ANY = CatalogQuery(store="all", preset=None, in_stock_only=False, hide_pets=False)

PER100 = "CASE WHEN price > 0 THEN CASE WHEN unit IN ('kg', 'l') THEN price / 10 ELSE price * 100 / (CASE WHEN weight > 0 THEN weight WHEN volume > 0 THEN volume END) END END"
DENSITY = "CASE WHEN kcal > 0 THEN protein / kcal * 100 END"
PER_PROTEIN = f"CASE WHEN protein > 0 THEN ({PER100}) * 100 / protein END"
PLAUSIBLE = """CASE WHEN kcal IS NULL OR protein IS NULL OR fat IS NULL OR carbs IS NULL THEN true WHEN kcal < 0 OR protein < 0 OR fat < 0 OR carbs < 0 THEN false
  WHEN kcal < 5 THEN true ELSE abs(protein * 4 + fat * 9 + carbs * 4 - kcal) / kcal <= 0.5 END"""


def _with(body: str) -> str:
    """The query over ``p``: the catalogue with its metrics."""
    return f"WITH RECURSIVE products AS ({PRODUCTS_SQL}), p AS (SELECT *, {PER100} AS per100, {DENSITY} AS density, {PER_PROTEIN} AS per_protein FROM products) {body}"


def _rows_sql(where: str, key: str, down: bool) -> str:
    return _with(f"SELECT id, title, row_number() OVER (ORDER BY {key} {'DESC' if down else 'ASC'} NULLS LAST, ord) AS rank FROM p WHERE {where}")


def _rows(request: CatalogQuery):
    return lambda spark, sf_dir: catalog.run(derived_products(spark, sf_dir), request).rows(columns=("id", "title")).select("id", "title", "rank")


def metrics_all(spark, sf_dir):
    p = metrics.with_metrics(derived_products(spark, sf_dir))
    return p.select("id", "per100", "density", "per_protein", metrics.nutrient_value("protein", "pack").alias("pack_protein"), metrics.is_plausible().alias("plausible"))


def labels(spark, sf_dir):
    return derived_products(spark, sf_dir).select("id", metrics.display_size().alias("size_label"))


def facet_counts(spark, sf_dir):
    return catalog.run(derived_products(spark, sf_dir), replace(ANY, hide_pets=True)).hits()


def category_summary(spark, sf_dir):
    s = facets.category_summary(derived_products(spark, sf_dir))
    return s.select("cat", "count", F.coalesce(s.counts["north"], F.lit(0)).alias("north"), F.coalesce(s.counts["south"], F.lit(0)).alias("south"), "img")


def category_blocks(spark, sf_dir):
    p = derived_products(spark, sf_dir)
    summary = facets.category_summary(p)
    dimension = summary.select(F.col("cat").alias("id"), F.col("cat").alias("title"), "count", "counts", F.lit(0).alias("cat_ord"))
    shown = filters.visible_categories(dimension, "north", True)
    hits = catalog.run(p, replace(ANY, store="north", in_stock_only=True)).hits()
    return facets.category_blocks(hits, shown).select("id", "hits")


def dedupe_first(spark, sf_dir):
    return first_by(derived_products(spark, sf_dir), "title", "ord").select("title", "id")


def fold_tokens(spark, sf_dir):
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", F.size(tokens_col(F.col("text"))).cast("long").alias("n_tokens"), F.md5(F.array_join(tokens_col(F.col("text")), " ")).alias("tokens_md5"))


def vocab_counts(spark, sf_dir):
    p = derived_products(spark, sf_dir)
    return p.select(F.explode(F.array_distinct(tokens_col(F.concat_ws(" ", "title", "brand", "path")))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def matching_keys(spark, sf_dir):
    p = derived_products(spark, sf_dir)
    return p.select("id", crossstore.size_key().alias("size"), crossstore.percent_key(F.col("title")).alias("pct"), crossstore.pack_count(F.col("title")).alias("cnt"))


def _search(query: str, fuzzy: bool):
    def run(spark, sf_dir):
        p = derived_products(spark, sf_dir)
        return search.search(p, search.build_index(p), query, fuzzy).select("id", "title")

    return run


def suggest_terms(spark, sf_dir):
    index = search.build_index(derived_products(spark, sf_dir))
    return search.suggestion_table(index, fold("widgit"))


def crossstore_edges(spark, sf_dir):
    return crossstore.similar_pairs(crossstore.matching_keys(derived_products(spark, sf_dir)))


def crossstore_clusters(spark, sf_dir):
    return crossstore.item_clusters(derived_products(spark, sf_dir)).select("id", "component")


def crossstore_compare(spark, sf_dir):
    c = crossstore.compare_stores(crossstore.item_clusters(derived_products(spark, sf_dir)))
    return c.withColumn("label", crossstore.price_class())


def cheaper_elsewhere(spark, sf_dir):
    p = derived_products(spark, sf_dir)
    c = crossstore.compare_stores(crossstore.item_clusters(p))
    return catalog.filtered(p, replace(ANY, cheaper_only=True), compared=c).select("id")


def alternatives_top5(spark, sf_dir):
    return alternatives.alternatives(derived_products(spark, sf_dir))


def has_alternative(spark, sf_dir):
    return alternatives.has_alternative(derived_products(spark, sf_dir), "north")


def category_paths(spark, sf_dir):
    region = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("title"))
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent_id"), F.col("n_name").alias("title")
    )
    return categories.category_paths(region.unionByName(nation))


def snapshot_stats(spark, sf_dir):
    return facets.snapshot_stats(derived_products(spark, sf_dir))


_PRESET_WHERE = {
    "cheap-protein": "protein >= 8 AND density >= 6",
    "filling": "protein >= 7 AND kcal >= 25 AND kcal <= 150",
    "lean": "protein >= 12 AND fat <= 5 AND density >= 6",
    "volume": "protein >= 3 AND kcal >= 15 AND kcal <= 80",
}
_KEY_SQL = {"pricePerProtein": "per_protein", "proteinPerKcal": "density", "kcal": "kcal"}

_MATCH_SQL = f"""
, k0 AS (SELECT ord, id, store, per100, title,
    CASE WHEN brand <> '' AND {FOLD.format('brand')} NOT IN ('без тм', 'no name', 'noname', 'без бренду', 'власна марка') THEN {FOLD.format('brand')} END AS b,
    CASE WHEN unit IN ('kg', 'l') THEN 'bulk' ELSE 'g' || CAST(CAST(floor(CASE WHEN weight > 0 THEN weight WHEN volume > 0 THEN volume END + 0.5) AS BIGINT) AS VARCHAR) END AS size,
    array_to_string(list_sort(list_transform(regexp_extract_all(title, '[0-9]+(?:[.,][0-9]+)?\\s*%'), lambda x: replace(regexp_replace(x, '[\\s%]', '', 'g'), ',', '.'))), ',') AS pct,
    CASE WHEN regexp_matches(title, '[0-9]+\\s*шт') THEN 'n' || regexp_extract(title, '([0-9]+)\\s*шт', 1) WHEN regexp_matches(title, '[0-9]+\\s*[*xх×]') THEN 'n' || regexp_extract(title, '([0-9]+)\\s*[*xх×]', 1)
      WHEN regexp_matches(title, '[*xх×]\\s*[0-9]+') THEN 'n' || regexp_extract(title, '[*xх×]\\s*([0-9]+)', 1) ELSE '' END AS cnt,
    list_distinct(list_filter({TOKENS.format('title')}, lambda t: NOT coalesce(list_contains({TOKENS.format('brand')}, t), false)
      AND t NOT IN ({', '.join("'" + fold(w) + "'" for w in crossstore.STOPWORDS)}) AND NOT regexp_matches(t, '^[0-9]+(г|кг|мл|л|шт)?$'))) AS toks
  FROM p)
, keyed AS (SELECT * FROM k0 WHERE b IS NOT NULL AND size IS NOT NULL)
, edges AS (SELECT x.ord AS src, y.ord AS dst FROM keyed x JOIN keyed y ON x.b = y.b AND x.size = y.size AND x.pct = y.pct AND x.cnt = y.cnt AND x.ord < y.ord
    JOIN (SELECT b, size, pct, cnt FROM keyed GROUP BY ALL HAVING count(DISTINCT store) >= 2) w ON x.b = w.b AND x.size = w.size AND x.pct = w.pct AND x.cnt = w.cnt
    WHERE len(x.toks) > 0 AND len(y.toks) > 0 AND len(list_intersect(x.toks, y.toks)) / (len(x.toks) + len(y.toks) - len(list_intersect(x.toks, y.toks))) >= 0.6)
, both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)
, reach AS (SELECT src AS a, src AS z FROM both_ways UNION SELECT r.a, e.dst FROM reach r JOIN both_ways e ON r.z = e.src)
, clusters AS (SELECT k.id, k.ord, k.store, k.per100, c.component FROM (SELECT a, min(z) AS component FROM reach GROUP BY a) c JOIN keyed k ON k.ord = c.a)
, priced AS (SELECT * FROM clusters WHERE per100 IS NOT NULL AND component IN (SELECT component FROM clusters WHERE per100 IS NOT NULL GROUP BY component
    HAVING count(DISTINCT store) >= 2 AND min(per100) > 0 AND max(per100) / min(per100) <= 2))
, best AS (SELECT component, store, arg_min(id, {{'p': per100, 'o': ord}}) AS id, min(per100) AS per100, min(ord) AS seen FROM priced GROUP BY component, store)
, compared AS (SELECT p1.id, arg_min(b.store, {{'p': b.per100, 's': b.seen}}) AS otherStore, arg_min(b.id, {{'p': b.per100, 's': b.seen}}) AS otherId, any_value(p1.per100) AS mine, min(b.per100) AS theirs
    FROM priced p1 JOIN best b ON p1.component = b.component AND p1.store <> b.store GROUP BY p1.id)
, final AS (SELECT id, otherStore, otherId, CASE WHEN mine <= theirs THEN 0 ELSE CAST(floor((mine - theirs) / theirs * 100 + 0.5) AS BIGINT) END AS deltaPct, mine <= theirs AS isCheapest FROM compared)
"""
_STOP = ", ".join(f"'{w}'" for w in alternatives.STOPWORDS)
_ALT_SQL = f"""
, a AS (SELECT ord, id, store, cat, kcal, inStock, density, per_protein AS ppp, list_distinct(list_filter({TOKENS.format('title')}, lambda t: NOT coalesce(list_contains({TOKENS.format('brand')}, t), false)
    AND t NOT IN ({_STOP}) AND NOT regexp_matches(t, '^[0-9]+(г|кг|мл|л|шт)?$') AND NOT regexp_matches(t, '{alternatives.DESCRIPTOR}'))) AS toks FROM p)
, s AS (SELECT * FROM a WHERE density IS NOT NULL AND kcal IS NOT NULL AND len(toks) > 0)
, c AS (SELECT * FROM s WHERE inStock AND kcal >= 15)
"""


def _with_part(part: str, body: str) -> str:
    return _with(part + body)


QUERIES = {
    "metrics_all": (metrics_all, _with(f"SELECT id, per100, density, per_protein, protein * (CASE WHEN weight > 0 THEN weight WHEN volume > 0 THEN volume END) / 100 AS pack_protein, {PLAUSIBLE} AS plausible FROM p")),
    "landing": (_rows(CatalogQuery.landing("north")), _rows_sql(f"store = 'north' AND inStock AND cat <> 'pets' AND {_PRESET_WHERE['cheap-protein']}", "per_protein", False)),
    **{
        f"preset_{k.replace('-', '_')}": (_rows(ANY.with_preset(k)), _rows_sql(_PRESET_WHERE[k], _KEY_SQL[PRESETS[k]["sort"][0]], PRESETS[k]["sort"][1] == "desc"))
        for k in PRESETS
    },
    "filter_discount": (_rows(replace(ANY, discount_only=True)), _rows_sql("oldPrice IS NOT NULL", "per_protein", False)),
    "filter_complete": (_rows(replace(ANY, complete_only=True)), _rows_sql("kcal IS NOT NULL AND protein IS NOT NULL AND fat IS NOT NULL AND carbs IS NOT NULL", "per_protein", False)),
    "filter_plausible": (_rows(replace(ANY, plausible_only=True)), _rows_sql(PLAUSIBLE, "per_protein", False)),
    "filter_price_range": (_rows(replace(ANY, price=("1000", "1500,5"))), _rows_sql("price >= 1000 AND price <= 1500.5", "per_protein", False)),
    "filter_brand": (_rows(replace(ANY, brand="Brand#3")), _rows_sql("brand = 'Brand#3'", "per_protein", False)),
    "filter_store": (_rows(replace(ANY, store="south")), _rows_sql("store = 'south'", "per_protein", False)),
    "filter_category": (_rows(replace(ANY, category="economy")), _rows_sql("cat = 'economy'", "per_protein", False)),
    "filter_density": (_rows(replace(ANY, min_density="12,5")), _rows_sql("density >= 12.5", "per_protein", False)),
    "sort_pack_basis": (_rows(replace(ANY, basis="pack", sort=("protein", "desc"))), _rows_sql("true", "protein * (CASE WHEN weight > 0 THEN weight WHEN volume > 0 THEN volume END) / 100", True)),
    "sort_per100": (_rows(replace(ANY, sort=("pricePer100", "asc"))), _rows_sql("true", "per100", False)),
    "sort_price_desc": (_rows(replace(ANY, sort=("price", "desc"))), _rows_sql("true", "price", True)),
    "sort_title_uk": (_rows(replace(ANY, sort=("title", "asc"))), _rows_sql("true", "title COLLATE uk", False)),
    "size_labels": (
        labels,
        _with("SELECT id, CASE WHEN unit = 'kg' THEN 'за кг' WHEN unit = 'l' THEN 'за л' WHEN weight > 0 THEN CAST(CAST(weight AS INTEGER) AS VARCHAR) || chr(160) || 'г' WHEN volume > 0 THEN CAST(CAST(volume AS INTEGER) AS VARCHAR) || chr(160) || 'мл' ELSE 'шт' END AS size_label FROM p"),
    ),
    "facet_counts": (facet_counts, _with("SELECT cat, count(*) AS hits FROM p WHERE cat <> 'pets' GROUP BY cat")),
    "category_blocks": (category_blocks, _with("SELECT cat AS id, count(*) AS hits FROM p WHERE store = 'north' AND inStock AND cat <> 'pets' GROUP BY cat")),
    "category_summary": (
        category_summary,
        _with("SELECT cat, count(*) AS count, count(*) FILTER (store = 'north') AS north, count(*) FILTER (store = 'south') AS south, arg_min(img, {'n': length(title), 'o': ord}) FILTER (inStock AND img <> '') AS img FROM p GROUP BY cat"),
    ),
    "snapshot_stats": (
        snapshot_stats,
        _with("SELECT store, count(*) AS totalKept, count(kcal) AS withKcal, count(protein) AS withProtein, count(fat) AS withFat, count(carbs) AS withCarbs, count(*) FILTER (kcal IS NOT NULL AND protein IS NOT NULL AND fat IS NOT NULL AND carbs IS NOT NULL) AS full4, count(oldPrice) AS withDiscount FROM p GROUP BY GROUPING SETS ((store), ())"),
    ),
    "dedupe_first": (dedupe_first, _with("SELECT title, arg_min(id, ord) AS id FROM p GROUP BY title")),
    "fold_tokens": (fold_tokens, f"SELECT doc_id, len({TOKENS.format('text')}) AS n_tokens, md5(array_to_string({TOKENS.format('text')}, ' ')) AS tokens_md5 FROM documents"),
    "vocab_counts": (vocab_counts, _with(f"SELECT token, count(*) AS n FROM (SELECT unnest(list_distinct({TOKENS.format(chr(32).join(['concat_ws(chr(32), title, brand, path)']))})) AS token FROM p) GROUP BY token")),
    "size_pct_pack_keys": (matching_keys, _with_part(_MATCH_SQL, "SELECT id, size, pct, cnt FROM k0")),
    "search_exact_prefix": (_search("widg red", False), _with(f"SELECT id, title FROM p WHERE len(list_filter({TOKENS.format('concat_ws(chr(32), title, brand, path)')}, lambda t: starts_with(t, 'wиdg'))) > 0 AND len(list_filter({TOKENS.format('concat_ws(chr(32), title, brand, path)')}, lambda t: starts_with(t, 'red'))) > 0")),
    # of the words of these titles only one is within reach of the first
    "search_fuzzy": (_search("widgte молода", True), _with("SELECT id, title FROM p WHERE contains(title, 'widget') AND contains(title, ' молода')")),
    "suggest_terms": (suggest_terms, "SELECT 'widget' AS display, CAST(1 AS DOUBLE) AS dist"),
    "crossstore_edges": (crossstore_edges, _with_part(_MATCH_SQL, "SELECT src, dst FROM edges")),
    "crossstore_clusters": (crossstore_clusters, _with_part(_MATCH_SQL, "SELECT id, component FROM clusters")),
    "crossstore_compare": (crossstore_compare, _with_part(_MATCH_SQL, "SELECT *, CASE WHEN isCheapest THEN 'cheapest' WHEN deltaPct < 1 THEN 'level' ELSE 'dearer' END AS label FROM final")),
    "cheaper_elsewhere": (cheaper_elsewhere, _with_part(_MATCH_SQL, "SELECT id FROM final WHERE NOT isCheapest AND deltaPct >= 1")),
    "alternatives_top5": (
        alternatives_top5,
        _with_part(_ALT_SQL, """SELECT source_id, rank, id, shared, density, cheaper FROM (SELECT s.id AS source_id, c.id, len(list_intersect(s.toks, c.toks)) AS shared, c.density, CASE WHEN s.ppp IS NOT NULL AND c.ppp IS NOT NULL THEN c.ppp <= s.ppp END AS cheaper,
          row_number() OVER (PARTITION BY s.id ORDER BY len(list_intersect(s.toks, c.toks)) DESC, c.density DESC, c.ord) AS rank
          FROM s JOIN c ON s.cat = c.cat AND s.id <> c.id AND c.density >= s.density * 1.2 WHERE list_has_any(s.toks, c.toks)) WHERE rank <= 5"""),
    ),
    "has_alternative": (has_alternative, _with_part(_ALT_SQL, "SELECT DISTINCT s.id FROM s JOIN c ON s.cat = c.cat AND s.id <> c.id AND c.store = 'north' AND c.density >= s.density * 1.2 WHERE list_has_any(s.toks, c.toks)")),
    "category_paths": (category_paths, "SELECT 'r' || r_regionkey AS id, r_name AS path, 'r' || r_regionkey AS top_id, r_name AS top_title FROM region UNION ALL SELECT 'n' || n_nationkey, r_name || ' / ' || n_name, 'r' || r_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
}


QUERIES |= search_queries.QUERIES
QUERIES |= raw_queries.queries_sql(lambda body: _with_part(_ALT_SQL, body), lambda body: _with_part(_MATCH_SQL, body))


def queries():
    return {name: run for name, (run, _) in QUERIES.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
