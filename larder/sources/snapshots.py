"""Raw store snapshots: JSON documents with nested products, merged to one product table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.functions.metrics import js_round
from larder.functions.parsing import discount_price, energy_kcal, first_number, from_kopecks, in_stock_flag, pick_image, usable_price
from larder.operators.categories import resolve_category

RAW_PRODUCT = (
    "id string, title string, top struct<id:string,title:string>, path string, price double, oldPrice double, weight double, volume double, unit string, "
    "kcal double, protein double, fat double, carbs double, brand string, img string, url string, inStock boolean"
)
SNAPSHOT = f"store string, title string, storeRef string, generatedAt string, totalSeen bigint, products array<struct<{', '.join(f.replace(' ', ':', 1) for f in RAW_PRODUCT.split(', '))}>>"

# The unified categories in display order.
UNIFIED = [
    ("fruits-vegetables", "Фрукти та овочі"), ("meat", "М'ясо та ковбаси"), ("fish", "Риба та морепродукти"), ("dairy-eggs", "Молочне, сири та яйця"),
    ("bakery", "Хліб та випічка"), ("grocery", "Бакалія та консерви"), ("sweets", "Солодощі"), ("snacks", "Чипси та снеки"), ("sauces", "Соуси та спеції"),
    ("drinks", "Напої"), ("coffee-tea", "Кава та чай"), ("frozen", "Заморозка"), ("ready-meals", "Кулінарія"), ("healthy", "Здорове харчування"),
    ("baby", "Дитяче харчування"), ("alcohol", "Алкоголь"), ("pets", "Товари для тварин"), ("other", "Інше"),
]
# A store's own top category and its unified one.
TOP_TO_UNIFIED = [
    ("fruits-and-vegetables-auchan", "fruits-vegetables"), ("meat-fish-poultry-auchan", "meat"), ("fish-and-seafood-auchan", "fish"),
    ("dairy-and-eggs-auchan", "dairy-eggs"), ("bakery-auchan", "bakery"), ("grocery-and-sweets-auchan", "grocery"), ("canned-food-auchan", "grocery"),
    ("world-cuisine-auchan", "grocery"), ("sweets-and-snacks-auchan", "sweets"), ("crisps-and-snacks-auchan", "snacks"), ("sauces-and-spices-auchan", "sauces"),
    ("drinks-auchan", "drinks"), ("hot-drinks-auchan", "coffee-tea"), ("frozen-auchan", "frozen"), ("ready-meals-auchan", "ready-meals"),
    ("bioproducts-and-diabetic-goods-auchan", "healthy"), ("babies-auchan", "baby"), ("eighteen-plus-auchan", "alcohol"), ("for-animals-auchan", "pets"),
    ("frukty-ovochi", "fruits-vegetables"), ("m-iaso", "meat"), ("kovbasni-vyroby-i-m-iasni-delikatesy", "meat"), ("ryba", "fish"),
    ("molochni-produkty-ta-iaitsia", "dairy-eggs"), ("syry", "dairy-eggs"), ("khlib-ta-vypichka", "bakery"), ("bakaliia-i-konservy", "grocery"),
    ("solodoshchi", "sweets"), ("sneky-ta-chypsy", "snacks"), ("sousy-i-spetsii", "sauces"), ("napoi", "drinks"), ("kava-chai", "coffee-tea"),
    ("zamorozhena-produktsiia", "frozen"), ("gotovi-stravy-i-kulinariia", "ready-meals"), ("zdorove-kharchuvannia", "healthy"), ("bady", "healthy"),
    ("dytiachi-tovary", "baby"), ("alkogol", "alcohol"), ("dlia-tvaryn", "pets"),
]
# The top sections that hold food, and the one of which only the children about food count.
FOOD_SECTIONS = [
    "frukty-ovochi", "m-iaso", "ryba", "kovbasni-vyroby-i-m-iasni-delikatesy", "syry", "khlib-ta-vypichka", "gotovi-stravy-i-kulinariia",
    "molochni-produkty-ta-iaitsia", "bady", "zdorove-kharchuvannia", "bakaliia-i-konservy", "sousy-i-spetsii", "solodoshchi", "sneky-ta-chypsy",
    "kava-chai", "napoi", "zamorozhena-produktsiia", "alkogol", "dlia-tvaryn",
]
PARTLY_FOOD, FOOD_TITLE = "dytiachi-tovary", "(?iu)харчуванн"


#: Products a listing page holds; a shorter one is the last.
PER_PAGE = 100
_ITEM = (
    "ean:string,title:string,category_id:string,parent_category_id:string,price:double,discount:struct<status:boolean,old_price:double>,weight:double,volume:double,"
    "unit:string,nutrition_facts:struct<ingredient_energy:string,ingredient_protein:string,ingredient_fat:string,ingredient_carbohydrates:string>,"
    "producer:struct<trademark:string>,img:map<string,string>,web_url:string,in_stock:boolean"
)
#: A listing page as fetched: the section, its place among the sections, the page from 1.
PAGE = f"section string, section_ord int, page int, results array<struct<{_ITEM}>>"


def listed_items(pages: DataFrame, per_page: int = PER_PAGE) -> DataFrame:
    """(section, section_ord, page, pos, item) of the listing pages (PAGE): a section goes on until its first page that is
    missing, empty or short; what lies behind that is not part of the listing. Pages fetched twice count once."""
    once = first_by(pages.withColumn("__page", F.struct("section", "page")), "__page", F.desc(F.size("results"))).drop("__page")
    so_far = Window.partitionBy("section").orderBy("page")
    full = F.size("results") >= per_page
    known = once.withColumns({"n": F.row_number().over(so_far), "short": F.coalesce(F.max(~full).over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))})
    return known.where((F.col("n") == F.col("page")) & ~F.col("short")).select("section", "section_ord", "page", F.posexplode("results").alias("pos", "item"))


def listed_products(items: DataFrame, paths: DataFrame) -> DataFrame:
    """RAW_PRODUCT rows of listed_items() with their place (order): prices in kopecks, texts as typed, categories by
    ``paths`` (id, path, top_id, top_title). Rows without any nutrient are left out; of rows that repeat a code the first
    in the order of the sections counts."""
    facts = {n: F.col(f"item.nutrition_facts.ingredient_{f}") for n, f in (("kcal", "energy"), ("protein", "protein"), ("fat", "fat"), ("carbs", "carbohydrates"))}
    parsed = {n: (energy_kcal if n == "kcal" else first_number)(c) for n, c in facts.items()}
    rows = items.select(
        F.struct("section_ord", "page", "pos").alias("order"), F.col("item.ean").alias("id"), F.col("item.title").alias("title"), "section", F.col("item.category_id").alias("one"),
        F.col("item.parent_category_id").alias("two"), from_kopecks(F.col("item.price")).alias("price"),
        from_kopecks(discount_price(F.col("item.discount.old_price"), F.col("item.price"), F.col("item.discount.status"))).alias("oldPrice"), *[F.col(f"item.{c}").alias(c) for c in ("weight", "volume", "unit")],
        *[v.alias(n) for n, v in parsed.items()], F.nullif("item.producer.trademark", F.lit("")).alias("brand"), pick_image(F.col("item.img")).alias("img"),
        F.nullif("item.web_url", F.lit("")).alias("url"), in_stock_flag(F.col("item.in_stock")).alias("inStock"),
    )
    first = first_by(with_any_nutrient(rows), "id", "order")
    placed = resolve_category(first, paths, "one", "two", "section")
    return placed.withColumn("top", F.struct(F.col("top_id").alias("id"), F.col("top_title").alias("title"))).drop("one", "two", "section", "top_id", "top_title")


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot documents below a path; a corrupt document is a row of nulls and is left out."""
    return spark.read.schema(SNAPSHOT).option("multiLine", True).json(path).where("store is not null")


def require_stores(snapshots: DataFrame, stores: list[str], allow_partial: bool = False) -> DataFrame:
    """The snapshots, once each of ``stores`` has products; otherwise an error, unless partial data are allowed."""
    full = snapshots.where(F.size("products") > 0).select("store").where(F.col("store").isin(stores)).distinct()
    missing = sorted(set(stores) - {r[0] for r in full.collect()})
    if missing and not allow_partial:
        raise ValueError(f"no products from {', '.join(missing)}")
    return snapshots


def raw_products(snapshots: DataFrame) -> DataFrame:
    """One row a product, with its store and position in the document."""
    return snapshots.select("store", F.posexplode("products").alias("pos", "p")).select("store", "pos", "p.*")


def first_by(df: DataFrame, key: str, order: str | Column) -> DataFrame:
    """The first row of each key; rows without a key are dropped."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.where(F.col(key).isNotNull()).withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def with_any_nutrient(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce("kcal", "protein", "fat", "carbs").isNotNull())


def _mapped(raw: DataFrame, top) -> DataFrame:
    table = raw.sparkSession.createDataFrame(TOP_TO_UNIFIED, "top_id string, unified string")
    return raw.join(F.broadcast(table), top == F.col("top_id"), "left")  # as many rows as the list above


def merged_products(raw: DataFrame, stores: list[str]) -> DataFrame:
    """The unified product table of raw products (store, pos, RAW_PRODUCT): stores in the order given, then by position."""
    price = usable_price(F.col("price"))
    ordered = F.struct(F.array_position(F.array(*map(F.lit, stores)), F.col("store")), "pos")
    return _mapped(raw, F.col("top.id")).select(
        ordered.alias("order"), "id", "store", "title", F.coalesce("unified", F.lit("other")).alias("cat"), "path", price.alias("price"),
        discount_price(F.col("oldPrice"), price).alias("oldPrice"), "weight", "volume", "unit", *[js_round(F.col(n), 1).alias(n) for n in ("kcal", "protein", "fat", "carbs")],
        "brand", "img", "url", "inStock",
    )


def unmapped_tops(raw: DataFrame) -> DataFrame:
    return _mapped(raw, F.col("top.id")).where("unified is null").groupBy(F.col("top.id").alias("top")).agg(F.count("*").alias("n"))


def food_sections(categories: DataFrame) -> DataFrame:
    """Of (id, slug, parent_id, title): the food sections, and the children about food of the partly edible one."""
    key = F.regexp_replace("slug", "-[0-9]+$", "")
    sections = categories.where(key.isin(FOOD_SECTIONS) & F.col("parent_id").isNull())
    partly = categories.where((key == PARTLY_FOOD) & F.col("parent_id").isNull()).select(F.col("id").alias("parent_id"))
    return sections.unionByName(categories.join(partly, "parent_id", "left_semi").where(F.col("title").rlike(FOOD_TITLE)).select(*categories.columns))
