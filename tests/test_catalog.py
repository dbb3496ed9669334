import pytest
from pyspark.sql import functions as F

from larder.functions import metrics, parsing
from larder.operators import alternatives, categories, crossstore, facets, filters, ordering
from larder.plans import catalog
from larder.plans.request import CatalogQuery, load_history, number, pushed, shown
from larder.sources import catalog as source
from larder.sources import snapshots

DEFAULTS = {"store": "auchan", "title": "товар", "cat": "dairy-eggs", "path": "", "price": 10.0, "weight": 100.0, "unit": "pcs", "inStock": True}


def products(spark, *rows, **common):
    full = [tuple({**dict.fromkeys(source.FIELDS), **DEFAULTS, "ord": i, "id": f"p{i}", **common, **r}[f] for f in source.FIELDS) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, source.PRODUCT)


def column(df, expr):
    return [r[0] for r in df.orderBy("ord").select(expr).collect()]


def test_metrics(spark):
    p = products(
        spark, {"weight": 200.0, "kcal": 100.0, "protein": 10.0, "fat": 4.0, "carbs": 6.0}, {"price": None}, {"price": -1.0}, {"unit": "kg", "weight": None}, {"weight": 0.0, "volume": 500.0, "protein": 5.0},
        {"weight": None, "kcal": 0.0, "protein": 1.0}, {"kcal": 100.0, "protein": -1.0, "fat": 1.0, "carbs": 1.0}, {"kcal": 3.0, "protein": 50.0, "fat": 1.0, "carbs": 1.0}, {"kcal": 100.0, "protein": 90.0, "fat": 1.0, "carbs": 1.0},
    )
    assert column(p, metrics.price_per_100g()) == [5.0, None, None, 1.0, 2.0, None, 10.0, 10.0, 10.0]
    assert column(p, metrics.protein_per_kcal())[:6] == [10.0, None, None, None, None, None]
    assert column(p, metrics.price_per_protein())[:5] == [50.0, None, None, None, 40.0]
    assert column(p, metrics.is_plausible()) == [True, True, True, True, True, True, False, True, False]
    assert column(p, metrics.nutrient_value("protein", "pack"))[:6] == [20.0, None, None, None, 25.0, None]
    assert column(p, metrics.display_size())[:5] == ["200 г", "100 г", "100 г", "за кг", "500 мл"]


def test_number_display(spark):
    df = spark.createDataFrame([(0, 1234.56), (1, None), (2, -1.0), (3, float("nan")), (4, 2.0)], "ord long, x double")
    assert column(df, metrics.display_number(F.col("x"), 1)) == ["1 234,6", "—", "—", "—", "2"]
    assert column(df, metrics.display_price(F.col("x")))[1:2] == ["—"]


def test_nulls_and_nan_last_both_ways(spark):
    p = products(spark, {"price": None}, {"price": float("nan")}, {"price": 2.0}, {"price": 1.0}, {"price": 2.0})
    ids = lambda d: [r.id for r in p.orderBy(*ordering.sort_columns("price", d)).collect()]
    assert ids("asc") == ["p3", "p2", "p4", "p0", "p1"] and ids("desc") == ["p2", "p4", "p3", "p0", "p1"]


def test_title_order(spark):
    p = products(spark, {"title": "Яблуко"}, {"title": "їжак"}, {"title": "Апельсин"}, {"title": "apple"}, {"title": "ґанок"}, {"title": "гарбуз"})
    assert [r.title for r in p.orderBy(*ordering.sort_columns("title", "asc")).collect()][:3] == ["Апельсин", "гарбуз", "ґанок"]
    assert ordering.next_sort("price", ("title", "asc")) == ("price", "desc") and ordering.next_sort("title", ("title", "asc")) == ("title", "desc")


def test_parsing(spark):
    texts = ["197.00ккал", "9,95г", "389,2/1625,6", "-3", "", None, "нема"]
    df = spark.createDataFrame(list(enumerate(texts)), "ord long, t string")
    assert column(df, parsing.first_number(F.col("t"))) == [197.0, 9.95, 389.2, -3.0, None, None, None]
    df = spark.createDataFrame(list(enumerate(["418.4 кДж", "418,4 KJ / 100 ккал", "50"])), "ord long, t string")
    assert column(df, parsing.energy_kcal(F.col("t"))) == [100.0, 418.4, 50.0]
    sizes = [("4х90г", False), ("6x50мл", False), ("0,5 л", False), ("1кг", False), ("шт", False), ("500г", True), (None, None), ("0г", False)]
    df = spark.createDataFrame([(i, *s) for i, s in enumerate(sizes)], "ord long, r string, w boolean")
    got = [tuple(x) for x in column(df, parsing.parse_size(F.col("r"), F.col("w")))]
    assert got == [("pcs", 360.0, None), ("pcs", None, 300.0), ("pcs", None, 500.0), ("pcs", 1000.0, None), ("pcs", None, None), ("kg", None, None), ("pcs", None, None), ("pcs", None, None)]
    df = spark.createDataFrame([(0, -0.25), (1, 0.25), (2, 2.35), (3, None)], "ord long, x double")
    assert column(df, metrics.js_round(F.col("x"), 1)) == [-0.2, 0.3, 2.4, None]
    df = spark.createDataFrame([(0, {"s200x200": "", "main": "m"}), (1, {"z": "x", "y": "http://y"}), (2, None)], "ord long, m map<string,string>")
    assert column(df, parsing.pick_image(F.col("m"))) == ["m", "http://y", None]
    df = spark.createDataFrame([(0, 5.0, 4.0, True), (1, 5.0, 4.0, False), (2, 4.0, 4.0, True), (3, None, 4.0, True)], "ord long, o double, p double, a boolean")
    assert column(df, parsing.discount_price(F.col("o"), F.col("p"), F.col("a"))) == [5.0, None, None, None]
    df = spark.createDataFrame([(0, "m-iaso-123", None, None), (1, "a-1-b", False, 3)], "ord long, s string, f boolean, n int")
    assert column(df, parsing.slug_key(F.col("s"))) == ["m-iaso", "a-1-b"]
    assert column(df, parsing.in_stock_flag(F.col("f"))) == [True, False] and column(df, parsing.in_stock_count(F.col("n"))) == [False, True]


def test_nutrition(spark):
    schema = "ord long, g array<struct<key:string,attributes:array<struct<attribute:struct<key:string>,value:struct<title:string,key:string>>>>>"
    attr = lambda k, t, v=None: ((k,), (t, v))
    rows = [(0, [("nutrient", [attr("calorie", "1674"), attr("proteins", None, "9,95г")])]), (1, [("other", [])]), (2, None), (3, [("nutrient", [])])]
    got = column(spark.createDataFrame(rows, schema), parsing.nutrition(F.col("g")))
    assert tuple(got[0]) == (400.1, 9.95, None, None) and got[1:] == [None, None, None]


def test_requests():
    q = CatalogQuery.landing("auchan")
    assert q.min_density == "6" and q.sort == ("pricePerProtein", "asc") and q.bounds("protein") == (8.0, None)
    assert q.with_preset("cheap-protein").min_density == "" and q.with_preset("lean").bounds("fat") == (None, 5.0)
    assert q.active_filters() == 2 and CatalogQuery(in_stock_only=False, price=("1", "2,5"), preset=None).active_filters() == 3
    assert [number(x) for x in ("1,5", "", "abc", "1e3", " 7 ", "inf")] == [1.5, None, None, 1000.0, 7.0, None]
    again = CatalogQuery.from_json(q.to_json())
    assert again == q
    assert CatalogQuery.from_json("{bad") == CatalogQuery() and CatalogQuery.from_json('{"preset":"gone","sort":["x","asc"],"hide_pets":1}').preset is None
    assert q.cleared().active_filters() == 0 and q.known_category({"meat"}).category == "all"
    assert "density ≥ 6" in q.describe()


def test_history():
    h = []
    for i in range(12):
        h = pushed(h, f"query {i}")
    assert len(h) == 10 and h[0]["q"] == "query 11"
    assert pushed(h, "query 5")[0]["q"] == "query 5" and len(pushed(h, "query 5")) == 10 and pushed(h, "x") == h
    assert len(shown(h, "query 11")) == 8 and load_history('[{"q":"a"},{"z":1},3]') == [{"q": "a", "filters": None}] and load_history("{") == []
    assert CatalogQuery().from_history({"q": "сир", "filters": {"ranges": {"fat": ["", "3"]}}}).bounds("fat") == (None, 3.0)


def test_filters_reject_nulls(spark):
    p = products(spark, {"kcal": 50.0}, {"kcal": None}, {"kcal": 150.0}, {"kcal": 80.0, "cat": "pets"}, {"kcal": 80.0, "inStock": False})
    q = CatalogQuery(store="all", preset=None, ranges={**CatalogQuery().ranges, "kcal": ("50", "100")}, sort=("kcal", "asc"))
    answer = catalog.run(p, q)
    rows, hits = answer.rows(), answer.hits()
    assert [r.id for r in rows.collect()] == ["p0"] and {r.cat: r.hits for r in hits.collect()} == {"dairy-eggs": 1}
    assert [r.id for r in catalog.run(p, CatalogQuery(store="all", preset=None, category="gone")).rows().collect()] == []
    assert [r.id for r in catalog.run(p, q).rows(limit=1).collect()] == ["p0"]


def test_summary(spark):
    p = products(
        spark, {"img": "a", "title": "довга назва"}, {"img": "b", "title": "коротка"}, {"img": "c", "title": "кратко1"}, {"img": "d", "title": "ї", "inStock": False}, {"store": "silpo", "cat": "meat"}, {"store": "silpo", "img": ""}
    )
    got = {r.cat: (r["count"], r.counts, r.img) for r in facets.category_summary(p).collect()}
    assert got == {"dairy-eggs": (5, {"auchan": 4, "silpo": 1}, "b"), "meat": (1, {"silpo": 1}, None)}
    dimension = spark.createDataFrame([("meat", "М", 0), ("dairy-eggs", "Д", 1), ("fish", "Р", 2)], "id string, title string, cat_ord int")
    ordered = facets.ordered_categories(facets.category_summary(p), dimension)
    assert [r.id for r in ordered.collect()] == ["dairy-eggs", "meat"]
    shown_ids = {r.id for r in filters.visible_categories(ordered, "silpo", True).collect()}
    assert shown_ids == {"dairy-eggs", "meat"} and {r.id for r in filters.visible_categories(ordered, "auchan", True).collect()} == {"dairy-eggs"}
    stats = {r.store: r.totalKept for r in facets.snapshot_stats(p).collect()}
    assert stats == {"auchan": 4, "silpo": 2, None: 6}


def compare(spark, *rows, **common):
    got = crossstore.compare_stores(crossstore.item_clusters(products(spark, *rows, **{"brand": "President", **common})))
    return {r.id: (r.otherId, r.deltaPct, r.isCheapest) for r in got.collect()}


def test_same_item_in_two_stores(spark):
    pair = ({"title": "Йогурт President полуниця 180г", "price": 63.9, "weight": 180.0}, {"title": "Йогурт President полуниця 180г", "price": 54.5, "weight": 180.0, "store": "silpo"})
    assert compare(spark, *pair) == {"p0": ("p1", 17, False), "p1": ("p0", 0, True)}


@pytest.mark.parametrize(
    "one,two",
    [
        ({"title": "Молоко", "weight": 900.0}, {"title": "Молоко", "weight": 1000.0, "store": "silpo"}),
        ({"title": "Сир 5%"}, {"title": "Сир 9%", "store": "silpo"}),
        ({"title": "Огірок", "brand": "без тм"}, {"title": "Огірок", "brand": "Без ТМ", "store": "silpo"}),
        ({"title": "Йогурт полуниця"}, {"title": "Йогурт персик чорниця", "store": "silpo"}),
        ({"title": "Йогурт"}, {"title": "Йогурт"}),
        ({"title": "Йогурт", "brand": None}, {"title": "Йогурт", "brand": None, "store": "silpo"}),
        ({"title": "Йогурт", "price": None}, {"title": "Йогурт", "store": "silpo"}),
        ({"title": "Йогурт", "price": 10.0}, {"title": "Йогурт", "price": 21.0, "store": "silpo"}),
        ({"title": "Йогурт 4х100г"}, {"title": "Йогурт 2х100г", "store": "silpo"}),
    ],
)
def test_not_the_same_item(spark, one, two):
    assert compare(spark, one, two) == {}


def test_loose_goods_ties_and_bridges(spark):
    loose = {"title": "Сир Гауда", "unit": "kg", "weight": None}
    assert compare(spark, {**loose, "price": 200.0}, {**loose, "price": 180.0, "store": "silpo"}) == {"p0": ("p1", 11, False), "p1": ("p0", 0, True)}
    assert compare(spark, {"title": "Сир Гауда"}, {"title": "Сир Гауда", "store": "silpo"}) == {"p0": ("p1", 0, True), "p1": ("p0", 0, True)}
    # the unpriced row links two that are not alike enough themselves
    chain = [{"title": "аа бб вв гг"}, {"title": "аа бб вв гг дд ее", "price": None}, {"title": "вв гг дд ее", "store": "silpo"}]
    assert set(compare(spark, *chain)) == {"p0", "p2"}


def test_pack_counts(spark):
    titles = ["Яйця 10шт", "Вода 6 x 0,5", "Сік 4х200", "Набір х12", "Чай", "Кава 3*1"]
    df = spark.createDataFrame(list(enumerate(titles)), "ord long, title string")
    assert column(df, crossstore.pack_count(F.col("title"))) == ["n10", "n6", "n4", "n12", "", "n3"]
    df = spark.createDataFrame(list(enumerate(["9% та 2,5 %", "без", "5% 5%"])), "ord long, title string")
    assert column(df, crossstore.percent_key(F.col("title"))) == ["2.5,9", "", "5,5"]


FOOD = {"price": 30.0, "kcal": 100.0, "protein": 5.0, "fat": 3.0, "carbs": 10.0}


def leaner(spark, *rows, store="all"):
    p = products(spark, *rows, **FOOD)
    found = alternatives.alternatives(p, store).where("source_id = 'p0'").orderBy("rank").collect()
    gate = {r.id for r in alternatives.has_alternative(p, store).collect()}
    assert ("p0" in gate) == bool(found)
    return [(r.id, r.cheaper) for r in found]


def test_alternatives(spark):
    base = {"title": "Йогурт полуниця"}
    assert leaner(spark, base, {"title": "Йогурт грецький", "protein": 10.0, "price": 20.0}) == [("p1", True)]
    assert leaner(spark, base, {"title": "Сир твердий", "protein": 10.0}) == []
    assert leaner(spark, base, {"title": "Йогурт", "protein": 10.0, "store": "silpo"}, store="auchan") == []
    assert leaner(spark, base, {"title": "Йогурт", "protein": 10.0, "cat": "meat"}) == []
    assert leaner(spark, base, {"title": "Йогурт", "protein": 2.0, "kcal": 5.0}) == []
    assert leaner(spark, base, {"title": "Йогурт", "protein": 5.5}) == []
    assert leaner(spark, {**base, "protein": None}, {"title": "Йогурт", "protein": 10.0}) == []
    assert leaner(spark, base, {"title": "Йогурт", "protein": 10.0, "inStock": False}) == []
    assert leaner(spark, {**base, "protein": 0.0}, {"title": "Йогурт", "protein": 0.0}) == [("p1", None)]
    assert leaner(spark, {"title": "Молода картопля"}, {"title": "Молода капуста", "protein": 10.0}) == []


def test_alternatives_order_and_limit(spark):
    rows = [{"title": "йогурт полуниця"}] + [{"title": "йогурт полуниця" if i % 3 == 0 else "йогурт", "protein": 6.0 + i % 4} for i in range(1, 12)]
    p = products(spark, *rows, **FOOD)
    r = [(x.ord, set(x.title.split()), x.protein / x.kcal * 100) for x in p.collect()]
    want = sorted(((-len(t & r[0][1]), -d, o) for o, t, d in r[1:] if d >= r[0][2] * 1.2))[:5]
    got = alternatives.alternatives(p).where("source_id = 'p0'").orderBy("rank").collect()
    assert [x.id for x in got] == [f"p{o}" for _, _, o in want]


def test_category_paths(spark):
    nodes = spark.createDataFrame([("a", None, "A"), ("b", "a", "B"), ("c", "b", "C"), ("x", "y", "X"), ("y", "x", "Y"), ("z", "gone", "Z")], "id string, parent_id string, title string")
    paths = categories.category_paths(nodes)
    got = {r.id: (r.path, r.top_id) for r in paths.collect()}
    assert got["c"] == ("A / B / C", "a") and got["a"] == ("A", "a") and got["z"] == ("Z", "z") and got["x"] == ("Y / X", "y")
    deep = spark.createDataFrame([(str(i), str(i - 1) if i else None, f"t{i}") for i in range(40)], "id string, parent_id string, title string")
    assert {r.id: (r.path.count(" / "), r.top_id) for r in categories.category_paths(deep).collect()} == {str(i): (i, "0") for i in range(40)}
    ring = spark.createDataFrame([(f"r{i}", f"r{(i + 1) % 5}", f"R{i}") for i in range(5)] + [("h", "r2", "H"), ("i", "h", "I"), ("s", "s", "S")], "id string, parent_id string, title string")
    got = {r.id: (r.path, r.top_id) for r in categories.category_paths(ring).collect()}
    assert got["r0"] == ("R4 / R3 / R2 / R1 / R0", "r4") and got["i"] == ("R1 / R0 / R4 / R3 / R2 / H / I", "r1") and got["s"] == ("S", "s")
    df = spark.createDataFrame([("c", None, None), ("?", "b", None), ("?", "?", "a"), (None, None, None)], "one string, two string, three string")
    assert [r.path for r in categories.resolve_category(df, paths, "one", "two", "three").collect()].count("Інше") == 1


def test_paths_take_logarithmic_rounds(spark, monkeypatch):
    """A chain of 1,500 nodes in 11 rounds; the first table is the start."""
    from larder.sources import storage

    written, write = [], storage.Scratch.write
    monkeypatch.setattr(storage.Scratch, "write", lambda self, df, name: (written.append(name), write(self, df, name))[1])
    chain = spark.range(1500).selectExpr("id", "if(id = 0, null, id - 1) AS parent_id", "'t' AS title")
    got = categories.category_paths(chain).selectExpr("max(length(path)) AS longest", "min(top_id) AS low", "max(top_id) AS high").first()
    assert (got.longest, got.low, got.high) == (1500 * 4 - 3, 0, 0) and len(written) <= 12


def raw(spark, tmp_path):
    import json

    item = lambda i, **k: {"id": i, "title": i, "top": {"id": "meat-fish-poultry-auchan", "title": "t"}, "price": 10.0, "kcal": 1.25, **k}
    one = {"store": "auchan", "totalSeen": 5, "products": [item("a", oldPrice=12.0), item("b", price=-1.0, oldPrice=3.0), item("a", title="again")]}
    two = {"store": "silpo", "products": [item("slp1", top={"id": "nowhere", "title": "?"}, oldPrice=9.0)]}
    for name, doc in (("one", one), ("two", two)):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    (tmp_path / "bad.json").write_text("{")
    return snapshots.read_snapshots(spark, str(tmp_path))


def test_snapshot_merge(spark, tmp_path):
    snaps = raw(spark, tmp_path)
    merged = snapshots.merged_products(snapshots.first_by(snapshots.raw_products(snaps), "id", "pos"), ["auchan", "silpo"])
    got = {r.id: (r.cat, r.price, r.oldPrice, r.kcal, r.title) for r in merged.collect()}
    assert got == {"a": ("meat", 10.0, 12.0, 1.3, "a"), "b": ("meat", None, None, 1.3, "b"), "slp1": ("other", 10.0, None, 1.3, "slp1")}
    assert [(r.top, r.n) for r in snapshots.unmapped_tops(snapshots.raw_products(snaps)).collect()] == [("nowhere", 1)]
    assert facets.total_seen(snaps).first()[0] == 5
    with pytest.raises(ValueError):
        snapshots.require_stores(snaps, ["auchan", "novus"])
    assert snapshots.require_stores(snaps, ["auchan", "novus"], allow_partial=True).count() == 2
    assert [r.id for r in source.with_order(merged, "order").orderBy("ord").collect()] == ["a", "b", "slp1"]


def test_snapshot_files_and_stream(spark, tmp_path):
    from larder.streaming.snapshots import watch_snapshots

    p = products(spark, {}, {"store": "silpo"})
    source.write_snapshot(p, facets.category_summary(p), facets.snapshot_stats(p), str(tmp_path / "out"))
    assert source.read_products(spark, str(tmp_path / "out/products")).count() == 2
    (tmp_path / "in").mkdir()
    raw(spark, tmp_path / "in")
    watch_snapshots(spark, str(tmp_path / "in"), str(tmp_path / "target"), str(tmp_path / "cp"), ["auchan", "silpo"]).awaitTermination(60)
    assert {r.store for r in spark.read.parquet(str(tmp_path / "target")).select("store").collect()} == {"auchan", "silpo"}


def test_details_cache(spark):
    cache = spark.createDataFrame([("a", 1.0), ("b", None)], "id string, kcal double")
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert [r.id for r in source.pending_details(wanted, cache).collect()] == ["c"]
    assert source.merged_details(cache, spark.createDataFrame([("b", 2.0)], "id string, kcal double")).count() == 2


def test_food_sections(spark):
    rows = [("1", "m-iaso-12", None, "М"), ("2", "dytiachi-tovary-3", None, "Д"), ("3", "x", "2", "Дитяче Харчування"), ("4", "y", "2", "Іграшки"), ("5", "posud", None, "П")]
    df = spark.createDataFrame(rows, "id string, slug string, parent_id string, title string")
    assert {r.id for r in snapshots.food_sections(df).collect()} == {"1", "3"}


@pytest.mark.parametrize("chunk", [1 << 20, 40, 3])
def test_components(spark, monkeypatch, chunk):
    import random

    from larder.operators import components
    from larder.sources.storage import Scratch

    monkeypatch.setattr(components, "CHUNK", chunk)
    rng = random.Random(5)
    pairs = [(10 * g + a, 10 * g + b) for g in range(20) for a, b in [(rng.randrange(10), rng.randrange(10)) for _ in range(rng.randrange(9))]]
    pairs += [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(30)] + [(5000, 5000)]
    root = {x: x for p in pairs for x in p if p[0] != p[1]}
    for _ in range(len(root)):
        for a, b in pairs:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    edges = spark.createDataFrame([*pairs, *pairs[:50], (None, 1), (7, None)], "src long, dst long")
    scratch = Scratch(spark, "components")
    got = [tuple(r) for r in components.connected_components(edges, scratch.write, scratch.drop).collect()]
    assert sorted(got) == sorted(root.items())
    assert components.connected_components(edges.limit(0), scratch.write, scratch.drop, "none").count() == 0


def test_stream_keeps_the_newest_document(spark, tmp_path):
    import json

    from larder.streaming.snapshots import watch_snapshots

    def arrive(name, date, price):
        doc = {"store": "auchan", "generatedAt": date, "products": [{"id": "a", "title": "a", "price": price, "kcal": 1.0}]}
        (tmp_path / "in" / name).write_text(json.dumps(doc))

    def price():
        watch_snapshots(spark, str(tmp_path / "in"), str(tmp_path / "target"), str(tmp_path / "cp"), ["auchan"]).awaitTermination(60)
        return [r.price for r in spark.read.parquet(str(tmp_path / "target")).collect()]

    (tmp_path / "in").mkdir()
    arrive("1.json", "2026-01-02T00:00:00Z", 2.0)
    arrive("2.json", "2026-01-01T00:00:00Z", 1.0)
    assert price() == [2.0]
    arrive("3.json", "2025-12-31T00:00:00Z", 0.5)
    assert price() == [2.0]
    arrive("4.json", "2026-01-03T00:00:00Z", 3.0)
    assert price() == [3.0]


@pytest.mark.parametrize("cell", [2048, 16])
def test_crowded_key(spark, monkeypatch, cell):
    """One brand and size with most rows, which share a token: the same pairs, and no cell has many rows."""
    import random

    monkeypatch.setattr(crossstore, "CELL", cell)
    rng = random.Random(2)
    rows = [{"brand": "B" if i % 8 else f"C{i % 5}", "store": ("a", "b")[(i // 8 + i) % 2], "title": " ".join(["товар", *sorted(rng.sample(["рис", "чай", "сік", "мед", "сіль"], rng.randint(0, 3)))])} for i in range(160)]
    keyed = crossstore.matching_keys(products(spark, *rows)).collect()
    want = set()
    for x in keyed:
        for y in keyed:
            a, b = set(x.toks), set(y.toks)
            if x.ord < y.ord and (x.b, x["size"], x.pct, x.cnt) == (y.b, y["size"], y.pct, y.cnt) and a and b and len(a & b) / len(a | b) >= 0.6:
                want.add((x.ord, y.ord))
    got = crossstore.similar_pairs(crossstore.matching_keys(products(spark, *rows)))
    assert {tuple(r) for r in got.collect()} == want and len(want) > 1000


def copied(spark, times):
    """Four kinds of one brand and size, three of them alike, and the copies of each in two stores."""
    titles = ["товар рис чай сік", "рис товар сік чай мед", "товар рис чай", "товар сіль кава какао"]
    return products(spark, *[{"brand": "B", "store": ("a", "b")[c % 2], "title": t} for c in range(times) for t in titles])


@pytest.mark.parametrize("run", [lambda p: crossstore.similar_pairs(crossstore.matching_keys(p)), crossstore.item_clusters])
def test_copies_do_not_meet(spark, monkeypatch, run):
    """What meets by tokens are kinds of products: their number does not grow with the copies."""
    sizes = {}
    write = crossstore.Scratch.write

    def counted(self, df, name):
        out = write(self, df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(crossstore.Scratch, "write", counted)
    met = []
    for times in (2, 60):
        run(copied(spark, times)).count()
        met.append(sizes["probes"])
    assert met[0] == met[1] > 0


@pytest.mark.parametrize("block", [256, 3])
def test_links_of_copies(spark, monkeypatch, block):
    """All links of rows, each once, however the copies are cut into blocks; and one cluster for kinds that are linked."""
    monkeypatch.setattr(crossstore, "BLOCK", block, raising=False)
    p = copied(spark, 10)
    kind = [{"рис", "чай", "сік"}, {"рис", "чай", "сік", "мед"}, {"рис", "чай"}, {"сіль", "кава", "какао"}]
    sets = [k | {"товар"} for _ in range(10) for k in kind]
    want = sorted((i, j) for i in range(40) for j in range(i + 1, 40) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.6)
    assert sorted(tuple(r) for r in crossstore.similar_pairs(crossstore.matching_keys(p)).collect()) == want
    assert {r.ord: r.component for r in crossstore.item_clusters(p).collect()} == {i: 3 if i % 4 == 3 else 0 for i in range(40)}
