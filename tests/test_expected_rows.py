"""Requests taken through their states, sections, categories and the dictionary, case by case."""

import json
from dataclasses import replace

from larder.functions import dictionary
from larder.functions.text import fold
from larder.operators import filters, ordering
from larder.plans import request
from larder.plans.request import CatalogQuery
from larder.sources import snapshots

# Words of another language or spelling, and a phrase they stand for.
MEANT = [("творог", "сир кисломолочний"), ("клубника", "полуниця"), ("клубнека", "полуниця"), ("клубни", "полуниця"), ("мука", "борошно"), ("морковь", "морква"), ("огурец", "огирок")]


def _states() -> list[tuple[str, str]]:
    """What a request becomes, case by case."""
    start, plain = CatalogQuery.landing("north"), CatalogQuery(store="north", preset=None)
    bounds = lambda q: json.dumps({n: q.bounds(n) for n in ("kcal", "protein", "fat")})
    history: list[dict] = []
    for i in range(12):
        history = request.pushed(history, f"query {i}")
    stored = CatalogQuery.from_json(start.to_json())
    broken = CatalogQuery.from_json('{"preset": "gone", "sort": ["x", "asc"], "hide_pets": 1, "price": ["1", 2], "store": "south", "ranges": {"fat": {"min": "1", "max": ""}}}')
    typed = replace(plain, query="сир", brand="B", category="meat", discount_only=True, price=("1", "2,5"), in_stock_only=False)
    return [
        ("landing preset", str(start.preset)), ("landing sort", " ".join(start.sort)), ("landing bounds", bounds(start)), ("landing density", start.min_density), ("landing active", str(start.active_filters())),
        ("preset again", str(start.with_preset("cheap-protein").preset)), ("preset again bounds", bounds(start.with_preset("cheap-protein"))), ("preset again sort", " ".join(start.with_preset("cheap-protein").sort)),
        ("other preset", bounds(start.with_preset("lean"))), ("filling sort", " ".join(plain.with_preset("filling").sort)), ("volume bounds", bounds(plain.with_preset("volume"))),
        ("active of typed", str(typed.active_filters())), ("cleared query", typed.cleared().query), ("cleared brand", str(typed.cleared().brand)), ("cleared stock", str(typed.cleared().in_stock_only)), ("reset query", typed.reset().query),
        ("unknown category", typed.known_category({"fish"}).category), ("known category", typed.known_category({"meat"}).category),
        ("same sort", " ".join(ordering.next_sort("price", ("price", "desc")))), ("new sort", " ".join(ordering.next_sort("price", ("title", "asc")))), ("new ascending sort", " ".join(ordering.next_sort("pricePer100", ("price", "asc")))),
        ("stored", str(stored == start)), ("broken json", str(CatalogQuery.from_json("{bad") == CatalogQuery())), ("broken preset", str(broken.preset)), ("broken sort", " ".join(broken.sort)), ("broken pets", str(broken.hide_pets)),
        ("broken price", " ".join(broken.price)), ("broken store", broken.store), ("broken fat", str(broken.bounds("fat"))),
        ("history length", str(len(history))), ("history top", history[0]["q"]), ("history again", f"{request.pushed(history, 'query 5')[0]['q']} {len(request.pushed(history, 'query 5'))}"), ("history short", str(request.pushed(history, " x ") == history)),
        ("history shown", str(len(request.shown(history, "query 11")))), ("history loaded", json.dumps(request.load_history('[{"q": "a"}, {"z": 1}, 3]'))), ("history broken", str(request.load_history("{"))),
        ("history taken", bounds(plain.from_history({"q": "сир", "filters": {"ranges": {"fat": ["", "3"]}}}))), ("numbers", str([request.number(x) for x in ("1,5", "", "abc", "1e3", " 7 ", "inf")])),
        ("badges", " | ".join(typed.badges())), ("landing badges", start.describe()),
    ]


# The cases above, one by one.
STATES = [
    ("landing preset", "cheap-protein"), ("landing sort", "pricePerProtein asc"), ("landing bounds", '{"kcal": [null, null], "protein": [8.0, null], "fat": [null, null]}'), ("landing density", "6"), ("landing active", "2"),
    ("preset again", "None"), ("preset again bounds", '{"kcal": [null, null], "protein": [null, null], "fat": [null, null]}'), ("preset again sort", "pricePerProtein asc"),
    ("other preset", '{"kcal": [null, null], "protein": [12.0, null], "fat": [null, 5.0]}'), ("filling sort", "proteinPerKcal desc"), ("volume bounds", '{"kcal": [15.0, 80.0], "protein": [3.0, null], "fat": [null, null]}'),
    ("active of typed", "5"), ("cleared query", "сир"), ("cleared brand", "None"), ("cleared stock", "False"), ("reset query", ""),
    ("unknown category", "all"), ("known category", "meat"), ("same sort", "price asc"), ("new sort", "price desc"), ("new ascending sort", "pricePer100 asc"),
    ("stored", "True"), ("broken json", "True"), ("broken preset", "None"), ("broken sort", "pricePerProtein asc"), ("broken pets", "True"), ("broken price", " "), ("broken store", "south"), ("broken fat", "(1.0, None)"),
    ("history length", "10"), ("history top", "query 11"), ("history again", "query 5 10"), ("history short", "True"), ("history shown", "8"), ("history loaded", '[{"q": "a", "filters": null}]'), ("history broken", "[]"),
    ("history taken", '{"kcal": [null, null], "protein": [null, null], "fat": [null, 3.0]}'), ("numbers", "[1.5, None, None, 1000.0, 7.0, None]"),
    ("badges", "price 1–2,5 | discount | B | meat | out of stock too"), ("landing badges", "protein ≥ 8, density ≥ 6"),
]


def test_request_states():
    assert _states() == STATES


def test_dictionary_phrases():
    assert all(phrase in {" ".join(p) for p in dictionary.alternatives(fold(typed))} for typed, phrase in MEANT)
    assert len(dictionary.entries()) == 134 and sum(len(e.phrases) for e in dictionary.entries()) == 153


SECTIONS = [("1", "m-iaso-12", None, "М"), ("2", "dytiachi-tovary-3", None, "Д"), ("3", "x", "2", "Дитяче Харчування"), ("4", "y", "2", "Іграшки"), ("5", "posud", None, "П"), ("6", "syry-7", "1", "С")]


def test_food_sections(spark):
    rows = spark.createDataFrame(SECTIONS, "id string, slug string, parent_id string, title string")
    assert sorted((r.id, r.title) for r in snapshots.food_sections(rows).collect()) == [("1", "М"), ("3", "Дитяче Харчування")]


def test_shown_categories(spark):
    """Categories of one store or of all, with and without pets."""
    rows = spark.createDataFrame([("meat", 3, {"north": 3}), ("fish", 2, {"south": 2}), ("pets", 1, {"north": 1}), ("none", 0, {})], "id string, count long, counts map<string,long>")
    shown = {(store, hidden): {r.id for r in filters.visible_categories(rows, store, hidden).collect()} for store in ("all", "north", "west") for hidden in (True, False)}
    assert shown == {
        ("all", True): {"meat", "fish"}, ("all", False): {"meat", "fish", "pets"}, ("north", True): {"meat"}, ("north", False): {"meat", "pets"}, ("west", True): set(), ("west", False): set()
    }
