"""A catalogue request: what the user has set, as data."""

from __future__ import annotations

import json
import math
import re
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from larder.functions.metrics import NUTRIENTS
from larder.operators.ordering import ASCENDING, next_sort

SORT_KEYS = ("title", "price", "pricePer100", "pricePerProtein", "proteinPerKcal", *NUTRIENTS)
HISTORY_LIMIT, HISTORY_SHOWN = 10, 8

# The canned queries.
PRESETS = {
    "cheap-protein": {"ranges": {"protein": ("8", "")}, "min_density": "6", "sort": ("pricePerProtein", "asc")},
    "filling": {"ranges": {"protein": ("7", ""), "kcal": ("25", "150")}, "min_density": "", "sort": ("proteinPerKcal", "desc")},
    "lean": {"ranges": {"protein": ("12", ""), "fat": ("", "5")}, "min_density": "6", "sort": ("pricePerProtein", "asc")},
    "volume": {"ranges": {"protein": ("3", ""), "kcal": ("15", "80")}, "min_density": "", "sort": ("kcal", "asc")},
}


def number(text: str) -> float | None:
    """A bound as typed, with decimal comma or point; None if it is no number."""
    text = text.strip().replace(",", ".", 1)
    if not re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text):
        return None
    value = float(text)
    return value if math.isfinite(value) else None


def _ranges(given: Any = None) -> dict[str, tuple[str, str]]:
    """All four nutrients, open where nothing valid is given."""
    out = {}
    for n in NUTRIENTS:
        pair = given.get(n) if isinstance(given, dict) else None
        if isinstance(pair, dict):
            pair = (pair.get("min"), pair.get("max"))
        valid = isinstance(pair, (list, tuple)) and len(pair) == 2 and all(isinstance(x, str) for x in pair)
        out[n] = tuple(pair) if valid else ("", "")
    return out


@dataclass(frozen=True)
class CatalogQuery:
    store: str = "all"
    query: str = ""
    category: str = "all"
    brand: str | None = None
    basis: str = "100g"
    ranges: dict[str, tuple[str, str]] = field(default_factory=_ranges)
    price: tuple[str, str] = ("", "")
    min_density: str = ""
    discount_only: bool = False
    complete_only: bool = False
    cheaper_only: bool = False
    plausible_only: bool = False
    in_stock_only: bool = True
    hide_pets: bool = True
    preset: str | None = "cheap-protein"
    sort: tuple[str, str] = ("pricePerProtein", "asc")

    @staticmethod
    def landing(store: str) -> CatalogQuery:
        return CatalogQuery(store=store, preset=None).with_preset("cheap-protein")

    def with_preset(self, key: str) -> CatalogQuery:
        """Apply a canned query; choosing it again clears its ranges and density only."""
        if self.preset == key:
            return replace(self, preset=None, ranges=_ranges(), min_density="")
        p = PRESETS[key]
        return replace(self, preset=key, ranges=_ranges(p["ranges"]), min_density=p["min_density"], sort=p["sort"])

    def with_sort(self, key: str) -> CatalogQuery:
        return replace(self, sort=next_sort(key, self.sort))

    def cleared(self) -> CatalogQuery:
        """Without filters; the words, store, stock, pets, plausibility, sort and basis stay."""
        keep = {k: getattr(self, k) for k in ("query", "store", "in_stock_only", "hide_pets", "plausible_only", "sort", "basis")}
        return CatalogQuery(**keep, preset=None)

    def reset(self) -> CatalogQuery:
        return replace(self.cleared(), query="")

    def known_category(self, ids: set[str]) -> CatalogQuery:
        return self if self.category in ids or self.category == "all" else replace(self, category="all")

    def bounds(self, nutrient: str) -> tuple[float | None, float | None]:
        low, high = self.ranges[nutrient]
        return number(low), number(high)

    def active_filters(self) -> int:
        """Each bound counts; stock and pets count when they are let in; store, basis and brand do not."""
        bounds = [x for pair in (*self.ranges.values(), self.price) for x in pair] + [self.min_density]
        flags = (self.category != "all", self.discount_only, self.complete_only, self.cheaper_only, self.plausible_only, not self.in_stock_only, not self.hide_pets)
        return sum(number(x) is not None for x in bounds) + sum(flags)

    def badges(self) -> list[str]:
        """The filters as short texts."""
        out = []
        for name, (low, high) in [*self.ranges.items(), ("price", self.price)]:
            if low and high:
                out.append(f"{name} {low}–{high}")
            elif low or high:
                out.append(f"{name} {'≥' if low else '≤'} {low or high}")
        if self.min_density:
            out.append(f"density ≥ {self.min_density}")
        named = {"discount_only": "discount", "complete_only": "complete", "cheaper_only": "cheaper elsewhere", "plausible_only": "plausible"}
        out += [text for flag, text in named.items() if getattr(self, flag)]
        out += [self.brand] * bool(self.brand) + [self.category] * (self.category != "all")
        return out + ["out of stock too"] * (not self.in_stock_only) + ["pets too"] * (not self.hide_pets)

    def describe(self) -> str:
        return ", ".join(self.badges())

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)

    @staticmethod
    def from_json(text: str | None) -> CatalogQuery:
        """A stored request; what is missing or malformed has its default, an unknown preset is none."""
        try:
            given = json.loads(text) if text else {}
        except ValueError:
            given = {}
        if not isinstance(given, dict):
            given = {}
        base = CatalogQuery()
        kept: dict[str, Any] = {}
        for name in ("store", "query", "category", "min_density"):
            if isinstance(given.get(name), str):
                kept[name] = given[name]
        for name in ("discount_only", "complete_only", "cheaper_only", "plausible_only", "in_stock_only", "hide_pets"):
            if isinstance(given.get(name), bool):
                kept[name] = given[name]
        if isinstance(given.get("brand"), str):
            kept["brand"] = given["brand"]
        if given.get("basis") in ("100g", "pack"):
            kept["basis"] = given["basis"]
        price, sort = given.get("price"), given.get("sort")
        if isinstance(price, list) and len(price) == 2 and all(isinstance(x, str) for x in price):
            kept["price"] = tuple(price)
        if isinstance(sort, list) and len(sort) == 2 and sort[0] in SORT_KEYS and sort[1] in ("asc", "desc"):
            kept["sort"] = tuple(sort)
        preset = given.get("preset", base.preset)
        return replace(base, **kept, ranges=_ranges(given.get("ranges")), preset=preset if preset in PRESETS else None)

    def from_history(self, entry: dict) -> CatalogQuery:
        """The words of a history entry and the filters kept with it, in manual mode."""
        kept = entry.get("filters") or {}
        return replace(self, query=entry["q"], preset=None, ranges=_ranges(kept.get("ranges")), min_density=str(kept.get("min_density", "")))


def pushed(history: list[dict], q: str, filters: dict | None = None) -> list[dict]:
    """History with a query at its top, each query once, the latest ten."""
    q = q.strip()
    if len(q) < 2:
        return history
    return [{"q": q, "filters": filters}, *[h for h in history if h["q"] != q]][:HISTORY_LIMIT]


def shown(history: list[dict], current: str) -> list[dict]:
    return [h for h in history if h["q"] != current.strip()][:HISTORY_SHOWN]


def load_history(text: str | None) -> list[dict]:
    """A stored history; entries without a query are left out."""
    try:
        given = json.loads(text) if text else []
    except ValueError:
        return []
    if not isinstance(given, list):
        return []
    return [{"q": h["q"], "filters": h.get("filters") if isinstance(h.get("filters"), dict) else None} for h in given if isinstance(h, dict) and isinstance(h.get("q"), str)][:HISTORY_LIMIT]


__all__ = ["ASCENDING", "CatalogQuery", "PRESETS", "load_history", "number", "pushed", "shown"]
