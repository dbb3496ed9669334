"""Predicates of a catalogue request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.metrics import NUTRIENTS, is_plausible, protein_per_kcal

PETS = "pets"


def in_store(store: str) -> Column:
    return F.lit(True) if store == "all" else F.col("store") == store


def of_brand(brand: str) -> Column:
    return F.col("brand") == brand


def discounted() -> Column:
    return F.col("oldPrice").isNotNull()


def complete() -> Column:
    known = F.lit(True)
    for n in NUTRIENTS:
        known &= F.col(n).isNotNull()
    return known


def no_pets() -> Column:
    return F.col("cat") != PETS


def in_stock() -> Column:
    return F.col("inStock")


def plausible() -> Column:
    return is_plausible()


def dense(least: float) -> Column:
    return protein_per_kcal() >= least


def between(column: str, low: float | None, high: float | None) -> Column:
    """Both ends belong; a null value fails once there is a bound."""
    fits = F.lit(True)
    if low is not None:
        fits &= F.col(column) >= low
    if high is not None:
        fits &= F.col(column) <= high
    return fits


def cheaper_elsewhere(products: DataFrame, compared: DataFrame) -> DataFrame:
    """Products that another store sells cheaper by a percent or more."""
    return products.join(compared.where(~F.col("isCheapest") & (F.col("deltaPct") >= 1)).select("id"), "id", "left_semi")


def visible_categories(categories: DataFrame, store: str, hide_pets: bool) -> DataFrame:
    """Categories with products in the store."""
    count = F.col("count") if store == "all" else F.coalesce(F.try_element_at("counts", F.lit(store)), F.lit(0))
    shown = categories.where(count > 0)
    return shown.where(F.col("id") != PETS) if hide_pets else shown
