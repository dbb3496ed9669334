"""Price and nutrition metrics. The order of operations is part of their definition: results are compared bit for bit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUTRIENTS = ("kcal", "protein", "fat", "carbs")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pack_size(weight="weight", volume="volume") -> Column:
    """Grams if positive, else millilitres if positive, else null."""
    return F.when(_c(weight) > 0, _c(weight)).when(_c(volume) > 0, _c(volume))


def nutrient_value(nutrient: str, basis: str = "100g") -> Column:
    """A nutrient per 100 g, or in the whole pack (null without a size)."""
    base = F.col(nutrient)
    return base if basis != "pack" else base * pack_size() / 100


def price_per_100g() -> Column:
    """Loose goods are priced per kg or l; packs by their size."""
    price = F.col("price")
    by_unit = F.when(F.col("unit").isin("kg", "l"), price / 10).otherwise(price * 100 / pack_size())
    return F.when(price > 0, by_unit)


def protein_per_kcal() -> Column:
    """Grams of protein in 100 kcal."""
    return F.when(F.col("kcal") > 0, F.col("protein") / F.col("kcal") * 100)


def price_per_protein() -> Column:
    return F.when(F.col("protein") > 0, price_per_100g() * 100 / F.col("protein"))


def is_plausible() -> Column:
    """Energy within half of what the macronutrients yield; unknown values and nearly no energy pass, negatives fail."""
    kcal, protein, fat, carbs = map(F.col, NUTRIENTS)
    unknown = kcal.isNull() | protein.isNull() | fat.isNull() | carbs.isNull()
    negative = (kcal < 0) | (protein < 0) | (fat < 0) | (carbs < 0)
    deviation = F.abs(protein * 4 + fat * 9 + carbs * 4 - kcal) / kcal
    return F.when(unknown, True).when(negative, False).when(kcal < 5, True).otherwise(deviation <= 0.5)


def js_round(x: Column, digits: int = 0) -> Column:
    """Half towards plus infinity."""
    scale = 10**digits
    return F.floor(x * scale + 0.5) / scale if digits else F.floor(x + 0.5)


def display_number(x: Column, digits: int) -> Column:
    """At most ``digits`` decimals, a narrow group mark and a decimal comma; a dash for null, non-finite or negative."""
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")) & (x >= 0)
    text = F.format_number(F.round(x, digits), digits)  # halves are rounded up, which format_number alone does not
    if digits:
        text = F.regexp_replace(text, r"\.?0+$", "")
    text = F.translate(text, ",.", "\u00a0,")
    return F.when(finite, text).otherwise("—")


def display_price(x: Column) -> Column:
    shown = display_number(x, 2)
    return F.when(shown == "—", shown).otherwise(F.concat(shown, F.lit("\u00a0₴")))


def display_size() -> Column:
    """The label of a pack: loose goods, kilograms or litres from a thousand on, pieces."""
    weight, volume = F.col("weight"), F.col("volume")
    label = lambda x, small, large: F.when(x >= 1000, F.concat(display_number(x / 1000, 1), F.lit(f"\u00a0{large}"))).otherwise(F.concat(display_number(x, 0), F.lit(f"\u00a0{small}")))
    return (
        F.when(F.col("unit") == "kg", "за кг").when(F.col("unit") == "l", "за л")
        .when(weight > 0, label(weight, "г", "кг")).when(volume > 0, label(volume, "мл", "л"))
        .when(F.col("unit") == "pcs", "шт").otherwise("—")
    )


def sort_keys(key: Column, descending: bool) -> Column:
    """Null and NaN last either way."""
    clean = F.nanvl(key, F.lit(None).cast("double"))
    return clean.desc_nulls_last() if descending else clean.asc_nulls_last()


def with_metrics(products):
    return products.withColumns({"per100": price_per_100g(), "density": protein_per_kcal(), "per_protein": price_per_protein()})
