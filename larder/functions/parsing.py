"""Parsing of raw store fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.metrics import js_round

#: White space as browsers see it in a pattern.
SPACES = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def first_number(text: Column) -> Column:
    """The first number in a text, decimal comma or point; null if there is none."""
    return F.regexp_extract(F.replace(text, F.lit(","), F.lit(".")), r"-?[0-9]+(?:\.[0-9]+)?", 0).try_cast("double")


def energy_kcal(text: Column) -> Column:
    """Kilocalories; kilojoules alone are converted and rounded to one decimal."""
    n = first_number(text)
    joules = text.rlike("(?iu)kj|кдж") & ~text.rlike("(?iu)kcal|ккал")
    return F.when(joules, js_round(n / 4.184, 1)).otherwise(n)


def repaired_kcal(kcal: Column) -> Column:
    """No food has over 950 kcal in 100 g: such a value is in kilojoules."""
    return F.when(kcal > 950, js_round(kcal / 4.184, 1)).otherwise(kcal)


def nutrition(groups: Column) -> Column:
    """Struct of the four nutrients from nested attribute groups (key, attributes of (attribute.key, value.(title, key)))."""
    group = F.get(F.filter(groups, lambda g: g["key"] == "nutrient"), F.lit(0))

    def value(key: str) -> Column:
        found = F.get(F.filter(group["attributes"], lambda a: a["attribute"]["key"] == key), F.lit(0))["value"]
        return first_number(F.coalesce(found["title"], found["key"]))

    fields = {"kcal": repaired_kcal(value("calorie")), "protein": value("proteins"), "fat": value("fats"), "carbs": value("carbohydrates")}
    any_known = F.coalesce(*fields.values()).isNotNull()
    return F.when(any_known, F.struct(*[v.alias(k) for k, v in fields.items()]))


def parse_size(ratio: Column, weighted: Column) -> Column:
    """Struct (unit, weight, volume) of a size label such as ``4х90г`` or ``0,5 л``; loose goods have unit kg."""
    text = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(ratio, F.lit(""))), SPACES + "+", ""), "[xх×]", "x")
    multi, single = r"^([0-9]+)x([0-9.,]+)(кг|г|мл|л)", r"([0-9.,]+)(кг|г|мл|л)"
    # one comma becomes a point, then the leading number counts
    number = lambda s: F.regexp_extract(F.regexp_replace(s, r"^([^,]*),", "$1."), r"^[0-9]*\.?[0-9]+|^[0-9]+", 0).try_cast("double")
    packs = F.regexp_extract(text, multi, 1).try_cast("double")
    is_multi = text.rlike(multi)
    amount = F.when(is_multi, packs * number(F.regexp_extract(text, multi, 2))).otherwise(number(F.regexp_extract(text, single, 1)))
    unit = F.when(is_multi, F.regexp_extract(text, multi, 3)).otherwise(F.regexp_extract(text, single, 2))
    total = F.when(unit.isin("кг", "л"), amount * 1000).otherwise(amount)
    total = F.when(total > 0, total)
    loose = F.coalesce(weighted, F.lit(False))
    return F.struct(
        F.when(loose, "kg").otherwise("pcs").alias("unit"),
        F.when(~loose & unit.isin("кг", "г"), total).alias("weight"),
        F.when(~loose & unit.isin("мл", "л"), total).alias("volume"),
    )


def slug_key(slug: Column) -> Column:
    return F.regexp_replace(slug, "-[0-9]+$", "")


def from_kopecks(x: Column) -> Column:
    return x / 100


def discount_price(old: Column, price: Column, active: Column | None = None) -> Column:
    """The old price if it is above the price, and the discount on."""
    on = F.lit(True) if active is None else F.coalesce(active, F.lit(False))
    return F.when(on & (old > price), old)


def pick_image(image: Column, sizes=("s200x200", "s350x350", "s464x464", "main", "normal")) -> Column:
    """First non-empty of the preferred sizes in a map, else its first http value."""
    preferred = [F.nullif(F.try_element_at(image, F.lit(s)), F.lit("")) for s in sizes]
    return F.coalesce(*preferred, F.get(F.filter(F.map_values(image), lambda v: v.startswith("http")), F.lit(0)))


def in_stock_flag(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(True))


def in_stock_count(stock: Column) -> Column:
    return F.coalesce(stock, F.lit(0)) > 0


def usable_price(price: Column) -> Column:
    return F.when(price > 0, price)


def product_link(base: str, slug: Column) -> Column:
    return F.when(slug != "", F.concat(F.lit(base), slug))
