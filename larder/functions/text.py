"""Folding and tokens of Ukrainian and Russian text: as columns, and as Python for the few words of a request."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that fold to one, and letters that vanish.
FOLDED_FROM = "іїыiєэёґ"
FOLDED_TO = "ииииееег"
DROPPED = "ьъ'’ʼ`"
TOKEN = "[a-z0-9а-яёіїєґ]+"
SURFACE_TOKEN = "[a-z0-9а-яёіїєґ'’ʼ`]+"

# Latin spelling of folded Cyrillic letters; дж is j.
LATIN = {
    "щ": "shch", "ж": "zh", "х": "h", "ч": "ch", "ш": "sh", "ц": "ts", "ю": "yu", "я": "ya", "й": "y",
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "з": "z", "и": "i", "к": "k", "л": "l",
    "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f",
}

_FOLD = str.maketrans(FOLDED_FROM, FOLDED_TO, DROPPED)


def fold(text: str) -> str:
    return text.lower().translate(_FOLD)


def tokenize(text: str) -> list[str]:
    return re.findall(TOKEN, fold(text))


def tokenize_surface(text: str) -> list[tuple[str, str]]:
    return [(f, s) for s in re.findall(SURFACE_TOKEN, text.lower()) if (f := fold(s))]


def to_latin(folded: str) -> str:
    return "".join(LATIN.get(c, c) for c in folded.replace("дж", "j"))


def has_cyrillic(text: str) -> bool:
    return re.search("[а-я]", text) is not None


def fold_col(text: Column) -> Column:
    return F.translate(F.lower(text), FOLDED_FROM + DROPPED, FOLDED_TO)


def tokens_col(text: Column) -> Column:
    return F.regexp_extract_all(fold_col(text), F.lit(TOKEN), F.lit(0))


def surface_col(text: Column) -> Column:
    """Array of (folded, surface), empty folds left out."""
    found = F.regexp_extract_all(F.lower(text), F.lit(SURFACE_TOKEN), F.lit(0))
    return F.filter(F.transform(found, lambda s: F.struct(fold_col(s).alias("folded"), s.alias("surface"))), lambda x: x["folded"] != "")


def latin_col(folded: Column) -> Column:
    out = F.replace(folded, F.lit("дж"), F.lit("j"))
    for cyrillic, latin in LATIN.items():
        if len(latin) > 1:
            out = F.replace(out, F.lit(cyrillic), F.lit(latin))
    single = {c: x for c, x in LATIN.items() if len(x) == 1}
    return F.translate(out, "".join(single), "".join(single.values()))
