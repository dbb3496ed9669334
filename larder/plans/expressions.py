"""SQL expressions that several registered queries share."""

from larder.functions.text import DROPPED, FOLDED_FROM, FOLDED_TO

_CHARS = (FOLDED_FROM + DROPPED).replace("'", "''")
FOLD = f"translate(lower({{}}), '{_CHARS}', '{FOLDED_TO}')"
TOKENS = "regexp_extract_all(" + FOLD + ", '[a-z0-9а-яёіїєґ]+')"
