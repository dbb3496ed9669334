"""Prefix edit distance with cheap confusable vowels and anchored word starts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters that Ukrainian and Russian spellings swap, at half the cost of an edit.
CONFUSABLE_CODES = [ord(c) for c in "еийо"]
#: Edits at full cost need both positions beyond this many letters.
ANCHORED = 2


def max_cost(word: str) -> float:
    """What a word may cost: by its length, nothing for numbers."""
    if word.isdigit() and word.isascii():
        return 0
    for longest, cost in ((2, 0), (3, 0.5), (6, 1), (8, 1.5)):
        if len(word) <= longest:
            return cost
    return 2


def _codes(words: list[str], width: int) -> np.ndarray:
    """Code points of the first ``width`` letters, a row a word; -1 beyond its end."""
    flat = np.frombuffer("".join(w[:width].ljust(width, "\0") for w in words).encode("utf-32-le"), np.int32).reshape(len(words), width).copy()
    flat[np.arange(width) >= np.array([len(w) for w in words])[:, None]] = -1
    return flat


def pair_distances(words: list[str], tokens: list[str], budget: float) -> np.ndarray:
    """Cheapest way from each word to any prefix of its token; infinite above ``budget``. The words, or the one for all
    tokens, have the same length.

    Substitutions, transpositions, deletions and insertions cost one, confusable letters one half. Full substitutions
    and transpositions need both positions beyond the anchored start, deletions the word's, insertions the token's; the
    border is free of that rule. What is further off the diagonal than the budget allows does not count, and no step of
    the word may cost more than the budget.

    One table for all pairs: word position, pair, token position. What is allowed where is laid down first.
    """
    n, reach = len(words[0]), math.floor(budget) + 1
    letters, own = _codes(tokens, n + reach), _codes(words, n).T[:, :, None]
    i, j = np.arange(1, n + 1)[:, None], np.arange(1, n + reach + 1)
    inside = (letters >= 0)[None] & (np.abs(i - j) <= reach)[:, None]
    free = ((i > ANCHORED) & (j > ANCHORED))[:, None]
    same = own == letters
    soft = np.isin(own, CONFUSABLE_CODES) & np.isin(letters, CONFUSABLE_CODES)
    change = np.where(same, 0, np.where(soft, 0.5, np.where(free, 1, np.inf)))
    crossed = np.zeros_like(same)
    crossed[1:, :, 1:] = same[1:, :, :-1] & same[:-1, :, 1:]
    turn, drop = np.where(crossed & free, 1, np.inf), np.where(i > ANCHORED, 1, np.inf)
    table = np.full((n + 1, len(tokens), n + reach + 1), np.inf)
    table[0] = np.where(np.pad(letters, ((0, 0), (1, 0))) >= 0, np.arange(n + reach + 1), np.inf)
    table[:, :, 0] = np.arange(n + 1)[:, None]
    late = np.arange(ANCHORED, n + reach + 1)
    for k in range(1, n + 1):
        cell = np.minimum(table[k - 1, :, :-1] + change[k - 1], table[k - 1, :, 1:] + drop[k - 1])
        if k > 1:
            cell[:, 1:] = np.minimum(cell[:, 1:], table[k - 2, :, :-2] + turn[k - 1, :, 1:])
        cell[~inside[k - 1]] = np.inf
        # insertions: the cheapest cell to the left and one for each letter since, beyond the anchored ones
        cell[:, ANCHORED - 1 :] = np.minimum.accumulate(cell[:, ANCHORED - 1 :] - late, axis=1) + late
        cell[~inside[k - 1]] = np.inf
        table[k, :, 1:] = cell
    steps = table.min(axis=2)
    found = np.where((steps > budget).any(axis=0), np.inf, steps[-1])
    return np.where([t.startswith(w) for w, t in zip(words if len(words) > 1 else words * len(tokens), tokens, strict=True)], 0.0, found)


def prefix_distances(word: str, tokens: list[str], budget: float) -> np.ndarray:
    """The same of one word to all tokens."""
    return pair_distances([word], tokens, budget)


def prefix_distance(word: str, token: str, budget: float) -> float:
    return float(prefix_distances(word, [token], budget)[0])


def word_matches(word: str, token: str) -> bool:
    cap = max_cost(word)
    return token.startswith(word) or (cap > 0 and prefix_distance(word, token, cap) <= cap)


#: Cells of the tables that are made together.
CELLS = 1 << 20


@F.pandas_udf(T.DoubleType())
def _distance(word: pd.Series, token: pd.Series, budget: pd.Series) -> pd.Series:
    asked = pd.DataFrame({"w": word, "t": token, "b": budget})
    out = pd.Series(np.nan, asked.index)
    asked = asked.dropna()
    # words of a length share a table: one for each word costs more than its pairs
    for (n, b), rows in asked.groupby([asked.w.map(len), "b"]):
        together = max(1, CELLS // ((n + 1) * (n + math.floor(b) + 2)))
        for at in range(0, len(rows), together):
            part = rows.iloc[at : at + together]
            out[part.index] = pair_distances(part.w.tolist(), part.t.tolist(), b)
    return out.where(np.isfinite(out)).astype("Float64")


def distance_col(word: Column, token: Column, budget: Column) -> Column:
    """Null if above the budget. Prefixes and tokens too short to match cost no table."""
    open_ = ~token.startswith(word) & (budget > 0) & (F.length(token) >= F.length(word) - F.floor(budget) - 1)
    return F.when(token.startswith(word), 0.0).otherwise(_distance(F.when(open_, word), token, budget))
