"""Typo-tolerant search over titles, brands and category paths."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import dictionary
from larder.functions.distance import distance_col, max_cost
from larder.functions.text import fold, has_cyrillic, surface_col, to_latin, tokenize, tokenize_surface


@dataclass
class SearchIndex:
    """postings (token, ord) and vocab (token, surface): a token's surface is the one seen first."""

    postings: DataFrame
    vocab: DataFrame


def build_index(products: DataFrame) -> SearchIndex:
    text = F.concat_ws(" ", "title", "brand", "path")
    words = products.select("ord", F.posexplode(surface_col(text)).alias("pos", "w")).select("ord", "pos", "w.folded", "w.surface")
    # the tokens of the folded text: a surface word without apostrophes is one token
    postings = words.select(F.col("folded").alias("token"), "ord").distinct()
    vocab = words.groupBy(F.col("folded").alias("token")).agg(F.min_by("surface", F.struct("ord", "pos")).alias("surface"))
    return SearchIndex(postings, vocab)


def _parts(query: str, fuzzy: bool) -> tuple[list[tuple], int]:
    """(word, alternative, part, text, budget, latin, parts): a word fits by any alternative, that by all its parts."""
    words = list(dict.fromkeys(tokenize(query)))
    rows = []
    for w, word in enumerate(words):
        ways = [((word,), False), *[(phrase, False) for phrase in dictionary.alternatives(word)]]
        if has_cyrillic(word):
            ways.append(((fold(to_latin(word)),), True))
        for a, (phrase, latin) in enumerate(ways):
            parts = list(dict.fromkeys(phrase))
            rows += [(w, a, p, text, float(max_cost(text)) if fuzzy else 0.0, latin, len(parts)) for p, text in enumerate(parts)]
    return rows, len(words)


def matching(index: SearchIndex, query: str, fuzzy: bool = True) -> DataFrame | None:
    """(ord) of the products that fit every word of the query; None if it has no words.

    A word fits literally (by prefix, or within its budget of edits), by the phrases of the closest dictionary keys, or,
    if Cyrillic, by its Latin spelling. Distances are computed once for each word of the vocabulary, not for products.
    """
    rows, n_words = _parts(query, fuzzy)
    if not n_words:
        return None
    fields = ("w", "a", "p", "text", "budget", "latin", "parts")
    parts = F.array(*[F.struct(*[F.lit(v).alias(f) for v, f in zip(r, fields, strict=True)]) for r in rows])
    tried = index.vocab.select("token", F.explode(parts).alias("x")).select("token", "x.*")
    tried = tried.where(~F.col("latin") | F.col("token").rlike("[a-z]"))
    hits = tried.where(distance_col(F.col("text"), F.col("token"), F.col("budget")) <= F.col("budget")) if fuzzy else tried.where(F.col("token").startswith(F.col("text")))
    found = index.postings.join(hits, "token").groupBy("ord", "w", "a").agg(F.count_distinct("p").alias("n"), F.first("parts").alias("parts"))
    return found.where("n = parts").groupBy("ord").agg(F.count_distinct("w").alias("n")).where(F.col("n") == n_words).select("ord")


def search(products: DataFrame, index: SearchIndex, query: str, fuzzy: bool = True) -> DataFrame:
    """The products that fit; all of them for a query without words."""
    found = matching(index, query, fuzzy)
    return products if found is None else products.join(found, "ord", "left_semi")


def suggestion_table(index: SearchIndex, target: str, limit: int = 6) -> DataFrame:
    """(display, dist, rank) of the best replacements of a word."""
    cap = float(max(2, math.ceil(len(target) / 2)))
    word = F.lit(target)
    near = index.vocab.where((F.col("token") != target) & (F.abs(F.length("token") - len(target)) <= cap))
    near = near.select(F.col("surface").alias("display"), distance_col(word, F.col("token"), F.lit(cap)).alias("dist"), F.lit(1).alias("kind"), F.col("token").alias("seen"))
    near = near.where("dist > 0")
    spark = index.vocab.sparkSession
    keys = spark.createDataFrame([(e.key, e.display[0], f"{i:04d}") for i, e in enumerate(dictionary.entries())], "key string, display string, seen string")
    known = keys.select("display", (distance_col(word, F.col("key"), F.lit(cap)) + 0.25).alias("dist"), F.lit(2).alias("kind"), "seen").where(F.col("dist") <= cap)
    best = near.unionByName(known).groupBy("display").agg(F.min("dist").alias("dist"), F.min(F.struct("kind", "seen")).alias("seen"))
    return best.orderBy("dist", F.length("display"), "seen", "display").limit(limit).select("display", "dist")


def suggest(index: SearchIndex, query: str, limit: int = 6) -> list[str]:
    """Queries with the longest word replaced by its closest known words, best first."""
    words = tokenize_surface(query)
    if not words:
        return []
    at = max(range(len(words)), key=lambda i: (len(words[i][0]), -i))
    if len(words[at][0]) < 3:
        return []
    out, seen = [], {fold(query.strip())}
    for display in [r[0] for r in suggestion_table(index, words[at][0], limit).collect()]:  # at most limit rows
        phrase = " ".join(display if i == at else s for i, (_, s) in enumerate(words))
        if fold(phrase) not in seen:
            seen.add(fold(phrase))
            out.append(phrase)
    return out


def diagnose(products: DataFrame, index: SearchIndex, query: str) -> tuple[str, list[str]]:
    """Why a result is empty: the filters, if the words alone match something; else the term, with suggestions."""
    found = matching(index, query)
    if found is None or not found.limit(1).isEmpty():
        return "filters", []
    return "term", suggest(index, query)
