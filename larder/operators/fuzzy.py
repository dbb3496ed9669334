"""Tables of typed words against a vocabulary or a dictionary, by an index of deletion neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.functions import dictionary
from larder.functions.distance import CONFUSABLE_CODES, distance_col

CONFUSABLE = "".join(map(chr, CONFUSABLE_CODES))
#: Words of this many letters and more are looked up by as many of their first letters.
LONGEST = 9


def budget(word: Column) -> Column:
    """What a word may cost: by its length, nothing for numbers; see larder.functions.distance.max_cost."""
    n = F.length(word)
    by_length = F.when(n <= 2, 0.0).when(n == 3, 0.5).when(n <= 6, 1.0).when(n <= 8, 1.5).otherwise(2.0)
    return F.when(word.rlike("^[0-9]+$"), 0.0).otherwise(by_length)


def _merged(word: Column) -> Column:
    """Letters that are confused with each other become one, so that only whole edits are left to find."""
    return F.translate(word, CONFUSABLE, CONFUSABLE[0] * len(CONFUSABLE))


def edits(letters: int) -> int:
    """Whole edits within the budget of a word of so many letters."""
    return 0 if letters <= 3 else 1 if letters < LONGEST else 2


#: (letters of a word, letters of the token's beginning) that may be near enough.
SIZES = [(n, m) for n in range(1, LONGEST + 1) for m in range(max(1, n - edits(n)), n + edits(n) + 1)]


def _shorter(head: Column) -> Column:
    """The string without each of its letters in turn."""
    return F.transform(F.sequence(F.lit(1), F.length(head)), lambda i: F.concat(F.substring(head, F.lit(1), i - 1), F.substring(head, i + 1, F.lit(LONGEST + 2))))


def _variants() -> Column:
    """Column ``head`` and what is left of it after as many deletions as the budget of ``letters`` has edits."""
    head, none = F.col("head"), F.array().cast("array<string>")
    once = F.when((F.col("letters") > 3) & (F.length(head) > 1), _shorter(head)).otherwise(none)
    twice = F.when((F.col("letters") >= LONGEST) & (F.length(head) > 2), F.flatten(F.transform(_shorter(head), _shorter))).otherwise(none)
    return F.array_distinct(F.concat(F.array(head), once, twice))


def neighbourhood_index(vocabulary: DataFrame, column: str = "token") -> DataFrame:
    """(letters, variant, token) of a table of distinct tokens: to be written once and joined by any table of words.

    A word's first letters are some edits from a beginning of the token, if the word is: so the beginnings of nearly as
    many letters count, and a long token has no more keys than one of LONGEST + 2 letters.
    """
    tokens = vocabulary.select(F.col(column).alias("token")).where("token <> ''")
    sizes = F.array(*[F.struct(F.lit(n).alias("letters"), F.lit(m).alias("m")) for n, m in SIZES])
    heads = tokens.select("token", F.explode(sizes).alias("s")).where("s.m <= length(token)").select("token", "s.letters", F.substring(_merged(F.col("token")), F.lit(1), F.col("s.m")).alias("head"))
    # a variant that a word has, too, lost at most as many letters of the word as it has edits
    fits = F.length("variant").between(F.col("letters") - F.when(F.col("letters") <= 3, 0).when(F.col("letters") < LONGEST, 1).otherwise(2), F.col("letters"))
    return heads.select("token", "letters", F.explode(_variants()).alias("variant")).where(fits).select("letters", "variant", "token").distinct()


def fuzzy_matches(words: DataFrame, index: DataFrame, column: str = "word") -> DataFrame:
    """(word, token, dist): the tokens that each distinct word fits, by prefix at no cost or within its budget of edits.

    Words and tokens that share a variant are joined; what meets is judged by the exact distance. Empty and null words fit
    nothing. No word meets the whole vocabulary.
    """
    words = words.select(F.col(column).alias("word")).where("word <> ''").distinct()
    heads = words.withColumn("letters", F.least(F.length("word"), F.lit(LONGEST))).withColumn("head", F.substring(_merged(F.col("word")), F.lit(1), F.col("letters")))
    keys = heads.select("letters", F.explode(_variants()).alias("variant"), "word")
    met = keys.join(index, ["letters", "variant"]).select("word", "token").distinct()
    judged = met.withColumn("dist", distance_col(F.col("word"), F.col("token"), budget(F.col("word"))))
    return judged.where(F.col("dist") <= budget(F.col("word")))


def dictionary_table(spark: SparkSession) -> DataFrame:
    """(key, phrase) of the built-in dictionary; phrases are arrays of words."""
    return spark.createDataFrame([(e.key, list(p)) for e in dictionary.entries() for p in e.phrases], "key string, phrase array<string>")


def closest_phrases(words: DataFrame, entries: DataFrame, column: str = "word") -> DataFrame:
    """(word, key, phrase) of the entries (key, phrase) whose keys are closest to a word, all of them if several are: a key
    that the word begins, else the keys within its budget."""
    found = fuzzy_matches(words, neighbourhood_index(entries.select("key").distinct(), "key"), column)
    closest = found.groupBy("word").agg(F.min("dist").alias("dist"))
    keys = found.join(closest, ["word", "dist"]).select("word", F.col("token").alias("key"))
    return keys.join(entries, "key").select("word", "key", "phrase").distinct()


def suggestions(words: DataFrame, vocabulary: DataFrame, index: DataFrame, limit: int = 6) -> DataFrame:
    """(word, place, token, dist): of each word the ``limit`` closest other tokens (token, n) within its budget: nearest
    first, then those that more rows hold, then in their own order."""
    near = fuzzy_matches(words, index).where(F.col("token") != F.col("word")).join(vocabulary.select("token", "n"), "token")
    by = F.row_number().over(Window.partitionBy("word").orderBy("dist", F.desc("n"), "token"))
    return near.withColumn("place", by).where(F.col("place") <= limit).select("word", "place", "token", "dist")
