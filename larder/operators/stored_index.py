"""A search index in files, for tables of queries: bitmaps of rows by token and row range, neighbourhoods of the tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.text import fold_col, latin_col, tokens_col
from larder.operators import fuzzy
from larder.operators.search import build_index

#: Rows that one of Spark's bitmaps covers.
RANGE = 32768
#: Up to so many tokens are named in the filter of the scan, which passes over the files and row groups without them.
NAMED = 256


def write_index(products: DataFrame, path: str) -> None:
    """The index of title, brand and path below ``path``, sorted, so that a token's rows lie together. Rows are numbered
    by ``ord`` (from 0, without great gaps)."""
    postings = build_index(products).postings.withColumn("nth", F.col("ord") + 1)
    bits = postings.groupBy("token", F.bitmap_bucket_number("nth").alias("range")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("nth")).alias("bits"))
    bits.repartitionByRange("token", "range").sortWithinPartitions("token", "range").write.parquet(f"{path}/postings")
    near = fuzzy.neighbourhood_index(products.sparkSession.read.parquet(f"{path}/postings").select("token").distinct())
    near.repartitionByRange("letters", "variant").sortWithinPartitions("letters", "variant").write.parquet(f"{path}/near")


def read_postings(spark: SparkSession, path: str, tokens: DataFrame) -> DataFrame:
    """(token, range, bits) of the given tokens: named in the scan if they are few, else met in a join."""
    postings = spark.read.parquet(f"{path}/postings")
    few = [r.token for r in tokens.limit(NAMED + 1).collect()]
    return postings.where(F.col("token").isin(few)) if len(few) <= NAMED else postings.join(tokens, "token", "left_semi")


def _ways(words: DataFrame, spark: SparkSession) -> DataFrame:
    """(word, way, part, latin, parts): a word fits by any of its ways, a way by all its parts: the word itself, the phrases
    of the closest dictionary keys, and for Cyrillic words the Latin spelling."""
    own = words.select("word", F.array("word").alias("phrase"), F.lit(False).alias("latin"))
    known = fuzzy.closest_phrases(words, fuzzy.dictionary_table(spark)).select("word", "phrase", F.lit(False).alias("latin"))
    spelt = words.where(F.col("word").rlike("[а-я]")).select("word", F.array(fold_col(latin_col(F.col("word")))).alias("phrase"), F.lit(True).alias("latin"))
    ways = own.unionByName(known).unionByName(spelt).withColumn("phrase", F.array_distinct("phrase"))
    return ways.select("word", F.concat_ws(" ", F.col("latin").cast("string"), "phrase").alias("way"), F.explode("phrase").alias("part"), "latin", F.size("phrase").alias("parts")).distinct()


def _rows_of(bitmaps: DataFrame) -> DataFrame:
    """(..., ord) of the bits that are set in (..., range, bits)."""
    keys = [c for c in bitmaps.columns if c not in ("range", "bits")]
    # bytes of a binary are reached at once, digits of its text only from its beginning
    filled = f"filter(sequence(0, {RANGE // 8 - 1}), i -> substring(bits, i + 1, 1) <> X'00')"
    octet = "named_struct('octet', i, 'value', cast(conv(hex(substring(bits, i + 1, 1)), 16, 10) as int))"
    octets = bitmaps.where(F.bitmap_count("bits") > 0).select(*keys, "range", F.explode(F.expr(f"transform({filled}, i -> {octet})")).alias("o")).select(*keys, "range", "o.*")
    set_bits = octets.select(*keys, "range", "octet", F.explode(F.expr("filter(sequence(0, 7), b -> (value & shiftleft(1, b)) <> 0)")).alias("bit"))
    return set_bits.select(*keys, ((F.col("range") - 1) * RANGE + F.col("octet") * 8 + F.col("bit")).cast("long").alias("ord"))


def search_many(spark: SparkSession, path: str, queries: DataFrame) -> DataFrame:
    """(query_id, ord): the rows that fit every word of each of ``queries`` (query_id, query), as search() finds for one.

    Ways and distances are worked out once for each distinct word, alternatives are or-ed and words and-ed as bitmaps, a
    range of rows at a time; rows appear only at the end. Queries without words and null queries are left out. Repeated
    query_ids must have one query. No word meets the vocabulary, no query the products.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens_col(F.col("query")))).alias("word"))
    ways = _ways(asked.select("word").distinct(), spark)
    near = fuzzy.fuzzy_matches(ways, spark.read.parquet(f"{path}/near"), "part").select(F.col("word").alias("part"), "token")
    hits = ways.join(near, "part").where(~F.col("latin") | F.col("token").rlike("[a-z]")).select("word", "way", "part", "parts", "token")
    held = read_postings(spark, path, hits.select("token").distinct())
    by_part = hits.join(held, "token").groupBy("word", "way", "part", "parts", "range").agg(F.bitmap_or_agg("bits").alias("bits"))
    by_way = by_part.groupBy("word", "way", "parts", "range").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n")).where("n = parts")
    by_word = by_way.groupBy("word", "range").agg(F.bitmap_or_agg("bits").alias("bits"))
    words = asked.groupBy("query_id").agg(F.count("*").alias("words"))
    found = asked.join(by_word, "word").groupBy("query_id", "range").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n"))
    return _rows_of(found.join(words, "query_id").where("n = words").select("query_id", "range", "bits"))
