"""The stored index: many queries at once give what search() gives for each, and only the rows of their tokens are read."""

import duckdb
import pytest
from pyspark.sql import functions as F

from larder.operators import search, stored_index
from larder.plans import search_queries
from larder.sources.catalog import PRODUCT

TITLES = ["Молоко Яготинське 2,6% 900г", "Йогурт Чудо полуниця", "Чипси Lays зі сметаною", "Сир Комо російський", "Coca-Cola 0,5л", "Масло вершкове", "Кава Jacobs Monarch", "Шоколад молочний Milka", "Вода Моршинська", None]
QUERIES = [(1, "молоко"), (2, "малако"), (3, "джакобс"), (4, "lays сметана"), (5, "чипси"), (6, "моло"), (7, "900"), (8, "сир кома"), (9, "xyzzy"), (10, "йогрут чудо"), (11, "кола"), (12, "шоколад milka")]


@pytest.fixture(scope="module")
def products(spark):
    rows = [{"ord": i, "id": str(i), "store": "s", "title": TITLES[i % len(TITLES)], "brand": "Milka" if i % 3 else None, "path": f"Їжа / word{i % 500}"} for i in range(0, 70_000, 7)]
    return spark.createDataFrame([[r.get(f) for f in PRODUCT.names] for r in rows], PRODUCT).repartition(4).cache()


def test_many_queries_as_one_by_one(spark, products, tmp_path):
    some = products.where("ord < 700 or ord > 69300")  # rows of three bitmaps
    stored_index.write_index(some, str(tmp_path))
    asked = spark.createDataFrame([*QUERIES, (13, ""), (14, None), (15, "!!")], "query_id long, query string")
    got = {}
    for r in stored_index.search_many(spark, str(tmp_path), asked).collect():
        got.setdefault(r.query_id, []).append(r.ord)
    index = search.build_index(some)
    index.postings.cache(), index.vocab.cache()
    for i, query in QUERIES:
        assert sorted(got.get(i, [])) == sorted(r.ord for r in search.matching(index, query).collect()), query
    assert set(got) <= {i for i, _ in QUERIES} and len(got) > 8
    assert stored_index.search_many(spark, str(tmp_path), asked.limit(0)).count() == 0


def test_reads_only_the_rows_of_its_tokens(spark, products, tmp_path, monkeypatch):
    stored_index.write_index(products, str(tmp_path))
    spark.read.parquet(f"{tmp_path}/postings").repartitionByRange(16, "token").sortWithinPartitions("token").write.parquet(f"{tmp_path}/cut/postings")
    tokens = spark.createDataFrame([("word123",)], "token string")

    def scanned(df):
        rows = len(df.collect())
        leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
        return rows, leaf.metrics().apply("numOutputRows").value()

    rows, read = scanned(stored_index.read_postings(spark, f"{tmp_path}/cut", tokens))
    assert 0 < rows <= read <= spark.read.parquet(f"{tmp_path}/postings").count() / 4
    few = {tuple(r) for r in stored_index.read_postings(spark, str(tmp_path), tokens).collect()}
    monkeypatch.setattr(stored_index, "NAMED", 0)  # too many to name: the join gives the same
    assert few == {tuple(r) for r in stored_index.read_postings(spark, str(tmp_path), tokens).collect()}


def test_every_bit_comes_back(spark):
    rows = [0, 7, 8, 32767, 32768, 40000, 65535, 65536]
    df = spark.createDataFrame([(1, i) for i in rows], "q int, ord long").withColumn("nth", F.col("ord") + 1)
    bits = df.groupBy("q", F.bitmap_bucket_number("nth").alias("range")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("nth")).alias("bits"))
    assert sorted(r.ord for r in stored_index._rows_of(bits).collect()) == rows


def test_queries_of_all_parts_against_sql(spark):
    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for table in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = con.execute(search_queries.INDEXED_SEARCH_SQL).fetchall()
    got = [(r.query_id, r.ord) for r in search_queries.indexed_search(spark, folder).collect()]
    assert sorted(got) == sorted(want) and got
