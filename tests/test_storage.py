"""Scans of small tables are dealt to all cores."""

from larder.sources.storage import spread


def test_spread_deals_one_row_group_to_all_cores(spark, tmp_path):
    spark.range(500).coalesce(1).write.parquet(str(tmp_path / "one"))
    table = spark.read.parquet(str(tmp_path / "one"))
    cores = spark.sparkContext.defaultParallelism
    dealt = spread(table)
    assert dealt.rdd.getNumPartitions() == cores
    assert dealt.schema == table.schema
    assert sorted(r.id for r in dealt.collect()) == list(range(500))
    assert min(dealt.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) > 0


def test_spread_leaves_scans_of_many_splits(spark):
    cores = spark.sparkContext.defaultParallelism
    table = spark.range(500).repartition(cores)
    assert spread(table) is table


def test_spread_empty(spark, tmp_path):
    spark.range(0).write.parquet(str(tmp_path / "none"))
    assert spread(spark.read.parquet(str(tmp_path / "none"))).count() == 0
