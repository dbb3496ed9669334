"""Versions are seen whole or not at all; the detail cache keeps the newest and writes little."""

import pytest

from larder.sources.versions import Conflict, DetailCache, Versions, read_version, write_version


def test_a_version_is_seen_whole_or_not(spark, tmp_path):
    root = str(tmp_path)
    assert read_version(spark, root) == {}
    one, two = spark.range(3), spark.createDataFrame([("a", None)], "k string, v double")
    assert write_version({"one": one, "two": two}, root) == 1
    held = read_version(spark, root)
    with pytest.raises(Exception, match="stop"):  # the second table fails: nothing changes
        write_version({"one": spark.range(9), "two": two.selectExpr("k", "raise_error('stop') AS v")}, root)
    assert read_version(spark, root)["one"].count() == 3
    (tmp_path / "versions" / "0000000002.json").write_text('{"one": {"pa')  # a writer that stopped while it committed
    assert Versions(spark, root).latest()[0] == 1 and read_version(spark, root)["one"].count() == 3
    assert write_version({"one": spark.range(5), "two": two.limit(0)}, root) == 3
    new = read_version(spark, root)
    assert new["one"].count() == 5 and new["two"].count() == 0 and new["two"].columns == ["k", "v"]
    assert held["one"].count() == 3 and [tuple(r) for r in held["two"].collect()] == [("a", None)]


def test_the_slower_of_two_writers_is_told(spark, tmp_path):
    first, second = Versions(spark, str(tmp_path)), Versions(spark, str(tmp_path))
    a, b = first.latest()[0], second.latest()[0]
    first.commit({"x": 1}, a)
    with pytest.raises(Conflict):
        second.commit({"x": 2}, b)
    assert second.latest() == (1, {"x": 1})


def test_detail_cache(spark, tmp_path):
    cache = DetailCache(spark, str(tmp_path), "double")
    rows = lambda xs: spark.createDataFrame(xs, "id string, detail double")
    assert cache.rows().count() == 0 and cache.missing(rows([("a", None)])).count() == 1
    want, written, n = {}, 0, 20
    for i in range(n):
        batch = [(f"k{i}", float(i)), ("hot", None if i % 2 else float(i)), (None, 1.0)]
        cache.flush(rows(batch + [(f"k{i}", float(i) - 1)]))
        want |= {k: v for k, v in batch if k}
        assert sum(r["level"] == 0 for r in cache.runs()) < cache.FANOUT
    assert {r.id: r.detail for r in cache.rows().collect()} == want
    assert [r.id for r in cache.missing(rows([("k3", None), ("hot", None), ("new", None)])).collect()] == ["new"]
    written = sum(spark.read.parquet(str(f)).count() for f in (tmp_path / "data").iterdir())
    assert written <= 2 * n * 3 and len(cache.runs()) <= 5  # two rows a flush, each written once a level: 20 flushes have three
