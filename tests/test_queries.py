"""Each registered catalogue query against its SQL, and the plans that matter."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__
from larder.plans.queries import QUERIES, oracle_sql, queries
from larder.sources.catalog import derived_products

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    return round(float(v), 9) if isinstance(v, (float, int, np.number)) else v


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(repr(tuple(map(plain, r))) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "part", "lineitem", "documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = rows(queries()[name](spark, SF).toPandas()), rows(con.execute(oracle_sql()[name]).df())
    assert got == want and want[1]


def test_queries_without_sql_have_rows(spark):
    for name in [n for n, (_, sql) in QUERIES.items() if not sql]:
        assert queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["id", "title", "rank"]
    assert set(queries()) <= set(__spark_entry__.queries())


def test_scan_reads_few_columns(spark):
    plan = queries()["facet_counts"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "l_shipdate" not in plan
    assert derived_products(spark, SF).count() > 0


def test_rows_write_what_is_wanted_and_hits_write_nothing(spark, monkeypatch):
    from larder.plans import catalog
    from larder.plans.request import CatalogQuery
    from larder.sources import storage

    written, write = [], storage.Scratch.write
    monkeypatch.setattr(storage.Scratch, "write", lambda self, df, name: (written.append(df.columns), write(self, df, name))[1])
    answer = catalog.run(derived_products(spark, SF), CatalogQuery.landing("north"))
    assert answer.hits().count() > 0 and answer.rows(limit=5).count() == 5 and not written
    whole = answer.rows(columns=("id", "title")).orderBy("rank").limit(5).collect()
    assert written == [["id", "title", "__row"]] and [r.id for r in whole] == [r.id for r in answer.rows(limit=5).collect()]
