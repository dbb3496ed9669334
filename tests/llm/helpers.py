import random

import duckdb
import pandas as pd

from larder.llm import simhash

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages")


def docs(spark, rows, extra=""):
    """Documents of (doc_id, text, lang, source), n_chars from the text."""
    full = [(*r, *(None,) * (4 - len(r)))[:4] for r in rows]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in full], "doc_id long, text string, lang string, source string, n_chars long")


def oracle(sql, **frames):
    con = duckdb.connect()
    for name, frame in frames.items():
        con.register(f"{name}_frame", frame)
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM {name}_frame")
    for t in TABLES:
        if t not in frames:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con.execute(sql).df()


def plain(x):
    if x is None or x is pd.NA or (isinstance(x, float) and x != x):
        return None
    x = x.item() if hasattr(x, "item") else x
    return int(x) if isinstance(x, float) and x.is_integer() else x


def same(spark_df, frame):
    one = spark_df.toPandas()
    columns = sorted(one.columns)
    assert columns == sorted(frame.columns)
    key = lambda df: sorted(repr(tuple(map(plain, r))) for r in df[columns].itertuples(index=False, name=None))
    assert key(one) == key(frame)


def words(rng: random.Random, n: int, letters: str = "abcdeéñß") -> str:
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(n))


def jaccard_classes(rows, shingle, similarity):
    sets = {i: set(simhash._hashes((t or "").encode(), shingle)) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            shared = len(sets[a] & sets[b])
            if a < b and (sets[a] == sets[b] or shared >= similarity * (len(sets[a]) + len(sets[b]) - shared)):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}
