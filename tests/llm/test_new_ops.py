"""Quality rules, vector codes and hard negatives."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import codebooks, negatives, quality
from larder.llm.common import Workspace

from .helpers import SF, docs, oracle, same, words

VECTORS = "vec_id long, embedding array<float>, label int"


def test_quality_sql(spark):
    same(quality.op11_quality(spark, SF), oracle(quality.OP11_SQL))


def odd_texts():
    rng = random.Random(4)
    rows = [(i, words(rng, 90), "fr" if i % 3 else "de", "s") for i in range(60)]
    rows += [(i, rows[3][1], "fr", "s") for i in range(100, 104)] + [rows[5], (None, words(rng, 70), "fr", "s"), (200, None, "fr", "s"), (201, "", None, "s"), (202, words(rng, 60), None, "s")]
    rows += [(203, "a\nb\n\n \na\nb c\n" * 30, "de", "s"), (204, "  x\ty\x0b#z|" * 80, "de", "s"), (205, "Ω" * 400 + " " + words(rng, 60, "ΩЖ漢"), "fr", "s"), (206, "one two", "only", "s")]
    return rows


def brute_counts(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(found[i : i + 3]) for i in range(len(found) - 2))
    covered = {i + j for i in range(len(found) - 2) if seen[tuple(found[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_counts():
    rng = random.Random(1)
    for text in [t or "" for _, t, *_ in odd_texts()] + [" ".join(rng.choice("ab") for _ in range(n)) for n in range(40)]:
        assert quality.base_counts(text.encode()) == brute_counts(text)


@pytest.mark.parametrize("entries", [1 << 22, 0])
def test_quality_odd(spark, monkeypatch, entries):
    monkeypatch.setattr(quality, "ENTRIES", entries)
    given = docs(spark, odd_texts()).withColumns({"kept": F.lit("x"), "half": F.lit(7), "cost": F.lit(None)})
    got = quality.judge_quality(given).toPandas()
    one = got.drop(columns=["cost", "chars", "perplexity"])
    want = oracle(quality.OP11_SQL, documents=docs(spark, odd_texts()).toPandas())
    key = lambda df: sorted(repr(tuple(None if x is None or x != x else int(x) for x in r)) for r in df[sorted(df.columns)].itertuples(index=False))
    assert key(one) == key(want)
    assert quality.judge_quality(docs(spark, []).limit(0)).count() == 0
    assert quality.judge_quality(docs(spark, [(1, None), (2, " ")])).where("kept or not base_failed").count() == 0


def test_model_is_a_distribution(spark):
    """The probabilities of a context's n-grams and of what it leaves to lower orders add up to one, at each order."""
    text = words(random.Random(5), 4000, "abcd")
    grams = Counter(text[i : i + quality.ORDER] for i in range(len(text) - quality.ORDER + 1))
    table = spark.createDataFrame([("x", g, n, n % 3) for g, n in grams.items()], "lang string, gram string, c0 long, c1 long")
    shares = quality.gram_shares(quality.gram_levels(table))
    sums = shares.groupBy("k", F.expr("left(gram, k - 1)")).agg(*[F.sum(f"a{f}").alias(f"a{f}") for f in (0, 1)], *[F.first(f"g{f}").alias(f"g{f}") for f in (0, 1)]).toPandas()
    for f in (0, 1):
        assert np.allclose(sums[f"a{f}"] + sums[f"g{f}"], 1) and (sums[f"g{f}"] > 0).all()
    # every context sees all four letters and the blank: whole distributions
    costs = quality.gram_costs(shares).toPandas()
    full = [np.exp(-rows.u1 / quality.UNIT).sum() for _, rows in costs.groupby(costs.gram.str[:4]) if len(rows) == 5]
    assert full and np.allclose(full, 1, atol=1e-3)


def test_perplexity_rejects_noise(spark):
    rng = random.Random(6)
    rows = [(i, words(rng, 120, "abcdé"), "fr", "s") for i in range(300)] + [(i, words(rng, 120, "zyxwvutsrqponmlkjihgfABCDEFGHIJ0123456789"), "fr", "s") for i in range(300, 304)]
    got = {r.doc_id: r.kept for r in quality.judge_quality(docs(spark, rows)).collect()}
    assert [got[i] for i in range(300, 304)] == [False] * 4 and all(got[i] for i in range(300))


def vectors(spark, rows):
    return spark.createDataFrame(rows, VECTORS)


def odd_vectors(d=16):
    rng = np.random.default_rng(3)
    make = lambda: [float(x) for x in rng.normal(size=d).astype(np.float32)]
    rows = [(i, make(), int(rng.integers(0, 4))) for i in range(1, 330)] + [(i, make(), None) for i in (400, 401)]
    copied = rows[40][1]
    rows += [(i, copied, i % 3) for i in range(500, 540)] + [(600, None, 1), (700, [], 1), (800, [float("nan")] * d, 1), (900, [None, *copied[1:]], 2), (1000, [float("-inf")] * d, 2), (1100, [0.0] * d, 1)]
    return rows


def lloyd(rows, parts=8, entries=16, rounds=6):
    kept = sorted(((i, np.floor(4096 * np.array(v, np.float64)).astype(np.int64).tolist(), l) for i, v, l in rows if v and all(x is not None and np.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0], r[1]))
    d = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == d]
    x = np.array([r[1] for r in kept]).reshape(len(kept), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    for turn in range(rounds + 1):
        code = np.stack([codebooks.nearest(x[:, p], books[p]) for p in range(parts)], axis=1)
        if turn < rounds:
            for p in range(parts):
                for e in set(code[:, p].tolist()):
                    mine = x[code[:, p] == e, p]
                    books[p, e] = mine.sum(axis=0) // len(mine)
    error = ((x - books[np.arange(parts)[None], code]) ** 2).sum(axis=(1, 2))
    return sorted((repr(r[0]), "".join(f"{c:02x}" for c in cs), int(e)) for r, cs, e in zip(kept, code.tolist(), error, strict=True)), books


def test_codes_sql(spark):
    same(codebooks.op12_vector_codes(spark, SF), oracle(codebooks.OP12_SQL))


@pytest.mark.parametrize("block", [8192, 20])
def test_codes_odd(spark, monkeypatch, block):
    monkeypatch.setattr(codebooks, "BLOCK", block)
    rows = [*odd_vectors(), odd_vectors()[7], (None, odd_vectors()[9][1], 1), (2000, [1.0] * 8, 1)]
    want, books = lloyd(rows)
    coded, got_books = codebooks.codes(vectors(spark, rows).withColumns({"code": F.lit("x"), "error": F.lit("y"), "trees": F.lit(1)}))
    out = codebooks.with_label_error(coded, Workspace(spark, "test")).collect()
    assert sorted((repr(r.vec_id), r.code, r.error) for r in out) == want and (books == got_books).all()
    sums = Counter()
    for r in out:
        sums[r.label] += r.error
    assert all(r.label_error == sums[r.label] for r in out)
    few, few_books = codebooks.codes(vectors(spark, rows[:3]))
    assert sorted((repr(r.vec_id), r.code, r.error) for r in few.collect()) == lloyd(rows[:3])[0] and few_books.shape == (8, 3, 2)
    none, none_books = codebooks.codes(vectors(spark, rows).limit(0))
    assert none.count() == 0 and none_books.size == 0


def test_trees_eliminate():
    """Clustered points go to their entries as whole subtrees; the assignment is that of comparing all."""
    rng = np.random.default_rng(8)
    centres = rng.integers(-4000, 4000, (16, 8))
    points = (centres[rng.integers(0, 16, 8000)] + rng.integers(-60, 60, (8000, 8))).astype(np.int64)
    stats = {}
    tree = codebooks.Tree(points)
    codebooks.filter_tree(tree, centres, stats)
    assert (codebooks.assign(tree, centres) == codebooks.nearest(points, centres)).all()
    assert stats["compared"] < 0.1 * stats["points"]
    sums, counts = codebooks.entry_sums(tree, centres)
    assert counts.sum() == 8000 and (sums.sum(axis=0) == points.sum(axis=0)).all()


def test_negatives_sql(spark):
    same(negatives.op13_hard_negatives(spark, SF), oracle(negatives.OP13_SQL))


def mined(rows, k=5):
    kept = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v):
            kept[i] = min(kept.get(i, (label, v)), (label, v))
    whole = {i: [int(np.floor(256 * float(x))) for x in v] for i, (_, v) in kept.items()}
    out = []
    for a in [i for i in kept if i % 100 == 0]:
        score = {i: sum(x * y for x, y in zip(whole[a], v, strict=True)) for i, v in whole.items() if i != a and len(v) == len(whole[a])}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if kept[i][0] == kept[a][0]][:k]:
            fits = [i for i in order if kept[i][0] != kept[a][0] and 80 * score[p] <= 100 * score[i] <= 100 * score[p]][:k]
            out += [(a, p, r + 1, i, score[p], score[i]) for r, i in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(256, 4096, 32), (2, 16, 5)])
def test_negatives_odd(spark, monkeypatch, sizes):
    for name, n in zip(("ANCHORS", "ROWS", "CHUNK"), sizes, strict=True):
        monkeypatch.setattr(negatives, name, n)
    # half of all rows have one label; other widths, repeated rows and ids
    rows = [(i, v, 1 if i % 2 else label) for i, v, label in odd_vectors() if i < 600 or not v or v[0] is None or len(v) == 16]
    rows += [(1200, [1.0, 2.0], 1), (1201, [1.0, 1.5], 1), (1202, [1.0, 1.4], 2), rows[99], (100, rows[5][1], 0), (None, rows[5][1], 0)]
    got = negatives.hard_negatives(vectors(spark, rows).withColumns({"block": F.lit("x"), "d": F.lit("y"), "rank": F.lit(1)})).collect()
    want = mined(rows)
    assert sorted(map(tuple, got)) == want and want
    assert negatives.hard_negatives(vectors(spark, rows).limit(0)).count() == 0
    assert negatives.hard_negatives(vectors(spark, [(100, [1.0], 1)])).count() == 0


def test_packed_numbers():
    rng = np.random.default_rng(0)
    for x in (np.zeros((3, 4), np.int64), rng.integers(-(2**15), 2**15, (50, 7)), rng.integers(-(2**61), 2**61, (5, 3)), np.zeros((0, 4), np.int64)):
        assert (negatives.unpack(negatives.pack(x), x.shape[1]) == x).all()
    assert len(negatives.pack(rng.integers(-100, 100, (64, 64)))) == 64 * 64 + 1
