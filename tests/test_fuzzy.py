"""Tables of words against vocabularies by deletion neighbourhoods."""

import random

import pytest

from larder.functions import dictionary
from larder.functions.distance import max_cost, prefix_distances
from larder.operators import fuzzy

LETTERS = "аеиокмтр"


def mutated(rng, token):
    w = list(token)
    for _ in range(rng.randint(0, 3)):
        i, op = rng.randrange(len(w) + 1), rng.randrange(4)
        if op == 0 and i < len(w):
            w[i] = rng.choice(LETTERS)
        elif op == 1 and i < len(w) > 1:
            del w[i]
        elif op == 2:
            w.insert(i, rng.choice(LETTERS))
        elif op == 3 and i + 1 < len(w):
            w[i], w[i + 1] = w[i + 1], w[i]
    return "".join(w)[: rng.randint(1, 14)]


def brute(words, vocabulary):
    out = set()
    for w in filter(None, words):
        b = max_cost(w)
        costs = prefix_distances(w, vocabulary, b) if b else [0.0 if t.startswith(w) else float("inf") for t in vocabulary]
        out |= {(w, t, float(d)) for t, d in zip(vocabulary, costs, strict=True) if d <= b}
    return out


@pytest.fixture(scope="module")
def given(spark):
    rng = random.Random(3)
    vocabulary = sorted({"".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 14))) for _ in range(900)} | {"12", "123", "90", "9", "19", "молоко", "молокопродукт", "м" * 300})
    words = sorted({mutated(rng, t) for t in rng.sample(vocabulary, 300)} | {"9", "молок", "смолоко", "м" * 299, ""})
    v = spark.createDataFrame([(t,) for t in vocabulary] + [(None,)], "token string")
    return words, vocabulary, spark.createDataFrame([(w,) for w in [*words, *words, None]], "word string"), fuzzy.neighbourhood_index(v)


def test_matches_are_those_of_all_pairs(given):
    words, vocabulary, w, index = given
    assert {tuple(r) for r in fuzzy.fuzzy_matches(w, index).collect()} == brute(words, vocabulary)


def test_no_word_meets_the_vocabulary(given):
    """Keys a token has, however long, and pairs that are judged."""
    words, vocabulary, w, index = given
    assert index.groupBy("token").count().agg({"count": "max"}).first()[0] < 400
    plan = fuzzy.fuzzy_matches(w, index)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and "Cartesian" not in plan and "letters" in plan


def test_closest_phrases(spark):
    words = ["творог", "клубнека", "клубни", "мука", "морковь", "лук", "ку", "нетакогослова"]
    found = fuzzy.closest_phrases(spark.createDataFrame([(w,) for w in words], "word string"), fuzzy.dictionary_table(spark))
    got = {(r.word, tuple(r.phrase)) for r in found.collect()}
    assert got == {(w, p) for w in words for p in dictionary.alternatives(w)} and got


def test_empty_tables(spark):
    none = spark.createDataFrame([], "word string")
    index = fuzzy.neighbourhood_index(spark.createDataFrame([], "token string"))
    assert fuzzy.fuzzy_matches(none, index).count() == 0


def test_words_of_a_length_share_a_table(monkeypatch):
    """Distances of pairs are those of each word alone, and a batch costs a table a length and budget, not one a word."""
    import pandas as pd

    from larder.functions import distance

    rng = random.Random(5)
    tokens = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(3, 14))) for _ in range(600)]
    words = [mutated(rng, t) or t for t in tokens]
    budgets = [max_cost(w) for w in words]
    calls = []
    table = distance._codes
    monkeypatch.setattr(distance, "_codes", lambda *a: calls.append(a) or table(*a))
    got = distance._distance.func(pd.Series(words), pd.Series(tokens), pd.Series(budgets, dtype=float))
    assert len(calls) <= 2 * len({(len(w), b) for w, b in zip(words, budgets, strict=True)})
    want = [float(prefix_distances(w, [t], b)[0]) for w, t, b in zip(words, tokens, budgets, strict=True)]
    assert [float("inf") if pd.isna(x) else x for x in got] == want and sum(x < 3 for x in want) > 100


def test_tokens_of_keys(spark, tmp_path):
    """A token counts once for each key, also if rows repeat it, and not for a null key."""
    from larder.plans import search_queries
    from larder.sources.storage import Scratch

    rows = [(1, "рис чай рис"), (1, "рис сік"), (2, "рис iоc"), (2, None), (None, "чай мед"), (3, "")]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    held = search_queries._held(spark, str(tmp_path), "benchmark", "item_id", Scratch(spark, "held"))
    assert {r.w: r.n for r in held.collect()} == {"рис": 2, "чай": 1, "сик": 1, "иоc": 1, "мед": 0}
