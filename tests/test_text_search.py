import math

import pytest
from pyspark.sql import functions as F

from larder.functions.dictionary import alternatives, entries
from larder.functions.distance import max_cost, prefix_distance, word_matches
from larder.functions.text import fold, fold_col, has_cyrillic, latin_col, surface_col, to_latin, tokenize, tokenize_surface, tokens_col
from larder.operators.search import build_index, diagnose, matching, search, suggest

SEARCHED = [
    ("Сир кисломолочний President 9% 300г", "President", "Молочне / Сир кисломолочний"),
    ("Полуниця свіжа", None, "Фрукти та овочі / Ягоди"),
    ("Сік яблучний Sandora 1л", "Sandora", "Напої / Соки"),
    ("Хліб Київхліб житній", "Київхліб", "Хліб та випічка"),
    ("Огірок короткоплідний", None, "Фрукти та овочі / Овочі"),
    ("Олія соняшникова Олейна 1л", "Олейна", "Бакалія / Олія"),
    ("Сир твердий Гауда", None, "Молочне / Сири тверді"),
    ("Морква мита", None, "Фрукти та овочі / Овочі"),
    ("Кава Jacobs Monarch розчинна 200г", "Jacobs", "Гарячі напої / Кава"),
    ("Чипси Lay's зі сметаною 133г", "Lay's", "Чипси та снеки"),
    ("Качка свіжа охолоджена", None, "М'ясо / Птиця"),
    ("Напій газований Живчик 0.5л", "Живчик", "Напої / Газовані"),
]
SUGGESTED = [
    ("Сир кисломолочний President 9% 300г", "President", "Молочне / Сир кисломолочний"),
    ("Полуниця свіжа", None, "Фрукти та овочі / Ягоди"),
    ("Олія соняшникова Олейна 1л", "Олейна", "Бакалія / Олія"),
    ("Молоко Яготинське 2,5% 900г", "Яготинське", "Молочне / Молоко"),
    ("Йогурт Активіа натуральний 2,7%", "Активіа", "Молочне / Йогурти"),
]


def table(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord long, title string, brand string, path string").cache()


@pytest.fixture(scope="module")
def shelf(spark):
    rows = table(spark, SEARCHED)
    return rows, build_index(rows)


@pytest.fixture(scope="module")
def small(spark):
    return build_index(table(spark, SUGGESTED))


@pytest.mark.parametrize("a,b", [("Індичка", "индичка"), ("Єгурт", "егурт"), ("сыр", "сир"), ("ҐУДЗИК", "гудзик"), ("Молокiя", "Молокія"), ("м'ясо", "мясо"), ("мʼясо", "мясо"), ("сіль", "сил"), ("подъезд", "подезд")])
def test_fold(a, b):
    assert fold(a) == fold(b)


def test_tokens():
    assert tokenize("Сир President 9% (180г)") == ["сир", "presиdent", "9", "180г"]
    assert tokenize_surface("М'ясо ' Lay's") == [("мясо", "м'ясо"), ("lays", "lay's")]


def test_columns_agree_with_python(spark):
    texts = [r[0] for r in SEARCHED] + ["", "ЇЖА єґ ь'’ʼ`", "ʼ ' президент джакобс щука"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumns({"f": fold_col(F.col("t")), "k": tokens_col(F.col("t")), "s": surface_col(F.col("t")), "l": latin_col(fold_col(F.col("t")))})
    for r in df.collect():
        assert (r.f, r.k, [tuple(x) for x in r.s], r.l) == (fold(r.t), tokenize(r.t), tokenize_surface(r.t), to_latin(fold(r.t)))


@pytest.mark.parametrize(
    "word,token,budget,cost",
    [
        ("молок", "молоко", 2, 0), ("молок", "молокопродукт", 2, 0), ("сок", "сік", 0.5, 0.5), ("хлеб", "хліб", 1, 0.5), ("сік", "сир", 0.5, math.inf), ("сок", "сир", 0.5, math.inf),
        ("молако", "молоко", 1, 1), ("молоок", "молоко", 1, 1), ("абвгде", "вгдабе", 1, math.inf), ("омлоко", "молоко", 1, math.inf), ("локо", "олоко", 1, 1), ("смолоко", "молоко", 1, 1), ("", "а", 1, 0), ("слово", "", 1, math.inf),
    ],
)
def test_prefix_distance(word, token, budget, cost):
    assert prefix_distance(fold(word), fold(token), budget) == cost


@pytest.mark.parametrize("ru,uk", [("индейка", "індичка"), ("печень", "печінка"), ("семга", "сьомга"), ("гречка", "гречка"), ("колбаса", "ковбаса"), ("треска", "тріска"), ("горчица", "гірчиця"), ("9", "90")])
def test_words_that_match(ru, uk):
    assert word_matches(fold(ru), fold(uk))


@pytest.mark.parametrize("a,b", [("мука", "макарони"), ("хлеб", "хребет"), ("9", "19")])
def test_words_that_do_not(a, b):
    assert not word_matches(fold(a), fold(b))


def test_budgets():
    assert [max_cost(w) for w in ("9", "123456789", "по", "сир", "риба", "шоколад", "кисломолочний")] == [0, 0, 0, 0.5, 1, 1.5, 2]


def test_dictionary():
    assert len(entries()) == 134 and sum(len(e.phrases) for e in entries()) == 153
    assert tuple(tokenize("сир кисломолочний")) in alternatives(fold("творог"))
    for typed in ("клубника", "клубнека", "клубни"):
        assert tuple(tokenize("полуниця")) in alternatives(fold(typed))
    assert ("цибуля",) not in alternatives(fold("мука"))


def test_latin():
    assert to_latin("джакобс") == "jakobs" and has_cyrillic("їa") is False and has_cyrillic("сир")


CASES = {
    "джакобс": ({"Кава Jacobs Monarch розчинна 200г"}, None), "президент": ({"Сир кисломолочний President 9% 300г"}, None), "лейс": ({"Чипси Lay's зі сметаною 133г"}, None),
    "морква": (None, {"Морква мита"}), "утка": ({"Качка свіжа охолоджена"}, None), "газировка": ({"Напій газований Живчик 0.5л"}, None), "300": ({"Сир кисломолочний President 9% 300г"}, None),
    "я" * 500: (None, set()), "сир молоко мясо риба хліб": (None, set()), "  ...полуниця!!!  ": (None, {"Полуниця свіжа"}), "клубника": (None, {"Полуниця свіжа"}), "клубніка": (None, {"Полуниця свіжа"}),
    "сок яблочный": (None, {"Сік яблучний Sandora 1л"}), "хлеб": ({"Хліб Київхліб житній"}, None), "огурец": (None, {"Огірок короткоплідний"}), "морковь": (None, {"Морква мита"}),
    "подсолнечное масло": (None, {"Олія соняшникова Олейна 1л"}), "сир гауда": (None, {"Сир твердий Гауда"}), "сир липовий": (None, set()), "sandora": (None, {"Сік яблучний Sandora 1л"}), "полун": (None, {"Полуниця свіжа"}),
}


@pytest.mark.parametrize("query", CASES)
def test_search(shelf, query):
    rows, index = shelf
    found = {r.title for r in search(rows, index, query).select("title").collect()}
    within, exactly = CASES[query]
    assert exactly is None or found == exactly
    assert within is None or within <= found


def test_search_creamy_not_hard_cheese(shelf):
    found = {r.title for r in search(*shelf, "творог").collect()}
    assert "Сир кисломолочний President 9% 300г" in found and "Сир твердий Гауда" not in found


@pytest.mark.parametrize("query", ["", "  !!! ", "   ", "%#@"])
def test_no_words_no_matcher(shelf, query):
    assert matching(shelf[1], query) is None
    assert search(*shelf, query).count() == len(SEARCHED)


def test_search_against_brute_force(spark, shelf):
    rows, index = shelf
    vocab = [set(tokenize(" ".join(x for x in r if x))) for r in SEARCHED]
    for query in ("сыр", "свежая", "напиток", "1л", "кава jacobs", "масло"):
        want = set()
        for i, tokens in enumerate(vocab):
            fits = True
            for w in tokenize(query):
                ways = [((w,), False), *[(p, False) for p in alternatives(w)]] + ([((fold(to_latin(w)),), True)] if has_cyrillic(w) else [])
                fits &= any(all(any(word_matches(p, t) and (not latin or any("a" <= c <= "z" for c in t)) for t in tokens) for p in phrase) for phrase, latin in ways)
            if fits:
                want.add(i)
        assert {r.ord for r in matching(index, query).collect()} == want, query


def test_suggestions(small):
    assert "полуниця" in suggest(small, "полунеця")
    found = suggest(small, "олея")
    assert "олія" in found and not any("олия" in x for x in found)
    assert "полуниця" in suggest(small, "клубнека")
    found = suggest(small, "молоко ягтинське")
    assert any(x.startswith("молоко ") for x in found) and any("яготинське" in x for x in found)
    assert suggest(small, "") == [] and suggest(small, "ї") == [] and "полуниця" not in suggest(small, "полуниця")
    suggest(small, "я" * 300)


def test_diagnosis(shelf):
    assert diagnose(*shelf, "морква") == ("filters", [])
    kind, words = diagnose(*shelf, "полунеця")
    assert kind in ("term", "filters") and (kind == "filters" or "полуниця" in words)
