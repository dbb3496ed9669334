"""Russian food words whose Ukrainian name has another root."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from larder.functions.distance import max_cost, prefix_distance
from larder.functions.text import fold, tokenize

# A word and its translations in order of preference; a translation of several words needs all of them.
ENTRIES = """
творог: сир кисломолочний, кисломолочний
творога: сир кисломолочний, кисломолочний
творожок: сирок
творожный: сирковий
творожная: сиркова
творожное: сиркове
сливки: вершки
сливок: вершки
сливочное: вершкове
сливочный: вершковий
сливочная: вершкова
молочка: молочний, молочна, молоко
сгущенка: згущене молоко, згущене
сгущенное: згущене
простокваша: ряжанка
маслице: масло
брынза: фета, бринза
ветчина: шинка
ветчины: шинка
говядина: яловичина
говядины: яловичина
говяжий: яловичий
говяжья: яловича
курица: курка, курятина
курицы: курка, курятина
куриное: куряче
куриная: куряча
куриный: курячий
куриные: курячі
утка: качка
утки: качка
утиное: качине, качка
утиная: качина, качка
сельдь: оселедець
селедка: оселедець
селедки: оселедець
лук: цибуля
лука: цибуля
картофель: картопля
картофеля: картопля
картошка: картопля
картошки: картопля
свекла: буряк
свеклы: буряк
горошек: горошок
горошка: горошок
тыква: гарбуз
тыквы: гарбуз
огурец: огірок
огурцы: огірки, огірок
огурцов: огірки, огірок
морковь: морква
морковка: морква
моркови: морква
укроп: кріп
укропа: кріп
сельдерей: селера
шампиньоны: печериці
шампиньон: печериця
вешенки: гливи
опята: опеньки
цветная: цвітна
клубника: полуниця
клубники: полуниця
клубничный: полуничний
земляника: суниця
арбуз: кавун
арбуза: кавун
персики: персики
крыжовник: аґрус
клюква: журавлина
клюквы: журавлина
черника: чорниця
черники: чорниця
голубика: лохина
ежевика: ожина
изюм: родзинки
изюма: родзинки
мука: борошно
муки: борошно
сахар: цукор
сахара: цукор
семечки: насіння
хлопья: пластівці
хлопьев: пластівці
овсянка: вівсянка
овсянки: вівсянка
овсяные: вівсяні
овсяная: вівсяна
овсяное: вівсяне
овсяный: вівсяний
гречневая: гречана
гречневые: гречані
гречневый: гречаний
ржаной: житній
ржаная: житня
ржаное: житнє
дрожжи: дріжджі
лапша: локшина
лапши: локшина
фасоль: квасоля
фасоли: квасоля
чечевица: сочевиця
чечевицы: сочевиця
орех: горіх
орехи: горіхи
орехов: горіхи
грецкий: волоський, грецький
уксус: оцет
подсолнечное: соняшникова олія, соняшникове
подсолнечная: соняшникова
растительное: олія
масло: масло, олія
масла: масло, олія
конфеты: цукерки
конфет: цукерки
конфета: цукерки
печенье: печиво
печенья: печиво
мороженое: морозиво
мороженого: морозиво
пирожное: тістечко
пирожные: тістечка, тістечко
кофе: кава
газировка: газований, газована
газированная: газований, газована
газированный: газований
водка: горілка
водки: горілка
блины: млинці
блинчики: млинці
оладьи: оладки
лейс: lays
спрайт: sprite
"""


@dataclass(frozen=True)
class Entry:
    key: str
    phrases: tuple[tuple[str, ...], ...]
    display: tuple[str, ...]


@lru_cache(maxsize=1)
def entries() -> tuple[Entry, ...]:
    found = []
    for line in ENTRIES.strip().splitlines():
        key, _, rest = line.partition(": ")
        shown = tuple(rest.split(", "))
        found.append(Entry(fold(key), tuple(tuple(tokenize(x)) for x in shown), shown))
    return tuple(found)


def alternatives(word: str) -> list[tuple[str, ...]]:
    """Phrases of the closest keys: a key that the word begins, or one within the word's budget."""
    cap = max_cost(word)
    costs = [(0.0 if e.key.startswith(word) else prefix_distance(word, e.key, cap) if cap else float("inf"), e) for e in entries()]
    least = min(c for c, _ in costs)
    return [] if least == float("inf") else [p for c, e in costs if c == least for p in e.phrases]
