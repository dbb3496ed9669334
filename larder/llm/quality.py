"""Quality rules: counts of each text, and bands of its perplexity under a modified Kneser-Ney model."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.llm.common import SHARE, Workspace, bounded_batches, read, spread

#: Code points of an n-gram. Words would not do: most word pairs of a corpus occur once, and the model would outgrow it.
ORDER = 5
#: Costs are whole units of 1/UNIT nats, so that sums do not depend on their order; bands are of whole BINS of a nat.
UNIT, BINS = 1 << 16, 1000
#: A language accepts from WIDTH quartile distances below its lower quartile to as many above its upper one; the distance
#: counts as LEAST_SPREAD bins at least.
WIDTH, LEAST_SPREAD = 8, 50
#: n-grams whose costs are sent to all workers, 16 bytes each; with more of them texts meet costs by a shuffle.
ENTRIES = 1 << 22
#: Windows handled at a time; their places fill the low bits of sorted keys.
SLICE_BITS = 20
#: Symbols that count.
SYMBOLS = b"#*$%&|<>"
POOLED = "\0"

MIX = np.uint64(0x9E3779B97F4A7C15)


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """(words, code points in words, symbols, repeated lines, words in repeated 3-word windows) of a text."""
    words = text.split()  # bytes split at exactly \\x20 and \\x09-\\x0D
    n = len(words)
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))
    symbols = sum(map(text.count, (SYMBOLS[i : i + 1] for i in range(len(SYMBOLS)))))
    seen: set[bytes] = set()
    lines = [x for x in text.split(b"\n") if x.strip()]
    seen.update(lines)
    if n < 4:
        return n, chars, symbols, len(lines) - len(seen), 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words])
    if len(known) == n:
        return n, chars, symbols, len(lines) - len(seen), 0
    pairs = ids[:-1] * len(known) + ids[1:]
    if len(known) >= 1 << 20:  # three ids would not fit into a long
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, at, often = np.unique(pairs[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
    again = often[at] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= again
    return n, chars, symbols, len(lines) - len(seen), int(covered.sum())


def language_seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode())


def windows(texts: list[bytes], seeds: np.ndarray):
    """Slices (codes, starts, text, hash) of all n-grams: of each text's words, joined by blanks, with ORDER - 1 blanks
    before and one behind. ``seeds`` has one number a text."""
    parts = []
    for t in texts:
        words = b" ".join(t.split())
        parts.append(" " * (ORDER - 1) + words.decode("utf-8", "replace") + " " if words else "")
    sizes = np.array([len(p) for p in parts], np.int64)
    codes = np.frombuffer("".join([*parts, "\0" * ORDER]).encode("utf-32-le"), np.uint32)
    ends, total = np.cumsum(sizes), int(sizes.sum())
    for a in range(0, total, 1 << SLICE_BITS):
        b = min(total, a + (1 << SLICE_BITS))
        first, last = np.searchsorted(ends, [a, b - 1], side="right")
        inside = np.minimum(ends[first : last + 1], b) - np.maximum(ends[first : last + 1] - sizes[first : last + 1], a)
        text = np.repeat(np.arange(first, last + 1), inside)
        hashed = seeds[text]
        for j in range(ORDER):
            hashed ^= codes[a + j : b + j]
            hashed *= MIX
            hashed ^= hashed >> np.uint64(29)
        whole = np.arange(a, b) + ORDER <= ends[text]
        yield codes, np.flatnonzero(whole) + a, text[whole], hashed[whole]


def gram_hashes(grams: list[str], seeds: np.ndarray) -> np.ndarray:
    """The same hashes of written n-grams."""
    codes = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).reshape(-1, ORDER)
    hashed = seeds.copy()
    for j in range(ORDER):
        hashed ^= codes[:, j]
        hashed *= MIX
        hashed ^= hashed >> np.uint64(29)
    return hashed


def runs(hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of one of each run of equal hashes, how many). A hash whose high bits another one has may come in several
    runs, which add up later: sorting keys with the place in their low bits is much cheaper than a sort of places."""
    low = np.uint64((1 << SLICE_BITS) - 1)
    order = (np.sort((hashed & ~low) | np.arange(len(hashed), dtype=np.uint64)) & low).astype(np.int64)
    ordered = hashed[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(order) else order
    return order[first], np.diff(np.append(first, len(order)))


class CostArrays:
    """Sorted hashes with the costs that texts of either half pay; a table of the hashes' top bits finds the place."""

    def __init__(self, hashes: np.ndarray, costs: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.costs = hashes[order], costs[:, order]
        self.shift = np.uint64(64 - max(1, int(len(hashes)).bit_length() + 1))
        heads = self.hashes >> self.shift
        self.first = np.searchsorted(heads, np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64)).astype(np.int32)
        self.steps = int(np.diff(self.first).max(initial=0))

    def look_up(self, hashed: np.ndarray, half: np.ndarray) -> np.ndarray:
        """Costs of hashes that all are there."""
        at = self.first[hashed >> self.shift]
        left = np.flatnonzero(self.hashes[at] != hashed)
        for _ in range(self.steps):
            if not len(left):
                break
            at[left] += 1
            left = left[self.hashes[at[left]] != hashed[left]]
        return self.costs[half, at]


def gram_levels(grams: DataFrame) -> DataFrame:
    """(k, lang, gram, c0, c1) of all orders from 1 to ORDER: occurrences in either half at the highest; below that in how
    many n-grams one longer an n-gram is the ending."""
    endings = grams.select("lang", F.explode(F.sequence(F.lit(2), F.lit(ORDER))).alias("k"), "gram", *[(F.col(f"c{f}") > 0).alias(f"in{f}") for f in (0, 1)])
    types = endings.groupBy("k", "lang", F.expr(f"substring(gram, {ORDER} + 1 - k)").alias("gram")).agg(*[F.bool_or(f"in{f}").alias(f"in{f}") for f in (0, 1)])
    lower = types.groupBy((F.col("k") - 1).alias("k"), "lang", F.expr("substring(gram, 2)").alias("gram")).agg(*[F.count_if(f"in{f}").alias(f"c{f}") for f in (0, 1)])
    return lower.unionByName(grams.withColumn("k", F.lit(ORDER)))


def discounts(levels: DataFrame) -> DataFrame:
    """(k, lang, d10, d20, d30, d11, d21, d31): what n-grams seen once, twice and more give away in either half."""
    seen = levels.groupBy("k", "lang").agg(*[F.count_if(F.col(f"c{f}") == i).cast("double").alias(f"n{i}{f}") for f in (0, 1) for i in (1, 2, 3, 4)])
    for f in (0, 1):
        n = [None, *[F.col(f"n{i}{f}") for i in (1, 2, 3, 4)]]
        # null unless all counts are there
        seen = seen.withColumns({f"d{i}{f}": F.when(F.least(*n[1:]) > 0, i - (i + 1) * (n[1] / (n[1] + 2 * n[2])) * n[i + 1] / n[i]) for i in (1, 2, 3)})
        seen = seen.withColumn("usual", F.coalesce(F.least(*[f"d{i}{f}" for i in (1, 2, 3)]) > 0, F.lit(False)))
        seen = seen.withColumns({f"d{i}{f}": F.when(F.col("usual"), F.col(f"d{i}{f}")).otherwise(F.lit(i / 2)) for i in (1, 2, 3)})
    return seen.select("k", "lang", *[f"d{i}{f}" for f in (0, 1) for i in (1, 2, 3)])


def gram_shares(levels: DataFrame) -> DataFrame:
    """(k, lang, gram, a0, g0, a1, g1, v): the discounted share that an n-gram has of its context in either half, what the
    context leaves to the order below, and its number of n-grams."""
    rows = levels.join(F.broadcast(discounts(levels)), ["k", "lang"])  # at most ORDER * (SHARE + 1) rows
    context = Window.partitionBy("k", "lang", F.expr("left(gram, k - 1)"))
    made = []
    for f in (0, 1):
        c = F.col(f"c{f}")
        seen = [F.count_if(c == 1).over(context), F.count_if(c == 2).over(context), F.count_if(c > 2).over(context)]
        given = F.col(f"d1{f}") * seen[0] + F.col(f"d2{f}") * seen[1] + F.col(f"d3{f}") * seen[2]
        own = F.when(c > 2, F.col(f"d3{f}")).when(c == 2, F.col(f"d2{f}")).when(c == 1, F.col(f"d1{f}")).otherwise(0.0)
        total = F.sum(c).over(context)
        made += [F.when(total > 0, (c - own) / total).otherwise(0.0).alias(f"a{f}"), F.when(total > 0, given / total).otherwise(1.0).alias(f"g{f}")]
    return rows.select("k", "lang", "gram", *made, F.count("*").over(context).alias("v"))


def gram_costs(shares: DataFrame) -> DataFrame:
    """(lang, gram, u0, u1): -log of the interpolated modified Kneser-Ney probability of each n-gram's last code point, in
    units, as texts of half 0 and of half 1 pay it. Each half pays by the counts of the other."""
    p = shares.where("k = 1").select("lang", "gram", *[(F.col(f"a{f}") + F.col(f"g{f}") * (1 / F.col("v"))).alias(f"p{f}") for f in (0, 1)])
    for k in range(2, ORDER + 1):
        below = p.select("lang", F.col("gram").alias("ending"), F.col("p0").alias("b0"), F.col("p1").alias("b1"))
        own = shares.where(F.col("k") == k).withColumn("ending", F.expr("substring(gram, 2)"))
        p = own.join(below, ["lang", "ending"]).select("lang", "gram", *[(F.col(f"a{f}") + F.col(f"g{f}") * F.col(f"b{f}")).alias(f"p{f}") for f in (0, 1)])
    cost = lambda c: F.floor(-F.log(c) * UNIT).cast("int")
    return p.select("lang", "gram", cost("p1").alias("u0"), cost("p0").alias("u1"))


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, cost, chars, perplexity, kept), one row
    for each row of ``docs``.

    Perplexity is that of a text's code points under a modified Kneser-Ney model of ORDER-grams of its language, counted
    over all documents. Texts belong to one of two halves by their hash, and each is judged by the model of the other
    half: none by its own counts, nor by those of its exact copies. A language's band reaches WIDTH quartile distances
    beyond the quartiles of the texts that pass the base rules; texts outside it are not kept.

    Languages that fewer than a SHARE-th of the rows have are one language, so there are at most SHARE + 1; a null
    language is the empty one. Null and empty texts have no words and fail the base rules; other columns are ignored.
    Rows may repeat, ids may be null. An empty table gives no rows.

    Texts are read twice, and never shuffled. Counts are added up in the tasks, then by Spark; probabilities are joins and
    windows over n-grams. The costs go to the workers as sorted hash arrays, if there are at most ENTRIES of them; else
    each text's hashed n-grams meet the costs in a shuffle.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    space = Workspace(spark, "quality")
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(
        F.col(id_col).alias("id"), text.cast("binary").alias("text"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), (F.md5(text) < "8").cast("int").alias("half")
    )
    held = docs.groupBy("lang").agg(F.count("*").alias("n"))
    total = docs.count()
    own = {r[0]: language_seed(r[0]) for r in held.where(F.col("n") * SHARE >= total).select("lang").collect()}  # at most SHARE

    def pooled(batch):
        langs = [x if x in own else POOLED for x in batch.column("lang").to_pylist()]
        return langs, np.array([own.get(x, 0) for x in langs], np.uint64)

    def count(stream):
        for batch in stream:
            langs, seeds = pooled(batch)
            half = batch.column("half").to_numpy()
            names = pa.array(langs, pa.string())
            # one bit tells the halves apart: their n-grams are counted in one go
            for codes, starts, at, hashed in windows(batch.column("text").to_pylist(), seeds):
                place, n = runs(hashed ^ (half[at].astype(np.uint64) << np.uint64(63)))
                grams = codes[starts[place][:, None] + np.arange(ORDER)].tobytes().decode("utf-32-le")
                columns = [names.take(pa.array(at[place])), pa.array([grams[i : i + ORDER] for i in range(0, len(grams), ORDER)], pa.string()), pa.array(half[at[place]]), pa.array(n)]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "gram", "half", "n"])

    counted = docs.mapInArrow(count, "lang string, gram string, half int, n long").groupBy("lang", "gram")
    grams = space.write(counted.agg(*[F.sum(F.when(F.col("half") == f, F.col("n")).otherwise(0)).alias(f"c{f}") for f in (0, 1)]), "grams")

    def hashed(stream):
        for batch in stream:
            seeds = np.array([own.get(x, 0) for x in batch.column("lang").to_pylist()], np.uint64)
            h = gram_hashes(batch.column("gram").to_pylist(), seeds).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), batch.column("u0"), batch.column("u1")], ["h", "u0", "u1"])

    shares = space.write(gram_shares(space.write(gram_levels(grams), "levels")), "shares")
    costs = space.write(gram_costs(shares).mapInArrow(hashed, "h long, u0 int, u1 int"), "costs")
    arrays = None
    if costs.count() <= ENTRIES:
        table = costs.toArrow()
        arrays = spark.sparkContext.broadcast(CostArrays(table.column("h").to_numpy().view(np.uint64), np.stack([table.column("u0").to_numpy(), table.column("u1").to_numpy()])))

    features = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def read_texts(stream):
        row = TaskContext.get().partitionId() << 40
        known = arrays.value if arrays else None
        for batch in stream:
            texts, (langs, seeds), half = batch.column("text").to_pylist(), pooled(batch), batch.column("half").to_numpy()
            counts = np.array([base_counts(t) for t in texts], np.int64).reshape(-1, 5)
            paid, chars, lists = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), [[] for _ in texts]
            for _, _, at, h in windows(texts, seeds):
                chars += np.bincount(at, minlength=len(texts))
                if known:
                    cost = known.look_up(h, half[at]).astype(np.int64)
                    ends = np.cumsum(cost)
                    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else at
                    paid[at[first]] += np.diff(np.append(ends[first] - cost[first], ends[-1:]))
                else:
                    for i in np.unique(at):
                        lists[i].append(h[at == i].view(np.int64))
            columns = [batch.column("id"), pa.array(langs, pa.string()), batch.column("half"), pa.array(np.arange(row, row + len(texts))), *map(pa.array, counts.T), pa.array(paid), pa.array(chars)]
            columns.append(pa.array([np.concatenate(x) if x else [] for x in lists], pa.list_(pa.int64())))
            row += len(texts)
            yield pa.RecordBatch.from_arrays(columns, ["id", "lang", "half", "row", *features, "cost", "chars", "grams"])

    id_type = docs.schema["id"].dataType.simpleString()
    judged = docs.mapInArrow(read_texts, f"id {id_type}, lang string, half int, row long, {', '.join(f + ' long' for f in features)}, cost long, chars long, grams array<bigint>")
    judged = space.write(judged if arrays is None else judged.drop("grams"), "judged")
    if arrays is None:
        each = judged.select("row", "half", F.explode("grams").alias("h")).groupBy("row", "half", "h").agg(F.count("*").alias("n"))
        summed = each.join(costs, "h").groupBy("row").agg(F.sum(F.col("n") * F.when(F.col("half") == 0, F.col("u0")).otherwise(F.col("u1"))).alias("cost"))
        judged = judged.drop("grams", "cost").join(summed, "row", "left").withColumn("cost", F.coalesce("cost", F.lit(0).cast("long")))

    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = judged.withColumn("base_failed", failed).withColumn("bin", F.expr(f"(cost * {BINS}) div (greatest(chars, 1) * {UNIT})"))
    bands = F.broadcast(quartile_bands(judged.where("not base_failed")))  # one row a language
    inside = F.coalesce(F.col("bin").between(F.col("low"), F.col("high")), F.lit(False))
    out = judged.join(bands, "lang", "left")
    return out.select(
        F.col("id").alias(id_col), *features, "base_failed", "cost", "chars", F.exp(F.col("cost") / (F.greatest("chars", F.lit(1)) * UNIT)).alias("perplexity"), (~F.col("base_failed") & inside).alias("kept")
    )


def quartile_bands(judged: DataFrame) -> DataFrame:
    """(lang, low, high) of rows (lang, bin), from a histogram: as exact as its bins, with a few thousand rows a language."""
    upto = Window.partitionBy("lang").orderBy("bin")
    cum = judged.groupBy("lang", "bin").agg(F.count("*").alias("n")).withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(Window.partitionBy("lang"))})
    quartile = lambda i: F.min(F.when(F.col("upto") * 4 >= F.col("total") * i, F.col("bin")))
    found = cum.groupBy("lang").agg(quartile(1).alias("q1"), quartile(3).alias("q3"))
    reach = F.greatest(F.col("q3") - F.col("q1"), F.lit(LEAST_SPREAD)) * WIDTH
    return found.select("lang", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))


def op11_quality(spark, sf_dir):
    judged = judge_quality(spread(read(spark, sf_dir, "documents").select("doc_id", "text", "lang")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _level_sql(k: int) -> str:
    """Counts, discounts and probabilities of order k in SQL."""
    counts = "" if k == ORDER else f"l{k} AS MATERIALIZED (SELECT lang, substr(gram, 2) AS gram, count(*) FILTER (c0 > 0) AS c0, count(*) FILTER (c1 > 0) AS c1 FROM l{k + 1} GROUP BY 1, 2),"
    found = lambda i, f: f"({i} - {i + 1} * (n1{f} / (n1{f} + 2 * n2{f})) * n{i + 1}{f} / n{i}{f})"
    usual = lambda f: f"n1{f} > 0 AND n2{f} > 0 AND n3{f} > 0 AND n4{f} > 0 AND least({', '.join(found(i, f) for i in (1, 2, 3))}) > 0"
    seen = ", ".join(f"CAST(count(*) FILTER (c{f} = {i}) AS DOUBLE) AS n{i}{f}" for f in (0, 1) for i in (1, 2, 3, 4))
    discounts = ", ".join(f"CASE WHEN {usual(f)} THEN {found(i, f)} ELSE {i / 2} END AS d{i}{f}" for f in (0, 1) for i in (1, 2, 3))
    made = ", ".join(
        f"CASE WHEN t{f} > 0 THEN (c{f} - CASE WHEN c{f} > 2 THEN d3{f} WHEN c{f} = 2 THEN d2{f} WHEN c{f} = 1 THEN d1{f} ELSE 0 END) / t{f} ELSE 0 END"
        f" + CASE WHEN t{f} > 0 THEN (d1{f} * x1{f} + d2{f} * x2{f} + d3{f} * x3{f}) / t{f} ELSE 1 END * {'1 / v' if k == 1 else f'b.p{f}'} AS p{f}"
        for f in (0, 1)
    )
    context = ", ".join(f"sum(c{f}) AS t{f}, count(*) FILTER (c{f} = 1) AS x1{f}, count(*) FILTER (c{f} = 2) AS x2{f}, count(*) FILTER (c{f} > 2) AS x3{f}" for f in (0, 1))
    below = "" if k == 1 else f"JOIN p{k - 1} b ON b.key = g.lang || substr(g.gram, 2)"
    return counts, f"""
  p{k} AS MATERIALIZED (SELECT g.lang, g.gram, g.lang || g.gram AS key, {made} FROM l{k} g JOIN (SELECT lang || left(gram, {k - 1}) AS h, count(*) AS v, {context} FROM l{k} GROUP BY 1) x ON x.h = g.lang || left(g.gram, {k - 1})
    JOIN (SELECT lang, {discounts} FROM (SELECT lang, {seen} FROM l{k} GROUP BY 1)) d ON d.lang = g.lang {below}),"""


OP11_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS own, CAST(md5(coalesce(text, '')) < '8' AS INTEGER) AS half,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
  names AS (SELECT own FROM d GROUP BY own HAVING count(*) * {SHARE} >= (SELECT count(*) FROM d)),
  docs AS MATERIALIZED (SELECT d.*, coalesce(names.own, '') || chr(1) AS lang, repeat(' ', {ORDER - 1}) || array_to_string(words, ' ') || ' ' AS line FROM d LEFT JOIN names USING (own)),
  w AS MATERIALIZED (SELECT r, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS i FROM docs),
  w3 AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM (SELECT r, i, w AS a, lead(w) OVER x AS b, lead(w, 2) OVER x AS c FROM w WINDOW x AS (PARTITION BY r ORDER BY i)) WHERE c IS NOT NULL),
  repeated AS (SELECT r, count(DISTINCT i + s) AS n FROM w3, (SELECT unnest([0, 1, 2]) AS s) WHERE n > 1 GROUP BY r),
  repeated_lines AS (SELECT r, sum(n - 1) AS n FROM (SELECT r, l, count(*) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM docs) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY r, l) GROUP BY r),
  base AS MATERIALIZED (SELECT docs.r, doc_id, lang, half, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, coalesce(x.n, 0) AS n_repeat_words FROM docs LEFT JOIN repeated x ON x.r = docs.r LEFT JOIN repeated_lines l ON l.r = docs.r),
  letters AS (SELECT r, lang, half, unnest(letters) AS x, unnest(range(1, len(letters) + 1)) AS i FROM (SELECT r, lang, half, regexp_extract_all(line, '(?s).') AS letters FROM docs WHERE len(words) > 0)),
  occurrences AS MATERIALIZED (SELECT r, lang, half, gram, count(*) AS n FROM (SELECT r, lang, half, {' || '.join(['x', *[f'lead(x, {j}) OVER o' for j in range(1, ORDER)]])} AS gram FROM letters WINDOW o AS (PARTITION BY r ORDER BY i)) WHERE gram IS NOT NULL GROUP BY ALL),
  l{ORDER} AS MATERIALIZED (SELECT lang, gram, coalesce(sum(n) FILTER (half = 0), 0) AS c0, coalesce(sum(n) FILTER (half = 1), 0) AS c1 FROM occurrences GROUP BY 1, 2),
  {' '.join(_level_sql(k)[0] for k in range(ORDER, 0, -1))}
  {' '.join(_level_sql(k)[1] for k in range(1, ORDER + 1))}
  paid AS (SELECT r, sum(n) AS chars, sum(n * CAST(floor(-ln(CASE WHEN half = 0 THEN p1 ELSE p0 END) * {UNIT}) AS BIGINT)) AS cost FROM occurrences o JOIN p{ORDER} p ON p.key = o.lang || o.gram GROUP BY r),
  judged AS MATERIALIZED (SELECT base.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce((cost * {BINS}) // (chars * {UNIT}), 0) AS bin FROM base LEFT JOIN paid ON paid.r = base.r),
  cum AS (SELECT lang, bin, sum(count(*)) OVER (PARTITION BY lang ORDER BY bin) AS upto, sum(count(*)) OVER (PARTITION BY lang) AS total FROM judged WHERE NOT base_failed GROUP BY lang, bin),
  q AS (SELECT lang, min(bin) FILTER (upto * 4 >= total) AS q1, min(bin) FILTER (upto * 4 >= total * 3) AS q3 FROM cum GROUP BY lang),
  bands AS (SELECT lang, q1 - {WIDTH} * greatest(q3 - q1, {LEAST_SPREAD}) AS low, q3 + {WIDTH} * greatest(q3 - q1, {LEAST_SPREAD}) AS high FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(bin BETWEEN low AND high, false) AS kept FROM judged LEFT JOIN bands ON bands.lang = judged.lang
"""
