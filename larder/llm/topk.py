"""Exact top-k inner-product search by pivot-table elimination."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.llm.common import Workspace, bounded_batches, join_by_key, keyed_vectors, read

#: Vectors that meet in one group: candidates, and queries.
CANDIDATE_BLOCK, QUERY_BLOCK = 8192, 1 << 16
#: Pivots, chosen from at most PIVOT_SAMPLE vectors; both change the speed, never the result.
PIVOTS, PIVOT_SAMPLE = 64, 1024
#: Candidates evaluated before the first look at the stopping bound; twice as many before each further one.
STEP = 256
#: Vectors of a larger squared norm have no distances; they are candidates of every query.
LARGEST = 2.0**100


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first choice: each pivot is the sample vector farthest from those before it."""
    if not len(sample):
        return sample
    chosen = [0]
    far = np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Rows: vectors. Columns: pivots."""
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0)).astype(np.float32)


def exact_scores(q: np.ndarray, x: np.ndarray, largest: float) -> np.ndarray:
    """Integer inner products of one vector with rows, whose components are at most ``largest``; Python's integers where
    a double would round."""
    if np.abs(q).sum() * largest < 2**53:
        return (x @ q).astype(np.int64)
    big = [int(v) for v in q]
    return np.array([sum(a * int(b) for a, b in zip(big, row, strict=True)) for row in x.tolist()], dtype=object)


def score_bounds(norm_q: np.ndarray, norm_c: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Upper bounds of scores from lower bounds of distances: 2 q.c = |q|^2 + |c|^2 - d(q, c)^2, and the rounding of the
    stored distances, generously."""
    return (norm_q + norm_c - lower * lower) / 2 + 1e-5 * (1 + norm_q + norm_c)


def search_block(q_ids, q, table_q, least, c_ids, c, table_c, k: int, evaluated: list[int] | None = None):
    """(query index, candidate id, score) of each query's k best among the candidates other than itself, of those that
    score at least ``least`` (one a query, -inf for any).

    The tables hold the distances to the pivots, a row a vector. By the triangle inequality the largest difference of two
    vectors' distances bounds their own distance from below, and so their score from above. Candidates are evaluated in
    the order of this bound; once the next bound is below the k-th score found, nothing left can enter, ties included.
    """
    norm_c, norm_q = (c * c).sum(1), (q * q).sum(1)
    by_pivot = np.ascontiguousarray(table_c.T)
    room = np.empty_like(by_pivot)
    largest = float(np.abs(c).max(initial=0))
    for i in range(len(q)):
        if len(by_pivot):
            np.abs(np.subtract(by_pivot, table_q[i][:, None], out=room), out=room)
            bound = score_bounds(norm_q[i], norm_c, room.max(axis=0).astype(np.float64))
        else:
            bound = np.full(len(c), np.inf)
        best_ids, best, worst = np.zeros(0, np.int64), np.zeros(0, np.int64), least[i]
        left = np.flatnonzero((bound >= worst) & (c_ids != q_ids[i]))
        step = STEP
        while len(left):
            if len(left) > step:
                part = np.argpartition(-bound[left], step - 1)
                now, left = left[part[:step]], left[part[step:]]
            else:
                now, left = left, left[:0]
            step *= 2
            if evaluated is not None:
                evaluated.append(len(now))
            ids, scores = np.concatenate([best_ids, c_ids[now]]), np.concatenate([best, exact_scores(q[i], c[now], largest)])
            order = np.lexsort((ids, -scores))[:k]
            best_ids, best = ids[order], scores[order]
            if len(best) == k:
                worst = max(worst, best[-1])
                left = left[bound[left] >= worst]
        for x, s in zip(best_ids.tolist(), best.tolist(), strict=True):
            if s >= least[i]:
                yield i, x, s


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` its k best other rows.

    Components x become floor(scale * x), x as double; the score is the integer inner product; ties go to the smaller
    id; fewer than k candidates are all returned. Vectors that are null, empty or hold null or non-finite components
    take no part; vectors only meet others of their number of components. A row of the result whose score is beyond a
    long is an error. Of rows that repeat an id the smallest vector counts. Other columns are ignored. Without queries
    or candidates there are no rows.

    A table of every vector's distances to the pivots is written once, and each vector belongs to the cell of its nearest
    pivot. A query is first searched in its own cell; the k-th score found there rules out all cells whose range of
    distances bounds them below it, before anything is shuffled to them. A cell's rows are dealt by hash into groups of
    bounded size, however many rows it has. Only the pivots' sample and one row a cell and width of the sample reach the
    driver. Vectors of a width that the sample lacks, or of huge components, are compared without bounds.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    space = Workspace(spark, "topk")
    usable = space.write(keyed_vectors(vectors, id_col, vec_col), "vectors")
    # hashed order: any rows do as pivots, and the same ones come in each run
    sample = [np.floor(np.array(r[0]) * scale) for r in usable.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).select("vec").collect()]
    sample = [x for x in sample if x @ x < LARGEST]
    pivots = {d: choose_pivots(np.array([x for x in sample if len(x) == d]), PIVOTS) for d in {*map(len, sample)}}


    def place(stream):
        for batch in stream:
            sizes = np.diff(batch.column("vec").offsets.to_numpy())
            flat = np.floor(batch.column("vec").flatten().to_numpy() * scale)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            cells, norms = np.full(len(sizes), -1, np.int32), np.full(len(sizes), np.inf)
            vecs, dists = [b""] * len(sizes), [np.zeros(0, np.float32)] * len(sizes)
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                x = flat[starts[at][:, None] + np.arange(d)]
                square = (x * x).sum(1)
                for i, v in zip(at, x, strict=True):
                    vecs[i] = v.tobytes()
                if int(d) in pivots:
                    small = square < LARGEST
                    table = distances(x[small], pivots[int(d)])
                    for i, t in zip(at[small], table, strict=True):
                        dists[i] = t
                    cells[at[small]], norms[at[small]] = table.argmin(1), square[small]
            columns = [batch.column("vec_id"), pa.array(sizes.astype(np.int32)), pa.array(cells), pa.array(vecs, pa.binary()), pa.array(dists, pa.list_(pa.float32())), pa.array(norms)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "d", "cell", "vec", "dist", "norm"])

    placed = space.write(usable.mapInArrow(place, "vec_id long, d int, cell int, vec binary, dist array<float>, norm double"), "placed")
    total = placed.count()
    sizes = space.write(placed.groupBy("d", "cell").agg(F.count("*").alias("n")), "sizes")
    each = [F.array(*[f(F.get("dist", F.lit(i))) for i in range(PIVOTS)]).alias(name) for f, name in ((F.min, "low"), (F.max, "high"))]
    known: dict[int, tuple[np.ndarray, ...]] = {}
    rows = placed.where("cell >= 0").groupBy("d", "cell").agg(*each, F.max("norm").alias("norm")).orderBy("d", "cell").collect()
    for d in pivots:
        own, p = [r for r in rows if r.d == d], len(pivots[d])
        known[d] = (np.array([r.cell for r in own]), np.array([r.low[:p] for r in own]), np.array([r.high[:p] for r in own]), np.array([r.norm for r in own]))

    def aim(stream):
        """Of each query (vec_id, d, cell, dist, norm, least) the cells, but its own, that may hold a score of ``least``."""
        for batch in stream:
            at, to = [], []
            for i, (d, own, dist, norm, least) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("d", "cell", "dist", "norm", "least")], strict=True)):
                cells = [-1]
                if d in known:
                    names, low, high, norms = known[d]
                    fits = np.ones(len(names), bool)
                    if own >= 0 and least is not None:
                        q = np.array(dist, np.float32)
                        fits = score_bounds(norm, norms, np.maximum(low - q, q - high).max(axis=1, initial=0).astype(np.float64)) >= least
                    cells += names[fits].tolist()
                cells = [c for c in cells if c != own]
                at += [i] * len(cells)
                to += cells
            picked = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([picked.column("vec_id"), picked.column("d"), pa.array(to, pa.int32()), *[picked.column(c) for c in ("vec", "dist", "least")]], ["vec_id", "d", "cell", "vec", "dist", "least"])

    def search(key, table):
        d, asks = key[0].as_py(), table.column("query").to_numpy(zero_copy_only=False)
        halves = []
        for half in (table.filter(pa.array(asks)), table.filter(pa.array(~asks))):
            dist = half.column("dist").combine_chunks().flatten().to_numpy()
            # without pivots, or with huge components on one side, there are no bounds
            dist = dist.reshape(len(half), -1) if len(half) and len(dist) % len(half) == 0 else np.zeros((len(half), 0), np.float32)
            halves.append((half.column("vec_id").to_numpy(), np.frombuffer(b"".join(half.column("vec").to_pylist())).reshape(len(half), d), dist))
        (q_ids, q, q_dist), (c_ids, c, c_dist) = halves
        if q_dist.shape[1] != c_dist.shape[1]:
            q_dist, c_dist = q_dist[:, :0], c_dist[:, :0]
        least = [-np.inf if x is None else x for x in table.filter(pa.array(asks)).column("least").to_pylist()]
        out: list[list] = [[], [], []]
        for i, v, score in search_block(q_ids, q, q_dist, least, c_ids, c, c_dist, k):
            if score >= 2**63:
                raise OverflowError(f"the score of {q_ids[i]} and {v} is beyond a long")
            for column, value in zip(out, (q_ids[i], v, score if score >= -(2**63) else None), strict=True):
                column.append(value)
        return pa.table([pa.array(x, pa.int64()) for x in out], names=["query_id", "vec_id", "score"])

    def found(targets: DataFrame, label: str) -> DataFrame:
        """The k best of each query in the cells it is aimed at, (query_id, vec_id, score)."""
        targets = space.write(targets, f"{label}-targets")
        asked = targets.groupBy("d", "cell").agg(F.count("*").alias("q")).join(sizes, ["d", "cell"])
        cut = lambda c, most: F.ceil(F.col(c) / most).cast("int")
        asked = space.write(asked.select("d", "cell", "n", "q", cut("n", CANDIDATE_BLOCK).alias("subs"), cut("q", QUERY_BLOCK).alias("parts")), f"{label}-cells")
        deal = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col(n)).cast("int")
        every_one = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        columns = ["d", "cell", "vec_id", "vec", "dist"]
        others = join_by_key(placed.select(*columns), asked.drop("q"), ["d", "cell"], "n", total)
        others = others.select(*columns, F.lit(None).cast("double").alias("least"), F.lit(False).alias("query"), deal("subs", 1).alias("sub"), every_one("parts").alias("part"))
        asks = join_by_key(targets.select(*columns, "least"), asked.drop("n"), ["d", "cell"], "q", targets.count())
        asks = asks.select(*columns, "least", F.lit(True).alias("query"), every_one("subs").alias("sub"), deal("parts", 2).alias("part"))
        met = others.unionByName(asks).groupBy("d", "cell", "sub", "part").applyInArrow(search, "query_id long, vec_id long, score long")
        return space.write(met, label)

    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "vec_id")
    queries = placed.where(F.col("vec_id") % every == 0)
    first = found(queries.withColumn("least", F.lit(None).cast("double")), "own")
    kth = first.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("least"))
    aimed = queries.join(kth, "vec_id", "left").select("vec_id", "d", "cell", "vec", "dist", "norm", "least")
    rest = found(aimed.mapInArrow(aim, "vec_id long, d int, cell int, vec binary, dist array<float>, least double"), "others")
    ranked = first.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    told = F.when(F.col("score").isNull(), F.raise_error(F.lit("a score is beyond a long")).cast("long")).otherwise(F.col("score"))
    return ranked.select("query_id", "rank", "vec_id", told.alias("score"))


def op2_topk(spark, sf_dir):
    return top_k(read(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.vec, c.vec), lambda p: p[1] * p[2])) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM pairs
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 5
"""
