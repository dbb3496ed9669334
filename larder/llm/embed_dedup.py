"""Embedding near-dedup by collision-counting projections."""

from __future__ import annotations

from math import ceil, comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import Workspace, bounded_batches, join_by_key, keyed_vectors, read
from larder.llm.components import connected_components
from larder.llm.simhash import fold_pairs

#: Steps of the quantised projections per unit.
GRAIN = 2048
#: Rows of a block, on average; a cell holds two, and their places fit 16 bits.
BLOCK_ROWS = 4096
#: Rows of a cell counted against all others at once, and pairs verified at once.
STRIP, VERIFIED = 256, 1 << 15


def within(window: float, distance: float) -> float:
    """Chance that two vectors at a distance project to values at most ``window`` apart on a standard normal direction."""
    return 1.0 if distance == 0 else erf(window / distance / sqrt(2))


def calibrate(distance: float, window: float, projections: int, recall: float) -> int:
    """The largest collision count that a pair at ``distance`` reaches with a chance of at least ``recall``."""
    p = within(window, distance)
    tail = 0.0
    for count in range(projections, 0, -1):
        tail += comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if tail >= recall:
            return count
    return 0


def near_classes(
    vectors: DataFrame, threshold: float = 0.95, projections: int = 16, recall: float = 0.995, seed: int = 8, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector: links at cosine >= ``threshold`` in double precision.

    Equal vectors are one, with a weight. Unit vectors are projected on random directions, each of which sorts them. Two
    at the threshold's distance d are more than 3.3 d apart on one of them with a chance under 0.001: the first cuts
    the vectors into slices, so that a vector meets only slices in that reach, and inside a cell the second leaves it a
    window of the others. Around each vector's value on every further direction lies a window of 1.4 d in the sorted
    order, and for each pair left the windows that hold it are counted. Pairs with the count that pairs at the threshold
    reach with a chance of ``recall`` are verified by their cosine. Closer pairs are found more surely, none is reported
    below the threshold. Vectors only meet others of their number of components.

    Slices of many rows are dealt by hash into blocks, and each two blocks in reach meet in one cell; a cell returns
    links per row and the roots of its classes, never its pairs.

    One row per id; null ids are dropped. Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing. Of rows that repeat an id the smallest vector counts. Other columns are ignored; an empty table gives
    no rows.
    """
    bounded_batches(vectors.sparkSession)
    space = Workspace(vectors.sparkSession, "near")
    distance = sqrt(max(0.0, 2 - 2 * threshold))
    window, reach = 1.4 * distance, 3.3 * distance
    least = calibrate(distance, window, projections, recall)
    everyone = vectors.select(F.col(id_col).cast("long").alias("vec_id")).where("vec_id is not null").distinct()
    usable = space.write(keyed_vectors(vectors, id_col, vec_col).where(F.exists("vec", lambda x: x != 0)), "vectors")
    total = usable.count()
    # copies: the smallest id stands for all
    usable = usable.withColumn("h", F.xxhash64("vec"))  # orders them at less cost than their components
    alike = space.write(usable.groupBy("h", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "alike")
    members = space.write(join_by_key(usable, alike, ["h", "vec"], "n", total).select("vec_id", "rep"), "members")
    slice_width = max(reach / 4, 1e-3)

    def directions(d: int) -> np.ndarray:
        return np.random.default_rng([seed, d]).standard_normal((d, projections + 2))

    def project(stream):
        made: dict[int, np.ndarray] = {}
        for batch in stream:
            sizes = np.diff(batch.column("vec").offsets.to_numpy())
            flat, starts = batch.column("vec").flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)])
            for d in np.unique(sizes).tolist():
                here = np.flatnonzero(sizes == d)
                x = flat[starts[here][:, None] + np.arange(d)]
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                if d not in made:
                    made = {d: directions(d)}  # one width at a time
                p = x @ made[d]
                at = np.floor(p[:, 0] / slice_width).astype(np.int32)
                q = np.clip(np.rint(p[:, 1:] * GRAIN), -32767, 32767).astype("<i2")
                ids, n = (batch.column(c).take(pa.array(here)) for c in ("rep", "n"))
                columns = [ids, n, pa.array([d] * len(here), pa.int32()), pa.array([r.tobytes() for r in x]), pa.array([r.tobytes() for r in q]), pa.array(at)]
                yield pa.RecordBatch.from_arrays(columns, ["rep", "n", "d", "unit", "q", "at"])

    projected = space.write(alike.select("rep", "n", "vec").mapInArrow(project, "rep long, n long, d int, unit binary, q binary, at int"), "projected")
    n_reps = projected.count()
    span = ceil(reach / slice_width)
    slices = space.write(projected.groupBy("d", "at").agg(F.count("*").alias("rows")).withColumn("blocks", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int")), "slices")
    # of each slice the slices in reach: at most 2 * span + 1
    near = slices.select("d", "rows", "blocks", F.col("at").alias("own"), F.explode(F.sequence(F.col("at") - span, F.col("at") + span)).alias("at"))
    near = near.join(slices.select("d", "at", F.col("blocks").alias("others")), ["d", "at"]).groupBy("d", F.col("own").alias("at"), "rows", "blocks")
    near = space.write(near.agg(F.collect_list(F.struct("at", "others")).alias("reach")), "reach")
    block = lambda at, b: F.struct(at.alias("at"), b.cast("int").alias("b"))
    dealt = join_by_key(projected, near, ["d", "at"], "rows", n_reps)
    dealt = dealt.withColumn("own", block(F.col("at"), F.pmod(F.xxhash64("rep"), F.col("blocks")))).withColumn("to", F.explode("reach"))
    dealt = dealt.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("to.others") - 1))).withColumn("other", block(F.col("to.at"), F.col("b")))
    cells = dealt.select("rep", "n", "d", "unit", "q", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") <= F.col("other")).alias("first"))
    w, r = round(window * GRAIN), round(reach * GRAIN)

    def count(key, table):
        d, alone = key[0].as_py(), key[1] == key[2]
        ids, weights = table.column("rep").to_numpy(), table.column("n").to_numpy()
        x = np.frombuffer(b"".join(table.column("unit").to_pylist())).reshape(-1, d)
        q = np.frombuffer(b"".join(table.column("q").to_pylist()), "<i2").reshape(len(x), -1).T.astype(np.int32)
        side = table.column("first").to_numpy(zero_copy_only=False)
        lefts, rights = (np.arange(len(ids)),) * 2 if alone else (np.flatnonzero(side), np.flatnonzero(~side))
        lefts, rights = lefts[np.lexsort((ids[lefts], q[0, lefts]))], rights[np.lexsort((ids[rights], q[0, rights]))]
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        # on each direction the place of every right row in the sorted order, and the window of every left row
        places, begins, widths = [], [], []
        for p in q[1:]:
            order = np.argsort(p[rights], kind="stable")
            place = np.empty(len(rights), np.uint32)
            place[order] = np.arange(len(rights))
            ordered = p[rights][order]
            begin = np.searchsorted(ordered, p[lefts] - w, "left")
            places.append(place.astype(np.uint16))
            begins.append(begin.astype(np.uint16))
            widths.append((np.searchsorted(ordered, p[lefts] + w, "right") - begin).astype(np.uint16))
        on_second = q[0, rights]
        for at in range(0, len(lefts), STRIP):
            stop = min(at + STRIP, len(lefts))
            start = np.searchsorted(on_second, q[0, lefts[at]] - r, "left")
            end = np.searchsorted(on_second, q[0, lefts[stop - 1]] + r, "right")
            if alone:
                start = max(start, at)
            if start >= end:
                continue
            hits = np.zeros((stop - at, end - start), np.uint8)
            for place, begin, width in zip(places, begins, widths, strict=True):
                # places before the window wrap around beyond its width
                hits += place[None, start:end] - begin[at:stop, None] < width[at:stop, None]
            i, j = np.nonzero(hits >= least)
            if alone:
                later = j + start > i + at
                i, j = i[later], j[later]
            left, right = lefts[i + at], rights[j + start]
            for k in range(0, len(left), VERIFIED):
                a, b = left[k : k + VERIFIED], right[k : k + VERIFIED]
                true = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
                a, b = a[true], b[true]
                np.add.at(links, a, weights[b])
                np.add.at(links, b, weights[a])
                fold_pairs(root, a, b)
        linked = np.flatnonzero(links)
        # the root is the first row of a class in the table, not its smallest id; any member will do
        return pa.table([ids[linked], ids[root[linked]], links[linked]], names=["rep", "root", "links"])

    found = space.write(cells.groupBy("d", "low", "high").applyInArrow(count, "rep long, root long, links long"), "found")
    degrees = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = connected_components(found.select(F.col("rep").alias("src"), F.col("root").alias("dst")), space).withColumnRenamed("node", "rep")
    told = alike.select("rep", "n").join(degrees, "rep", "left").join(classes, "rep", "left")
    told = told.select("rep", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    linked = join_by_key(members, space.write(told, "told"), ["rep"], "n", total)
    named = everyone.join(linked, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return named.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))


def op8_embed_dedup(spark, sf_dir):
    return near_classes(read(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.vec, b.vec) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), classes AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT c.vec_id, coalesce(n, 0) AS n_links, component_id, c.vec_id = component_id AS kept
FROM classes c LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) d ON c.vec_id = d.a
"""
