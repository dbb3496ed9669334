"""Hard negatives by a two-dimensional block matrix product."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.llm.common import Workspace, bounded_batches, read
from larder.operators.ordering import numbered

#: A tile of scores: anchors by rows; a panel has CHUNK components of either. An int64 tile is 8 MB at most.
ANCHORS, ROWS, CHUNK = 256, 4096, 32


BLOCK_TYPE = pa.struct([("d", pa.int32()), ("i", pa.int64())])
LONGS = pa.list_(pa.int64())
WANTED = pa.list_(pa.struct([("anchor", pa.int64()), ("positive", pa.int64()), ("score", pa.int64())]))
DDL = {"block": "struct<d: int, i: bigint>", "longs": "array<bigint>", "wanted": "array<struct<anchor: bigint, positive: bigint, score: bigint>>"}


def pack(x: np.ndarray) -> bytes:
    """int64 numbers, signs folded into the lowest bit, as planes of their bytes without the planes that are all zero: the
    number of planes, then the planes."""
    folded = ((x << 1) ^ (x >> 63)).view(np.uint64)
    planes = max(1, (int(folded.max(initial=0)).bit_length() + 7) // 8)
    return bytes([planes]) + np.ascontiguousarray(folded.reshape(-1, 1).view(np.uint8)[:, :planes].T).tobytes()


def unpack(data: bytes, width: int) -> np.ndarray:
    """The numbers, ``width`` a row."""
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    folded = np.zeros((planes.shape[1], 8), np.uint8)
    folded[:, : data[0]] = planes.T
    folded = folded.view(np.uint64).ravel()
    return ((folded >> np.uint64(1)).view(np.int64) ^ -(folded & np.uint64(1)).view(np.int64)).reshape(-1, width)


def panels(rows: DataFrame, size: int, role: str, space: Workspace) -> tuple[DataFrame, DataFrame]:
    """(panels, heads): rows (d, label, vec_id, vec) in the order of their labels, cut into blocks of ``size``.

    Panels are (block, chunk, x, ids, labels): the integer components of a block in one chunk of dimensions; only that of
    chunk 0 has ids and labels. heads are (block, low, high), the range of a block's labels. All vectors of a block have
    the same number of components.
    """
    placed = numbered(rows, [F.col("d"), F.col("label"), F.col("vec_id")], "place", 0)
    block = F.struct("d", F.floor(F.col("place") / size).alias("i"))
    gathered = placed.groupBy(block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("label", "vec_id", "vec"))).alias("rows"))  # at most ``size`` rows
    gathered = gathered.select("block", F.col("rows.vec_id").alias("ids"), F.col("rows.label").alias("labels"), F.col("rows.vec").alias("vecs"))
    schema = pa.schema([("block", BLOCK_TYPE), ("chunk", pa.int32()), ("x", pa.binary()), ("ids", LONGS), ("labels", LONGS)])

    def cut(stream):
        for batch in stream:
            for i in range(batch.num_rows):
                head = {c: batch.column(c)[i].as_py() for c in ("ids", "labels")}
                x = batch.column("vecs")[i].values.flatten().to_numpy().reshape(len(head["ids"]), -1)
                if np.abs(x).max(initial=0) >= 2.0**62:
                    raise OverflowError("components beyond a long")
                x = x.astype(np.int64)
                for chunk, at in enumerate(range(0, x.shape[1], CHUNK)):
                    out = {"block": batch.column("block")[i].as_py(), "chunk": chunk, "x": pack(np.ascontiguousarray(x[:, at : at + CHUNK]))}
                    yield pa.RecordBatch.from_pylist([out | (head if chunk == 0 else {})], schema)

    cut_up = space.write(gathered.mapInArrow(cut, f"block {DDL['block']}, chunk int, x binary, ids {DDL['longs']}, labels {DDL['longs']}"), f"{role}-panels")
    return cut_up, cut_up.where("chunk = 0").select("block", F.array_min("labels").alias("low"), F.array_max("labels").alias("high"))


def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of integer rows; by doubles where these are exact, an error beyond a long."""
    bound = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * x.shape[1]
    if bound < 2**53:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    if bound >= 2**61:
        raise OverflowError("scores beyond a long")
    return x @ y.T


def score_tiles(pairs: DataFrame, left: DataFrame, right: DataFrame, reduce_tile, schema: str) -> DataFrame:
    """The rows that ``reduce_tile(head, scores)`` makes of the tiles ``pairs`` (a, b): a block of anchors, one of rows.

    For each tile and chunk of dimensions both panels meet in a task, which multiplies them and sends its partial int64 tile
    on; the partial tiles of a tile are added up where it is reduced. head has ids, labels, row_ids, row_labels and wanted.
    A task holds two panels or two tiles at a time.
    """
    columns = ["a", "b", "chunk", "x", "ids", "labels", "wanted", "side"]
    ours = left.withColumnRenamed("block", "a").join(pairs, "a").withColumn("side", F.lit(0)).select(*columns)
    theirs = right.withColumnRenamed("block", "b").join(pairs, "b").withColumns({"side": F.lit(1), "wanted": F.lit(None)}).select(*columns)
    met = ours.unionByName(theirs).repartition("a", "b", "chunk").sortWithinPartitions("a", "b", "chunk", "side")
    partial = pa.schema([("a", BLOCK_TYPE), ("b", BLOCK_TYPE), ("chunk", pa.int32()), ("n", pa.int32()), ("tile", pa.binary()), *[(c, LONGS) for c in ("ids", "labels", "row_ids", "row_labels")], ("wanted", WANTED)])

    def multiply(stream):
        kept = None
        for batch in stream:
            for row in batch.to_pylist():
                if row["side"] == 0:
                    kept = row
                    continue
                width = min(CHUNK, row["a"]["d"] - CHUNK * row["chunk"])
                tile = product(unpack(kept["x"], width), unpack(row["x"], width))
                out = {f: kept[f] for f in ("a", "b", "chunk", "ids", "labels", "wanted")} | {"n": tile.shape[1], "tile": pack(tile), "row_ids": row["ids"], "row_labels": row["labels"]}
                yield pa.RecordBatch.from_pylist([out], partial)

    heads = ", ".join(f"{c} {DDL['longs']}" for c in ("ids", "labels", "row_ids", "row_labels"))
    tiles = met.mapInArrow(multiply, f"a {DDL['block']}, b {DDL['block']}, chunk int, n int, tile binary, {heads}, wanted {DDL['wanted']}")
    tiles = tiles.repartition("a", "b").sortWithinPartitions("a", "b", "chunk")

    def add(stream):
        head, scores = None, None
        for batch in stream:
            for row in batch.to_pylist():
                tile = unpack(row.pop("tile"), row["n"])
                if row["chunk"]:
                    scores = scores + tile
                    continue
                if head:
                    yield reduce_tile(head, scores)
                head, scores = row, tile
        if head:
            yield reduce_tile(head, scores)

    return tiles.mapInArrow(add, schema)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        kept = np.flatnonzero(scores >= least)
        return kept[np.lexsort((ids[kept], -scores[kept]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def hard_negatives(
    vectors: DataFrame, positives: int = 5, negatives: int = 5, every: int = 100, low: int = 80, high: int = 100, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by ``every``; an anchor's positives are the ``positives`` other rows of its
    label with the highest scores; for each, the ``negatives`` highest scores of rows of other labels count that lie between
    ``low`` and ``high`` hundredths of the positive's. The score is the inner product of the components floor(scale * x);
    ties go to smaller ids; what is fewer is all returned.

    Rows with a null id, a null label or a null or empty vector, or with a null or non-finite component, take no part.
    Vectors only meet others of their number of components. Of rows that repeat an id the smallest (label, vector) counts.
    Other columns are ignored. No rows or anchors: no result. A score that might leave a long is an error.

    Both sides lie in blocks in the order of labels, so positives need only the tiles of which both sides may have a label,
    and negatives only those that are not of one and the same label. All anchors meet all rows, but once for most pairs.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    space = Workspace(spark, "negatives")
    vec = F.col("vec")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(vec) > 0) & F.coalesce(fine, F.lit(False)))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("r"))
    # doubles: a component beyond a long is an error where it is cut up
    whole = F.transform(F.col("r.vec"), lambda x: F.when(F.abs(x * scale) < 2.0**62, F.floor(x * scale).cast("double")).otherwise(x * scale))
    rows = space.write(rows.select(F.size("r.vec").alias("d"), F.col("r.label").alias("label"), "vec_id", whole.alias("vec")), "rows")
    left, left_heads = panels(rows.where(F.col("vec_id") % every == 0), ANCHORS, "anchor", space)
    right, right_heads = panels(rows, ROWS, "row", space)
    # blocks meet by a salt, so that no task has all of them
    salts = F.array(*map(F.lit, range(64)))
    ours = left_heads.select(F.col("block").alias("a"), F.col("low").alias("a_low"), F.col("high").alias("a_high"), F.col("block.d").alias("d"), F.explode(salts).alias("salt"))
    theirs = right_heads.select(F.col("block").alias("b"), F.col("low").alias("b_low"), F.col("high").alias("b_high"), F.col("block.d").alias("d"), (F.col("block.i") % 64).cast("int").alias("salt"))
    tiles = space.write(ours.join(theirs, ["d", "salt"]).drop("d", "salt"), "tiles")
    same = tiles.where("a_low <= b_high and b_low <= a_high").select("a", "b")
    other = tiles.where("not (a_low = a_high and b_low = b_high and a_low = b_low)").select("a", "b")

    def table(found: list[tuple], names: list[str]) -> pa.RecordBatch:
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else [[]] * len(names))]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in flat], names)

    def nearest_of_label(head, scores):
        ids, labels, found = np.array(head["row_ids"]), np.array(head["row_labels"]), []
        for i, (anchor, label) in enumerate(zip(head["ids"], head["labels"], strict=True)):
            at = np.flatnonzero((labels == label) & (ids != anchor))
            at = at[_best(scores[i, at], ids[at], positives)]
            found.append((np.full(len(at), anchor), ids[at], scores[i, at]))
        return table(found, ["anchor", "positive", "score"])

    # nothing to be told to the tiles yet
    plain = left.withColumn("wanted", F.lit(None).cast(DDL["wanted"]))
    near = score_tiles(same, plain, right, nearest_of_label, "anchor long, positive long, score long")
    first = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "positive"))
    near = space.write(near.withColumn("place", first).where(F.col("place") <= positives).drop("place"), "positives")

    def in_windows(head, scores):
        ids, labels, found = np.array(head["row_ids"]), np.array(head["row_labels"]), []
        place = {anchor: i for i, anchor in enumerate(head["ids"])}
        by_anchor: dict[int, list[tuple[int, int]]] = {}
        for w in head["wanted"] or []:
            by_anchor.setdefault(w["anchor"], []).append((w["positive"], w["score"]))
        for anchor, wanted in by_anchor.items():
            row = scores[place[anchor]]
            # whole numbers: low * p <= 100 * n <= high * p
            bounds = [(-(-low * p // 100), high * p // 100) for _, p in wanted]
            at = np.flatnonzero((labels != head["labels"][place[anchor]]) & (row >= min(b[0] for b in bounds)) & (row <= max(b[1] for b in bounds)))
            at = at[np.lexsort((ids[at], -row[at]))]
            for (positive, score), (least, most) in zip(wanted, bounds, strict=True):
                begin = int(np.searchsorted(-row[at], -most, side="left"))
                mine = at[begin : begin + negatives]
                mine = mine[row[mine] >= least]
                found.append((np.full(len(mine), anchor), np.full(len(mine), positive), ids[mine], np.full(len(mine), score), row[mine]))
        return table(found, ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    anchors = left.where("chunk = 0").select("block", F.explode("ids").alias("anchor"))
    told = near.join(anchors, "anchor").groupBy("block").agg(F.collect_list(F.struct("anchor", "positive", "score")).alias("wanted"))  # a few for each anchor of a block
    told = left.join(told, "block", "left").withColumn("wanted", F.when(F.col("chunk") == 0, F.col("wanted")))
    fields = ("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score")
    met = score_tiles(other, told, right, in_windows, ", ".join(f"{f} long" for f in fields))
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    ranked = met.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label))


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS alike, list_sum(list_transform(list_zip(a.vec, v.vec), lambda p: p[1] * p[2])) AS score
  FROM v a, v WHERE a.vec_id % 100 = 0 AND a.vec_id <> v.vec_id AND len(a.vec) = len(v.vec)
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, CAST(positive_score AS BIGINT) AS positive_score, CAST(score AS BIGINT) AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT alike AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""
