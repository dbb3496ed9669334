"""Product-quantised codes of vectors: integer Lloyd rounds by the filtering algorithm."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import Workspace, bounded_batches, join_by_key, read

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096.0
#: Vectors of one set of trees, and points below which a tree is not split further.
BLOCK, LEAF = 8192, 16
#: Components beyond this could take squared distances out of a long.
LARGEST = float(1 << 26)


class Tree:
    """A kd-tree over the parts of a block at one position. Points are laid out so that every node is a range of them;
    nodes hold their bounding box, the sum of their points and their number."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        spans, self.left = [(0, len(points))], []
        lows, highs, sums = [], [], []
        for lo, hi in spans:  # grows while it is read
            inside = points[self.order[lo:hi]]
            low, high = inside.min(axis=0), inside.max(axis=0)
            lows.append(low)
            highs.append(high)
            sums.append(inside.sum(axis=0))
            if hi - lo <= LEAF or (low == high).all():
                self.left.append(-1)
                continue
            middle = (hi - lo) // 2
            self.order[lo:hi] = self.order[lo:hi][np.argpartition(inside[:, (high - low).argmax()], middle)]
            self.left.append(len(spans))
            spans += [(lo, lo + middle), (lo + middle, hi)]
        self.spans, self.left = np.array(spans, np.int64), np.array(self.left, np.int64)
        self.low, self.high, self.sums = np.array(lows), np.array(highs), np.array(sums)
        self.points = points[self.order]

    ARRAYS = ("order", "spans", "left", "low", "high", "sums", "points")

    def pack(self) -> dict[str, bytes]:
        return {f: np.ascontiguousarray(getattr(self, f), np.int64).tobytes() for f in self.ARRAYS}

    @classmethod
    def unpack(cls, packed: dict[str, bytes], width: int) -> Tree:
        tree = cls.__new__(cls)
        for f in cls.ARRAYS:
            flat = np.frombuffer(packed[f], np.int64)
            setattr(tree, f, flat if f in ("order", "left") else flat.reshape(-1, 2 if f == "spans" else width))
        return tree


def nearest(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Index of the nearest entry of each point; the first of equally near ones."""
    return ((points[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)


def filter_tree(tree: Tree, entries: np.ndarray, stats: dict[str, int] | None = None):
    """(nodes, entry of each) so that the nodes' ranges are disjoint and all their points have that entry nearest, and
    (places, entry of each) of the points that were compared one by one.

    All nodes of a depth go down together. An entry z is out of a node if another one, the nearest to the box's middle, is
    nearer to every point of the box: so if it is at the box's corner that lies farthest in z's direction. At a tie there
    the smaller index wins. A node with one entry left goes to that entry as a whole.
    """
    k = len(entries)
    nodes, alive = np.zeros(1, np.int64), np.ones((1, k), bool)
    whole, whole_entry, single, single_entry = [], [], [], []
    index = np.arange(k)
    while len(nodes):
        low, high = tree.low[nodes], tree.high[nodes]
        # twice the middle, to stay with integers
        far = ((2 * entries[None] - (low + high)[:, None, :]) ** 2).sum(axis=2)
        best = np.where(alive, far, np.iinfo(np.int64).max).argmin(axis=1)
        star = entries[best]
        corner = np.where(entries[None] > star[:, None, :], high[:, None, :], low[:, None, :])
        ahead = ((corner - entries[None]) ** 2).sum(axis=2) - ((corner - star[:, None, :]) ** 2).sum(axis=2)
        alive &= (ahead < 0) | ((ahead == 0) & (index[None] < best[:, None]))
        alive[np.arange(len(nodes)), best] = True
        done = alive.sum(axis=1) == 1
        whole.append(nodes[done])
        whole_entry.append(best[done])
        nodes, alive = nodes[~done], alive[~done]
        leaf = tree.left[nodes] < 0
        for node, left in zip(nodes[leaf], alive[leaf], strict=True):
            places = np.arange(*tree.spans[node])
            choice = np.flatnonzero(left)
            single.append(places)
            single_entry.append(choice[nearest(tree.points[places], entries[choice])])
        children = tree.left[nodes[~leaf]]
        nodes, alive = np.concatenate([children, children + 1]), np.concatenate([alive[~leaf]] * 2)
    joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (whole, whole_entry, single, single_entry)]
    if stats is not None:
        stats["points"] = stats.get("points", 0) + len(tree.order)
        stats["compared"] = stats.get("compared", 0) + len(joined[2])
    return joined


def entry_sums(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, counts) of the points of each entry."""
    whole, whole_entry, single, single_entry = filter_tree(tree, entries)
    sums, counts = np.zeros_like(entries), np.zeros(len(entries), np.int64)
    np.add.at(sums, whole_entry, tree.sums[whole])
    np.add.at(counts, whole_entry, tree.spans[whole, 1] - tree.spans[whole, 0])
    np.add.at(sums, single_entry, tree.points[single])
    np.add.at(counts, single_entry, 1)
    return sums, counts


def assign(tree: Tree, entries: np.ndarray) -> np.ndarray:
    """The entry of each point, in the order in which the points were given."""
    whole, whole_entry, single, single_entry = filter_tree(tree, entries)
    out = np.zeros(len(tree.order), np.int64)
    for node, entry in zip(whole, whole_entry, strict=True):
        out[tree.order[slice(*tree.spans[node])]] = entry
    out[tree.order[single]] = single_entry
    return out


def codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label"):
    """(id, label, code, error) of each usable row, and the codebooks, an array of (part, entry, component).

    Rows whose vector is null, empty or holds null or non-finite components are left out, and so are rows of another number
    of components than the row of the smallest id. Components x become floor(scale * x); vectors are cut into ``parts``
    equal consecutive parts, and a number of components that ``parts`` does not divide is an error, as are components beyond
    LARGEST units. A codebook starts as the parts of the ``entries`` smallest ids (all rows, if fewer); rows that repeat an
    id come in the order of their components, null ids last. Every row that is not left out is returned, repeated ones too.
    Other columns are ignored. An empty table gives no rows and empty codebooks.

    Rows are dealt into blocks, and each block builds its kd-trees once; they are written. A round reads the trees, goes down
    them with the codebooks (``parts`` times ``entries`` short vectors) and returns sums and counts of each entry, added up
    by Spark; no more than that reaches the driver.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)  # a block's trees are a row of some MB
    space = Workspace(spark, "codebooks")
    vec = F.col("vec")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.where((F.size(vec) > 0) & F.coalesce(fine, F.lit(False))).withColumn("vec", F.transform(vec, lambda x: F.floor(x * scale).cast("double")))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(entries).select("vec").collect()  # as many as a codebook holds
    label_type = rows.schema["label"].dataType.simpleString()
    if not first:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0), np.zeros((parts, 0, 0), np.int64)
    d = len(first[0][0])
    if d % parts:
        raise ValueError(f"{d} components cannot be cut into {parts} equal parts")
    width = d // parts
    rows = rows.where(F.size(vec) == d)
    books = np.array([r[0] for r in first if len(r[0]) == d]).astype(np.int64).reshape(-1, parts, width).transpose(1, 0, 2)

    def plant(stream):
        for batch in stream:
            for at in range(0, batch.num_rows, BLOCK):
                block = batch.slice(at, BLOCK)
                x = block.column("vec").flatten().to_numpy().reshape(-1, d)
                if np.abs(x).max() > LARGEST:
                    raise OverflowError(f"components beyond {LARGEST:.0f} units")
                trees = [Tree(np.ascontiguousarray(x[:, p * width : (p + 1) * width]).astype(np.int64)).pack() for p in range(parts)]
                yield pa.RecordBatch.from_pylist([{"ids": block.column("vec_id").to_pylist(), "labels": block.column("label").to_pylist(), "trees": trees}], planted)

    tree_type = pa.struct([(f, pa.binary()) for f in Tree.ARRAYS])
    label_arrow = spark.createDataFrame([], f"label {label_type}").toArrow().schema.field("label").type
    planted = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(label_arrow)), ("trees", pa.list_(tree_type))])
    fields = ", ".join(f"{f}: binary" for f in Tree.ARRAYS)
    blocks = space.write(rows.mapInArrow(plant, f"ids array<bigint>, labels array<{label_type}>, trees array<struct<{fields}>>"), "trees")

    def one_round(books):
        def add(stream):
            sums, counts = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
            for batch in stream:
                for trees in batch.column("trees").to_pylist():
                    for p, packed in enumerate(trees):
                        s, c = entry_sums(Tree.unpack(packed, width), books[p])
                        sums[p] += s
                        counts[p] += c
            p, e = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

        added = blocks.select("trees").mapInArrow(add, "part long, entry long, n long, sums array<bigint>").groupBy("part", "entry")
        new = books.copy()
        for r in added.agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums")).collect():  # a row an entry
            new[r.part, r.entry] = [s // r.n for s in r.sums]
        return new

    for _ in range(rounds):
        books = one_round(books)

    def encode(stream):
        for batch in stream:
            for row in batch.to_pylist():
                code, error = np.zeros((len(row["ids"]), parts), np.int64), np.zeros(len(row["ids"]), np.int64)
                for p, packed in enumerate(row["trees"]):
                    tree = Tree.unpack(packed, width)
                    code[:, p] = assign(tree, books[p])
                    error[tree.order] += ((tree.points - books[p][code[tree.order, p]]) ** 2).sum(axis=1)
                text = ["".join(f"{x:02x}" for x in c) for c in code.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(row["labels"], label_arrow), pa.array(text, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(encode, f"vec_id long, label {label_type}, code string, error long"), books


def with_label_error(coded: DataFrame, space: Workspace) -> DataFrame:
    """Rows with label_error, the error added up over the rows of equal labels; null labels are equal."""
    coded = space.write(coded.withColumns({"unknown": F.col("label").isNull(), "key": F.coalesce(F.col("label").cast("string"), F.lit(""))}), "coded")
    sums = space.write(coded.groupBy("unknown", "key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label-sums")
    return join_by_key(coded, sums, ["unknown", "key"], "n", coded.count()).drop("unknown", "key")


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op12_vector_codes(spark, sf_dir):
    coded, books = codes(read(spark, sf_dir, "embeddings"))
    out = with_label_error(coded, Workspace(spark, "codes"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def _lloyd_sql() -> str:
    """Assignment and update of each round, over parts (r, p, x) with x the integer components, and books (p, e, x)."""
    near = lambda i: f"""a{i} AS MATERIALIZED (SELECT r, p, arg_min(e, {{'d': d, 'e': e}}) AS e, min(d) AS d FROM (SELECT r, v.p, e, list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
    FROM parts v JOIN b{i} b ON b.p = v.p) GROUP BY r, p)"""  # noqa: E731
    move = lambda i: f"""b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.x, b.x) AS x FROM b{i} b LEFT JOIN (SELECT p, e, list(m ORDER BY j) AS x FROM (SELECT p, e, j, CAST(floor(sum(y) / count(*)) AS BIGINT) AS m FROM
    (SELECT v.p, e, unnest(v.x) AS y, unnest(range(len(v.x))) AS j FROM parts v JOIN a{i} a ON a.r = v.r AND a.p = v.p) GROUP BY p, e, j) GROUP BY p, e) n ON n.p = b.p AND n.e = b.e)"""  # noqa: E731
    return ",\n  ".join([*[f"{near(i)},\n  {move(i)}" for i in range(ROUNDS)], near(ROUNDS)])


OP12_SQL = f"""
WITH v AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST) AS r, list_transform(embedding, lambda x: CAST(floor({SCALE:.0f} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  parts AS MATERIALIZED (SELECT r, p, x[p * len(x) // {PARTS} + 1 : (p + 1) * len(x) // {PARTS}] AS x FROM v, (SELECT unnest(range({PARTS})) AS p)),
  b0 AS MATERIALIZED (SELECT p, r - 1 AS e, x FROM parts WHERE r <= {ENTRIES}),
  {_lloyd_sql()},
  coded AS (SELECT vec_id, label, string_agg(lpad(format('{{:x}}', e), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM v JOIN a{ROUNDS} a ON a.r = v.r GROUP BY v.r, vec_id, label),
  digest AS (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, e, j)) AS h FROM (SELECT p, e, unnest(x) AS y, unnest(range(len(x))) AS j FROM b{ROUNDS}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM coded, digest
"""
