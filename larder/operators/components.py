"""Connected components of a distributed edge table."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Edges folded at a time, and the most that one task folds alone (16 MB).
CHUNK = 1 << 20


def _folded(edges: DataFrame) -> DataFrame:
    """(node, component, chunk): the classes of the edges (src, dst long) that a task sees, CHUNK edges at a time."""

    def fold(stream):
        chunk, held, n = 0, [], 0
        for batch in chain(stream, [None]):
            if batch is not None:
                held.append(np.stack([batch.column("src").to_numpy(), batch.column("dst").to_numpy()]))
                n += batch.num_rows
            if n and (batch is None or n >= CHUNK):
                nodes, at = np.unique(np.concatenate(held, axis=1), return_inverse=True)
                left, right = at.reshape(2, -1)
                root, was = np.arange(len(nodes)), None
                while was is None or (root != was).any():
                    was = root.copy()
                    low = np.minimum(root[left], root[right])
                    for side in (left, right):
                        np.minimum.at(root, root[side], low)
                    root = root[root]
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root]), pa.array(np.full(len(nodes), chunk))], ["node", "component", "chunk"])
                chunk, held, n = chunk + 1, [], 0

    return edges.select("src", "dst").mapInArrow(fold, "node long, component long, chunk long")


def connected_components(edges: DataFrame, write: Callable[[DataFrame, str], DataFrame], drop: Callable[[str], None], label: str = "components") -> DataFrame:
    """(node, component) of every node in ``edges`` (src, dst long); component is the smallest node reachable.

    Each task first folds its own edges to one edge a node. If CHUNK edges or fewer are left, one task folds these; else
    they go through rounds: each takes the smallest label among the neighbours (a partial aggregate, so a hub costs each
    map task one row) and then follows the label's own label, which halves the remaining path lengths. Rounds go through
    ``write``, the one before is dropped; nothing but a change flag reaches the driver. An edge table with repeated rows,
    loops or no rows is fine; null ends are ignored.
    """
    edges = edges.select("src", "dst").where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
    edges = write(_folded(edges).select(F.col("node").alias("src"), F.col("component").alias("dst")), f"{label}-folded")
    if edges.count() <= CHUNK:
        return write(_folded(edges.repartition(1)).select("node", "component"), f"{label}-0")
    edges = edges.where("src != dst")
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = write(both.distinct(), f"{label}-edges")
    labels = both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("component"))
    labels = write(labels, f"{label}-0")
    turn = 0
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("dst"), "component"), "dst")
            .groupBy(F.col("src").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        lower = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("via"))
        ahead = labels.select(F.col("node").alias("via"), F.col("component").alias("beyond"))
        moved = lower.join(ahead, "via").select("node", "was", F.least("via", "beyond").alias("component"))
        turn += 1
        now = write(moved, f"{label}-{turn}")
        changed = now.where(F.col("component") < F.col("was")).limit(1).count()
        drop(f"{label}-{turn - 1}")
        labels = now.select("node", "component")
        if not changed:
            return labels
