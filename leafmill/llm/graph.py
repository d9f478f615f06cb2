"""Connected components of an undirected graph.

Few edges, counted first, are settled in one task, which spares them the rounds
of shuffles; more go through alternating large and small stars.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import checkpointed

#: Far more rounds than graphs need; every round at least halves long chains.
ROUNDS = 60


#: The most edges (16 bytes each) that one task takes.
FEW = 500_000


def _few(batches):
    """Least labels by hooking and pointer jumping over all edges at once."""
    parts = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if b.num_rows]
    if not parts:
        return
    node, ends = np.unique(np.concatenate(parts, axis=1), return_inverse=True)
    u, v = ends.reshape(2, -1)
    label = np.arange(len(node))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        for side in (u, v):
            np.minimum.at(new, side, low)
            np.minimum.at(new, label[side], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[label])], ["node", "component"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large or small star: neighbours are tied to the least node around.

    Only a minimum is taken for each node, before the shuffle where it can be,
    and joined back; no neighbourhood is collected.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = both.join(least, "u")
    if large:
        tied = out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        tied = out.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return tied.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that ``edges`` (a, b) touch; the component is its least node.

    Edges are kept with the larger node first.  Loops are dropped.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now = checkpointed(now)
    if now.count() <= FEW:
        return now.coalesce(1).mapInArrow(_few, "node long, component long")
    mark = None
    for _ in range(ROUNDS):
        now = checkpointed(_star(_star(now, True), False))
        # the sum of hashes tells whether the set of edges changed
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
