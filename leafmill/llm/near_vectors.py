"""Operator 2: near-duplicate vectors by NN-descent.

Equal vectors are one node, named by a hash of the vector; vec_ids only label
rows and components.  The neighbour graph starts from windows of nodes
that random hyperplanes bring next to each other, and is refined by local
joins: all neighbours and reverse neighbours of a node are compared with one
another, and each keeps its best.  A list that is full of linked neighbours is
saturated and is enlarged.  Edges from the threshold on tie nodes into parts.

Every part is then compared as a whole, large ones block by block, with matrix
products.  Only counts leave those tasks, so a group of thousands of near copies
is counted exactly without emitting its pairs, and a link is lost only if its
ends are in different parts.  An audit looks for such links: it compares sampled
nodes with all vectors and takes the mean, over the nodes that have links, of
the share found, for the nodes of big parts and for all others apart.  The
sample of the others grows until enough of them have links.  While the audit
fails, the graph gets new windows and is refined again, with weak neighbours
as guides; if it still fails after the last round, all nodes are compared with
all, chunk by chunk, which is exact and takes the square of their number.

Defined edge cases: vectors that are null, empty, zero or hold null or
non-finite components link with nothing, and neither do vectors of different
lengths; rows that share a vec_id and a vector are copies of one another; rows
that share a vec_id but differ in their vectors are nodes of their own, of one
component; an empty table gives an empty result; only ``vec_id`` and ``embedding`` are read,
so labels and extra columns never matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import checkpointed, shuffle_partitions
from leafmill.llm.graph import _few, components

LINK = 0.9
#: Neighbours that are less alike are of no use on the way to links.
FLOOR = 0.6
NEIGHBOURS, MOST_NEIGHBOURS = 12, 48
TABLES, PLANES, WINDOW = 8, 16, 32
REFINEMENTS, AUDITS = 2, 5
#: The best neighbours that rounds after a failed audit keep below the floor.
WEAK = 4
#: The audit's sample, and the share of a node's links that must be found in the mean.
SAMPLE, RECALL = 256, 0.98
#: Parts from so many nodes on are sampled apart; elsewhere so many linked nodes are wanted,
#: from a sample of so many nodes and components of vectors at most.
BIG, ENOUGH, MOST_SAMPLE, MOST_NUMBERS = 64, 64, 16_384, 4_000_000
BLOCK, CHUNK = 1024, 4096


def matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors of one length, in double precision."""
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    # scaled first, so that squares neither overflow nor vanish
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def by_length(batch: pa.RecordBatch, vector: int):
    """(rows of the batch, unit vectors) for each vector length in it."""
    size = batch.column(vector).value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield at, matrix(batch.column(vector).take(pa.array(at)))


def nodes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with the node they belong to (null if none), and the nodes with their vector, copies and least vec_id."""
    e = F.col("embedding")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fine = e.isNotNull() & F.coalesce(~F.exists(e, bad) & F.exists(e, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(fine, F.transform(e, lambda x: x.cast("double") + F.lit(0.0))).alias("vector"))
    for seed in range(8):  # hashes that clash are drawn anew
        named = rows.withColumn("node", F.when(F.col("vector").isNotNull(), F.xxhash64("vector", F.lit(seed))))
        known = named.where(F.col("node").isNotNull() & F.col("vec_id").isNotNull())
        nodes = checkpointed(known.groupBy("node", "vector").agg(F.min("vec_id").alias("label"), F.count("*").alias("copies")))
        if nodes.groupBy("node").count().where("count > 1").isEmpty():
            return named, nodes
    raise RuntimeError("hashes of vectors clash")


def same_id(rows: DataFrame) -> DataFrame:
    """Edges (a, b) between nodes that share a vec_id."""
    known = rows.where(F.col("node").isNotNull() & F.col("vec_id").isNotNull()).select("vec_id", "node")
    least = known.groupBy("vec_id").agg(F.min("node").alias("a"), F.max("node").alias("most")).where("a <> most").select("vec_id", "a")
    return known.join(least, "vec_id").select("a", F.col("node").alias("b")).where("a <> b").distinct()


def windows(nodes: DataFrame, seed: int, weak: int = 0) -> DataFrame:
    """Candidate edges (a, b, likeness) among nodes that random hyperplanes put in a row."""

    def project(batches):
        for batch in batches:
            for at, unit in by_length(batch, 1):
                planes = np.random.default_rng([seed, unit.shape[1]]).standard_normal((TABLES, PLANES + 1, unit.shape[1]))
                for t in range(TABLES):
                    side = unit @ planes[t].T
                    code = (side[:, :PLANES] > 0) @ (1 << np.arange(PLANES, dtype=np.int64))
                    part = batch.take(pa.array(at))
                    key = (unit.shape[1] * TABLES + t) << 32 | code
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(side[:, PLANES]), part.column(0), part.column(1)], ["key", "turn", "node", "vector"])

    def compare(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
            batch = table.to_batches()[0] if table.num_rows else batch
            yield from edges_of(batch)
            rest = batch.slice(max(0, batch.num_rows - WINDOW))  # the next batch goes on from here

    def edges_of(batch):
        key = batch.column(0).to_numpy() >> 32
        node = batch.column(2).to_numpy()
        found = []
        for at, unit in by_length(batch, 3):
            for k in np.unique(key[at]):
                mine = np.flatnonzero(key[at] == k)
                for start in range(0, len(mine), WINDOW):
                    rows = mine[start : start + 2 * WINDOW]
                    found += kept(node[at[rows]], unit[rows] @ unit[rows].T, NEIGHBOURS, weak)
        yield edge_batch(found)

    dealt = nodes.select("node", "vector").mapInArrow(project, "key long, turn double, node long, vector array<double>")
    dealt = dealt.repartitionByRange(shuffle_partitions(nodes.sparkSession), "key", "turn", "node").sortWithinPartitions("key", "turn", "node")
    return dealt.mapInArrow(compare, "a long, b long, likeness double")


def kept(node: np.ndarray, like: np.ndarray, k: int, weak: int) -> list[np.ndarray]:
    """Edges of a compared group: each member's k best, and so many best ones however weak."""
    return [best(node, like, k), *([best(node, like, weak, -2)] if weak else [])]


def best(node: np.ndarray, like: np.ndarray, k: int, floor: float = FLOOR) -> np.ndarray:
    """Edges (a, b, likeness) of a compared group: each member's k best from the floor on."""
    np.fill_diagonal(like, -1)
    if len(node) > k + 1:
        least = np.partition(like, len(node) - k, axis=1)[:, len(node) - k]
        i, j = np.nonzero((like >= floor) & ((like >= least[:, None]) | (like >= least[None, :])))
    else:
        i, j = np.nonzero(like >= floor)
    keep = node[i] < node[j]
    return np.rec.fromarrays([node[i[keep]], node[j[keep]], like[i[keep], j[keep]]], names="a,b,likeness")


def edge_batch(found: list) -> pa.RecordBatch:
    rows = np.concatenate(found) if found else np.rec.fromarrays([np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)], names="a,b,likeness")
    rows = rows[np.unique(np.column_stack([rows["a"], rows["b"]]), axis=0, return_index=True)[1]] if len(rows) else rows
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[k])) for k in ("a", "b", "likeness")], ["a", "b", "likeness"])


def lists(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """(node, other, likeness, rank) of each node's best neighbours, as many as its list holds."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other"), "likeness").unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"), "likeness"))
    both = both.groupBy("node", "other").agg(F.max("likeness").alias("likeness"))
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("likeness"), "other")))
    return ranked.where(F.col("rank") <= MOST_NEIGHBOURS).join(sizes, "node", "left").where(F.col("rank") <= F.coalesce("size", F.lit(NEIGHBOURS))).drop("size")


def refined(graph: DataFrame, nodes: DataFrame, weak: int = 0) -> DataFrame:
    """Edges between neighbours of a node, forward and reverse."""
    # a list is bounded, but many lists may name one node: as many of those as a list holds
    back = graph.select(F.col("other").alias("node"), F.col("node").alias("other"))
    back = back.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("node", "other")))).where(F.col("rank") <= NEIGHBOURS)
    around = graph.select("node", "other").unionByName(back.select("node", "other")).distinct()
    members = around.join(nodes.select(F.col("node").alias("other"), "vector"), "other").select("node", "other", "vector")

    def compare(batches):
        rest = None
        for batch in batches:
            batch = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks().to_batches()[0]
            centre = batch.column(0).to_numpy()
            cut = int(np.searchsorted(centre, centre[-1]))  # the last group may go on
            if cut:
                yield groups(batch.slice(0, cut))
            rest = batch.slice(cut)
        if rest is not None and rest.num_rows:
            yield groups(rest)

    def groups(batch):
        found = []
        for at, unit in by_length(batch, 2):
            centre, node = batch.column(0).to_numpy()[at], batch.column(1).to_numpy()[at]
            new = np.append(np.flatnonzero(np.concatenate([[True], centre[1:] != centre[:-1]])), len(centre))
            for i, j in zip(new[:-1].tolist(), new[1:].tolist(), strict=True):
                if j - i > 1:
                    found += kept(node[i:j], unit[i:j] @ unit[i:j].T, MOST_NEIGHBOURS, weak)
        return edge_batch(found)

    return members.repartition("node").sortWithinPartitions("node", "other").mapInArrow(compare, "a long, b long, likeness double")


def undirected(graph: DataFrame) -> DataFrame:
    return graph.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"), "likeness").distinct()


def placed(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """node, vector and part; a node without links is its own part."""
    return nodes.join(parts, "node", "left").select("node", "vector", F.coalesce("component", "node").alias("part"))


def by_vector_length(rows) -> dict[int, tuple]:
    """Places, nodes, parts and unit vectors of a few rows in pandas, by the length of the vectors."""
    out = {}
    for n, some in rows.reset_index(drop=True).groupby(rows["vector"].map(len).to_numpy()):
        out[int(n)] = some.index.to_numpy(), some["node"].to_numpy(), some["part"].to_numpy(), matrix(pa.array(some["vector"].tolist(), pa.list_(pa.float64())))
    return out


def shares(known: DataFrame, rows) -> np.ndarray:
    """The share of each row's true links that lie within its part; of no links, not a number."""
    asked, n = by_vector_length(rows), len(rows)

    def brute(batches):
        total, lost = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for batch in batches:
            for at, unit in by_length(batch, 1):
                if unit.shape[1] not in asked:
                    continue
                place, node, part, own = asked[unit.shape[1]]
                for k in range(0, len(at), 256):
                    some = at[k : k + 256]
                    true = (own @ unit[k : k + 256].T >= LINK) & (node[:, None] != batch.column(0).to_numpy()[some])
                    total[place] += true.sum(axis=1)
                    lost[place] += (true & (part[:, None] != batch.column(2).to_numpy()[some])).sum(axis=1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some]), pa.array(lost[some])], ["row", "total", "lost"])

    sums = known.mapInArrow(brute, "row long, total long, lost long").groupBy("row").agg(F.sum("total"), F.sum("lost")).collect()
    out = np.full(n, np.nan)
    for row, total, lost in sums:
        out[row] = 1 - lost / total
    return out


def recall(nodes: DataFrame, parts: DataFrame, seed: int) -> float:
    """The mean share of a linked node's links that is found: the least of nodes in big parts and of others."""
    known = placed(nodes, parts)
    big = parts.groupBy(F.col("component").alias("part")).agg(F.count("*").alias("members")).where(F.col("members") >= BIG).select("part")
    least = 1.0
    for how, wanted in (("left_semi", 1), ("left_anti", ENOUGH)):
        size = SAMPLE
        while True:
            picked = known.join(big, "part", how).select("node", "vector", "part").orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(size).toPandas()
            found = shares(known, picked) if len(picked) else np.zeros(0)
            linked = found[~np.isnan(found)]
            most = min(MOST_SAMPLE, MOST_NUMBERS // max(1, int(picked["vector"].map(len).max()) if len(picked) else 1))
            if len(linked) >= wanted or len(picked) < size or size >= most:
                break
            size = min(4 * size, most)
        if len(linked):
            least = min(least, float(linked.mean()))
    return least


def joined(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """Edges (a, b) that tie all parts between which there are links, by comparing all nodes with all."""
    known = placed(nodes, parts)
    chunks = max(1, -(-nodes.count() // CHUNK))
    edges = None
    for k in range(chunks):
        new = checkpointed(known.mapInArrow(tied(by_vector_length(known.where(F.pmod(F.xxhash64("node"), F.lit(chunks)) == k).toPandas())), "a long, b long"))
        edges = new if edges is None else edges.unionByName(new)
    return edges.distinct()


def tied(asked: dict[int, tuple]):
    """A function from batches of nodes to edges between their parts and those of ``asked``; no more edges than nodes."""

    def run(batches):
        for batch in batches:
            for at, unit in by_length(batch, 1):
                if unit.shape[1] not in asked:
                    continue
                _, _, part, own = asked[unit.shape[1]]
                for k in range(0, len(at), 256):
                    other = batch.column(2).to_numpy()[at[k : k + 256]]
                    i, j = np.nonzero((own @ unit[k : k + 256].T >= LINK) & (part[:, None] != other))
                    if len(i):
                        pairs = np.unique(np.column_stack([part[i], other[j]]), axis=0)
                        for out in _few([pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in pairs.T], ["a", "b"])]):
                            yield out.rename_columns(["a", "b"])

    return run


def counted(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """(node, links) of nodes in ``parts`` (node, part), all compared within their part, in blocks if it is large."""
    blocks = parts.groupBy("part").agg(F.count("*").alias("members")).withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    every = parts.join(blocks, "part").join(nodes, "node")
    held = every.where("blocks > 1").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # a block meets every block of its part in another group, once as the rows and once as the columns
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = held.withColumn("other", other).select("part", F.col("own").alias("i"), F.col("other").alias("j"), F.lit(0).alias("side"), "node", "copies", "vector")
    columns = held.withColumn("other", other).select("part", F.col("other").alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"), "node", "copies", "vector")

    def compare(key, table):
        table = table.combine_chunks()
        out_node, out = [], []
        for batch in table.to_batches():
            side = batch.column(3).to_numpy()
            for at, unit in by_length(batch, 6):
                node, copies = batch.column(4).to_numpy()[at], batch.column(5).to_numpy()[at]
                left, right = np.flatnonzero(side[at] == 0), np.flatnonzero(side[at] == 1)
                for k in range(0, len(left), 256):
                    some = left[k : k + 256]
                    like = (unit[some] @ unit[right].T >= LINK) & (node[some][:, None] != node[right][None, :])
                    out_node.append(node[some])
                    out.append(like @ copies[right])
        return pa.table({"node": np.concatenate(out_node) if out else np.zeros(0, np.int64), "links": np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)})

    def whole(batches):
        rest = None
        for batch in batches:
            batch = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks().to_batches()[0]
            part = batch.column(0).to_numpy()
            cut = int(np.searchsorted(part, part[-1]))  # the last part may go on
            if cut:
                yield from runs(batch.slice(0, cut))
            rest = batch.slice(cut)
        if rest is not None and rest.num_rows:
            yield from runs(rest)

    def runs(batch):
        for at, unit in by_length(batch, 3):
            part, node, copies = (batch.column(c).to_numpy()[at] for c in range(3))
            new = np.append(np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), len(part))
            links = np.zeros(len(part), np.int64)
            for i, j in zip(new[:-1].tolist(), new[1:].tolist(), strict=True):
                like = unit[i:j] @ unit[i:j].T >= LINK
                np.fill_diagonal(like, False)
                links[i:j] = like @ copies[i:j]
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(links)], ["node", "links"])

    small = every.where("blocks = 1").select("part", "node", "copies", "vector").repartition("part").sortWithinPartitions("part", "node")
    pairs = rows.unionByName(columns).groupBy("part", "i", "j").applyInArrow(compare, "node long, links long")
    return pairs.groupBy("node").agg(F.sum("links").alias("links")).unionByName(small.mapInArrow(whole, "node long, links long"))


def near_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    rows, nodes = nodes_of(vectors)
    sizes = nodes.select("node", F.lit(NEIGHBOURS).alias("size"))
    edges = None
    for turn in range(AUDITS):
        weak = WEAK if turn else 0
        new = windows(nodes, turn, weak)
        graph = checkpointed(lists(new if edges is None else edges.unionByName(new), sizes))
        for _ in range(REFINEMENTS):
            full = graph.where((F.col("likeness") >= LINK)).groupBy("node").agg(F.count("*").alias("linked"))
            sizes = sizes.join(full, "node", "left").select("node", F.when(F.col("linked") >= F.col("size"), F.least(F.col("size") * 2, F.lit(MOST_NEIGHBOURS))).otherwise(F.col("size")).alias("size"))
            sizes = checkpointed(sizes)
            graph = checkpointed(lists(undirected(graph).unionByName(refined(graph, nodes, weak)), sizes))
        edges = undirected(graph)
        links = edges.where(F.col("likeness") >= LINK).select("a", "b")
        parts = checkpointed(components(links))
        if recall(nodes, parts, turn) >= RECALL:
            break
    else:
        links = links.unionByName(joined(nodes, parts))
        parts = checkpointed(components(links))

    # linked nodes count by their copies; what only a vec_id ties is one component, but no link
    known = nodes.join(parts, "node", "left").join(counted(nodes, parts.withColumnRenamed("component", "part")), "node", "left")
    ties = checkpointed(same_id(rows))
    if not ties.isEmpty():
        parts = checkpointed(components(links.unionByName(ties)))
    whole = nodes.select("node", "label").join(parts, "node", "left").select("node", "label", F.coalesce("component", "node").alias("part"))
    label = whole.groupBy("part").agg(F.min("label").alias("component_id"))
    known = known.select("node", F.coalesce("links", F.lit(0)).alias("links"), "copies").join(whole.join(label, "part").select("node", "component_id"), "node")
    out = rows.select("vec_id", "node").join(known, "node", "left").select(
        "vec_id", F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
