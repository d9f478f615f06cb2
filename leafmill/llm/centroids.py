"""Operator 13: centroid clustering by equal-average equal-variance search.

Vectors are turned into whole numbers, floor(64 x) of each component, so that
sums, distances and centroids are exact.  Centroids lie sorted by their
components' mean.  The search for a vector's nearest one starts at the vector's
own mean and goes outward: d * (difference of the means)**2 is a lower bound of the
squared distance, so once it exceeds the best distance a whole side is done
with; of what remains, (difference of the deviations)**2 is added to the bound,
and only centroids that pass both get their distance computed, in integers.
The bounds are floats that are lowered by far more than their rounding error, so
they never reject a nearest centroid; ties go to the smaller number.

Each round is one pass: tasks return sums of each cluster in each batch, Spark adds
them up, and the driver gets clusters x components numbers whatever the corpus
size.  The centroids go out with the tasks; nothing else is broadcast but the
clusters' totals, one row for each.  No pass shuffles vectors.

Defined edge cases: vectors that are null, of another number of components, or with
null or non-finite ones are not kept and have no row; with fewer kept vectors than
centroids each is one; equal vec_ids are rows of their own, and a tie of hashes at
the start goes to the smaller vector; a null vec_id hashes as ``1:``; whole numbers
beyond +-2**27 are held there, so that distances fit a long, and sums of distances
beyond a long are null; an empty table gives an empty result; only ``vec_id``
and ``embedding`` are read, so extra columns never clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import shared_folder

COMPONENTS, SCALE, CENTROIDS, ROUNDS = 64, 64, 16, 3
#: Whole components stay within these bounds.
MOST = 1 << 27
#: The share of a bound, and of the squares that went into it, by which it is lowered.
SLACK = 1e-9
#: Vectors of a block, so that a block's differences fit the processor's caches.
BLOCK = 4096


def whole(batch: pa.RecordBatch, components: int = COMPONENTS) -> tuple[pa.Array, np.ndarray]:
    """vec_ids and whole components of a batch's kept vectors."""
    ids, vectors = batch.column(0), batch.column(1)
    sized = pc.fill_null(pc.equal(pc.list_value_length(vectors), components), False)
    ids, vectors = ids.filter(sized), vectors.filter(sized)
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), components)  # nulls turn into NaN
    finite = np.isfinite(x).all(axis=1)
    with np.errstate(over="ignore"):
        x = np.clip(np.floor(x[finite] * SCALE), -MOST, MOST).astype(np.int64)
    return ids.filter(pa.array(finite)), x


def _profile(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, and lengths of the deviations from them, and squared lengths."""
    x = x.astype(np.float64)
    mean = x.mean(axis=1)
    return mean, np.sqrt(((x - mean[:, None]) ** 2).sum(axis=1)), (x * x).sum(axis=1)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each vector the number of the nearest centroid and the squared distance."""
    parts = [_nearest(x[a : a + BLOCK], centroids) for a in range(0, len(x), BLOCK)]
    return (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, k, d = len(x), len(centroids), x.shape[1]
    c_mean, c_dev, c_square = _profile(centroids)
    order = np.argsort(c_mean, kind="stable")
    c_mean, c_dev, c_square = c_mean[order], c_dev[order], c_square[order]
    mean, dev, square = _profile(x)
    best = np.full(n, np.iinfo(np.int64).max)
    number = np.full(n, k)
    right = np.searchsorted(c_mean, mean)
    left = right - 1
    active = np.arange(n)
    far = np.concatenate([c_mean, [np.inf]])
    while len(active):
        # the nearer side by mean; a side that has run out is infinitely far
        lo, hi = left[active], right[active]
        below = np.where(lo >= 0, mean[active] - far[lo], np.inf)
        above = far[np.minimum(hi, k)] - mean[active]
        down = below <= above
        gap = np.where(down, below, above)
        at = np.where(down, lo, np.minimum(hi, k - 1))
        with np.errstate(invalid="ignore"):
            slack = SLACK * (square[active] + c_square[at])
            bound = d * gap * gap * (1 - SLACK) - slack
        open_ = (gap < np.inf) & (bound <= best[active])  # all that lie further out have no smaller bound
        active, at, down, gap, slack = active[open_], at[open_], down[open_], gap[open_], slack[open_]
        both = (d * gap * gap + (dev[active] - c_dev[at]) ** 2) * (1 - SLACK) - slack
        passed = both <= best[active]
        who, which = active[passed], order[at[passed]]
        diff = x[who] - centroids[which]
        exact = np.einsum("ij,ij->i", diff, diff)
        better = (exact < best[who]) | ((exact == best[who]) & (which < number[who]))
        best[who[better]], number[who[better]] = exact[better], which[better]
        left[active] -= down
        right[active] += ~down
    return number, best


def _start(vectors: DataFrame, seed: int, k: int, components: int) -> np.ndarray:
    """The first centroids: the kept vectors with the smallest hashes of their ids."""

    def run(batches):
        for batch in batches:
            ids, x = whole(batch, components)
            yield pa.RecordBatch.from_arrays([ids, _lists(x)], ["vec_id", "x"])

    kept = vectors.mapInArrow(run, "vec_id long, x array<long>")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.select(name.alias("name"), "x").orderBy("name", "x").limit(k).collect()
    return np.array([r["x"] for r in first], np.int64).reshape(len(first), components)


def _lists(x: np.ndarray) -> pa.Array:
    n, d = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, d, dtype=np.int32)), pa.array(x.ravel()))


def _moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid as the floor of its vectors' mean; those without vectors stay."""
    k, d = centroids.shape

    def run(batches):
        for batch in batches:
            _, x = whole(batch, d)
            number, _ = nearest(x, centroids)
            sums = np.zeros((k, d), np.int64)
            np.add.at(sums, number, x)
            many = np.bincount(number, minlength=k)
            used = np.flatnonzero(many)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(many[used]), _lists(sums[used])], ["cluster", "many", "sums"])

    parts = vectors.mapInArrow(run, "cluster long, many long, sums array<long>")
    added = parts.select("cluster", "many", F.posexplode("sums").alias("place", "part")).groupBy("cluster", "place").agg(F.sum("many").alias("many"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    out = centroids.copy()
    for r in added.collect():  # at most clusters x components rows
        out[r["cluster"], r["place"]] = int(r["total"]) // r["many"]
    return out


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 1, components: int = COMPONENTS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and squared distance of every kept vector, and the final centroids."""
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    centroids = _start(vectors, seed, k, components)
    for _ in range(rounds if len(centroids) else 0):
        centroids = _moved(vectors, centroids)

    def run(batches):
        for batch in batches:
            ids, x = whole(batch, components)
            number, distance = nearest(x, centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(number.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, "vec_id long, cluster int, distance long"), centroids


def clusters(vectors: DataFrame, **parameters) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector."""
    spark = vectors.sparkSession
    found, centroids = cluster(vectors, **parameters)
    folder = shared_folder(spark, "clusters")
    found.write.parquet(folder)  # read twice: for the totals and for the rows
    found = spark.read.schema(found.schema).parquet(folder)
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    totals = found.groupBy("cluster").agg(exact.alias("own")).collect()  # one row for each cluster
    over_all = sum(int(r["own"]) for r in totals)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    fits = lambda v: v if v < 1 << 63 else None
    rows = [(r["cluster"], fits(int(r["own"])), fits(over_all), names[r["cluster"]]) for r in totals]
    told = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 1, components: int = COMPONENTS) -> str:
    """The same rows by plain comparison of every vector with every centroid."""
    ctes = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')), x) AS r, vec_id, x FROM (SELECT vec_id, list_transform(embedding, lambda y: greatest(-{MOST}, least({MOST}, floor({SCALE} * y::DOUBLE)))::BIGINT) AS x
 FROM embeddings WHERE len(embedding) = {components} AND len(list_filter(embedding, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0))""",
        f"c0 AS MATERIALIZED (SELECT r - 1 AS c, x FROM v WHERE r <= {k})",
    ]
    near = "SELECT r, any_value(v.vec_id) AS vec_id, any_value(v.x) AS x, min((d, c)) AS best FROM (SELECT v.r, c.c, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, {c} c) JOIN v USING (r) GROUP BY r"
    for i in range(rounds + 1):
        ctes.append(f"a{i} AS MATERIALIZED (SELECT r, vec_id, x, best[1] AS d, best[2] AS c FROM ({near.format(c=f'c{i}').replace('min((d, c))', 'min([d, c])')}))")
        if i < rounds:
            ctes.append(f"s{i} AS (SELECT c, list(m ORDER BY p) AS x FROM (SELECT c, p, (sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) // count(*) AS m FROM (SELECT c, unnest(x) AS y, unnest(range({components})) AS p FROM a{i}) GROUP BY c, p) GROUP BY c)")
            ctes.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(s{i}.x, c{i}.x)::BIGINT[] AS x FROM c{i} LEFT JOIN s{i} USING (c))")
    a, c = f"a{rounds}", f"c{rounds}"
    return f"""WITH {", ".join(ctes)} SELECT vec_id, {a}.c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY {a}.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string({c}.x, ',')) AS centroid_sha256 FROM {a} JOIN {c} USING (c)"""
