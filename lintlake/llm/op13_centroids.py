"""Centroid clustering with the threshold algorithm.

Vectors are integers, so sums, means (floor of sum over count) and distances are exact and do not depend
on how rows are dealt to tasks. A round assigns every vector to its nearest centroid and sums the vectors
of each centroid in their tasks; only the sums, ``k`` times ``dims`` numbers, reach the driver, and only
the centroids go back.

The nearest centroid is found by the threshold algorithm: every dimension holds the centroids sorted by
their value there. From a vector's own value the lists are walked outward, one step in all dimensions at
a time; a centroid met for the first time gets its exact distance. No centroid that was not met yet can
be nearer than the sum of the squared gaps at the frontier, so a vector is done once that sum strictly
exceeds its best distance (an equal one could still be a centroid of a smaller number).

Defined results: a vector that is null, of another length, or holds a null or a number that is not finite
is left out; ties go to the centroid of the smaller number; rows that repeat an id are vectors of their
own, and of repeated ids the smaller vector starts first; a missing id counts as the empty text in the
hash; fewer than ``k`` vectors make as many centroids; an empty table gives no rows; other columns are
ignored. A component of 2^27 or more (in whole units) is refused with an error, as its squares would
leave the range of a long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import small_batches, stored

#: Components of a vector, centroids, rounds, whole units of one, vectors that are walked at a time.
DIMS, K, ROUNDS, UNITS, WALKED = 64, 16, 3, 64, 1_024
LARGEST = 1 << 27
FAR = np.iinfo(np.int64).max


def whole_vectors(vectors: DataFrame, id_col="vec_id", vector_col="embedding", dims=DIMS, units=UNITS) -> DataFrame:
    """(vec_id, e): the kept vectors with whole components."""
    e = vectors[vector_col]
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    made = vectors.where((F.size(e) == dims) & finite).select(
        vectors[id_col].alias("vec_id"), F.transform(e, lambda x: F.floor(x.cast("double") * units)).alias("e")
    )
    most = F.array_max(F.transform("e", lambda x: F.abs(x)))
    refused = F.raise_error(F.lit(f"a component of {LARGEST} units or more"))
    return made.withColumn("e", F.when(most >= LARGEST, refused.cast("array<bigint>")).otherwise(F.col("e")))


def first_centroids(vectors: DataFrame, k=K) -> list[list[int]]:
    """The vectors with the smallest hash of their id, in its order."""
    key = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [r.e for r in vectors.select(key.alias("key"), "e").orderBy("key", "e").limit(k).collect()]


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid of each row, by the threshold algorithm."""
    k, dims = centroids.shape
    order = np.argsort(centroids, axis=0, kind="stable")
    values = np.take_along_axis(centroids, order, axis=0)
    # below the first and above the last entry of each list lies nothing
    fenced = np.full((k + 2, dims), FAR)
    fenced[1:-1] = values
    order = np.concatenate([order[:1], order, order[-1:]])
    dim = np.arange(dims)
    up = np.stack([np.searchsorted(values[:, d], x[:, d]) for d in dim], axis=1) + 1
    down = up - 1
    best, number = np.full(len(x), FAR), np.full(len(x), k)
    met = np.zeros((len(x), k), bool)
    at = np.arange(len(x))
    for _ in range(k):
        here, lower, upper = x[at], down[at], up[at]
        below = np.where(lower > 0, here - fenced[lower, dim], FAR)
        above = np.where(upper <= k, fenced[upper, dim] - here, FAR)
        to_lower = below <= above
        reached = order[np.where(to_lower, lower, upper), dim]
        down[at], up[at] = lower - to_lower, upper + ~to_lower
        found = np.zeros((len(at), k), bool)
        found[np.arange(len(at))[:, None], reached] = True
        row, new = np.nonzero(found & ~met[at])
        met[at] |= found
        distance = np.full((len(at), k), FAR)
        distance[row, new] = ((here[row] - centroids[new]) ** 2).sum(axis=1)
        least = distance.argmin(axis=1)  # the smaller number of equal ones
        nearer = distance[np.arange(len(at)), least]
        better = (nearer < best[at]) | (nearer == best[at]) & (least < number[at])
        best[at[better]], number[at[better]] = nearer[better], least[better]
        frontier = (np.minimum(below, above) ** 2).sum(axis=1)
        at = at[frontier <= best[at]]
        if not len(at):
            break
    return number, best


def _walked(batch: pa.RecordBatch, centroids: np.ndarray):
    """Parts of a batch with their vectors, centroid numbers and distances."""
    for i in range(0, batch.num_rows, WALKED):
        part = batch.slice(i, WALKED)
        x = part.column("e").flatten().to_numpy().reshape(part.num_rows, -1)
        yield part, x, *nearest(x, centroids)


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round."""
    c = np.array(centroids, np.int64)

    def sums(batches):
        total, count = np.zeros_like(c), np.zeros(len(c), np.int64)
        for b in batches:
            for _, x, number, _ in _walked(b, c):
                np.add.at(total, number, x)
                count += np.bincount(number, minlength=len(c))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    made = vectors.mapInArrow(sums, "cluster bigint, n bigint, total array<bigint>")
    made = made.select("cluster", "n", F.posexplode("total").alias("i", "x")).groupBy("cluster", "i")
    out = [list(row) for row in centroids]
    for r in made.agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n")).collect():
        out[r.cluster][r.i] = int(r.x) // r.n
    return out


def assigned(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(vec_id, cluster, distance)."""
    c = np.array(centroids, np.int64)

    def assign(batches):
        for b in batches:
            for part, _, number, distance in _walked(b, c):
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(assign, f"vec_id {kind}, cluster int, distance bigint")


def cluster(
    vectors: DataFrame, id_col="vec_id", vector_col="embedding", dims=DIMS, k=K, rounds=ROUNDS, units=UNITS,
) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    kept = stored(whole_vectors(small_batches(vectors), id_col, vector_col, dims, units), "vectors")
    centroids = first_centroids(kept, k)
    for _ in range(rounds if centroids else 0):
        centroids = moved(kept, centroids)
    found = stored(assigned(kept, centroids), "assigned") if centroids else kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    sums = {r.cluster: int(r.x) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("x")).collect()}
    known = [(i, sums.get(i, 0), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    known = vectors.sparkSession.createDataFrame(known, "cluster int, cluster_inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", F.lit(sum(sums.values())).cast("long").alias("inertia"), "centroid_sha256"
    )
