"""Clustering of integer vectors by centroids, exact, with scalar lookup tables.

Each round tabulates, for every dimension, integer value that occurs there and
centroid, the squared difference. A vector's distances are then sums of rows
gathered from the tables. A round is one job over the vectors; what it gives back
is a sum and a count for each centroid and dimension, whatever the number of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lekha.plans.shared import written

#: Components are below this in size, so that squared distances in 64 dimensions fit a long.
LARGEST = 1 << 27
#: A dimension's values are numbered by their place between the least and the greatest while these are so near, else by sorting.
SPAN = 1 << 20
#: Vectors that are looked at together.
ROWS = 4096


def occurring(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a column, in order, and each row's place among them."""
    low, high = int(column.min()), int(column.max())
    if high - low >= SPAN:
        return np.unique(column, return_inverse=True)
    there = np.zeros(high - low + 1, bool)
    there[column - low] = True
    return np.flatnonzero(there) + low, (np.cumsum(there) - 1)[column - low]


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of each vector to each centroid, by one table a dimension."""
    out = np.zeros((len(vectors), len(centroids)), np.int64)
    for k in range(vectors.shape[1] if len(vectors) else 0):
        values, place = occurring(vectors[:, k])
        table = (values[:, None] - centroids[None, :, k]) ** 2
        out += table[place]
    return out


def _vectors(batch: pa.RecordBatch, dims: int):
    column = batch.column("v")
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    for at in range(0, len(flat), ROWS):
        yield at, flat[at : at + ROWS]


def _sums(centroids: np.ndarray):
    """(cluster, dim, total, n): the sums of each cluster's vectors in this part."""

    def run(batches):
        k, dims = centroids.shape
        total, n = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for _, x in _vectors(batch, dims):
                near = distances(x, centroids).argmin(axis=1)  # the first of equal ones
                for c in np.unique(near):
                    total[c] += x[near == c].sum(axis=0)
                    n[c] += int((near == c).sum())
        c, d = np.nonzero(np.repeat(n[:, None] > 0, dims, axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(d.astype(np.int32)), pa.array(total[c, d]), pa.array(n[c])], names=["cluster", "dim", "total", "n"])

    return run


def _assigned(centroids: np.ndarray):
    def run(batches):
        for batch in batches:
            for at, x in _vectors(batch, centroids.shape[1]):
                far = distances(x, centroids)
                near = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").slice(at, len(x)), pa.array(near.astype(np.int32)), pa.array(far[np.arange(len(x)), near])], names=["vec_id", "cluster", "distance"])

    return run


def quantised(vectors: DataFrame, column: str = "embedding", scale: int = 1024, dims: int = 64) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component, of the vectors with exactly `dims` components.

    Left out are rows without a vec_id, null vectors and vectors with null or
    non-finite components; and those with a component of LARGEST or more in size
    (once scaled), whose distances no long could hold.
    """
    whole = F.coalesce((F.size(column) == dims) & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < LARGEST)), F.lit(False))
    return vectors.where(F.col("vec_id").isNotNull() & whole).select("vec_id", F.transform(column, lambda x: F.floor(x.cast("double") * scale).cast("bigint")).alias("v"))


def first_centroids(vectors: DataFrame, key: Column, k: int = 8) -> np.ndarray:
    """The k vectors with the smallest keys (ties: the smaller vector), in that order; fewer if there are fewer."""
    return np.array([r.v for r in vectors.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()], np.int64)


def refine(vectors: DataFrame, centroids: np.ndarray, rounds: int = 10) -> np.ndarray:
    """The centroids after so many rounds: every vector goes to its nearest (ties: the smaller number), each that has any becomes their floored mean."""
    for _ in range(rounds if len(centroids) else 0):
        sums = vectors.mapInArrow(_sums(centroids), "cluster int, dim int, total bigint, n bigint")
        rows = sums.groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()  # clusters times dimensions at most
        new = centroids.copy()
        for r in rows:
            new[r.cluster, r.dim] = r.total // r.n
        if (new == centroids).all():  # all later rounds are the same
            break
        centroids = new
    return centroids


def cluster(vectors: DataFrame, key: Column, k: int = 8, rounds: int = 10) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid): each of vectors (vec_id, v) with its centroid after the rounds.

    Centroids begin as in first_centroids, by key (a column over vec_id). distance
    is squared; cluster_inertia and inertia are its sums over the cluster and over
    all. Vectors (see quantised) have no nulls and equally many components.
    Repeated rows count once each; with fewer than k vectors there are fewer
    centroids, equal ones may stand in several, of which the first gets all; an
    empty table gives an empty result. Other columns are not read.
    """
    vectors = written(vectors.select("vec_id", "v"), "vectors")
    centroids = refine(vectors, first_centroids(vectors, key, k), rounds)
    if not len(centroids):
        return vectors.select("vec_id", *(F.lit(0).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"))), F.col("v").alias("centroid"))
    found = written(vectors.mapInArrow(_assigned(centroids), f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, cluster int, distance bigint"), "assigned")
    sums = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    named = found.sparkSession.createDataFrame(
        [(c, s, sum(sums.values()), centroids[c].tolist()) for c, s in sums.items()], "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    return found.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def digest(centroid: Column) -> Column:
    """sha256 of a vector's components in decimal, joined by commas."""
    return F.sha2(F.array_join(centroid.cast("array<string>"), ","), 256)
