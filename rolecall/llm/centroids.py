"""Centroid clustering by a bisector tournament, exact in integers.

For every pair a < b of centroids the bisecting plane has the integer normal 2 (b - a) and the threshold |b|^2 - |a|^2:
a vector is strictly nearer to b when its product with the normal exceeds the threshold. A vector's nearest centroid is
the winner of k - 1 such sign tests, in which the winner so far meets the next number; zero favours the smaller number.
Only the winner's distance is then worked out. Rounds sum up in each task, so a round shuffles k rows a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stages import stage

#: Integers up to this size keep every product of a sign test, and every distance, inside 64 bits.
LARGEST = 1 << 27

_RUN = 4096  # vectors compared at once


@dataclass(frozen=True)
class CentroidSettings:
    clusters: int = 40
    rounds: int = 5
    dimensions: int = 64
    scale: int = 256
    seed: int = 2


def bisectors(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every pair (a, b) of centroids, the normal and the threshold of the plane between them."""
    square = (centroids * centroids).sum(axis=1)
    return 2 * (centroids[None, :, :] - centroids[:, None, :]), square[None, :] - square[:, None]


def nearest(vectors: np.ndarray, normals: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """The number of the nearest centroid of each vector; of equally near ones the smallest."""
    best = np.zeros(len(vectors), np.int64)
    for b in range(1, len(thresholds)):
        side = np.einsum("ij,ij->i", vectors, normals[best, b])
        best[side > thresholds[best, b]] = b
    return best


def _runs(batch: pa.RecordBatch, dimensions: int) -> Iterator[tuple[int, np.ndarray]]:
    flat = batch.column("v").flatten().to_numpy().reshape(-1, dimensions)
    for first in range(0, len(flat), _RUN):
        yield first, flat[first : first + _RUN].astype(np.int64)


def _summed(centroids: np.ndarray):
    def run(batches):
        planes = bisectors(centroids)
        sums, counts = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for batch in batches:
            for _, vectors in _runs(batch, centroids.shape[1]):
                best = nearest(vectors, *planes)
                np.add.at(sums, best, vectors)
                counts += np.bincount(best, minlength=len(counts))
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(counts[full]), pa.array(list(sums[full]), pa.list_(pa.int64()))],
                                         ["cluster", "n", "sums"])
    return run


def _assigned(centroids: np.ndarray):
    def run(batches):
        planes = bisectors(centroids)
        for batch in batches:
            best, far = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for first, vectors in _runs(batch, centroids.shape[1]):
                own = nearest(vectors, *planes)
                apart = vectors - centroids[own]
                best[first : first + len(own)], far[first : first + len(own)] = own, (apart * apart).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(best), pa.array(far)], ["vec_id", "cluster", "distance"])
    return run


def integers(vectors: DataFrame, settings: CentroidSettings) -> DataFrame:
    """(vec_id, v) of the vectors that take part: `dimensions` components, none null or not finite, each turned into
    floor(scale * x). Vectors that would pass LARGEST have no exact distance and take no part either."""
    x = F.col("embedding")
    fits = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * settings.scale) <= LARGEST))
    kept = vectors.filter((F.size(x) == settings.dimensions) & fits)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"),
                       F.transform(x, lambda c: F.floor(c.cast("double") * settings.scale).cast("int")).alias("v"))


def cluster(vectors: DataFrame, settings: CentroidSettings = CentroidSettings(), name: str = "centroids") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid) of the vectors of `vectors` (vec_id, embedding)
    that `integers` keeps; other columns are not looked at.

    The first centroids are the vectors with the smallest sha256 of `seed:vec_id`, vectors without id last, ties by id
    and components. With fewer vectors than `clusters` each is a centroid of its own; with none the result is empty.
    Each round assigns all vectors and replaces each non-empty centroid by the floor of its vectors' mean. Rows that
    repeat an id are vectors of their own. Inertias are null where they pass a long.
    """
    spark = vectors.sparkSession
    kept = stage(integers(vectors, settings), f"{name}-vectors")
    order = F.sha2(F.concat(F.lit(f"{settings.seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(F.asc_nulls_last(order), F.asc_nulls_last("vec_id"), "v").limit(settings.clusters).collect()
    centroids = np.array([r.v for r in first], np.int64).reshape(len(first), settings.dimensions)
    for _ in range(settings.rounds if first else 0):
        parts = kept.select("v").mapInArrow(_summed(centroids), "cluster int, n long, sums array<bigint>")
        totals = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(settings.dimensions)])
        for c, n, *sums in totals.collect():
            centroids[c] = [s // n for s in sums]
    ends = stage(kept.mapInArrow(_assigned(centroids), "vec_id long, cluster int, distance long"), f"{name}-ends")
    of = {r.cluster: r.total for r in ends.groupBy("cluster").agg(F.try_sum("distance").alias("total")).collect()}
    whole = sum(t for t in of.values() if t is not None)
    whole = None if None in of.values() or whole >= 1 << 63 else whole
    # one row a cluster
    about = spark.createDataFrame([(c, of[c], whole, centroids[c].tolist()) for c in sorted(of)],
                                  "cluster int, cluster_inertia long, inertia long, centroid array<bigint>")
    return ends.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
