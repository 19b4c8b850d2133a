"""Centroid clustering of integer vectors with a table of pivot distances (LAESA)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segue.llm.store import saved

DIMENSIONS, SCALE, CENTROIDS, ROUNDS = 64, 64, 16, 3
#: Components beyond this have squared distances that a long cannot hold.
LARGEST = 1 << 27
#: Distances are 64-bit floats in the bounds only; a bound is lowered by this share before it may exclude a centroid.
SLACK = 1e-9


def integer_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """``vec_id, v``: floor(scale * x) of every component, of whole vectors only.

    A vector is whole when it has ``dimensions`` components, none of them null, NaN or
    infinite, or so large that its squared distances would not fit a long (2^27 after
    scaling).
    """
    whole = ((F.size("embedding") == dimensions)
             & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < LARGEST)))
    return (vectors.where(F.col("embedding").isNotNull() & whole)
            .select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("v")))


def start_vectors(ints: DataFrame, count: int = CENTROIDS) -> np.ndarray:
    """The ``count`` vectors whose ids have the smallest digests, in digest order; ties by components.

    Vectors without an id have no digest and start no cluster.  At most ``count`` rows reach the driver.
    """
    digest = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = (ints.where(F.col("vec_id").isNotNull()).select(digest.alias("digest"), "v")
            .orderBy("digest", "v").limit(count).collect())
    return np.array([r["v"] for r in rows], dtype=np.int64)


def _matrix(column: pa.Array, width: int, kind=np.int64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, width)


def _lists(matrix: np.ndarray) -> pa.ListArray:
    rows, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * width, pa.int32()), pa.array(matrix.ravel()))


def _squared(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to one centre."""
    difference = points - centre
    return np.einsum("ij,ij->i", difference, difference)


def pivot_table(ints: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``vec_id, v, to_pivots``: the squared distance of every vector to every pivot, formed and stored once."""
    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _matrix(batch.column(1), pivots.shape[1])
            table = np.stack([_squared(points, p) for p in pivots], axis=1)
            yield pa.record_batch([batch.column(0), batch.column(1), _lists(table)], names=["vec_id", "v", "to_pivots"])

    return saved(ints.mapInArrow(measured, "vec_id long, v array<int>, to_pivots array<long>"))


def nearest(points: np.ndarray, to_pivots: np.ndarray, centres: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and exact squared distance of the nearest centre of each row (ties: smaller number), and distances formed.

    The differences of pivot distances bound every centre's distance from below.  The
    centre with the lowest bound is measured first; only those whose bound does not
    exceed that distance are measured after it.
    """
    known = np.sqrt(to_pivots.astype(np.float64))
    of_centres = np.sqrt(np.stack([_squared(centres, p) for p in pivots], axis=1).astype(np.float64))
    bounds = np.zeros((len(points), len(centres)))
    for j in range(len(pivots)):
        np.maximum(bounds, np.abs(known[:, j, None] - of_centres[None, :, j]), out=bounds)
    # both roots carry a rounding error that grows with their size, not with their difference
    reach = (known.max(axis=1)[:, None] + of_centres.max(axis=1)[None, :] + 1.0) * SLACK
    bounds = np.maximum(bounds - reach, 0.0) ** 2 * (1.0 - SLACK)

    best = bounds.argmin(axis=1)
    distance = np.empty(len(points), dtype=np.int64)
    for k in range(len(centres)):
        mine = np.flatnonzero(best == k)
        distance[mine] = _squared(points[mine], centres[k])
    first, measured = best.copy(), len(points)
    for k in range(len(centres)):
        open_ = np.flatnonzero((bounds[:, k] <= distance) & (first != k))
        exact = _squared(points[open_], centres[k])
        closer = (exact < distance[open_]) | ((exact == distance[open_]) & (k < best[open_]))
        distance[open_[closer]], best[open_[closer]] = exact[closer], k
        measured += len(open_)
    return best, distance, measured


def _moved(table: DataFrame, centres: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, int]:
    """The centres after one round, and how many exact distances it took.

    A task adds its vectors up per centre and component; what reaches the driver is one row per centre and component.
    """
    width = centres.shape[1]

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(centres), width + 2), dtype=np.int64)
        for batch in batches:
            points = _matrix(batch.column(0), width)
            best, _, measured = nearest(points, _matrix(batch.column(1), len(pivots)), centres, pivots)
            for k in range(len(centres)):
                totals[k, :width] += points[best == k].sum(axis=0)
            totals[:, width] += np.bincount(best, minlength=len(centres))
            totals[0, width + 1] += measured
        places = np.indices(totals.shape)
        yield pa.record_batch([pa.array(places[0].ravel()), pa.array(places[1].ravel()), pa.array(totals.ravel())],
                              names=["centre", "place", "total"])

    parts = table.select("v", "to_pivots").mapInArrow(added, "centre long, place long, total long")
    totals = np.zeros((len(centres), width + 2), dtype=np.int64)
    for row in parts.groupBy("centre", "place").agg(F.sum("total").alias("total")).collect():
        totals[row["centre"], row["place"]] = row["total"]
    counts = totals[:, width]
    moved = np.where(counts[:, None] > 0, totals[:, :width] // np.maximum(counts, 1)[:, None], centres)
    return moved, int(totals[0, width + 1])


def clustered(vectors: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS,
              scale: int = SCALE) -> tuple[DataFrame, np.ndarray, list[int]]:
    """``vec_id, cluster, distance`` of every whole vector, the final centroids, and exact distances formed per round.

    Centroids start as the vectors of ``start_vectors``, which are also the fixed pivots.
    Each round assigns every vector and moves every non-empty centroid to the
    componentwise floor of its vectors' mean; then vectors are assigned once more.  All
    sums and distances are exact integers, so results do not depend on partitions.

    Null, short, long, NaN or infinite vectors are left out (see ``integer_vectors``).  A
    null id keeps its vector, which starts no cluster; repeated rows count as often as
    they occur; equal distances go to the smaller number; fewer vectors with ids than
    ``count`` give fewer centroids, and without any (an empty table too) there are no
    rows.  Only ``vec_id`` and ``embedding`` are read, so further columns cannot clash.
    """
    ints = integer_vectors(vectors, dimensions, scale)
    centres = start_vectors(ints, count)
    shape = "vec_id long, cluster int, distance long"
    if not len(centres):
        return vectors.sparkSession.createDataFrame([], shape), centres.reshape(0, dimensions), []
    pivots, formed = centres, []
    table = pivot_table(ints, pivots)
    for _ in range(rounds):
        centres, measured = _moved(table, centres, pivots)
        formed.append(measured)
    final = centres

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, distance, _ = nearest(_matrix(batch.column(1), dimensions), _matrix(batch.column(2), len(pivots)), final, pivots)
            yield pa.record_batch([batch.column(0), pa.array(best.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return saved(table.mapInArrow(assigned, shape)), final, formed


def digests(vectors: DataFrame) -> DataFrame:
    """Every vector's cluster and distance with the inertias and its centroid's digest."""
    rows, centres, _ = clustered(vectors)
    named = [(k, hashlib.sha256(",".join(map(str, centre)).encode()).hexdigest()) for k, centre in enumerate(centres.tolist())]
    names = vectors.sparkSession.createDataFrame(named, "cluster int, centroid_sha256 string")
    per_cluster = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = rows.agg(F.sum("distance").alias("inertia"))
    of_cluster = per_cluster.join(names, "cluster").withColumn("inertia", whole.scalar())
    # one row per centroid, at most ``count`` of them
    return rows.join(F.broadcast(of_cluster), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
