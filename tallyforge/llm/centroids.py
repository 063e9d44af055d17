"""Centroid clustering by Lloyd's rounds over changes (delta Lloyd).

Vectors become integers, so that sums and distances are exact whatever the order of addition. Each vector's owner and distance
are kept in a table, the centroids' sums and counts on the driver (as many as there are centroids). After a round only
what changed is looked at: a vector whose own centroid stands still, or has come no farther, can only go over to a centroid that
moved, so it is compared with these alone; only one whose own centroid moved away is compared with all. Vectors that
changed owner are added to one sum and taken from another, as signed integers added up by task and then over tasks. When no centroid
moves, the rounds that are left would change nothing and are left out.

Vectors are kept if they have exactly `dims` components, none null, NaN or infinite; null and empty arrays, as others, give no
row. Equal distances go to the smaller number. Repeated rows each count. Of equal hashes among the first centroids the smaller
vec_id and vector come first, a null vec_id last. With fewer vectors than centroids there are as many centroids as vectors,
and an empty table gives no rows. Components beyond 2**27 in size count as that, as squared distances would not fit 64 bits. Columns beside
vec_id and embedding aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored

MOST = 1 << 27
NOBODY = -1


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column without nulls, all of `dims` components."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def integers(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """vec_id, e: floor(scale * x) of the components of the vectors that are kept."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("embedding"), dims).astype(np.float64)
            fine = np.isfinite(x).all(axis=1)
            e = np.clip(np.floor(scale * x[fine]), -MOST, MOST).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(pa.array(fine)), lists(e)], names=["vec_id", "e"])

    # a null component arrives as NaN
    return vectors.where(F.size("embedding") == dims).select("vec_id", "embedding").mapInArrow(run, f"vec_id {kind}, e array<int>")


def lists(e: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(e) + 1) * e.shape[1], pa.int32()), pa.array(e.ravel()))


def first_centroids(points: DataFrame, k: int, seed: str = "3") -> np.ndarray:
    """The k points whose `seed:vec_id` has the smallest SHA-256, as int64."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = points.orderBy(key.asc_nulls_last(), "vec_id", "e").limit(k).select("e").collect()
    return np.array([r.e for r in rows], np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray, owner: np.ndarray, distance: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, distance) of the points x after centroids marked in changed have moved; owner NOBODY: not assigned yet."""
    best, least = owner.copy(), distance.copy()
    square = lambda rows, c: ((rows - centroids[c]) ** 2).sum(axis=1)
    everywhere = owner == NOBODY
    for c in np.flatnonzero(changed):
        mine = np.flatnonzero(owner == c)
        least[mine] = square(x[mine], c)
        everywhere[mine] = least[mine] > distance[mine]
    least[owner == NOBODY] = np.iinfo(np.int64).max
    for c in range(len(centroids)):
        look = np.flatnonzero((everywhere | changed[c]) & (owner != c))
        d = square(x[look], c)
        better = (d < least[look]) | ((d == least[look]) & (c < best[look]))
        best[look[better]], least[look[better]] = c, d[better]
    return best, least


def assigned(state: DataFrame, centroids: np.ndarray, changed: np.ndarray, dims: int) -> DataFrame:
    """state (vec_id, e, owner, distance) with new owners and distances, and the owner before as `was`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, distance = (batch.column(c).to_numpy() for c in ("owner", "distance"))
            best, least = nearest(matrix(batch.column("e"), dims).astype(np.int64), centroids, owner.astype(np.int64), distance, changed)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("e"), pa.array(best.astype(np.int32)), pa.array(least), batch.column("owner")], names=["vec_id", "e", "owner", "distance", "was"])

    kind = state.schema["vec_id"].dataType.simpleString()
    return state.select("vec_id", "e", "owner", "distance").mapInArrow(run, f"vec_id {kind}, e array<int>, owner int, distance long, was int")


def transfers(state: DataFrame, k: int, dims: int) -> np.ndarray:
    """What the rows that changed owner add to each centroid's count and sums: k rows of 1 + dims signed integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, 1 + dims), np.int64)
        for batch in batches:
            own = np.hstack([np.ones((batch.num_rows, 1), np.int64), matrix(batch.column("e"), dims).astype(np.int64)])
            for name, sign in (("was", -1), ("owner", 1)):
                at = batch.column(name).to_numpy()
                for c in np.unique(at[at != NOBODY]):
                    total[c] += sign * own[at == c].sum(axis=0)
        c, i = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(i.astype(np.int32)), pa.array(total[c, i])], names=["c", "i", "x"])

    moved = state.where("owner <> was").select("e", "owner", "was").mapInArrow(run, "c int, i int, x long")
    out = np.zeros((k, 1 + dims), np.int64)
    for r in moved.groupBy("c", "i").agg(F.sum("x").alias("x")).collect():
        out[r.c, r.i] = r.x
    return out


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that is kept.

    One table of assignments a round; a table is dropped when the next one is complete.
    """
    spark = vectors.sparkSession
    points = stored(integers(vectors, dims, scale), "points")
    centroids = first_centroids(points, k)
    state = points.withColumns({"owner": F.lit(NOBODY), "distance": F.lit(0).cast("long")})
    centroids = centroids.reshape(-1, dims)
    totals, changed, before = np.zeros((len(centroids), 1 + dims), np.int64), np.ones(len(centroids), bool), points
    for done in range(rounds + 1):
        if not changed.any():
            break
        state = stored(assigned(state, centroids, changed, dims), "assigned")
        dropped(before)
        before = state
        if done == rounds:
            break
        totals += transfers(state, len(centroids), dims)
        some = totals[:, 0] > 0
        new = centroids.copy()
        new[some] = totals[some, 1:] // totals[some, :1]
        changed = (new != centroids).any(axis=1)
        centroids = new
    digests = spark.createDataFrame([(c, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())], "cluster int, centroid_sha256 string")
    rows = state.select("vec_id", F.col("owner").alias("cluster"), "distance")
    sums = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    # one row a centroid each
    sums = sums.join(F.broadcast(sums.agg(F.sum("cluster_inertia").alias("inertia")))).join(F.broadcast(digests), "cluster")
    return rows.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
