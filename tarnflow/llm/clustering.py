"""Centroid clustering in integers, by Exponion search.

Every vector carries its centroid, an upper bound on the distance to it and a lower
bound on that to any other; when centroids move, the bounds move by as much.  While
the upper bound stays below the lower one, or below half the way to the nearest other
centroid, nothing is computed.  Otherwise only centroids inside a ball around the
current one are scanned: with u the distance to it and s the way from it to its
nearest neighbour, the nearest two lie within 2u + s.  A list of distances between
centroids, sorted once a round, gives the ball's content; its radius is inclusive, so
centroids at equal distance are seen and the smaller number wins.

Vectors sit in blocks, the rows of a DataFrame; a round maps the blocks and sums each
centroid's members.  Only centroids and their sums reach the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .vectors import matrix

SCALE = 1024
#: Vectors of a block (a quarter of a megabyte, of 64 components).
BLOCK = 1024
#: Components beyond this could make squared distances overflow 64 bits (of up to 64 components).
MOST = 1 << 27
#: Below this all products are exact in double precision, and distances are matrix products.
_SMALL = 1 << 22
#: Bounds are kept this much apart, relatively, so that rounding never skips a tie.
_SLACK = 1e-9
_STATE = "ids binary, null_ids binary, v binary, cluster binary, upper binary, lower binary"


def distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances [vectors, centroids] of integers."""
    if max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) < _SMALL:
        a, b = v.astype(float), c.astype(float)
        return (np.square(a).sum(axis=1)[:, None] + np.square(b).sum(axis=1)[None, :] - 2 * a @ b.T).astype(np.int64)
    return np.stack([np.square(v - row).sum(axis=1) for row in c], axis=1)


def own_distance(v: np.ndarray, c: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    return np.square(v - c[cluster]).sum(axis=1)


class Neighbours:
    """Distances between centroids: for each the others by distance, and half the way to the nearest."""

    def __init__(self, c: np.ndarray):
        d = np.sqrt(distances(c, c).astype(float))
        self.order = np.argsort(d, axis=1, kind="stable")
        self.sorted = np.take_along_axis(d, self.order, axis=1)
        other = d + np.where(np.eye(len(c), dtype=bool), np.inf, 0)
        self.nearest = other.min(axis=1, initial=np.inf)


def assign(v: np.ndarray, c: np.ndarray, near: Neighbours, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest centroids (ties: the smaller number), new bounds, and how many distances were computed."""
    cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
    free = np.maximum(lower, near.nearest[cluster] / 2) * (1 - _SLACK)
    rest = np.flatnonzero(~(upper * (1 + _SLACK) < free))
    upper[rest] = np.sqrt(own_distance(v[rest], c, cluster[rest]).astype(float))
    computed = len(rest)
    rest = rest[~(upper[rest] * (1 + _SLACK) < free[rest])]
    # Inclusive, and rounded up: what lies on the ball's edge is scanned.
    radius = (2 * upper[rest] + near.nearest[cluster[rest]]) * (1 + _SLACK)
    radius = np.where(np.isfinite(radius), radius, np.inf)
    inside = np.array([np.searchsorted(near.sorted[a], r, side="right") for a, r in zip(cluster[rest], radius)], np.int64)
    # Lists are cut at powers of two, so that few sizes are scanned apart.
    inside = np.minimum(len(c), 1 << np.ceil(np.log2(np.maximum(inside, 1))).astype(np.int64))
    key = cluster[rest] * (len(c) + 1) + inside
    for k in np.unique(key):
        own = rest[key == k]
        seen = np.sort(near.order[k // (len(c) + 1)][: k % (len(c) + 1)])
        d = distances(v[own], c[seen])
        computed += d.size
        at = d.argmin(axis=1)  # the first, so the smallest number
        cluster[own] = seen[at]
        upper[own] = np.sqrt(d[np.arange(len(own)), at].astype(float))
        if len(seen) > 1:
            lower[own] = np.sqrt(np.partition(d, 1, axis=1)[:, 1].astype(float))
        else:
            lower[own] = np.inf
    return cluster, upper, lower, computed


def moved_bounds(old: np.ndarray, new: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds after the centroids moved: up by the own one's way, down by the longest of the others."""
    way = np.sqrt(np.square(new - old).sum(axis=1).astype(float)) * (1 + _SLACK)
    longest = np.argmax(way) if len(way) else 0
    second = np.max(np.delete(way, longest), initial=0.0)
    return upper + way[cluster], lower - np.where(cluster == longest, second, way[longest] if len(way) else 0.0)


def _get(batch: pa.RecordBatch, i: int, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(batch.column(name)[i].as_py(), kind)


def _members(batch: pa.RecordBatch, i: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's vectors and their clusters."""
    return _get(batch, i, "v", np.int32).astype(np.int64).reshape(-1, width), _get(batch, i, "cluster", np.int32).astype(np.int64)


def integer_vectors(vectors: DataFrame, width: int) -> DataFrame:
    """vec_id, v array<long>: rows with exactly `width` finite components, each floor(1024 * x)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = rows.where(F.col("x").isNotNull() & (F.size("x") == width)).where(finite)
    # Far beyond what is accepted, to be refused rather than wrapped.
    bound = float(1 << 40)
    whole = F.transform("x", lambda x: F.floor(F.greatest(F.least(x * float(SCALE), F.lit(bound)), F.lit(-bound))).cast("long"))
    return kept.select("vec_id", whole.alias("v"))


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, seed: int = 3) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector.

    Kept are rows whose vector has exactly `width` components, none null or
    non-finite, as integers floor(1024 * x).  Centroids start as the k kept rows of
    smallest hash of their id (equal hashes: the smaller vector, component by
    component); with fewer rows there are fewer.  Each round assigns every vector
    to the nearest centroid, ties to the smaller number, and moves non-empty
    centroids to the exact floor of their members' mean; then all are assigned
    once more.  Each row counts, repeated ones too; a null id is hashed as the
    empty text.  Further columns are ignored; without kept rows there is no
    result.  A component of 2^27 or more after scaling is a ValueError.
    """
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, width)
    size = F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))
    if (rows.agg(F.max(size).alias("m")).collect()[0]["m"] or 0) >= MOST:
        raise ValueError("components are too large for exact 64-bit distances")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.select(name.alias("h"), "v").orderBy("h", "v").limit(k).collect()  # k rows
    empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], empty)
    c = np.array([r["v"] for r in first], np.int64)
    k = len(c)

    def blocks(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                n = part.num_rows
                ids = part.column("vec_id")
                state = (np.zeros(n, np.int32), np.full(n, np.inf), np.full(n, -np.inf))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.tobytes()], pa.binary()) for x in (ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), matrix(part.column("v"), width, np.int32), *state)],
                    names=["ids", "null_ids", "v", "cluster", "upper", "lower"],
                )

    def step(old: np.ndarray | None, new: np.ndarray):
        """Assign each block's vectors to the new centroids."""

        def run(batches):
            near = Neighbours(new)
            for batch in batches:
                for i in range(batch.num_rows):
                    (v, cluster), upper, lower = _members(batch, i, width), _get(batch, i, "upper", float), _get(batch, i, "lower", float)
                    if old is not None:
                        upper, lower = moved_bounds(old, new, cluster, upper, lower)
                    cluster, upper, lower, _ = assign(v, new, near, cluster, upper, lower)
                    made = [pa.array([x.tobytes()], pa.binary()) for x in (cluster.astype(np.int32), upper, lower)]
                    one = batch.slice(i, 1)
                    yield pa.RecordBatch.from_arrays([*(one.column(x) for x in ("ids", "null_ids", "v")), *made], names=batch.schema.names)

        return run

    def sums(batches):
        """A task's members and sums of each centroid: k * width numbers."""
        total, count = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                v, cluster = _members(batch, i, width)
                np.add.at(total, cluster, v)
                count += np.bincount(cluster, minlength=k)
        own = np.flatnonzero(count)
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * width, pa.int32()), pa.array(total[own].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(count[own]), values], names=["cluster", "n", "total"])

    state, old = cut(rows.mapInArrow(blocks, _STATE)), None
    for _ in range(rounds):
        state = cut(state.mapInArrow(step(old, c), _STATE))
        parts = state.select("cluster", "v").mapInArrow(sums, "cluster int, n long, total array<long>")
        found = parts.select("cluster", "n", F.posexplode("total").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect()  # k * width rows
        old, c = c, c.copy()
        for r in found:
            c[r["cluster"], r["at"]] = r["x"] // r["n"]
    last = c

    def result(batches):
        for batch in step(old, last)(batches):
            v, cluster = _members(batch, 0, width)
            ids, gone = _get(batch, 0, "ids", np.int64), _get(batch, 0, "null_ids", bool)
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=gone), pa.array(cluster.astype(np.int32)), pa.array(own_distance(v, last, cluster))], names=["vec_id", "cluster", "distance"])

    placed = cut(state.mapInArrow(result, "vec_id long, cluster int, distance long"))
    per = {r["cluster"]: int(r["d"]) for r in placed.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows
    digest = [hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest() for row in last]
    about = spark.createDataFrame([(n, d, sum(per.values()), digest[n]) for n, d in per.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
