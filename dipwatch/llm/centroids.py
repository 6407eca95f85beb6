"""Centroid clustering that skips distances by geometric drift tightening.

Lloyd's rounds over integer vectors. Each vector carries its centroid, an upper bound of the distance to it and a lower bound of the
distance to all others. Centroids move between rounds, so the bounds are carried over: the upper one grows by its centroid's drift. The
lower one need not fall by the full drift of the others. All vectors of a cluster lie in a sphere about its old centroid, whose radius is
their greatest upper bound. For another centroid that moves from A to B, d(x, A) - d(x, B) is sought over that sphere; it depends only on
where x lies in the plane of x, A and B. The points where it is at least 2h are within a hyperbola about B, and so within the cone from the
midpoint M of A and B that holds the hyperbola's asymptotes: seen from M, an x at angle t from the direction of the move loses at most
|AB| cos t, and nothing from a right angle on. The sphere is seen from M under angles of arcsin(radius / distance) about its centre, and
the least of them gives the loosening (``loosened``). A vector whose upper bound stays below its lower bound, or below half the distance
from its centroid to the nearest other one, keeps its centroid; the others are scanned exactly.

On Spark: vectors are written once, in buckets by a row number; the state of a round (centroid and bounds, a few numbers a row) is a table
in the same buckets, so reading both side by side moves nothing. Each round is one pass of numpy batches, with one row a task and centroid
for what joined and left it; sums of those, (dimensions + 2) * k numbers, are all that meets on the driver. Centroids are sums of integers
and distances are integers, so results do not depend on tasks, order or rounding: bounds are floating point, but within a margin the
vector is scanned.

Defined results: a vector of another number of components than ``dimensions``, or with a null or non-finite one, is left out; a component
beyond +-2**27 after scaling is held there, as squared distances must fit 64 bits; the first centroids are taken by hash, then id, then
components (a null id last); with fewer vectors than ``k`` there are as many centroids; equal centroids give way to the smaller number and
may stay empty; repeated rows count each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dipwatch.llm.frames import partitions
from dipwatch.session import stage, stage_path

#: Fixed values of op11's contract.
DIMENSIONS = 64
CENTROIDS = 8
ROUNDS = 10
SEED = 3
SCALE = 1024
LIMIT = 1 << 27
_SLACK = 1e-6
_STATE = "row long, cluster int, upper double, lower double, moved array<long>"


def whole_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id, point (array of integers) of the vectors that count."""
    parts = F.col("embedding")
    sound = (F.size(parts) == dimensions) & F.forall(
        parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    held = F.transform(parts, lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(float(-LIMIT))), F.lit(float(LIMIT)))).cast("int"))
    return vectors.filter(sound).select(F.col("vec_id").cast("long").alias("vec_id"), held.alias("point"))


def _bucketed(df: DataFrame, name: str, buckets: int, key: str = "row") -> DataFrame:
    """Write ``df`` in buckets of ``key`` to the shared folder: tables of one key and count are joined without a shuffle."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).sortBy(key).option("path", stage_path(spark, name)).saveAsTable(table)
    return spark.table(table)


def _beside(points: DataFrame, state: DataFrame) -> DataFrame:
    """Each vector with its state; a merge of equal buckets, so a task's rows stay those of one bucket."""
    return points.join(state.filter("cluster >= 0").drop("moved").hint("merge"), "row")


def first_centroids(points: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    named = points.withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    top = named.orderBy(F.asc_nulls_last("hash"), "vec_id", "point").limit(k).select("point").collect()
    return np.array([r["point"] for r in top], np.int64)


def loosened(radius: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """[i, j]: most by which d(x, old j) - d(x, new j) can be above 0 for an x within ``radius[i]`` of old centroid i."""
    drift = np.sqrt(((new - old) ** 2).sum(1).astype(float))
    middle, to = (old + new) / 2.0, (new - old) / np.maximum(drift, 1e-300)[:, None]
    line = old[:, None, :] - middle[None, :, :]
    away = np.sqrt((line ** 2).sum(2))
    along = (line * to[None]).sum(2)
    with np.errstate(divide="ignore", invalid="ignore"):
        angle = np.arccos(np.clip(along / away, -1, 1)) - np.arcsin(np.clip(radius[:, None] / away, 0, 1))
    seen = np.where(radius[:, None] < away, np.cos(np.clip(angle, 0, np.pi / 2)), 1.0)
    return drift[None] * np.minimum(1.0, seen + _SLACK)


class Move:
    """What a round needs to carry bounds over: centroids, the drift of each, the loosening of each cluster, half gaps."""

    def __init__(self, new: np.ndarray, old: np.ndarray | None = None, radius: np.ndarray | None = None):
        k = len(new)
        self.new, self.k = new, k
        gaps = np.sqrt(((new[:, None] - new[None]) ** 2).sum(2).astype(float))
        np.fill_diagonal(gaps, np.inf)
        self.half = gaps.min(1) / 2 if k > 1 else np.full(k, np.inf)
        if old is not None:
            self.drift = np.sqrt(((new - old) ** 2).sum(1).astype(float))
            loss = loosened(radius, old, new)
            np.fill_diagonal(loss, 0)
            self.loss = loss.max(1)


def _distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, a column a centroid."""
    out = np.empty((len(points), len(centroids)), np.int64)
    for j, c in enumerate(centroids):
        d = points - c
        out[:, j] = np.einsum("ij,ij->i", d, d)
    return out


def assigned(points: np.ndarray, move: Move, cluster: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None):
    """(cluster, upper, lower, rows scanned) after a move of the centroids; None for the first round."""
    n = len(points)
    if cluster is None:
        cluster, upper, lower, open_ = np.zeros(n, np.int32), np.zeros(n), np.zeros(n), np.arange(n)
    else:
        upper, lower = upper + move.drift[cluster], np.maximum(0, lower - move.loss[cluster])
        cluster = cluster.copy()
        floor = np.maximum(lower, move.half[cluster])
        open_ = np.flatnonzero(upper * (1 + _SLACK) + _SLACK >= floor * (1 - _SLACK))
        if len(open_):
            # The distance to the own centroid often settles it.
            d = points[open_] - move.new[cluster[open_]]
            upper[open_] = np.sqrt(np.einsum("ij,ij->i", d, d).astype(float))
            open_ = open_[upper[open_] * (1 + _SLACK) + _SLACK >= floor[open_] * (1 - _SLACK)]
    if len(open_):
        d = _distances(points[open_], move.new)
        best = d.argmin(1)  # the first of equals
        cluster[open_] = best
        upper[open_] = np.sqrt(d[np.arange(len(d)), best].astype(float))
        if move.k > 1:
            d[np.arange(len(d)), best] = np.iinfo(np.int64).max
            lower[open_] = np.sqrt(d.min(1).astype(float))
        else:
            lower[open_] = np.inf
    return cluster, upper, lower, len(open_)


def _points(column: pa.ListArray, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dimensions).astype(np.int64)


def _round(batches: Iterator[pa.RecordBatch], move: Move, first: bool, dimensions: int) -> Iterator[pa.RecordBatch]:
    """State rows, and at the end one row a centroid (cluster -1 - j): rows joined less left, their sums, rows scanned."""
    moved, any_row = np.zeros((move.k, dimensions + 2), np.int64), None
    for batch in batches:
        if not batch.num_rows:
            continue
        points, rows = _points(batch.column("point"), dimensions), batch.column("row").to_numpy()
        any_row = int(rows[0])
        before = None if first else batch.column("cluster").to_numpy()
        state = (None, None, None) if first else (before, batch.column("upper").to_numpy(), batch.column("lower").to_numpy())
        cluster, upper, lower, scanned = assigned(points, move, *state)
        moved[0, -1] += scanned
        changed = np.arange(len(points)) if first else np.flatnonzero(cluster != before)
        for j in range(move.k):
            came = changed[cluster[changed] == j]
            moved[j, :-2] += points[came].sum(0)
            moved[j, -2] += len(came)
            if not first:
                left = changed[before[changed] == j]
                moved[j, :-2] -= points[left].sum(0)
                moved[j, -2] -= len(left)
        yield pa.RecordBatch.from_arrays([
            pa.array(rows), pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower),
            pa.nulls(len(rows), pa.list_(pa.int64()))], ["row", "cluster", "upper", "lower", "moved"])
    if any_row is not None:
        # They bear a row number of the task, so that they stay in its bucket.
        yield pa.RecordBatch.from_arrays([
            pa.array([any_row] * move.k, pa.int64()), pa.array([-1 - j for j in range(move.k)], pa.int32()), pa.nulls(move.k, pa.float64()),
            pa.nulls(move.k, pa.float64()), pa.array(moved.tolist(), pa.list_(pa.int64()))], ["row", "cluster", "upper", "lower", "moved"])


def _totals(state: DataFrame, k: int, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """(k x dimensions + 2 numbers summed over tasks, greatest upper bound of each cluster)."""
    summed = F.array(*[F.sum(F.col("moved")[i]) for i in range(dimensions + 2)])
    sums = state.filter("cluster < 0").groupBy("cluster").agg(summed.alias("x"), F.lit(0.0).alias("u"))
    radii = state.filter("cluster >= 0").groupBy("cluster").agg(F.max("upper").alias("u")).select(
        "cluster", F.lit(None).cast("array<long>").alias("x"), "u")
    total, radius = np.zeros((k, dimensions + 2), np.int64), np.zeros(k)
    for r in sums.unionAll(radii).collect():
        if r["cluster"] < 0:
            total[-1 - r["cluster"]] = r["x"]
        else:
            radius[r["cluster"]] = r["u"]
    return total, radius


def _final(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, dimensions: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        d = _points(batch.column("point"), dimensions) - centroids[batch.column("cluster").to_numpy()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("cluster"), pa.array(np.einsum("ij,ij->i", d, d))], ["vec_id", "cluster", "distance"])


def clustered(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS,
              scale: int = SCALE) -> tuple[DataFrame, np.ndarray, list[int]]:
    """(vec_id, cluster, distance of each vector), the centroids and, per pass, the number of vectors that were scanned."""
    spark = vectors.sparkSession
    buckets = partitions(spark)
    points = _bucketed(
        whole_vectors(vectors, dimensions, scale).withColumn("row", F.monotonically_increasing_id()), "points", buckets)
    centroids = first_centroids(points, k, seed)
    k = len(centroids)
    if not k:
        return points.selectExpr("vec_id", "0 AS cluster", "0L AS distance"), centroids, []
    move, total, state, scanned = Move(centroids), np.zeros((k, dimensions + 2), np.int64), None, []
    for step in range(rounds + 1):
        both = points if state is None else _beside(points, state)
        made = both.mapInArrow(partial(_round, move=move, first=state is None, dimensions=dimensions), _STATE)
        state = _bucketed(made, "state", buckets)
        change, radius = _totals(state, k, dimensions)
        scanned.append(int(change[:, -1].sum()))
        total += change
        if step < rounds:
            count = total[:, -2:-1]
            moved = np.where(count > 0, total[:, :-2] // np.maximum(count, 1), centroids)
            move, centroids = Move(moved, centroids, radius), moved
    out = _beside(points, state).mapInArrow(
        partial(_final, centroids=centroids, dimensions=dimensions), "vec_id long, cluster int, distance long")
    return stage(out, "clusters"), centroids, scanned


def op11_centroids(vectors: DataFrame) -> DataFrame:
    found, centroids, _ = clustered(vectors)
    spark = vectors.sparkSession
    inertia = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    names = spark.createDataFrame(
        [(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids.tolist())],
        "cluster int, centroid_sha256 string")
    # The window runs over one row a centroid.
    each = inertia.join(names, "cluster").withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy()))
    return found.join(F.broadcast(each), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
