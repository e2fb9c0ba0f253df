"""K-means in whole numbers, with centroids filtered by an n-simplex projection.

A few pivots span a simplex. A vector's distances to the pivots, measured once
and kept with it, fix the apex it has over that simplex: coordinates in the
pivots' span and an altitude. For two apexes with the same base part ``b`` and
altitudes ``h`` and ``g`` the distance of the vectors lies between

    sqrt(|b1 - b2|^2 + (h - g)^2)   and   sqrt(|b1 - b2|^2 + (h + g)^2).

A centroid whose lower bound exceeds another one's upper bound cannot be the
nearest. The others are compared exactly, in whole numbers, so ties and sums do
not depend on rounding or on the order of rows. Each round reads the kept rows
once and sends one partial sum per centroid and batch of rows; only the totals,
40 times 64 numbers, reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_side, stored

WIDTH = 64
SCALE = 256
CENTROIDS = 40
ROUNDS = 5
PIVOTS = 16
SEED = "2"
#: Vectors from which the pivots are chosen, the first by hash.
PIVOT_SAMPLE = 512
#: Rounding that a pivot may add to the coordinates, as a share of the widest distance; a flatter one is not used.
ROUNDING = 1e-8
#: Largest and smallest 64-bit numbers; larger results are given as these.
LIMIT = (1 << 63) - 1
#: Squared distances below this are exact in doubles.
_EXACT = 1 << 53
#: Vectors that array code handles at once.
BLOCK = 8192


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, width: int, scale: int) -> DataFrame:
    """vec_id and v, floor(scale x) of each component, of the rows with ``width`` finite components."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    fine = v.isNotNull() & (F.size(v) == width) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(fine).select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), F.transform(v, lambda x: F.floor(x * scale).cast("bigint")).alias("v"))


def start_order(seed: str) -> list[Column]:
    """Ascending by hash of the id; rows without an id last, rows with one id by their vectors."""
    return [F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), F.col("v").asc()]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of ``x`` to a point or as many points ``y``; Python's own integers where 64 bits are too few."""
    widest = float(np.abs(x.astype(np.float64)).max(initial=0)) + float(np.abs(y.astype(np.float64)).max(initial=0))
    if widest * widest * x.shape[1] < _EXACT:
        gap = x.astype(np.float64) - y.astype(np.float64)
        return np.einsum("ij,ij->i", gap, gap).astype(np.int64)
    gap = x.astype(object) - y.astype(object)
    return (gap * gap).sum(1)


class Simplex:
    """Pivots that stand well apart, and the projection of others onto them."""

    def __init__(self, sample: np.ndarray, pivots: int):
        points = np.unique(sample, axis=0).astype(np.float64)
        reach = np.linalg.norm(points - points[0], axis=1)
        chosen = [int(reach.argmax())]
        offset = points - points[chosen[0]]
        basis = np.zeros((0, points.shape[1]))
        self.reach, self.errors = max(float(reach.max()), 1.0), []
        while len(chosen) < min(pivots, points.shape[1]):  # the next stands farthest out of the span so far
            out = offset - (offset @ basis.T) @ basis
            height = np.linalg.norm(out, axis=1)
            best = int(height.argmax())
            if height[best] <= 0:
                break
            error = (4 + np.abs(basis @ offset[best]) @ np.array(self.errors)) / height[best]
            if error * self.reach * np.finfo(float).eps > ROUNDING:
                break
            self.errors.append(float(error))
            chosen.append(best)
            basis = np.vstack([basis, out[best] / height[best]])
        self.pivots = points[chosen]
        #: Places of the pivots in the span's own coordinates: lower triangular, the first at zero.
        self.base = (self.pivots - self.pivots[0]) @ basis.T

    def distances(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.stack([np.sqrt(np.square(x - p).sum(1)) for p in self.pivots], 1)

    def apex(self, distance: np.ndarray) -> np.ndarray:
        """Coordinates in the span, then the altitude, from distances to the pivots."""
        first = np.square(distance[:, 0])
        out = np.zeros((len(distance), len(self.base)))
        for k in range(1, len(self.base)):
            point = self.base[k]
            known = out[:, : k - 1] @ point[: k - 1]
            out[:, k - 1] = ((first - np.square(distance[:, k]) + point @ point) / 2 - known) / point[k - 1]
        out[:, -1] = np.sqrt(np.maximum(first - np.square(out[:, :-1]).sum(1), 0))
        return out

    def bounds(self, x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squares of the lower and upper bounds of all distances between two sets of apexes, widened by the rounding."""
        base = np.square(x[:, None, :-1] - c[None, :, :-1]).sum(2)
        far = np.maximum(np.sqrt(np.square(x).sum(1))[:, None], np.sqrt(np.square(c).sum(1))[None]) + self.reach
        margin = np.finfo(float).eps * far * far * (64 + 16 * far * sum(self.errors))
        return base + np.square(x[:, -1:] - c[None, :, -1]) - margin, base + np.square(x[:, -1:] + c[None, :, -1]) + margin


def nearest(x: np.ndarray, apex: np.ndarray, centroids: np.ndarray, c_apex: np.ndarray, simplex: Simplex) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each row (ties to the smaller number), its squared distance, and the exact comparisons made.

    The centroid with the lowest lower bound is compared first; its distance
    then serves as an upper bound too.
    """
    low, high = simplex.bounds(apex, c_apex)
    reached = np.minimum(high.min(1), squared(x, centroids[low.argmin(1)]).astype(np.float64) * (1 + 1e-15) + 1)
    open_pairs = low <= reached[:, None]
    best = np.full(len(x), -1, np.int64)
    least = np.full(len(x), LIMIT, np.int64)
    for j, centroid in enumerate(centroids):
        rows = np.flatnonzero(open_pairs[:, j])
        if len(rows):
            d = squared(x[rows], centroid)
            if d.dtype == object and least.dtype != object:
                least = least.astype(object)
            closer = (d < least[rows]) | (best[rows] < 0)
            best[rows[closer]], least[rows[closer]] = j, d[closer]
    return best, least, int(open_pairs.sum())


def _project(simplex: Simplex, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            apex = simplex.apex(simplex.distances(matrix(rows.column("v"), width)))
            flat = pa.ListArray.from_arrays(np.arange(0, apex.size + 1, apex.shape[1], dtype=np.int32), pa.array(apex.ravel()))
            yield pa.RecordBatch.from_arrays([rows.column("vec_id"), rows.column("v"), flat], names=["vec_id", "v", "apex"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        for start in range(0, rows.num_rows, BLOCK):
            yield rows.slice(start, BLOCK)


def _sums(centroids: np.ndarray, c_apex: np.ndarray, simplex: Simplex):
    """Per batch and centroid: members and, for each component, sums of the upper and lower 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = centroids.shape[1]
        total = np.zeros((len(centroids), 2 * width + 1), np.int64)
        for rows in _blocks(batches):
            x = matrix(rows.column("v"), width)
            best, _, _ = nearest(x, matrix(rows.column("apex"), c_apex.shape[1]), centroids, c_apex, simplex)
            parts = np.hstack([np.ones((len(x), 1), np.int64), x >> 32, x & 0xFFFFFFFF])
            np.add.at(total, best, parts)
        used = np.flatnonzero(total[:, 0])
        flat = pa.ListArray.from_arrays(np.arange(0, len(used) * total.shape[1] + 1, total.shape[1], dtype=np.int32), pa.array(total[used].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), flat], names=["cluster", "sums"])

    return run


def _assign(centroids: np.ndarray, c_apex: np.ndarray, simplex: Simplex):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            best, least, compared = nearest(matrix(rows.column("v"), centroids.shape[1]), matrix(rows.column("apex"), c_apex.shape[1]), centroids, c_apex, simplex)
            shown = least if least.dtype != object else np.array([min(d, LIMIT) for d in least], np.int64)
            count = np.full(len(best), compared / max(len(best), 1))
            yield pa.RecordBatch.from_arrays([rows.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(shown.astype(np.int64)), pa.array(count)], names=["vec_id", "cluster", "distance", "compared"])

    return run


_RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, compared double"


def clusters(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, pivots: int = PIVOTS, seed: str = SEED
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, compared (exact comparisons a vector, on average).

    The first centroids are the ``k`` vectors with the smallest hash of
    ``seed:id`` (all, if fewer); rows that repeat count each, so centroids may be
    alike, of which the smaller number takes all. Rows without an id are
    clustered but start no centroid, unless too few rows have one. Vectors of
    another width, or with null or non-finite components, take no part.
    Components beyond 64 bits count as the nearest 64-bit number, and distances
    and inertias beyond them are given as 2^63 - 1; comparisons stay exact.
    Extra columns are ignored; an empty table gives no rows.
    """
    spark = rows.sparkSession
    whole = whole_vectors(rows, id_col, vector_col, width, scale)
    first = whole.orderBy(*start_order(seed)).limit(max(k, PIVOT_SAMPLE)).collect()
    if not first:
        return spark.createDataFrame([], _RESULT)
    sample = np.array([r["v"] for r in first], np.int64)
    centroids = sample[:k].copy()
    simplex = Simplex(sample, pivots)
    kept = stored(whole.mapInArrow(_project(simplex, width), "vec_id long, v array<long>, apex array<double>"))
    for _ in range(rounds):
        partial = kept.mapInArrow(_sums(centroids, simplex.apex(simplex.distances(centroids)), simplex), "cluster int, sums array<long>")
        each = partial.select("cluster", F.posexplode("sums").alias("at", "value"))
        totals = np.zeros((len(centroids), 2 * width + 1), object)
        for r in each.groupBy("cluster", "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():
            totals[r["cluster"], r["at"]] = int(r["value"])
        for j in np.flatnonzero(totals[:, 0]):
            sums = totals[j, 1 : width + 1] * (1 << 32) + totals[j, width + 1 :]
            centroids[j] = np.array([int(s) // int(totals[j, 0]) for s in sums], np.int64)
    given = stored(kept.mapInArrow(_assign(centroids, simplex.apex(simplex.distances(centroids)), simplex), "vec_id long, cluster int, distance long, compared double"))
    clip = lambda total: F.least(total, F.lit(LIMIT).cast("decimal(38,0)")).cast("bigint")
    inertia = given.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum"))
    per = inertia.collect()
    total = sum(int(r["sum"]) for r in per)
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    table = spark.createDataFrame([(r["cluster"], r["sum"], names[r["cluster"]]) for r in per], "cluster int, sum decimal(38,0), centroid_sha256 string")
    met = given.join(small_side(table, k), "cluster")
    return met.select("vec_id", "cluster", "distance", clip(F.col("sum")).alias("cluster_inertia"), F.lit(min(total, LIMIT)).cast("bigint").alias("inertia"), "centroid_sha256", "compared")
